"""Typed loading of delimited records that sets broken rows apart with their reason.

Each worker writes a batch of records to a file of its own and reads it with DuckDB's CSV
reader and its reject tables, whose line-level errors are joined back to the records.
Records whose quotes don't pair up are read from files of their own, so that an unclosed
quote can't swallow its neighbours.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowFormat:
    """Columns (name, DuckDB type, Spark type) of a record and its checks.

    A check is (reason, SQL predicate over the texts of the columns, null where empty); the
    row fails with the first reason whose predicate is true.  A value that can't be cast to
    the type of its column is null in the typed row unless a check rejects it.
    """

    columns: tuple[tuple[str, str, str], ...]
    checks: tuple[tuple[str, str], ...]


_LETTERS = "[ACGTNacgtn]+"
_PLACE = r"[^\[\],\s]+:[0-9]+"
_MATE = rf"(?:\[{_PLACE}\[|\]{_PLACE}\])"
_ALLELE = rf"(?:{_LETTERS}|\*|\.|<[A-Za-z0-9:_]+>|{_LETTERS}{_MATE}|{_MATE}{_LETTERS})"
VARIANT_ROWS = RowFormat(
    columns=(
        ("chrom", "VARCHAR", "string"),
        ("pos", "INTEGER", "int"),
        ("id", "VARCHAR", "string"),
        ("ref", "VARCHAR", "string"),
        ("alt", "VARCHAR", "string"),
        ("qual", "DOUBLE", "double"),
        ("filter", "VARCHAR", "string"),
        ("svtype", "VARCHAR", "string"),
        ("svlen", "INTEGER", "int"),
        ("end", "BIGINT", "bigint"),
        ("info", "VARCHAR", "string"),
    ),
    checks=(
        ("bad_pos", r"""pos IS NULL OR NOT regexp_full_match(pos, '0*[1-9][0-9]{0,9}') OR try_cast(pos AS BIGINT) > 2147483647"""),
        ("bad_alt", f"NOT regexp_full_match(coalesce(alt, ''), '{_ALLELE}(?:,{_ALLELE})*')"),
        ("bad_svtype", "coalesce(svtype, '') NOT IN ('', '.', 'DEL', 'INS', 'DUP', 'INV', 'CNV', 'BND')"),
    ),
)
#: One field of a well-quoted record, and the whole record.
FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
RECORD = rf"{FIELD}(?:,{FIELD})*"
_ONE_FIELD = re.compile(rf"({FIELD})(?:,|$)", re.S)
#: Records that one call of the reader takes.
BATCH = 10_000


def _requoted(line: str) -> str:
    """A well-quoted record with line feeds outside quotes, written with every field quoted."""
    out, at = [], 0
    while at <= len(line):
        m = _ONE_FIELD.match(line, at)
        f = m.group(1)
        if f or m.end() < len(line) or line.endswith(",") or at == 0:
            out.append(f if f.startswith('"') else f'"{f}"' if f else "")
        if m.end() == len(line) and not m.group(0).endswith(","):
            break
        at = m.end()
        if at == len(line):
            out.append("")
            break
    return ",".join(out)


def _read(con, table: str, files: list[str], names: list[str]) -> list[tuple[str, int, str]]:
    """Read files into ``table``; the errors as (file, line, kind)."""
    columns = {"__at": "INTEGER"} | {n: "VARCHAR" for n in names}
    con.execute(f"DROP TABLE IF EXISTS reject_errors; DROP TABLE IF EXISTS reject_scans; DROP TABLE IF EXISTS {table}")
    con.execute(
        f"""CREATE TABLE {table} AS SELECT * FROM read_csv({files}, header = false, auto_detect = false, delim = ',', quote = '"', escape = '"',
            strict_mode = true, nullstr = '', max_line_size = 50000000, columns = {columns}, store_rejects = true, rejects_limit = 0, parallel = false)"""
    )
    return con.execute("SELECT s.file_path, e.line, e.error_type FROM reject_errors e JOIN reject_scans s USING (scan_id, file_id)").fetchall()


def read_batch(con, lines: pa.Array, fmt: RowFormat) -> pa.Table:
    """``place`` of the line in the batch, ``reason`` and the columns of ``fmt`` of a batch of records.

    The reader and its reject tables decide; an exact check of the quoting rule follows for
    records with quotes, since the reader lets a quote inside an unquoted field pass.
    """
    names = [n for n, *_ in fmt.columns]
    con.register("__lines", pa.table({"place": pa.array(range(len(lines)), pa.int32()), "line": lines}))
    con.execute(
        f"""CREATE OR REPLACE TABLE raw AS SELECT *, quoted AND NOT regexp_full_match(line, '{RECORD}') AS ill,
            regexp_matches(CASE WHEN quoted THEN regexp_replace(line, '"[^"]*"', '', 'g') ELSE line END, '[\\n\\r]') AS broken,
            quoted AND (length(line) - length(replace(line, '"', ''))) % 2 = 1 AS odd
            FROM (SELECT *, contains(line, '"') AS quoted FROM __lines WHERE line <> '')"""
    )
    together = con.execute("SELECT place, line, broken FROM raw WHERE NOT odd AND NOT (broken AND ill) ORDER BY place").fetchall()
    alone = con.execute("SELECT place, line FROM raw WHERE odd OR (broken AND ill)").fetchall()
    folder = tempfile.mkdtemp(prefix="rejects-")
    errors: dict[int, str] = {}
    try:
        path = os.path.join(folder, "together.csv")
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.writelines(f"{i},{_requoted(x) if broken else x}\n" for i, x, broken in together)
        if together:
            for _, line, kind in _read(con, "parsed", [path], names):
                i = together[line - 1][0]
                reason = "column_count" if kind in ("MISSING COLUMNS", "TOO MANY COLUMNS") else "quoting"
                errors[i] = "quoting" if "quoting" in (reason, errors.get(i)) else reason
        else:
            con.execute("CREATE OR REPLACE TABLE parsed AS SELECT 0 AS __at, " + ", ".join(f"''::VARCHAR AS \"{n}\"" for n in names) + " WHERE false")
        if alone:
            files = []
            for i, x in alone:
                files.append(os.path.join(folder, f"{i}.csv"))
                with open(files[-1], "w", encoding="utf-8", newline="") as f:
                    f.write(f"{i},{x}\n")
            for file, _, kind in _read(con, "apart", files, names):
                errors[int(os.path.basename(file)[:-4])] = "column_count" if kind in ("MISSING COLUMNS", "TOO MANY COLUMNS") else "quoting"
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    con.register("__errors", pa.table({"place": pa.array(list(errors), pa.int32()), "reason": pa.array(list(errors.values()), pa.string())}))
    checks = " ".join(f"WHEN {p} THEN '{r}'" for r, p in fmt.checks)
    typed = ", ".join(f'CASE WHEN reason IS NULL THEN try_cast("{n}" AS {t}) END AS "{n}"' for n, t, _ in fmt.columns)
    return con.sql(
        f"""SELECT place, reason, {typed} FROM (
            SELECT l.place, p.*, CASE WHEN coalesce(l.line, '') = '' THEN 'column_count' WHEN r.ill THEN 'quoting' WHEN e.reason IS NOT NULL THEN e.reason
                WHEN p.__at IS NULL THEN 'column_count' {checks} END AS reason
            FROM __lines l LEFT JOIN raw r USING (place) LEFT JOIN __errors e USING (place) LEFT JOIN parsed p ON p.__at = l.place)"""
    ).to_arrow_table()


def parse_rows(df: DataFrame, row_id: str, line: str, fmt: RowFormat = VARIANT_ROWS) -> DataFrame:
    """``row_id``, ``reason`` (null for a valid row) and the typed columns of every record.

    Every input row gives one row, also with a repeated or null id.  A null or empty line
    has the wrong column count.  The typed columns of a failed row are null.  A column of
    ``fmt`` with the name of ``row_id`` comes out as ``<name>_field``.
    """
    kind = dict(df.dtypes)[row_id]
    out_names = [f"{n}_field" if n == row_id else n for n, *_ in fmt.columns]
    schema = f"`{row_id}` {kind}, reason string, " + ", ".join(f"`{o}` {s}" for o, (_, _, s) in zip(out_names, fmt.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for b in batches:
            for lo in range(0, len(b), BATCH):
                part = b.slice(lo, BATCH)
                got = read_batch(con, part.column(1).cast(pa.string()), fmt)
                ids = pc.take(part.column(0), got.column("place"))
                columns = [ids] + [got.column(i + 1).combine_chunks() for i in range(len(names) + 1)]
                yield from pa.table(columns, names=[row_id, "reason", *out_names]).to_batches()

    names = [n for n, *_ in fmt.columns]
    return df.select(F.col(row_id).alias("__id"), F.col(line).alias("__line")).mapInArrow(run, schema)


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows that passed every check."""
    return parsed.where("reason is null").drop("reason")


def rejected_rows(parsed: DataFrame, row_id: str) -> DataFrame:
    """Id and reason of the rows that failed."""
    return parsed.where("reason is not null").select(row_id, "reason")

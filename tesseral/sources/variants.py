"""Variant call text files: scan, decomposition to typed variants, and the way back to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import genomics as gn

#: The columns of the format.
COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of variant text files (also gzipped, many at once), one row per line: split in Catalyst.

    ``pos`` is 1-based as in the file; a dot is null; ``info`` is a map in which a flag has an
    empty value; ``samples`` is an array of the sample columns, ``format`` their keys.
    """
    return parse_lines(spark.read.text(path), "value")


def parse_lines(lines: DataFrame, line: str) -> DataFrame:
    """The same of a table of lines; headers, blank and null lines give no row."""
    parts = F.split(F.col(line), "\t")
    rows = lines.where(F.col(line).isNotNull() & ~F.col(line).startswith("#") & (F.trim(line) != "")).select(parts.alias("p"))
    text = lambda i: F.nullif(F.get("p", F.lit(i)), F.lit("."))
    items = F.filter(F.split(F.coalesce(text(7), F.lit("")), ";"), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(F.element_at(F.split(x, "=", 2), 1).alias("k"), F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit("")).alias("v")))
    first = F.filter(pairs, lambda x: x["k"] != "")
    return rows.select(
        text(0).alias("chrom"), text(1).try_cast("long").alias("pos"), text(2).alias("id"), F.upper(text(3)).alias("ref"), text(4).alias("alt"), text(5).try_cast("double").alias("qual"), text(6).alias("filter"),
        F.map_from_entries(F.array_distinct(first)).alias("info"), text(8).alias("format"), F.when(F.size("p") > 9, F.slice("p", F.lit(10), F.size("p") - 9)).otherwise(F.array().cast("array<string>")).alias("samples"),
    )


def header_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of a file's header line."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return [] if head is None else head[0].split("\t")[9:]


#: Characters that have a meaning in a record, and how they are written in a value.
ESCAPES = (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))


def info(name: str) -> Column:
    """A value of the info map; null without it, also where it is a dot."""
    out = F.nullif(F.try_element_at(F.col("info"), F.lit(name)), F.lit("."))
    for plain, written in reversed(ESCAPES):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return out


def escaped(text: Column) -> Column:
    """A text as a value of a record."""
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def decompose(records: DataFrame, skip_imprecise: bool = True) -> DataFrame:
    """Typed variants of records with ``chrom``, ``pos`` (1-based), ``id``, ``ref``, ``alt`` and ``info``.

    One row per variant: ``vartype`` (SNV, MNV, DEL, INS, REP, INV, DUP, BND, METH, REF),
    ``length``, ``seq`` and ``haplotype``; and one with a ``skip`` reason per allele that is
    none.  A structural type comes from SVTYPE, all else from the alleles.
    """
    alts = F.split(F.coalesce("alt", F.lit("")), ",")
    event = F.nullif(F.trim(info("EVENT")), F.lit(""))
    base = records.withColumns({"svtype": info("SVTYPE"), "end_pos": info("END").try_cast("long"), "svlens": F.split(info("SVLEN"), ","), "imprecise": F.map_contains_key("info", "IMPRECISE"), "haplotype": gn.haplotype_id(event, F.col("id"), info("MATEID")), "n_alts": F.size(alts)})
    one = base.select("*", F.posexplode(alts).alias("allele", "a"))
    ref, a, sv = F.col("ref"), F.upper("a"), F.col("svtype")
    rl, al = F.length("ref"), F.length("a")
    svlen = F.abs(F.get("svlens", F.col("allele")).try_cast("long"))
    anchored_ins = (rl == 1) & (al > 1) & a.startswith(ref)
    anchored_del = (al == 1) & (rl > 1) & ref.startswith(a)
    span = F.col("end_pos") + 1 - F.col("pos")  # END and POS count from 1, both within
    del_len = F.coalesce(F.abs(F.get("svlens", F.lit(0)).try_cast("long")), F.when(F.col("svlens").isNull(), F.col("end_pos") - 1 - F.col("pos")))
    symbolic = a.startswith("<")
    none = F.lit(None)
    reason = (
        F.when(F.col("skip_imprecise") & F.col("imprecise") & sv.isNotNull() & (sv != "BND"), "imprecise")
        .when((sv == "INV") & (F.col("n_alts") != 1), "inversion_invalid_alt")
        .when((sv == "INV") & F.col("end_pos").isNull(), "inversion_missing_end")
        .when((sv == "DUP") & (F.col("n_alts") != 1), "duplication_invalid_alt")
        .when((sv == "DUP") & F.col("end_pos").isNull(), "duplication_missing_end")
        .when((sv == "BND") & F.col("haplotype").isNull(), "breakend_no_event")
        .when((sv == "INS") & (F.col("n_alts") != 1), "several_alts")
        .when((sv == "INS") & ~anchored_ins, "insertion_without_sequence")
        .when((sv == "DEL") & (F.col("n_alts") != 1), "several_alts")
        .when((sv == "DEL") & (F.coalesce(del_len, F.lit(0)) <= 0), "deletion_without_length")
        .when((sv == "DEL") & (a != "<DEL>") & ~anchored_del, "deletion_alleles")
        .when(sv.isNotNull() & ~sv.isin("INV", "DUP", "BND", "INS", "DEL"), "other_svtype")
        .when(sv.isNull() & (a == "<DEL>") & svlen.isNull(), "deletion_without_length")
        .when(sv.isNull() & symbolic & ~a.isin("<*>", "<DEL>", "<METH>"), "other_symbol")
        .when(a == "", "no_allele")
    )
    kind = (
        F.when(sv.isin("INV", "DUP", "BND", "INS", "DEL"), sv)
        .when(a == "<*>", "REF")
        .when(a == "<DEL>", "DEL")
        .when(a == "<METH>", "METH")
        .when((rl == 1) & (al == 1), "SNV")
        .when(rl == al, "MNV")
        .when(anchored_del, "DEL")
        .when(anchored_ins, "INS")
        .otherwise("REP")
    )
    typed = one.withColumn("skip_imprecise", F.lit(skip_imprecise)).withColumn("skip", reason).withColumn("vartype", F.when(F.col("skip").isNull(), kind))
    vt = F.col("vartype")
    length = F.when(vt.isin("INV", "DUP"), span).when((vt == "DEL") & (sv == "DEL"), del_len).when((vt == "DEL") & symbolic, svlen).when(vt == "DEL", rl - al).when(vt == "INS", al - rl).when(vt == "MNV", al)
    seq = F.when(vt == "INS", F.substr(a, rl + 1)).when(vt.isin("SNV", "MNV", "REP", "BND"), F.when(vt == "BND", F.col("a")).otherwise(a)).otherwise(none)
    return typed.select("chrom", "pos", "id", "ref", F.col("a").alias("alt"), "allele", "vartype", length.cast("long").alias("length"), seq.alias("seq"), "haplotype", "skip")


def skip_counts(variants: DataFrame) -> DataFrame:
    """How many alleles were left out, by reason."""
    return variants.where("skip is not null").groupBy("skip").agg(F.count("*").alias("n"))


def to_lines(df: DataFrame, infos: Sequence[str], formats: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Record lines (``value``) of a table with chrom, pos, id, ref and alt, its info columns and per sample the columns of format keys.

    Null values are left out of the info and dots elsewhere; flags are boolean columns.
    """
    types = dict(df.dtypes)
    text = lambda c: F.coalesce(F.translate(F.col(c).cast("string"), "\t\n\r", "   "), F.lit("."))

    def item(c: str) -> Column:
        if types[c] == "boolean":
            return F.when(F.col(c), F.lit(c.upper()))
        if types[c].startswith("array"):
            return F.when(F.size(c) > 0, F.concat(F.lit(c.upper() + "="), F.array_join(F.transform(F.col(c).cast("array<string>"), escaped), ",")))
        return F.concat(F.lit(c.upper() + "="), escaped(F.col(c).cast("string")))

    info_text = F.concat_ws(";", *(item(c) for c in infos))
    parts = [text("chrom"), text("pos"), text("id"), text("ref"), text("alt"), F.lit("."), F.lit("."), F.when(info_text == "", ".").otherwise(info_text)]
    if formats:
        keys = list(next(iter(formats.values())))
        parts.append(F.lit(":".join(keys)))
        parts += [F.concat_ws(":", *(text(cols[k]) for k in keys)) for cols in formats.values()]
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def header(contigs: Sequence[tuple[str, int]], infos: dict[str, tuple[str, str, str]], formats: dict[str, tuple[str, str, str]], samples: Sequence[str]) -> list[str]:
    """Header lines: contigs, info and format fields (number, type, description) and the column line."""
    out = ["##fileformat=VCFv4.3"] + [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    for what, fields in (("INFO", infos), ("FORMAT", formats)):
        out += [f'##{what}=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in fields.items()]
    last = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return [*out, "\t".join(last)]


def write_calls(df: DataFrame, path: str, head: Sequence[str], infos: Sequence[str], formats: dict[str, dict[str, str]] | None = None) -> None:
    """Calls as text files in order of contig and position: a file per range, the header in a file of its own before them."""
    spark = df.sparkSession
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    ordered = df.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    to_lines(ordered, infos, formats).write.mode("overwrite").text(f"{path}/records")

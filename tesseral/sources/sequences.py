"""Sequence and alignment text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Contigs (``contig``, ``seq``) of sequence files; a file is read whole by one task, as contigs have no ends to split at."""
    whole = spark.read.text(path, wholetext=True)
    records = whole.select(F.explode(F.filter(F.split("value", "(?m)^>"), lambda x: F.trim(x) != "")).alias("r"))
    return records.select(F.regexp_extract("r", r"^(\S+)", 1).alias("contig"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text files, one row per line.

    ``pos`` counts from 0; ``tags`` is a map of the optional fields' values as text; ``quals``
    are the base qualities, null where there are none.  Header lines give no row.
    """
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(p.alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    tags = F.transform(F.when(F.size("p") > 11, F.slice("p", F.lit(12), F.size("p") - 11)).otherwise(F.array().cast("array<string>")), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.regexp_replace(x, "^..:.:", "").alias("v")))
    quals = F.when(at(10) != "*", F.transform(F.split(at(10), ""), lambda c: F.ascii(c) - 33))
    return rows.select(
        at(0).alias("name"), at(1).cast("int").alias("flag"), F.nullif(at(2), F.lit("*")).alias("contig"), (at(3).cast("long") - 1).alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"),
        F.nullif(at(6), F.lit("*")).alias("mate_contig"), (at(7).cast("long") - 1).alias("mate_pos"), at(8).cast("int").alias("tlen"), F.nullif(at(9), F.lit("*")).alias("seq"), quals.alias("quals"), F.map_from_entries(tags).alias("tags"),
    )

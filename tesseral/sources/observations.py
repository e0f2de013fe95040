"""Tables of observations, properties of alignments, plain sinks and plots."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the columns that ``write_observations`` writes.
FORMAT_VERSION = "1"


def write_observations(df: DataFrame, path: str, options: Mapping[str, object], sample: str = "sample") -> None:
    """Observations as Parquet, by sample, with the format's version and the options they were made with beside them."""
    df.write.mode("overwrite").partitionBy(sample).parquet(f"{path}/observations")
    spark = df.sparkSession
    spark.createDataFrame([(FORMAT_VERSION, json.dumps(dict(options), sort_keys=True))], "version string, options string").coalesce(1).write.mode("overwrite").json(f"{path}/lineage")


def read_lineage(spark: SparkSession, path: str) -> dict:
    """Options that observations were made with; another version of the format is an error."""
    row = spark.read.schema("version string, options string").json(f"{path}/lineage").first()
    if row is None or row["version"] != FORMAT_VERSION:
        raise ValueError(f"observations of format {row['version'] if row else None}, not {FORMAT_VERSION}")
    return json.loads(row["options"])


def read_observations(spark: SparkSession, paths: Mapping[str, str], samples: Sequence[str]) -> DataFrame:
    """Observations of the samples of a scenario, each from a path of its own.

    A sample may be left out: it has no observations.  A path of an unknown sample is an
    error, as is another version of the format.
    """
    unknown = sorted(set(paths) - set(samples))
    if unknown:
        raise ValueError(f"observations of samples {unknown} that the scenario doesn't have")
    if not paths:
        raise ValueError("observations of at least one sample are needed")
    out = None
    for name in sorted(paths):
        read_lineage(spark, paths[name])
        one = spark.read.parquet(f"{paths[name]}/observations").drop("sample").withColumn("sample", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_delimited(df: DataFrame, path: str, tab: bool = True) -> None:
    """A table as delimited text with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if tab else ",").csv(path)


#: Properties of alignments and what they are where a file doesn't say.
PROPERTIES: dict[str, object] = {
    "insert_size": None, "max_del_cigar_len": None, "max_ins_cigar_len": None, "frac_max_softclip": None, "max_read_len": 0, "max_mapq": 60,
    "gap_params": {"prob_insertion_artifact": 2.8e-6, "prob_deletion_artifact": 5.1e-6, "prob_insertion_extend_artifact": 0.0, "prob_deletion_extend_artifact": 0.0}, "wildtype_homopolymer_error_model": {},
}


def load_properties(text: str) -> dict:
    """Alignment properties from JSON text, with defaults; insert sizes need a positive deviation."""
    got = PROPERTIES | json.loads(text)
    size = got["insert_size"]
    if size is not None and not size["sd"] > 0:
        raise ValueError("the deviation of insert sizes must be above zero")
    return got


def plot(rows: Sequence[Mapping[str, object]], mark: str, x: str, y: str, color: str | None = None, title: str = "") -> str:
    """A Vega-Lite plot of some rows as JSON text."""
    encoding = {"x": {"field": x, "type": "quantitative"}, "y": {"field": y, "type": "quantitative"}} | ({"color": {"field": color, "type": "nominal"}} if color else {})
    return json.dumps({"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": title, "data": {"values": list(rows)}, "mark": mark, "encoding": encoding}, sort_keys=True)


def plot_table(df: DataFrame, path: str, mark: str, x: str, y: str, color: str | None = None, most: int = 100_000) -> None:
    """A plot of an aggregated table, written to a local file; a table of more than ``most`` rows is an error."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a plot of more than {most} rows: aggregate first")
    Path(path).write_text(plot(rows, mark, x, y, color))

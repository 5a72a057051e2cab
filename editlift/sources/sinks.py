"""Sinks: ndjson, csv and output split by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.functions.labels import known_label
from editlift.operators.backlog import nest_catalogue


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    """Lines of JSON; an existing output is refused unless the mode says otherwise."""
    df.write.mode(mode).json(path, compression=compression)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_by_label(
    df: DataFrame,
    path: str,
    label: str = "wp10",
    mode: str = "append",
    fmt: str = "json",
    strict: bool = True,
    compact: bool = False,
) -> None:
    """One folder per class. Tasks write what they hold, so nothing is shuffled
    and a large class is spread over many files. ``strict`` fails the job on an
    unknown class. ``compact`` rebalances first, for fewer and even files: one
    shuffle, in which a large class is split into partitions of even size.

    ``mode="replace"`` rewrites the folders of the classes present in ``df`` and
    leaves the other classes' folders as they are (dynamic partition overwrite);
    ``overwrite`` replaces the whole output, ``append`` adds files."""
    out = df.withColumn(label, known_label(F.col(label))) if strict else df
    out = out.hint("rebalance", label) if compact else out
    if mode == "replace":
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(label)
    else:
        writer = out.write.mode(mode).partitionBy(label)
    if fmt == "json":
        writer = writer.option("compression", "gzip")
    writer.format(fmt).save(path)


def write_catalogue(catalogue: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Catalogue rows as lines of nested JSON, one line per section and category."""
    nested = nest_catalogue(catalogue).select(
        F.to_json(F.create_map("section", F.create_map("category", "templates"))).alias("value")
    )
    nested.write.mode(mode).text(path)

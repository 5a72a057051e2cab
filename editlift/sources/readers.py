"""Scans: ndjson, csv and catalogue files with a declared schema.

Malformed input raises when it is read; no row of nulls stands for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlift.functions.labels import label_code
from editlift.operators.backlog import CATALOGUE_SCHEMA
from editlift.session import spread
from editlift.sources import schemas


def read_ndjson(spark: SparkSession, path: str | list[str], schema: str = schemas.REVISION) -> DataFrame:
    """Lines of JSON, plain or gzip. A gzip file is one split, so few of them are spread."""
    return spread(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


#: Column of a tolerant read that holds a malformed line as it was.
CORRUPT = "_corrupt_record"


def read_ndjson_tolerant(spark: SparkSession, path: str | list[str], schema: str = schemas.REVISION) -> DataFrame:
    """Lines of JSON where a malformed line is a row with ``_corrupt_record`` set and the other
    columns null; well-formed lines have it null. Split the two with ``split_corrupt``."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return spread(reader.json(path))


def split_corrupt(rows: DataFrame, observation) -> tuple[DataFrame, DataFrame]:
    """(good rows without the column, malformed rows with the line as ``line``). ``observation`` (a
    ``pyspark.sql.Observation``) counts ``rows`` and ``corrupt`` in the pass that reads the good rows.

    Spark refuses a scan that reads the corrupt column alone, so the malformed rows keep the
    other (null) columns beside ``line``."""
    counted = rows.observe(observation, F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("corrupt"))
    good = counted.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = rows.where(F.col(CORRUPT).isNotNull()).withColumnRenamed(CORRUPT, "line")
    return good, bad


def read_labeled_one(spark: SparkSession, path: str) -> DataFrame:
    """One featurized file without its text columns; they are left out of the schema."""
    return read_ndjson(spark, path, schemas.FEATURIZED)


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """A folder of featurized files as one frame, with the class code.

    Reads what ``write_by_label`` writes: the class is the partition folder.
    """
    return read_labeled_one(spark, path).withColumn("code", label_code(F.col("wp10")))


def read_featurized_csv(spark: SparkSession, path: str, schema: str = schemas.FEATURIZED) -> DataFrame:
    """Featurized revisions from csv with a header; ``revid`` stays a column."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return rows.withColumn("code", label_code(F.col("wp10")))


def read_class_counts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(class, articles) from csv; lines that start with # are comments."""
    reader = spark.read.schema(schemas.CLASS_COUNTS).option("comment", "#").option("header", header).option("mode", "FAILFAST")
    return reader.csv(path)


def read_catalogue(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """The nested maintenance catalogue as a map column ``value``: one per file, or per line."""
    text = spark.read.text(path, wholetext=whole_file)
    return text.select(F.from_json("value", CATALOGUE_SCHEMA, {"mode": "FAILFAST"}).alias("value"))


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column missing in one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

"""How many articles each class has, and what share that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editlift.functions.labels import CLASSES, label_code


def class_frequency(df: DataFrame, label: str = "wp10") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("articles"))


def keep_classes(df: DataFrame, label: str = "wp10", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Rows of the listed classes, best class first."""
    return df.where(F.col(label).isin(*classes)).orderBy(label_code(F.col(label)).desc())


def class_share(counts: DataFrame, label: str = "wp10", articles: str = "articles") -> DataFrame:
    """Adds pct, the share in percent. ``counts`` has one row per class."""
    total = F.sum(articles).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.col(articles).cast("double") * 100 / total)


def share_between(counts: DataFrame, low: str, high: str, label: str = "wp10") -> DataFrame:
    """One row: percent of all articles from class ``low`` up to class ``high``."""
    code = label_code(F.col(label))
    shares = class_share(counts, label)
    first, last = sorted((CLASSES.index(low), CLASSES.index(high)))
    return shares.where(code.between(first, last)).agg(F.sum("pct").alias("pct"))

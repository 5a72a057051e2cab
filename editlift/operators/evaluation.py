"""Evaluation of predictions over six ordered classes.

Everything follows from the confusion counts: one aggregation with map-side
combine leaves 36 rows at most, and all metrics are taken from those.
``df`` has integer columns actual and pred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlift.functions.labels import CLASSES
from editlift.functions.probability import log_loss_term

K = len(CLASSES)


def confusion_counts(df: DataFrame) -> DataFrame:
    """(actual, pred, n) of the pairs that occur; a pair with a null or unknown code counts nowhere."""
    known = F.col("actual").between(0, K - 1) & F.col("pred").between(0, K - 1)
    return df.where(known).groupBy("actual", "pred").agg(F.count("*").alias("n"))


def unknown_pairs(df: DataFrame) -> DataFrame:
    """One row: how many pairs the metrics leave out for a null or unknown code."""
    known = F.col("actual").between(0, K - 1) & F.col("pred").between(0, K - 1)
    return df.agg(F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))


def class_grid(counts: DataFrame) -> DataFrame:
    """The counts on the full grid of classes, zero where a pair never occurs."""
    codes = F.array(*[F.lit(k) for k in range(K)])
    grid = (
        counts.sparkSession.range(1, numPartitions=1)
        .select(F.explode(codes).alias("actual"))
        .select("actual", F.explode(codes).alias("pred"))
    )
    return grid.join(counts, ["actual", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion(df: DataFrame) -> DataFrame:
    """(actual, pred, n, p, p_actual): counts, share of all, share of the actual class."""
    grid = class_grid(confusion_counts(df))
    everything = Window.partitionBy(F.lit(0))
    actual = Window.partitionBy("actual")
    n = F.col("n").cast("double")
    return grid.select(
        "actual",
        "pred",
        "n",
        (n / F.sum("n").over(everything)).alias("p"),
        (n / F.nullif(F.sum("n").over(actual), F.lit(0))).alias("p_actual"),
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    """One row per actual class, one column p0..p5 per predicted class; missing cells 0."""
    cells = confusion(df)
    return (
        cells.groupBy("actual")
        .pivot("pred", list(range(K)))
        .agg(F.first("p_actual"))
        .select("actual", *[F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(f"p{k}") for k in range(K)])
    )


def exact_hit(actual: Column, pred: Column) -> Column:
    """Share of the one-hot cells that agree: all, or all but two."""
    return F.when(actual == pred, 1.0).otherwise(1.0 - 2.0 / K)


def ordinal_hit(actual: Column, pred: Column) -> Column:
    """Share of the columns 1..K-1 of the cumulated one-hot rows that agree."""
    missed = F.abs(pred - actual) - F.when((F.least(pred, actual) == 0) & (pred != actual), 1).otherwise(0)
    return F.lit(1.0) - missed / F.lit(float(K - 1))


def _weighted(value: Column, where: Column | None = None) -> Column:
    n = F.col("n") if where is None else F.when(where, F.col("n"))
    return F.sum(value * n) / F.sum(n)


def hit_rates(df: DataFrame) -> DataFrame:
    """One row: exact hit rate over one-hot cells, ordinal hit rate, ordinal score."""
    y, p = F.col("actual"), F.col("pred")
    return confusion_counts(df).agg(
        _weighted(exact_hit(y, p)).alias("exact_hit"),
        _weighted(ordinal_hit(y, p)).alias("ordinal_hit"),
        (F.lit(1.0) - _weighted(F.abs(p - y) / F.lit(float(K - 1)))).alias("ordinal_score"),
    )


def ordinal_score(df: DataFrame) -> DataFrame:
    """One row: 1 - mean(|pred - actual|) / (K - 1)."""
    return hit_rates(df).select("ordinal_score")


def _per_class(counts: DataFrame, by: str, exact: str, ordinal: str) -> DataFrame:
    y, p = F.col("actual"), F.col("pred")
    return counts.groupBy(F.col(by).alias("class_code")).agg(
        _weighted(F.when(y == p, 1.0).otherwise(0.0)).alias(exact),
        _weighted(ordinal_hit(y, p)).alias(ordinal),
        F.sum("n").alias(f"n_{by}"),
    )


def recall(df: DataFrame) -> DataFrame:
    """(class_code, recall_exact, recall, n_actual) per actual class."""
    return _per_class(confusion_counts(df), "actual", "recall_exact", "recall")


def precision(df: DataFrame) -> DataFrame:
    """(class_code, precision_exact, precision, n_pred) per predicted class."""
    return _per_class(confusion_counts(df), "pred", "precision_exact", "precision")


def class_report(df: DataFrame) -> DataFrame:
    """One row per class: n, precision and recall, ordinal and exact.

    A class that is never predicted, or never occurs, has null there.
    """
    by_pair = class_grid(confusion_counts(df))
    y, p, n = F.col("actual"), F.col("pred"), F.col("n")
    codes = by_pair.select("actual", "pred", "n", F.explode(F.array_distinct(F.array("actual", "pred"))).alias("class_code"))
    mine, theirs = y == F.col("class_code"), p == F.col("class_code")

    def share(value: Column, side: Column) -> Column:
        return F.sum(F.when(side, value * n)) / F.nullif(F.sum(F.when(side, n)), F.lit(0))

    hit = F.when(y == p, 1.0).otherwise(0.0)
    return codes.groupBy("class_code").agg(
        F.sum(F.when(mine, n)).alias("n"),
        share(ordinal_hit(y, p), theirs).alias("precision"),
        share(hit, theirs).alias("precision_exact"),
        share(ordinal_hit(y, p), mine).alias("recall"),
        share(hit, mine).alias("recall_exact"),
    )


def macro_scores(df: DataFrame) -> DataFrame:
    """One row: macro means and F1, exact over all classes, ordinal without class 0."""
    above = F.col("class_code") > 0
    means = class_report(df).agg(
        F.avg("precision_exact").alias("precision_exact"),
        F.avg("recall_exact").alias("recall_exact"),
        F.avg(F.when(above, F.col("precision"))).alias("precision"),
        F.avg(F.when(above, F.col("recall"))).alias("recall"),
    )

    def f1(p: str, r: str) -> Column:
        return F.lit(2.0) * F.col(p) * F.col(r) / (F.col(p) + F.col(r))

    return means.withColumn("f1_exact", f1("precision_exact", "recall_exact")).withColumn(
        "f1", f1("precision", "recall")
    )


def log_loss(df: DataFrame, prob: str = "prob", code: str = "actual") -> DataFrame:
    """One row: mean of -log of the probability of the true class."""
    return df.agg(F.avg(log_loss_term(F.col(prob), F.col(code))).alias("log_loss"))

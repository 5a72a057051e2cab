"""Global numbering without a global sort: rows ranked by a 64-bit id.

An id is cut into three digits. Ids are counted per leading digits, and each
level of counts is summed up within the level above, so no window holds more
than 2^22 narrow rows, whatever the ids look like. Where the ids lie close
together the last digit is made shorter, by their smallest and largest, so that
they still fill many windows. The result does not depend on the digits or the
partitioning, so a task that runs again gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 22
#: Windows that ids in a short range are dealt over: between this power of two and half of it.
WINDOWS = 10


def last_digit(smallest: int | None, largest: int | None) -> int:
    """Bits of the last digit for ids in a range."""
    if smallest is None or largest is None:
        return DIGIT
    return min(DIGIT, max(0, (largest - smallest).bit_length() - WINDOWS))


def global_rank(df: DataFrame, id_col: str, out: str = "rank") -> DataFrame:
    """Distinct ids with their rank from 0 in ascending order."""
    ids = df.select(F.col(id_col).cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    bounds = df.agg(F.min(F.col(id_col).cast("long")).alias("low"), F.max(F.col(id_col).cast("long")).alias("high")).first()
    cut = ids.select(
        "_id", F.shiftright("_id", last_digit(bounds["low"], bounds["high"])).alias("_mid"), F.shiftright("_id", 2 * DIGIT).alias("_top")
    ).repartition("_top", "_mid")

    per_mid = cut.groupBy("_top", "_mid").agg(F.count("*").alias("_n"))
    per_top = per_mid.groupBy("_top").agg(F.sum("_n").alias("_n"))
    earlier = (Window.unboundedPreceding, -1)
    # At most 2^20 rows, one per leading digit.
    tops = per_top.select(
        "_top",
        F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_top").rowsBetween(*earlier)), F.lit(0)).alias("_t"),
    )
    in_top = Window.partitionBy("_top").orderBy("_mid").rowsBetween(*earlier)
    mids = per_mid.withColumn("_m", F.coalesce(F.sum("_n").over(in_top), F.lit(0)))
    starts = mids.join(tops, "_top").select("_top", "_mid", (F.col("_m") + F.col("_t")).alias("_start"))

    local = Window.partitionBy("_top", "_mid").orderBy("_id")
    ranked = cut.withColumn("_row", F.row_number().over(local) - 1).join(starts, ["_top", "_mid"])
    return ranked.select(F.col("_id").alias(id_col), (F.col("_start") + F.col("_row")).alias(out))


def id_batches(df: DataFrame, id_col: str, size: int = 50, separator: str = "|") -> DataFrame:
    """(batch, n, ids): ids in ascending order, ``size`` per batch, joined by a separator."""
    ranked = global_rank(df, id_col).withColumn("batch", F.floor(F.col("rank") / size).cast("long"))
    return ranked.groupBy("batch").agg(
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_list(id_col)).cast("array<string>"), separator).alias("ids"),
    )

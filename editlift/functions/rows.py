"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, *keep: str, array: str | Column, value: str, pos: str = "pos") -> DataFrame:
    """One row per array element, with its position from 0.

    The outer form with a test of the position gives the rows of the inner
    form. It keeps the optimizer from adding a size test below the explode,
    which would evaluate the array, often a regular expression, a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def left_join_many(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join for a right side where one key may hold a large share of the rows.

    Rows with a match come from an inner join, whose skewed partitions can be
    split on either side; a left join could not split its right side. The rest
    comes from an anti join against the distinct keys.
    """
    matched = left.join(right, on)
    unmatched = left.join(right.select(on).distinct(), on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)

"""Dump and page records, flattened to one row per revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.functions.rows import unnest
from editlift.session import broadcast_if_small

PAGE_FIELDS = ("id", "title", "namespace", "redirect")
USER_FIELDS = ("id", "text")


def flatten_revisions(dump: DataFrame) -> DataFrame:
    """Nested dump revisions as flat rows: page_*, deleted_*, user_* columns.

    A missing struct gives nulls; a missing comment gives an empty string.
    """
    nested = {"id", "page", "user", "deleted", "comment"}
    deleted = dump.schema["deleted"].dataType.fieldNames()
    return dump.select(
        F.col("id").alias("rev_id"),
        *[F.col(f"page.{f}").alias(f"page_{f}") for f in PAGE_FIELDS],
        *[F.col(f"deleted.{f}").alias(f"deleted_{f}") for f in deleted],
        *[F.col(f"user.{f}").alias(f"user_{f}") for f in USER_FIELDS],
        F.coalesce("comment", F.lit("")).alias("comment"),
        F.col("page.redirect").isNotNull().alias("is_redirect"),
        *[c for c in dump.columns if c not in nested],
    )


def first_pages(df: DataFrame, max_pages: int | None = None, page: str = "page_id") -> DataFrame:
    """Revisions of the first pages by page id; all of them without a maximum."""
    if max_pages is None:
        return df
    pages = df.select(page).distinct().orderBy(page).limit(max_pages)
    return df.join(pages, page, "left_semi")


def page_revisions(pages: DataFrame) -> DataFrame:
    """One row per revision of a page record, with its main text and page columns.

    Revisions whose text was removed are dropped.
    """
    rows = unnest(pages, "pageid", "ns", "title", array="revisions", value="_r")
    return rows.select(
        "_r.*", "pageid", "ns", "title"
    ).withColumn("wikitext", F.col("slots")["main"]["*"]).where(F.col("wikitext").isNotNull()).drop("slots")


def attach_labels(revisions: DataFrame, labels: DataFrame, rev: str = "revid", label_seq: str = "seq") -> DataFrame:
    """Inner join with the label of each revision id; the last label of an id wins.

    Few labels are broadcast, so that the text of the revisions is not shuffled.
    """
    last = broadcast_if_small(labels.groupBy("rev_id").agg(F.max_by("wp10", label_seq).alias("wp10")))
    plain = revisions.drop("wp10")
    if rev == "rev_id":
        return plain.join(last, "rev_id")
    return plain.join(last.withColumnRenamed("rev_id", rev), rev)

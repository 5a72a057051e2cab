"""Pages by title: redirects, newest revision, missing titles, talk pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.functions.titles import is_blank, talk_title
from editlift.session import broadcast_if_small, reliable_checkpoint


def follow_redirects(df: DataFrame, redirects: DataFrame, title: str = "title", out: str = "title") -> DataFrame:
    """Replace a title by the target of its redirect, one hop."""
    hop = redirects.groupBy(F.col("from_title").alias("_from")).agg(F.max("to_title").alias("_to"))
    joined = df.join(hop, F.col(title) == F.col("_from"), "left")
    return joined.withColumn(out, F.coalesce("_to", F.col(title))).drop("_from", "_to")


def redirect_closure(redirects: DataFrame) -> DataFrame:
    """(from_title, to_title) with chains followed to their end; cycles left out.

    Each round joins the table with itself, which doubles the length followed,
    so a chain of n hops takes log2(n) rounds. Titles that still point at a
    redirect when a round settles none are in, or lead into, a cycle: they
    keep their own name, so they have no row here.
    """
    current = redirects.groupBy("from_title").agg(F.max("to_title").alias("to_title"))
    open_before = None
    while True:
        step = current.select(F.col("from_title").alias("_from"), F.col("to_title").alias("_to"))
        doubled = current.join(step, F.col("to_title") == F.col("_from"), "left").select(
            "from_title", F.coalesce("_to", "to_title").alias("to_title")
        )
        starts = current.select(F.col("from_title").alias("_from"))
        state = reliable_checkpoint(
            doubled.join(starts, F.col("to_title") == F.col("_from"), "left").select(
                "from_title", "to_title", F.col("_from").isNotNull().alias("open")
            )
        )
        still_open = state.where("open").count()
        if still_open == 0 or still_open == open_before:
            return state.where(~F.col("open")).select("from_title", "to_title")
        open_before = still_open
        current = state.select("from_title", "to_title")


def newest_ids(pages: DataFrame, title: str = "title", timestamp: str = "timestamp", rev: str = "revid") -> DataFrame:
    """Id of the newest revision of every title, by time, then by id.

    Only the narrow columns are read and shuffled, one row per title and task.
    """
    newest = F.max(F.struct(timestamp, rev)).alias("_newest")
    return pages.groupBy(title).agg(newest).select(F.col("_newest")[rev].alias(rev))


def newest_revision(pages: DataFrame, title: str = "title", timestamp: str = "timestamp", rev: str = "revid") -> DataFrame:
    """The newest revision of every title; the text does not pass through the aggregation."""
    return pages.join(newest_ids(pages, title, timestamp, rev), rev, "left_semi")


def asked_titles(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """(request_id, asked, title): requests with a title, redirects followed."""
    named = requests.where(~is_blank(F.col("title"))).select("request_id", F.col("title").alias("asked"))
    return follow_redirects(named, redirects, title="asked", out="title")


def requested_pages(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """The newest revision of every requested title, once each.

    Few titles and ids are broadcast, so that the text of the pages is not shuffled.
    """
    titles = broadcast_if_small(asked.select("title").distinct())
    wanted = pages.select("title", "timestamp", "revid").join(titles, "title", "left_semi")
    return pages.join(broadcast_if_small(newest_ids(wanted)), "revid", "left_semi")


def lookup_pages(requests: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Requests with the newest revision of their page, redirects followed.

    ``found`` is false where no such page exists. Blank and null titles are
    dropped. ``requests`` has request_id and title; ``pages`` has revid, pageid,
    title, timestamp, content.
    """
    asked = asked_titles(requests, redirects)
    return (
        asked.join(requested_pages(asked, pages), "title", "left")
        .withColumn("found", F.col("revid").isNotNull())
        .withColumn("talk_page", F.when(F.col("found"), talk_title(F.col("title"))))
    )


def not_found(requests: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Requests, blank ones aside, that no page answers."""
    asked = asked_titles(requests, redirects)
    return asked.join(pages.select("title"), "title", "left_anti").select("request_id", "asked", "title")


def with_talk_page(pages: DataFrame, talk_pages: DataFrame, title: str = "title") -> DataFrame:
    """Pages joined with their talk page; ``talk_pages`` has talk_title and more."""
    return pages.withColumn("talk_title", talk_title(F.col(title))).join(talk_pages, "talk_title", "left")

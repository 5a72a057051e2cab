"""Template, link and category usage: counts per revision and inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.functions import markup as M
from editlift.functions.rows import left_join_many, unnest
from editlift.functions.titles import strip
from editlift.session import broadcast_if_small


def _names(df: DataFrame, text_col: str, key: str, finder) -> DataFrame:
    cleaned = df.select(key, M.clean(F.col(text_col)).alias("_clean"))
    return unnest(cleaned.select(key, finder(F.col("_clean")).alias("_all")), key, array="_all", value="_name")


def template_counts(df: DataFrame, text_col: str = "wikitext", key: str = "rev_id") -> DataFrame:
    """(key, name, n): uses of each template; name trimmed, case kept."""
    return (
        _names(df, text_col, key, M.template_names)
        .groupBy(key, strip(F.col("_name")).alias("name"))
        .agg(F.count("*").alias("n"))
    )


def link_counts(df: DataFrame, text_col: str = "wikitext", key: str = "rev_id") -> DataFrame:
    """(key, name, n): uses of each link target, trimmed."""
    return (
        _names(df, text_col, key, M.link_titles)
        .groupBy(key, strip(F.col("_name")).alias("name"))
        .agg(F.count("*").alias("n"))
    )


def image_links(df: DataFrame, text_col: str = "wikitext", key: str = "rev_id") -> DataFrame:
    """(key, pos, title) of links to files, images and media."""
    rows = _names(df, text_col, key, M.link_titles)
    return rows.where(F.col("_name").rlike("(?i)^(?:File|Image|Media):")).select(
        key, "pos", F.col("_name").alias("title")
    )


def category_links(df: DataFrame, text_col: str = "wikitext", key: str = "rev_id") -> DataFrame:
    """(key, pos, title) of category links."""
    rows = _names(df, text_col, key, M.link_titles)
    return rows.where(F.col("_name").rlike("(?i)^Category:")).select(key, "pos", F.col("_name").alias("title"))


def template_index(df: DataFrame, aliases: DataFrame, text_col: str = "wikitext", key: str = "page_id") -> DataFrame:
    """Distinct (template, key): which pages embed which template.

    ``aliases`` has alias, template; names compare trimmed and in lower case. A
    name without an alias stands for itself. Repeats are dropped in the row,
    and again within each task before the one shuffle.
    """
    cleaned = df.select(key, M.clean(F.col(text_col)).alias("_clean"))
    names = F.array_distinct(F.transform(M.template_names(F.col("_clean")), M.catalogue_key))
    used = unnest(cleaned.select(key, names.alias("_all")), key, array="_all", value="_used").select(key, "_used")
    lookup = aliases.groupBy(M.catalogue_key(F.col("alias")).alias("_used")).agg(
        F.min(M.catalogue_key(F.col("template"))).alias("_target")
    )
    return (
        used.join(broadcast_if_small(lookup), "_used", "left")
        .select(F.coalesce("_target", "_used").alias("template"), key)
        .distinct()
    )


def pages_embedding(index: DataFrame, template: str, key: str = "page_id") -> DataFrame:
    """Keys of the pages that embed one template."""
    return index.where(F.col("template") == template.strip().lower()).select(key)


def category_members(
    df: DataFrame, redirects: DataFrame, text_col: str = "wikitext", key: str = "page_id", title: str = "title"
) -> DataFrame:
    """(category, key, title, alias): pages of a category, with the redirects to each.

    One row per redirect, null where there is none, so that neither a large
    category nor a title with many redirects is gathered in one place.
    """
    cleaned = df.select(key, title, M.clean(F.col(text_col)).alias("_clean"))
    links = unnest(
        cleaned.select(key, title, M.link_titles(F.col("_clean")).alias("_all")),
        key, title, array="_all", value="_name",
    ).where(F.col("_name").rlike("(?i)^Category:"))
    members = links.select(
        strip(F.regexp_replace("_name", "(?i)^Category:", "")).alias("category"), key, title
    ).distinct()
    aliases = redirects.select(F.col("from_title").alias("alias"), F.col("to_title").alias(title)).distinct()
    return left_join_many(members, aliases, title).select("category", key, title, "alias")

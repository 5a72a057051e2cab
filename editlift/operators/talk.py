"""Quality as assessed on talk pages: by category and by project banner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.functions import banners as B


def quality_by_category(categories: DataFrame, key: str = "page_id", category: str = "category") -> DataFrame:
    """(key, quality): the best class among a page's categories, null for none."""
    return (
        categories.groupBy(key)
        .agg(F.min(B.category_priority(F.col(category))).alias("_best"))
        .select(key, B.category_class(F.col("_best")).alias("quality"))
    )


def parse_banners(talk: DataFrame, key: str = "page_id", banner: str = "banner", seq: str = "seq") -> DataFrame:
    """(key, seq, name, class, importance) of the project banners."""
    is_project = F.contains(F.col(banner), F.lit("WikiProject"))
    return talk.where(is_project).select(
        key,
        seq,
        B.banner_name(F.col(banner)).alias("name"),
        B.clean_class(B.parameter(F.col(banner), "class")).alias("class"),
        B.clean_importance(B.parameter(F.col(banner), "importance")).alias("importance"),
    )


def project_map(talk: DataFrame, key: str = "page_id", banner: str = "banner", seq: str = "seq") -> DataFrame:
    """(key, name, class, importance): each project once, its last banner wins."""
    last = F.max_by(F.struct("class", "importance"), F.col(seq)).alias("_last")
    return (
        parse_banners(talk, key, banner, seq)
        .groupBy(key, "name")
        .agg(last)
        .select(key, "name", F.col("_last")["class"].alias("class"), F.col("_last")["importance"].alias("importance"))
    )


def quality_by_banner(projects: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, quality): the best listed class among a page's projects, null for none."""
    return (
        projects.groupBy(key)
        .agg(F.min(B.banner_priority(F.col("class"))).alias("_best"))
        .select(key, B.priority_class(F.col("_best")).alias("quality"))
    )

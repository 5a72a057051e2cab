"""Maintenance notices: the catalogue of templates and the hits per revision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.functions.markup import catalogue_key
from editlift.functions.rows import left_join_many, unnest
from editlift.functions.titles import bare_template_name
from editlift.session import LITERAL_MAX_ROWS, broadcast_if_small

# Catalogue sections in use, the section each is counted under,
# and the feature column of that section.
SECTION_OF = {
    "Accuracy": "Accuracy", "Content": "Content", "Style": "Style",
    "File Description": "File", "File Quality": "File", "Other": "Other", "Links": "Links",
}
COLUMN_OF = {
    "Accuracy": "backlog_accuracy", "Content": "backlog_content", "Style": "backlog_style",
    "File": "backlog_files", "Other": "backlog_other", "Links": "backlog_links",
}
DEFAULT_EXCLUDED = ("Too few wikilinks",)

CATALOGUE_SCHEMA = "map<string, map<string, map<string, array<string>>>>"


def build_catalogue(templates: DataFrame, redirects: DataFrame) -> DataFrame:
    """Template list and its redirects as rows (section, category, template, alias).

    ``templates`` has section, category, template; ``redirects`` has from_title,
    to_title in the ``Template:`` namespace. A template without a redirect keeps
    one row with a null alias. Aliases stay rows: one template may have any
    number of them.
    """
    names = templates.withColumn("template", bare_template_name(F.col("template")))
    aliases = redirects.select(
        bare_template_name(F.col("to_title")).alias("template"),
        bare_template_name(F.col("from_title")).alias("alias"),
    ).distinct()
    return left_join_many(names, aliases, "template").select("section", "category", "template", "alias")


def unnest_catalogue(catalogue: DataFrame, column: str = "value") -> DataFrame:
    """Nested map section -> category -> template -> aliases, as rows."""
    return (
        catalogue.select(F.explode(column).alias("section", "_categories"))
        .select("section", F.explode("_categories").alias("category", "_templates"))
        .select("section", "category", F.explode("_templates").alias("template", "_aliases"))
        .select("section", "category", "template", F.explode_outer("_aliases").alias("alias"))
    )


def nest_catalogue(catalogue: DataFrame) -> DataFrame:
    """One row per category with a map template -> aliases, for the file form.

    A category's templates and their aliases are a hand-kept list of short names.
    """
    return (
        catalogue.groupBy("section", "category", "template")
        .agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
        .groupBy("section", "category")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("template", "aliases")))).alias("templates"))
    )


def flatten_catalogue(catalogue: DataFrame, excluded: tuple[str, ...] = DEFAULT_EXCLUDED) -> DataFrame:
    """Lookup (name, section): each template name and alias, lower case, once.

    A name listed under two sections goes to the later of them by name; the two
    file sections count as one.
    """
    section = F.create_map(*[F.lit(x) for pair in SECTION_OF.items() for x in pair])[F.col("section")]
    return (
        catalogue.where(F.col("section").isin(*SECTION_OF))
        .where(~F.col("category").isin(*excluded) if excluded else F.lit(True))
        .select(F.explode(F.array("template", "alias")).alias("name"), section.alias("section"))
        .where(F.col("name").isNotNull())
        .groupBy(F.lower("name").alias("name"))
        .agg(F.max("section").alias("section"))
    )


def backlog_hits(df: DataFrame, lookup: DataFrame, names: str = "templates", key: str = "rev_id") -> DataFrame:
    """One row per template hit: key, position in the text, name, section."""
    tokens = unnest(df, key, array=names, value="_name").select(
        key, "pos", catalogue_key(F.col("_name")).alias("name")
    )
    return tokens.join(broadcast_if_small(lookup.select("name", "section")), "name")


def backlog_by_join(df: DataFrame, lookup: DataFrame, names: str, key: str = "rev_id") -> DataFrame:
    """Per key and section: number of hits and the distinct names, first seen first.

    Works for a lookup of any size. Hits are first summed per name, so what is
    gathered per key is its distinct names and not its hits.
    """
    per_name = (
        backlog_hits(df, lookup, names, key)
        .groupBy(key, "section", "name")
        .agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    )
    aggs = []
    for section, column in COLUMN_OF.items():
        mine = F.col("section") == section
        aggs.append(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).cast("int").alias(column))
        seen = F.sort_array(F.collect_list(F.when(mine, F.struct("pos", "name"))))
        aggs.append(
            F.nullif(F.array_join(F.transform(seen, lambda s: s["name"]), " "), F.lit("")).alias(f"{column}_templates")
        )
    return per_name.groupBy(key).agg(*aggs)


def lookup_literals(lookup: DataFrame, max_rows: int = LITERAL_MAX_ROWS) -> dict[str, list[str]] | None:
    """The lookup as literals per section, or None where it is too large for that."""
    rows = lookup.select("section", "name").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    out: dict[str, list[str]] = {section: [] for section in COLUMN_OF}
    for section, name in sorted((r.section, r.name) for r in rows if r.section in COLUMN_OF):
        out[section].append(name)
    return out


def _among(names: list[str]) -> Callable[[Column], Column]:
    return lambda n: n.isin(names)


def backlog_columns(keys: Column, literals: dict[str, list[str]]) -> dict[str, Column]:
    """The same columns as expressions over the array of catalogue keys of a row."""
    out: dict[str, Column] = {}
    for section, column in COLUMN_OF.items():
        known = literals.get(section) or []
        if known:
            hits = F.filter(keys, _among(known))
            out[column] = F.size(hits)
            out[f"{column}_templates"] = F.nullif(F.array_join(F.array_distinct(hits), " "), F.lit(""))
        else:
            out[column] = F.lit(0)
            out[f"{column}_templates"] = F.lit(None).cast("string")
    return out

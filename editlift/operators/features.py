"""Features of a revision and the columns a quality model sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.functions import markup as M
from editlift.operators.backlog import COLUMN_OF, backlog_by_join, backlog_columns, lookup_literals

# The columns of the feature row and of the model row.
FEATURES = (
    "words", "headings", "sub_headings", "images", "categories", "wikilinks", "external_links",
    "main_templates", "cite_templates", "infoboxes", "templates",
    "backlog_accuracy", "backlog_accuracy_templates", "backlog_content", "backlog_content_templates",
    "backlog_style", "backlog_style_templates", "backlog_files", "backlog_files_templates",
    "backlog_other", "backlog_other_templates", "backlog_links", "backlog_links_templates",
    "ref", "smartlists", "coordinates", "text",
)
PER_WORD = (
    "headings", "sub_headings", "main_templates", "external_links", "wikilinks", "cite_templates",
    "templates", "ref", "images", "categories", "smartlists",
)
BACKLOG_COUNTS = (
    "backlog_accuracy", "backlog_content", "backlog_other", "backlog_style", "backlog_links",
)
FLAGS = ("coordinates", "infoboxes")
COUNTS = ("words", *BACKLOG_COUNTS, *PER_WORD)
RAW_COLUMNS = (*COUNTS, *FLAGS)
MODEL_COLUMNS = (*COUNTS, *(f"{c}_per_word" for c in PER_WORD), *FLAGS)


def featurize(
    df: DataFrame,
    text_col: str = "wikitext",
    lookup: DataFrame | None = None,
    key: str = "rev_id",
) -> DataFrame:
    """The row with all feature columns; existing columns of these names are replaced.

    A maintenance lookup of bounded size is folded into the expressions, so the
    whole step is one narrow projection. A larger one is joined. Both count a
    hit once, also where the lookup repeats a row; keys may repeat or be null.
    """
    if lookup is not None:
        lookup = lookup.select("name", "section").distinct()
    literals = {} if lookup is None else lookup_literals(lookup)
    keep = [c for c in df.columns if c not in FEATURES and c != "tables"]
    source = text_col
    if text_col in FEATURES:
        source = "_source"
        df = df.withColumnRenamed(text_col, source)
        keep = [c for c in df.columns if c not in FEATURES and c not in ("tables", source)]
    cleaned = df.select(*keep, *([source] if source not in keep else []), M.clean(F.col(source)).alias("_clean"))
    parts = cleaned.select(
        *cleaned.columns,
        M.template_names(F.col("_clean")).alias("_names"),
        M.link_titles(F.col("_clean")).alias("_links"),
        M.heading_lines(F.col("_clean")).alias("_heads"),
        M.strip_markup(F.col("_clean")).alias("_plain"),
    ).withColumn("_keys", F.transform("_names", M.catalogue_key))
    names, links, heads = F.col("_names"), F.col("_links"), F.col("_heads")
    columns: dict[str, Column] = {
        "words": M.count_words(F.col("_plain")),
        "headings": M.count_headings(heads),
        "sub_headings": M.count_sub_headings(heads),
        "images": M.count_images(links),
        "categories": M.count_categories(links),
        "wikilinks": M.count_wikilinks(links),
        "external_links": F.size(M.external_urls(F.col("_clean"))),
        "main_templates": M.count_main(names),
        "cite_templates": M.count_with_prefix(names, "cite"),
        "infoboxes": M.count_with_prefix(names, "infobox"),
        "templates": F.size(names),
        "ref": F.size(M.ref_tags(F.col("_clean"))),
        "smartlists": F.lit(0),
        "coordinates": M.has_coordinates(F.col(source)),
        "text": F.col("_plain"),
        "tables": F.size(M.tables(F.col("_clean"))),
    }
    if literals is not None:
        columns.update(backlog_columns(F.col("_keys"), literals))
        return parts.select(*keep, *[columns[c].alias(c) for c in FEATURES], columns["tables"].alias("tables"))
    # Counts are taken before the join, so it carries no arrays of the text.
    # A row is told by its key and text; equal rows have equal hits.
    row = F.concat_ws(":", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("-")), F.xxhash64(source))
    own = parts.select(*keep, *[c.alias(name) for name, c in columns.items()], row.alias("_row"))
    hits = backlog_by_join(parts.select(row.alias("_row"), "_names").dropDuplicates(["_row"]), lookup, "_names", "_row")
    for name in COLUMN_OF.values():
        # A null text has null counts, as in the literal form.
        columns[name] = F.when(F.col("templates").isNotNull(), F.coalesce(F.col(name), F.lit(0)))
        columns[f"{name}_templates"] = F.col(f"{name}_templates")
    joined = own.join(hits, "_row", "left")
    return joined.select(
        *keep, *[(columns[c] if c.startswith("backlog_") else F.col(c)).alias(c) for c in (*FEATURES, "tables")]
    )


def model_columns(source: dict[str, Column] | None = None) -> dict[str, Column]:
    """The 30 model columns as expressions over the raw feature columns."""
    raw = source or {c: F.col(c) for c in RAW_COLUMNS}
    words = raw["words"].cast("double")
    out = {c: raw[c].cast("double") for c in COUNTS}
    out.update({f"{c}_per_word": raw[c].cast("double") / words for c in PER_WORD})
    out.update({c: (raw[c].cast("int") != 0).cast("double") for c in FLAGS})
    return out


def model_projection(df: DataFrame, *keep: str) -> DataFrame:
    """Identity columns plus the 30 model columns."""
    columns = model_columns()
    return df.select(*keep, *[columns[c].alias(c) for c in MODEL_COLUMNS])

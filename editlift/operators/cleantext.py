"""Plain text with spans: sections, top-level pieces, rules, offsets.

A section is cut into its top-level pieces by a scan that counts brackets
(``functions.brackets``), so nested markup of any depth stays inside its piece. Rules then say what a piece leaves behind. The text of a
revision is put together in the row; only narrow (kind, name, length) rows are
exploded for the offsets, so no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.functions import markup as M
from editlift.functions.brackets import top_level_pieces
from editlift.functions.rows import unnest
from editlift.functions.titles import strip
from editlift.operators.spans import running_starts
from editlift.session import scratch_path

SECTION_MARK = "\u0001"
ANY_HEADING = r"(?dm)^={1,6}[^=\n][^\n]*={1,6}[ \t]*$"

# Tags and links that leave nothing, and templates that are
# references.
TAGS_DROPPED = ("table", "img")
REFERENCE_TEMPLATES = ("ref", "note")

@dataclass(frozen=True)
class Rules:
    """What to keep, remove and strip. Names are compared in lower case; template
    names in their normal form, by prefix."""

    tags_keep: tuple[str, ...] = ()
    tags_remove: tuple[str, ...] = ()
    templates_keep: tuple[str, ...] = ()
    templates_remove: tuple[str, ...] = ()
    headings_remove: tuple[str, ...] = ()


def split_sections(text: Column) -> Column:
    """The text cut before every heading line; the lead comes first, even if empty."""
    return F.split(F.regexp_replace(text, ANY_HEADING, SECTION_MARK + "$0"), SECTION_MARK)


def section_heading(section: Column) -> Column:
    """Title of the heading a section starts with; null for the lead."""
    line = F.regexp_extract(section, r"(?d)^={1,6}([^=\n][^\n]*?)={1,6}[ \t]*(?:\n|$)", 1)
    return F.nullif(strip(line), F.lit(""))


def keeps_section(section: Column, removed: tuple[str, ...]) -> Column:
    """Is the heading none of the removed ones (trimmed, lower case)."""
    if not removed:
        return F.lit(True)
    return ~F.coalesce(F.lower(section_heading(section)).isin(*removed), F.lit(False))


def sections(df: DataFrame, *key: str, text_col: str = "wikitext") -> DataFrame:
    """(key, sec_no, heading, section), in order from 0."""
    cleaned = df.select(*key, M.clean(F.col(text_col)).alias("_clean"))
    parts = cleaned.select(*key, split_sections(F.col("_clean")).alias("_all"))
    rows = unnest(parts, *key, array="_all", value="section", pos="sec_no")
    return rows.select(*key, "sec_no", section_heading(F.col("section")).alias("heading"), "section")


def drop_sections(df: DataFrame, headings: tuple[str, ...]) -> DataFrame:
    """Rows of ``sections`` without those under the given headings."""
    return df.where(~F.coalesce(F.lower("heading").isin(*headings), F.lit(False))) if headings else df


def _tag_name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"(?i)^<([a-z][a-z0-9]*)", 1))


def _link_target(piece: Column) -> Column:
    return F.regexp_extract(piece, r"^\[\[([^\[\]|]*)", 1)


def _template_name(piece: Column) -> Column:
    return M.template_key(F.regexp_extract(piece, r"^\{\{([^{}|<>\[\]]*)", 1))


def piece_kind(piece: Column) -> Column:
    """ref, tag, template, table, link, image, category, url, heading, quotes or text.

    References are told first: they look like tags or templates.
    """
    closed_braces = piece.startswith("{{") & piece.endswith("}}")
    named = F.when(_template_name(piece).isin(*REFERENCE_TEMPLATES), "ref").otherwise("template")
    tag = F.when(_tag_name(piece) == "ref", "ref").otherwise("tag")
    target = F.lower(_link_target(piece))
    link = (
        F.when(target.rlike("^(?:file|image|media):"), "image")
        .when(target.startswith("category:"), "category")
        .otherwise("link")
    )
    return (
        F.when(F.length(piece) < 2, "text")
        .when(closed_braces, named)
        .when(piece.startswith("{|"), "table")
        .when(piece.rlike("(?i)^<[a-z].*"), tag)
        .when(piece.startswith("[["), link)
        .when(piece.startswith("["), "url")
        .when(piece.startswith("="), "heading")
        .when(piece.startswith("''"), "quotes")
        .otherwise("text")
    )


def piece_name(kind: Column, piece: Column) -> Column:
    """Tag name, template name in normal form, or link target; null for the rest."""
    by_tag = F.when(piece.startswith("<"), _tag_name(piece))
    by_template = F.when(piece.startswith("{{"), _template_name(piece))
    return (
        F.when(kind.isin("ref", "tag"), F.coalesce(by_tag, by_template))
        .when(kind == "template", by_template)
        .when(kind == "table", F.lit("table"))
        .when(kind.isin("link", "image", "category"), _link_target(piece))
    )


def _decode(text: Column) -> Column:
    return M.decode_entities(text)


def _starts_with_any(name: Column, prefixes: tuple[str, ...]) -> Column:
    """False for an empty list."""
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def rendered(kind: Column, name: Column, piece: Column, rules: Rules) -> Column:
    """What a piece leaves in the text; null for nothing."""
    nothing = F.lit(None).cast("string")
    dropped = tuple(t.lower() for t in (*TAGS_DROPPED, *rules.tags_remove))
    kept = tuple(t.lower() for t in rules.tags_keep)
    tag = (
        F.when(name.isin(*TAGS_DROPPED), nothing)
        .when(name.isin(*kept) if kept else F.lit(False), F.concat(F.lit("<"), name, F.lit(">")))
        .when(name.isin(*dropped), nothing)
        .otherwise(M.strip_markup(piece))
    )
    # A stripped template leaves no text, so only kept ones show.
    template = F.when(
        _starts_with_any(name, rules.templates_keep), F.concat(F.lit("{{"), name, F.lit("}}"))
    ).otherwise(F.lit(" "))
    return (
        F.when(kind == "text", _decode(piece))
        .when(kind == "ref", F.lit(" "))
        .when(kind == "tag", tag)
        .when(kind == "template", template)
        .when(kind.isin("table", "image", "category", "heading", "quotes"), nothing)
        .otherwise(M.strip_markup(piece))
    )


def describe_pieces(raw: Column, rules: Rules) -> Column:
    """Array of (kind, name, raw, piece) of raw top-level pieces, in order."""

    def describe(p: Column) -> Column:
        return M.let(
            piece_kind(p),
            lambda kind: M.let(
                piece_name(kind, p),
                lambda name: F.struct(
                    kind.alias("kind"),
                    name.alias("name"),
                    p.alias("raw"),
                    rendered(kind, name, p, rules).alias("piece"),
                ),
            ),
        )

    return F.transform(raw, describe)


def section_pieces(sections: Column, rules: Rules) -> Column:
    """Pieces of an array of sections, one section after another: nesting of any depth
    is matched by the counting scan of ``brackets``."""
    return describe_pieces(top_level_pieces(sections), rules)


def _revision_pieces(df: DataFrame, *key: str, text_col: str, rules: Rules) -> DataFrame:
    """Key and ``_pieces``, the pieces of all kept sections of a revision."""
    cleaned = df.select(*key, M.clean(F.col(text_col)).alias("_clean"))
    kept = cleaned.select(
        *key,
        F.filter(split_sections(F.col("_clean")), lambda s: keeps_section(s, rules.headings_remove)).alias("_kept"),
    )
    return kept.select(*key, section_pieces(F.col("_kept"), rules).alias("_pieces"))


def pieces(df: DataFrame, *key: str, text_col: str = "wikitext", rules: Rules = Rules()) -> DataFrame:
    """(key, pos, kind, name, raw, piece): the top-level pieces of a revision."""
    rows = unnest(_revision_pieces(df, *key, text_col=text_col, rules=rules), *key, array="_pieces", value="_p")
    return rows.select(*key, "pos", "_p.*")


def clean_text(df: DataFrame, *key: str, text_col: str = "wikitext", rules: Rules = Rules()) -> DataFrame:
    """(key, text): the pieces joined, in the row."""
    rows = _revision_pieces(df, *key, text_col=text_col, rules=rules)
    return rows.select(*key, _joined(F.col("_pieces")).alias("text"))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")


def _narrow(pieces: Column) -> Column:
    """Array of (kind, name, length) of the pieces, in order."""
    return F.transform(
        pieces,
        lambda p: F.struct(
            p["kind"].alias("kind"),
            p["name"].alias("name"),
            F.coalesce(F.length(p["piece"]), F.lit(0)).alias("length"),
        ),
    )


def _placed(narrow: DataFrame, *key: str) -> DataFrame:
    flat = unnest(narrow, *key, array="_marks", value="_m").select(*key, "pos", "_m.*")
    return running_starts(flat, *key, length="length")


def _marks(df: DataFrame, *key: str, text_col: str, rules: Rules) -> DataFrame:
    rows = _revision_pieces(df, *key, text_col=text_col, rules=rules)
    return _placed(rows.select(*key, _narrow(F.col("_pieces")).alias("_marks")), *key)


def _references(placed: DataFrame, *key: str) -> DataFrame:
    return placed.where(F.col("kind") == "ref").select(*key, "pos", F.col("start").alias("offset"))


def text_and_references(
    df: DataFrame, *key: str, text_col: str = "wikitext", rules: Rules = Rules()
) -> tuple[DataFrame, DataFrame]:
    """What ``clean_text`` and ``reference_offsets`` give, each text scanned once: its joined text and narrow pieces are written to the shared folder."""
    rows = _revision_pieces(df, *key, text_col=text_col, rules=rules)
    path = scratch_path(df.sparkSession, "pieces")
    rows.select(*key, _joined(F.col("_pieces")).alias("text"), _narrow(F.col("_pieces")).alias("_marks")).write.parquet(path)
    scanned = df.sparkSession.read.parquet(path)
    return scanned.select(*key, "text"), _references(_placed(scanned.select(*key, "_marks"), *key), *key)


def template_spans(df: DataFrame, *key: str, text_col: str = "wikitext", rules: Rules = Rules()) -> DataFrame:
    """(key, start, end, label) of each top-level template in the joined text."""
    return (
        _marks(df, *key, text_col=text_col, rules=rules)
        .where(F.col("kind") == "template")
        .select(*key, "start", (F.col("start") + F.col("length")).alias("end"), F.col("name").alias("label"))
    )


def reference_offsets(df: DataFrame, *key: str, text_col: str = "wikitext", rules: Rules = Rules()) -> DataFrame:
    """(key, pos, offset) of each top-level reference in the joined text."""
    return _references(_marks(df, *key, text_col=text_col, rules=rules), *key)

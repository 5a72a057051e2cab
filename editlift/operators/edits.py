"""Hypothetical edits: their catalogue, the edited feature rows, and the gains.

Every revision is scored as it is and once per edit, and the edits are compared
in the row. A scorer in closed form does all of it in one projection
(``suggest_edits``); a fitted model takes exploded rows (``score_edits``), and
only the ranking of the narrow gains shuffles (``rank_edits``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlift.functions.labels import CLASSES, code_label
from editlift.functions.markup import let
from editlift.functions.probability import expected_code, median_code, modal_code, percent
from editlift.functions.rows import unnest
from editlift.operators.features import FLAGS, RAW_COLUMNS

GAIN_DIGITS = 9
SHOW_ABOVE = 0.005


@dataclass(frozen=True)
class Edit:
    number: int
    name: str
    column: str
    delta: int
    words: int
    kind: str
    advice: str


# The edits, the column each one changes and by how much, and the
# words it brings along. Numbers give the order of equal gains.
EDITS = (
    Edit(1, "sentence", "words", 0, 15, "words", "Write one more sentence, about 15 words"),
    Edit(2, "paragraph", "words", 0, 150, "words", "Write one more paragraph, about 150 words"),
    Edit(3, "headings", "headings", 1, 2, "both", "Give the article another section"),
    Edit(4, "sub_headings", "sub_headings", 1, 2, "both", "Divide a section with a sub-heading"),
    Edit(5, "images", "images", 1, 0, "both", "Show an image"),
    Edit(6, "categories", "categories", 1, 2, "both", "Put the article into one more category"),
    Edit(7, "wikilinks", "wikilinks", 1, 1, "both", "Link to another article"),
    Edit(8, "external_links", "external_links", 1, 1, "both", "Link to a page elsewhere"),
    Edit(9, "citation", "cite_templates", 1, 5, "both", "Cite a source"),
    Edit(10, "ref", "ref", 1, 15, "both", "Write a footnote"),
    Edit(11, "coordinates", "coordinates", 1, 0, "flag", "State the coordinates"),
    Edit(12, "infoboxes", "infoboxes", 1, 0, "flag", "Start with an infobox"),
    Edit(13, "backlog_accuracy", "backlog_accuracy", -1, 0, "count", "Settle a notice about accuracy"),
    Edit(14, "backlog_other", "backlog_other", -1, 0, "count", "Settle a notice of another kind"),
    Edit(15, "backlog_style", "backlog_style", -1, 0, "count", "Settle a notice about style"),
    Edit(16, "backlog_links", "backlog_links", -1, 0, "count", "Settle a notice about links"),
)

#: A scorer adds an array column of class probabilities to a frame that has the
#: raw feature columns: (frame, output name) -> frame.
Scorer = Callable[[DataFrame, str], DataFrame]


def add_count(value: Column, delta: Column | int) -> Column:
    """A count after an edit; never below zero."""
    return F.greatest(value + delta, F.lit(0))


def add_words(words: Column, delta: Column | int) -> Column:
    """The word count after an edit; never below one."""
    return F.greatest(words + delta, F.lit(1))


def set_flag(value: Column) -> Column:
    """A flag after an edit: on, whatever it was."""
    return F.coalesce(F.lit(1), value.cast("int"))


def edit_array(with_unchanged: bool = False, edits: tuple[Edit, ...] = EDITS) -> Column:
    """The catalogue as a constant array of structs; number 0 changes nothing."""

    def row(number: int, name: str, column: str, delta: int, words: int, kind: str) -> Column:
        return F.struct(
            F.lit(number).alias("edit_no"),
            F.lit(name).alias("edit"),
            F.lit(column).alias("column"),
            F.lit(delta).alias("delta"),
            F.lit(words).alias("words_delta"),
            F.lit(kind).alias("kind"),
        )

    rows = [row(e.number, e.name, e.column, e.delta, e.words, e.kind) for e in edits]
    if with_unchanged:
        rows.insert(0, row(0, "unchanged", "words", 0, 0, "words"))
    return F.array(*rows)


def edited_columns(
    edit: Column, edits: tuple[Edit, ...] = EDITS, raw: dict[str, Column] | None = None
) -> dict[str, Column]:
    """The raw feature columns after the edit of the row."""
    raw = raw or {c: F.col(c).cast("int") for c in RAW_COLUMNS}
    changed = {e.column for e in edits if e.kind != "words"}
    out = {}
    for name in RAW_COLUMNS:
        value = raw[name]
        if name == "words":
            out[name] = add_words(value, edit["words_delta"])
        elif name in FLAGS:
            out[name] = F.when(edit["column"] == name, set_flag(value)).otherwise(value)
        elif name in changed:
            out[name] = F.when(edit["column"] == name, add_count(value, edit["delta"])).otherwise(value)
        else:
            out[name] = value
    return out


class ExpressionScorer(Protocol):
    """A model in closed form: class probabilities as one expression of the raw columns."""

    def probabilities(self, raw: dict[str, Column]) -> Column: ...

    def __call__(self, df: DataFrame, out: str) -> DataFrame: ...


def edit_variants(df: DataFrame, *keep: str, with_unchanged: bool = True, edits: tuple[Edit, ...] = EDITS) -> DataFrame:
    """Each row once per edit, with the features as they are after it.

    The narrow columns are projected first, so no text is multiplied; the
    variants come from a constant array, so there is no join either.
    """
    narrow = df.select(*keep, *RAW_COLUMNS, F.explode(edit_array(with_unchanged, edits)).alias("_edit"))
    edit = F.col("_edit")
    columns = edited_columns(edit, edits)
    return narrow.select(
        *keep,
        edit["edit_no"].alias("edit_no"),
        edit["edit"].alias("edit"),
        *[columns[c].alias(c) for c in RAW_COLUMNS],
    )


def score_revisions(df: DataFrame, scorer: Scorer, decision: str = "median") -> DataFrame:
    """Adds prob, score (expected class), code and best (predicted class)."""
    n = len(CLASSES)
    scored = scorer(df, "prob")
    prob = F.col("prob")
    code = median_code(prob, n) if decision == "median" else modal_code(prob)
    return (
        scored.withColumn("score", expected_code(prob, n))
        .withColumn("code", code)
        .withColumn("best", code_label(F.col("code")))
    )


def suggest_edits(df: DataFrame, scorer: ExpressionScorer, edits: tuple[Edit, ...] = EDITS) -> DataFrame:
    """Adds ``edits``: the edits that help, best first, as an array in the row.

    For a scorer in closed form. The variants live in an array of the row, so
    nothing is multiplied and nothing is shuffled; it also runs on a stream.
    ``df`` has the raw feature columns and ``score``.
    """
    n = len(CLASSES)

    def gains(row: Column) -> Column:
        raw = {c: row[c] for c in RAW_COLUMNS}

        def one(edit: Column) -> Column:
            prob = scorer.probabilities(edited_columns(edit, edits, raw))
            gain = let(prob, lambda p: F.round(expected_code(p, n) - row["score"], GAIN_DIGITS))
            return F.struct((-gain).alias("loss"), edit["edit_no"].alias("edit_no"), edit["edit"].alias("edit"))

        return F.transform(edit_array(False, edits), one)

    # Bound as one struct first: a column named inside the loop would have its
    # whole expression, regular expressions included, evaluated once per edit.
    narrow = F.struct(*[F.col(c).cast("int").alias(c) for c in RAW_COLUMNS], F.col("score"))
    helpful = F.filter(let(narrow, gains), lambda e: e["loss"] < 0)
    ranked = F.transform(
        F.sort_array(helpful),
        lambda e, i: F.struct(
            (i + 1).alias("rank"),
            e["edit_no"].alias("edit_no"),
            e["edit"].alias("edit"),
            (-e["loss"]).alias("gain"),
        ),
    )
    return df.withColumn("edits", ranked)


def explode_suggestions(df: DataFrame, *key: str) -> DataFrame:
    """The suggestions as rows (key, rank, edit_no, edit, gain)."""
    return unnest(df, *key, array="edits", value="_e").select(*key, "_e.*")


def score_edits(df: DataFrame, scorer: Scorer, *keep: str, edits: tuple[Edit, ...] = EDITS) -> DataFrame:
    """Long table of all edits of all rows with features, prob, score and gain.

    For any scorer, fitted ones included. The row is scored before it is
    multiplied, so the gain is taken in the row and nothing is shuffled.
    """
    n = len(CLASSES)
    base = scorer(df.select(*keep, *RAW_COLUMNS), "_base_prob").select(
        *keep, *RAW_COLUMNS, expected_code(F.col("_base_prob"), n).alias("base_score")
    )
    return score_variants(base, scorer, *keep, edits=edits)


def score_variants(base: DataFrame, scorer: Scorer, *keep: str, edits: tuple[Edit, ...] = EDITS) -> DataFrame:
    """As ``score_edits``, of rows that carry their own ``base_score``."""
    n = len(CLASSES)
    variants = edit_variants(base, *keep, "base_score", with_unchanged=False, edits=edits)
    return (
        scorer(variants, "prob")
        .withColumn("score", expected_code(F.col("prob"), n))
        .withColumn("gain", F.round(F.col("score") - F.col("base_score"), GAIN_DIGITS))
    )


def suggest_fitted(scored: DataFrame, scorer: Scorer, *key: str, edits: tuple[Edit, ...] = EDITS) -> DataFrame:
    """(key, prob, score, best, edits) of rows from ``score_revisions``, for a fitted scorer.

    What the row's own score gave travels with its sixteen narrow variants, so the input
    is read and scored once, and one aggregation per key brings both together.
    """
    own = F.struct("prob", "score", "best").alias("_own")
    base = scored.select(*key, *RAW_COLUMNS, F.col("score").alias("base_score"), own)
    entry = F.struct((-F.col("gain")).alias("loss"), "edit_no", "edit")
    gathered = (
        score_variants(base, scorer, *key, "_own", edits=edits)
        .groupBy(*key)
        .agg(F.first("_own").alias("_own"), F.sort_array(F.collect_list(F.when(F.col("gain") > 0, entry))).alias("_helpful"))
    )
    ranked = F.transform(
        "_helpful",
        lambda e, i: F.struct((i + 1).alias("rank"), e["edit_no"].alias("edit_no"), e["edit"].alias("edit"), (-e["loss"]).alias("gain")),
    )
    return gathered.select(*key, "_own.*", ranked.alias("edits"))


def rank_edits(scored: DataFrame, *key: str, min_gain: float = 0.0, top: int | None = None) -> DataFrame:
    """Edits that help, best first per row; equal gains in catalogue order.

    The narrow columns are shuffled, sixteen rows per key. The filter stays
    above the ranking: pushed below, it would run the model a second time.
    """
    order = Window.partitionBy(*key).orderBy(F.col("gain").desc(), F.col("edit_no"))
    ranked = (
        scored.select(*key, "edit_no", "edit", "gain")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("gain") > min_gain)
    )
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def gather_edits(ranked: DataFrame, *key: str) -> DataFrame:
    """One row per key with its ranked edits (sixteen at most) as an array."""
    entry = F.struct("rank", "edit_no", "edit", "gain")
    return ranked.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("edits"))


def advice_for(edit: Column, edits: tuple[Edit, ...] = EDITS) -> Column:
    """The wording of an edit for readers."""
    return F.try_element_at(F.create_map(*[F.lit(x) for e in edits for x in (e.name, e.advice)]), edit)


def shown_edits(edits: Column) -> Column:
    """The edits above the display cut, with their wording and gain in whole percent."""
    return F.transform(
        F.filter(edits, lambda e: e["gain"] > SHOW_ABOVE),
        lambda e: F.struct(
            e["edit"].alias("edit"),
            advice_for(e["edit"]).alias("advice"),
            percent(e["gain"]).alias("gain_pct"),
        ),
    )


def shown_classes(prob: Column) -> Column:
    """All classes from best to worst with their probability in whole percent."""
    return F.array(
        *[
            F.struct(F.lit(CLASSES[k]).alias("class"), percent(prob[k]).alias("pct"))
            for k in reversed(range(len(CLASSES)))
        ]
    )

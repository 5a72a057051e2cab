"""Spelling variants grouped by asymmetric q-chunks.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. Each occurrence may be
perturbed: with ``h`` the unsigned CRC-32 of the UTF-8 text ``<doc_id>:<run>`` (a null id is written
as the empty string), a run with ``h % 199 == 0`` loses its code point ``h % length``. Words are the
distinct results of at least ``min_chars`` code points that occur ``min_count`` times or more.

Two words are near when one inserted, deleted or replaced code point turns one into the other.
Candidates come from asymmetric q-chunks: a word ``x`` of length L gives two disjoint chunks, its
first ``L // 2`` code points at 0 and the rest at ``L // 2``. One edit spoils at most one chunk, and
the other stays in the near word ``y`` at its place or shifted by one. ``y`` gives all its positional
grams of the chunk lengths of the three lengths ``x`` may have (len(y) - 1 .. len(y) + 1), and the
two sides are joined on (length of x, chunk, position, gram) with the chunk's position taken within
a shift of one. Every candidate is verified by the edit distance, so the result is exact.

A word's form is its near word of the largest count (ties: smallest in code-point order) if that
count is at least ``ratio`` times its own; its root follows forms to the end (counts grow at least
``ratio``-fold per step, so there are no cycles and the walk is short).

Cases: null texts have no words, an empty table gives an empty table, very long texts are read
whole. Extra input columns are ignored. Ties in count are broken by code-point order. A word with no near word has
``n_near`` 0, a null form and itself as root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.llm.common import ascii_lower
from editlift.session import reliable_checkpoint

#: Fixed values of the contract.
LETTERS = "[A-Za-zÀ-ÿ]+"
PERTURB_MOD = 199
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5


def perturbed(word: Column, doc_id: Column) -> Column:
    """The run, or the run without its code point ``h % length`` when 199 divides ``h``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    cut = (h % F.length(word)).cast("int")
    return F.when(h % PERTURB_MOD == 0, F.overlay(word, F.lit(""), cut + 1, F.lit(1))).otherwise(word)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over all occurrences; the count is combined map-side before the shuffle."""
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LETTERS), 0)).alias("w"))
    words = runs.select(perturbed(ascii_lower(F.col("w")), F.col("doc_id")).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _chunks(words: DataFrame) -> DataFrame:
    """Each word's two disjoint chunks, the second at the three positions it may take in a near word."""
    length = F.length("word")
    half = F.floor(length / 2).cast("int")
    first = words.select("word", length.alias("lx"), F.lit(0).alias("chunk"), F.lit(0).alias("pos"), F.substring("word", 1, half).alias("gram"))
    second = words.select(
        "word", length.alias("lx"), F.lit(1).alias("chunk"), F.explode(F.array(half - 1, half, half + 1)).alias("pos"),
        F.expr("substring(word, floor(length(word) / 2) + 1)").alias("gram"),
    )
    return first.unionByName(second)


def _grams(words: DataFrame, min_chars: int) -> DataFrame:
    """All positional grams of ``y`` at the chunk lengths of each length x may have, where a chunk may stand."""
    length = F.length("word")
    lx = F.explode(F.array(length - 1, length, length + 1)).alias("lx")
    shapes = words.select("word", lx).where(F.col("lx") >= min_chars)
    half = F.floor(F.col("lx") / 2).cast("int")
    first = shapes.select("word", "lx", F.lit(0).alias("chunk"), F.lit(0).alias("pos"), F.expr("substring(word, 1, floor(lx / 2))").alias("gram"))
    second = shapes.select("word", "lx", F.explode(F.sequence(half - 1, half + 1)).alias("pos")).select(
        "word", "lx", F.lit(1).alias("chunk"), "pos", F.expr("substring(word, pos + 1, lx - floor(lx / 2))").alias("gram"),
    )
    return first.unionByName(second).where(F.length("gram") == F.when(F.col("chunk") == 0, F.floor(F.col("lx") / 2)).otherwise(F.col("lx") - F.floor(F.col("lx") / 2)))


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct ordered pairs (word, other) at edit distance one."""
    x = _chunks(words.select("word"))
    y = _grams(words.select("word"), min_chars).withColumnRenamed("word", "other")
    cand = x.join(y, ["lx", "chunk", "pos", "gram"]).where(F.col("word") != F.col("other")).select("word", "other").distinct()
    return cand.where(F.levenshtein("word", "other", 1) == 1)


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Per word: ``word, n, n_near, form, form_n, root``."""
    counts = reliable_checkpoint(word_counts(docs, min_chars, min_count))
    pairs = near_pairs(counts, min_chars)
    other = counts.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = (
        pairs.join(other, "other")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other"))).alias("best"))
    )
    forms = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.neg") >= ratio * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.neg") >= ratio * F.col("n"), -F.col("best.neg")).cast("long").alias("form_n"),
    )
    forms = reliable_checkpoint(forms)
    # Follow forms by pointer jumping: each round doubles the distance covered.
    step = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        hop = step.alias("a").join(step.alias("b"), F.col("a.root") == F.col("b.word")).select(
            F.col("a.word"), F.col("b.root").alias("root"), (F.col("b.root") != F.col("a.root")).alias("moved"),
        )
        hop = reliable_checkpoint(hop)
        step = hop.select("word", "root")
        if hop.where("moved").isEmpty():
            break
    return forms.join(step, "word").select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")

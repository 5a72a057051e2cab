"""Quality rules whose thresholds adapt to each language and source.

Every document gets a few signals. A mergeable quantile sketch per language and
source counts the values of each signal in logarithmic buckets (2 % wide, so a
quantile is right to 2 %); sketches are merged by adding counts, inside a task
before the shuffle, then across tasks, then into coarser groups. The bounds of
a group follow from the quartiles: a value further than ``REACH`` quartile ranges outside
is rejected, so a group's ordinary documents stay whatever the group is like.
A group with fewer than ``LEAST`` documents takes the merged sketch of its
language, or of all documents. Documents are joined with the bounds of their group.

Cases: null text has no words and fails the base rule. A null language or
source is a group of its own. A group where all values are equal has bounds at
that value plus the slack. Repeated rows count and are judged each. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlift.llm.common import pieces, staged, text_or_empty

GROWTH = 1.02
REACH = 4.0
LEAST = 200

#: Signal: slack added to its bounds, and whether low values are rejected too.
SIGNALS = {
    "chars_per_word": (1.0, True),
    "symbols_per_word": (0.1, False),
    "dup_lines_per_word": (0.05, False),
    "repeats_per_word": (0.35, False),
}

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has more than once."""
    n = len(words)
    if n < 4:
        return 0
    place: dict[bytes, int] = {}
    at = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=n)
    m = len(place)
    if m == n:
        return 0
    if m < 1 << 21:
        key = (at[:-2] * m + at[1:-1]) * m + at[2:]
    else:
        _, two = np.unique(at[:-1] * m + at[1:], return_inverse=True)
        key = two[:-1] * m + at[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    hit = np.zeros(n - 2, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def signals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, groups, counts of the whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            rows = [measure(t) for t in piece.column(piece.num_columns - 1).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *counts], names)

    rows = df.select(
        df[id_col].alias("id"),
        *(df[g].cast("string").alias(f"group{k}") for k, g in enumerate(groups)),
        text_or_empty(text_col).alias("text"),
    )
    names = [*rows.columns[:-1], *BASE]
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(b, T.LongType()) for b in BASE)])
    return rows.mapInArrow(run, schema)


def ratio(name: str) -> Column:
    top = {
        "chars_per_word": "word_chars", "symbols_per_word": "n_symbols",
        "dup_lines_per_word": "n_dup_lines", "repeats_per_word": "n_repeat_words",
    }[name]
    return F.try_divide(F.col(top), F.col("n_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signal, bucket, n): counts per bucket; -100000 holds the zeros."""
    values = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), ratio(s).alias("x")) for s in SIGNALS)))
    bucket = F.when(F.col("v.x") > 0, F.floor(F.log(F.col("v.x")) / log(GROWTH))).otherwise(-100_000)
    return (
        rows.where(F.col("n_words") > 0).select(*keys, values.alias("v"))
        .groupBy(*keys, F.col("v.signal").alias("signal"), bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    )


def bounds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, low_<signal>, high_<signal>) from merged sketches; a group has a few thousand buckets at most."""
    from pyspark.sql import Window

    group = Window.partitionBy(*keys, "signal") if keys else Window.partitionBy("signal")
    merged = sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.select(
        *keys, "signal", "bucket",
        F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"),
    )
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(F.exp((F.col("bucket") + 0.5) * log(GROWTH)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    quartiles = ranked.groupBy(*keys, "signal").agg(
        F.max("total").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3")
    )
    spread = REACH * (F.col("q3") - F.col("q1"))
    columns = [F.max("n").alias("n")]
    for name, (slack, low) in SIGNALS.items():
        mine = F.col("signal") == name
        columns.append(F.max(F.when(mine, F.col("q3") + spread + slack)).alias(f"high_{name}"))
        columns.append(F.max(F.when(mine, (F.col("q1") - spread - slack) if low else F.lit(-1.0))).alias(f"low_{name}"))
    return quartiles.groupBy(*keys).agg(*columns)


def judge(rows: DataFrame, groups: int = 2, least: int = LEAST) -> DataFrame:
    """Signals with ``base_failed`` and ``kept``. ``rows`` should be staged, since it is read twice."""
    keys = [f"group{k}" for k in range(groups)]
    known = rows.select("*", *(F.coalesce(F.col(k), F.lit("\x00null")).alias(f"_{k}") for k in keys))
    keys = [f"_{k}" for k in keys]
    sketch = sketches(known, keys)
    limits = [c for s in SIGNALS for c in (f"low_{s}", f"high_{s}")]

    # Coarser groups are merged sketches; the finest with enough documents counts.
    chosen = bounds(sketch, keys)
    for depth in range(groups - 1, -1, -1):
        outer = bounds(sketch, keys[:depth])
        if depth:
            joined = chosen.join(outer.select(*keys[:depth], *(F.col(c).alias(f"outer_{c}") for c in ["n", *limits])), keys[:depth])
        else:
            row = outer.first()  # the one row for all documents
            joined = chosen.select("*", *(F.lit(row[c] if row else None).cast("double").alias(f"outer_{c}") for c in ["n", *limits]))
        enough = F.col("n") >= least
        chosen = joined.select(
            *keys, F.when(enough, F.col("n")).otherwise(F.col("outer_n")).alias("n"),
            *(F.when(enough, F.col(c)).otherwise(F.col(f"outer_{c}")).alias(c) for c in limits),
        )
    out = known.join(chosen.drop("n"), keys, "left")
    fits = F.lit(True)
    for s in SIGNALS:
        fits = fits & (ratio(s) <= F.col(f"high_{s}")) & (ratio(s) >= F.col(f"low_{s}"))
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False))).drop(*keys, *limits)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, counts, base_failed, kept) for every row."""
    rows = staged(signals(df, id_col, text_col, groups), "quality")
    return judge(rows, len(groups)).select(F.col("id").alias(id_col), *BASE, "base_failed", "kept")

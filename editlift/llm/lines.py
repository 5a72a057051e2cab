"""Line dedup by levelled sorted runs of line hashes [native: DataFrame functions only].

A line's key is the line with blanks (``[\\x20\\x09-\\x0D]``) stripped at both ends and A-Z lower-cased.
A key of at least ``min_chars`` code points that also occurs in a document with a smaller ``doc_id``
loses that line; the smallest holder keeps all of its lines, repeats within it included.

Method: documents are taken in ``batches`` ranges of ``doc_id``, smallest first. Each batch
finds the first holder of each of its keys inside the batch (an aggregate, combined map-side), then
merge-anti-joins its keys against the sorted runs written by earlier batches: a key already in a run
was held by a smaller id. The keys the batch adds become a new sorted run at level 0; whenever a level
holds ``fanout`` runs they are merged into one run of the next level, so a batch probes only
O(fanout * log(batches)) runs. Runs and the dropped line positions are written below the shared
folder (``spark.checkpoint.dir``), so a lost executor costs only its batch. Finally each document
is rebuilt in its row from the positions dropped in it (a set difference of indices, linear in its lines).

A key is two independent 64-bit hashes (128 bits), so equal hashes of different keys are not
expected at any corpus size.

Cases: a null or empty text is one empty line, whose key is too short to drop. A null ``doc_id``
ranks after every id: such a row loses every key some numbered document also holds, and keys held
only by null-id rows stay. Rows with equal ``doc_id`` are one holder, so repeated rows keep the same
lines. Very long texts are split like others; only their own lines are gathered in their row.
Extra columns are kept as they are; the operator's own columns are ``n_lines``, ``n_dropped`` and
``kept`` (clashing input columns of these names are replaced). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.llm.common import BLANKS, ascii_lower, text_or_empty
from editlift.session import scratch_path

#: Keys shorter than this (in code points) never drop a line.
MIN_CHARS = 10

#: Ranges of doc_id taken one after another.
BATCHES = 8

#: Runs of one level merged into one of the next.
FANOUT = 2

_HASH = ["_h1", "_h2"]
_RUN = "_h1 long, _h2 long"


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def line_key(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, f"^[{BLANKS}]+|[{BLANKS}]+$", ""))


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Approximate doc_id quantiles; any bounds give the same result, they only even out the batches."""
    if batches <= 1:
        return []
    probs = [k / batches for k in range(1, batches)]
    row = docs.agg(F.percentile_approx("doc_id", probs, 1000).alias("q")).first()
    return sorted(set(row["q"] or []))


def _batch_of(bounds: list[int]) -> Column:
    """Index of a document's range; null ids go to the last batch."""
    idx = F.lit(0)
    for b in bounds:
        idx = idx + F.when(F.col("doc_id") > F.lit(b), 1).otherwise(0)
    return F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(idx)


class _Runs:
    """Levelled sorted runs of key hashes, written to the shared folder."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def read(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(_RUN).parquet(*paths) if paths else None

    def _write(self, keys: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        keys.repartition(*_HASH).sortWithinPartitions(*_HASH).write.parquet(path)
        return path

    def add(self, keys: DataFrame) -> None:
        self.levels[0].append(self._write(keys))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self.spark.read.schema(_RUN).parquet(*self.levels[level]))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop repeated lines; returns the input rows with ``n_lines``, ``n_dropped`` and ``kept`` (the text left)."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in {"n_lines", "n_dropped", "kept", "_thash", "_drop"}]
    base = docs.select(*own).withColumn("_thash", F.xxhash64(text_or_empty("text")))
    bounds = _bounds(base, batches)
    lines = (
        base.select("doc_id", "_thash", F.posexplode(F.split(text_or_empty("text"), "\n", -1)).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.length("_key") >= min_chars)
        .select("doc_id", "_thash", "_pos", F.xxhash64(F.lit(1), "_key").alias("_h1"), F.xxhash64(F.lit(2), "_key").alias("_h2"))
        .withColumn("_batch", _batch_of(bounds))
    )
    # The narrow line rows are written once, by batch; each batch then reads only its own.
    staged_lines = scratch_path(spark, "line-keys")
    lines.write.partitionBy("_batch").parquet(staged_lines)
    lines = spark.read.schema(lines.schema).parquet(staged_lines)
    runs = _Runs(spark, fanout)
    drops = []
    for b in range(len(bounds) + 1):
        mine = lines.where(F.col("_batch") == b).drop("_batch")
        # First holder inside the batch; the ordering puts null ids last.
        first = mine.groupBy(*_HASH).agg(F.min("doc_id").alias("_first"))
        seen = runs.read()
        if seen is not None:
            first = first.join(seen.withColumn("_old", F.lit(True)), _HASH, "left")
        else:
            first = first.withColumn("_old", F.lit(None).cast("boolean"))
        first = _staged(first, "line-first")
        path = scratch_path(spark, "line-drops")
        earlier = F.coalesce(F.col("_old"), F.lit(False))
        smaller = F.when(F.col("doc_id").isNull(), F.col("_first").isNotNull()).otherwise(F.col("_first") < F.col("doc_id"))
        mine.join(first, _HASH).where(earlier | smaller).select("doc_id", "_thash", "_pos").write.parquet(path)
        drops.append(path)
        runs.add(first.where(F.col("_old").isNull()).select(*_HASH))
    dropped = (
        spark.read.schema("doc_id long, _thash long, _pos int").parquet(*drops)
        .groupBy("doc_id", "_thash")
        .agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))
    )
    joined = base.join(dropped, (base["doc_id"].eqNullSafe(dropped["doc_id"])) & (base["_thash"] == dropped["_thash"]), "left")
    parts = F.split(text_or_empty("text"), "\n", -1)
    n = F.size(parts)
    gone = F.coalesce(dropped["_drop"], F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")
    return joined.select(
        *[base[c] for c in own],
        n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept"),
    )

"""Near-duplicates by circulant MinHash, banding and exact Jaccard.

Two permutations make all coordinates of a signature: a fixed one scatters the
shingles over the 32-bit circle, and the other, applied to the circle shifted by k, gives
coordinate k. Bands of ``ROWS`` coordinates bring texts together; there are so many of
them that a pair at the threshold is missed with a chance below ``MISS``.

Texts of equal shingle sets are one class. In each band the members are
compared with one hub. Hubs are taken in the same order of all sets in every band, so that a large
group has few of them and its links grow with its members, not with members times bands. Members that are
still apart from their band's smallest or largest set are compared with these. What
the verified links leave apart inside a band is then compared in full: every
member outside the band's largest component with the members of other components, where parity
sketches of the sets first rule out pairs that are provably too far apart. So no link
is lost, and within a large group of copies pairs are not expanded. Every link is
confirmed on the full sets. Components follow by spreading the smallest id with pointer jumping,
each round written to the shared folder.

Cases: without words or text a set is empty and linked with nothing. Rows that share an
id are one node. A null id is linked with nothing and not kept. Copies are members of their class. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlift.llm.common import pieces, staged, text_or_empty
from editlift.session import broadcast_if_small

ROWS = 5
MISS = 1e-6

#: Ids up to this many (8 bytes each) are broadcast to pick the texts to compare.
PICKED = 500_000

#: Shingles hashed at once, so that a chunk stays in the cache.
CHUNK = 1 << 16
WORDS_KEPT = 100_000

#: 64-bit words of a parity sketch.
PARITY_WORDS = 16


def bands_for(percent: int, rows: int = ROWS) -> int:
    return ceil(log(MISS) / log(1 - (percent / 100) ** rows))


class Shingler:
    """Hashed shingle sets; hashes of words are kept inside a task."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words: dict[bytes, int] = {}
        odd = np.random.default_rng(20).integers(0, 1 << 63, size=width, dtype=np.uint64)
        self.factors = odd << np.uint64(1) | np.uint64(1)

    def sets(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        known = self.words
        if len(known) > WORDS_KEPT:
            known.clear()
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in words]
        h = np.array(hashes, dtype=np.uint64)
        n, width = len(h), self.width
        if n == 0:
            return h
        if n < width:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00short" + b" ".join(words))], dtype=np.uint64)
        mixed = h[: n - width + 1] * self.factors[0]
        for k in range(1, width):
            mixed ^= mixed >> np.uint64(29)
            mixed += h[k : n - width + 1 + k] * self.factors[k]
            mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of coordinates per set; the sets are not empty."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    # The first permutation scatters; its values are places on the circle.
    circle = ((flat * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    x, y = np.empty_like(circle), np.empty_like(circle)
    for k in range(coordinates):
        np.add(circle, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=x)  # shifted
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x7FEB352D), out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x846CA68B), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    n, coordinates = signature.shape
    parts = signature.reshape(n, coordinates // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, coordinates // rows + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), parts.shape[:2]).copy()
    for k in range(rows):
        key = (key ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signed(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, h, bands): size, 128-bit name of the set and band keys of each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for piece in pieces(batches, "text", 2 << 20):
            sets = [shingler.sets(t) for t in piece.column(1).to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list[list[int] | None] = [None] * len(sets)
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            start = 0
            while start < len(full):
                end, size = start, 0
                while end < len(full) and (end == start or size + len(sets[full[end]]) <= CHUNK):
                    size += len(sets[full[end]])
                    end += 1
                found = band_keys(signatures([sets[k] for k in full[start:end]], bands * rows), rows).tolist()
                for k, row in zip(full[start:end], found):
                    keys[k] = row
                start = end
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ], ["id", "n", "h", "bands"])

    schema = T.StructType([df.schema["id"], T.StructField("n", T.LongType()), T.StructField("h", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return df.mapInArrow(run, schema)


def parity(shingles: np.ndarray) -> np.ndarray:
    """One bit per bucket of shingles: whether their number is odd.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    counts = np.bincount((shingles >> np.uint64(32)) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def named_sets(texts: DataFrame, width: int) -> DataFrame:
    """(h, shingles, sketch) where the name follows from the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for piece in pieces(batches, "text", 2 << 20):
            sets = [s for t in piece.column(0).to_pylist() if len(s := shingler.sets(t))]
            if sets:
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), lists, pa.array([parity(s).tolist() for s in sets], pa.list_(pa.int64()))], ["h", "shingles", "sketch"])

    return texts.mapInArrow(run, "h binary, shingles array<long>, sketch array<long>")


def picked_sets(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(h, shingles, sketch) of the texts of the given ids, which are read again; staged."""
    texts = rows.join(broadcast_if_small(ids.select(F.col("rep").alias("id")), PICKED), "id", "left_semi").select("text")
    return staged(named_sets(texts, width).dropDuplicates(["h"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set names whose full sets are similar enough."""
    left = sets.select(F.col("h").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("h").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b").join(left, "b").join(right, "a")
    return joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def may_reach(n: Column, sketch: Column, m: Column, other: Column, percent: int) -> Column:
    """False where the sketches prove that the Jaccard similarity of two sets of sizes n and m is below the threshold."""
    apart = sum((F.bit_count(sketch[k].bitwiseXOR(other[k])) for k in range(1, PARITY_WORDS)), F.bit_count(sketch[0].bitwiseXOR(other[0])))
    return (100 + percent) * apart <= (100 - percent) * (n + m)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (u, v) reaches."""
    both = staged(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct(), "links")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("node"), "root"), "roots")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("near"))
        joined = labels.join(near, labels["node"] == near["u"]).select("node", "root", F.least("root", "near").alias("low"))
        # The root may by now know a smaller root.
        roots = labels.select(F.col("node").alias("low"), F.col("root").alias("lower"))
        fresh = staged(joined.join(roots, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("lower", "low")).alias("root")), "roots")
        if fresh.where("old <> root").isEmpty():
            return fresh.select("node", "root")
        labels = fresh.select("node", "root")


def joined_roots(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after further links: these are followed between the roots alone. A node without a row is its own root."""
    at = lambda end: F.coalesce(F.col(f"{end}_root"), F.col(end)).alias(end)
    known = edges.join(roots.toDF("u", "u_root"), "u", "left").join(roots.toDF("v", "v_root"), "v", "left")
    merged = components(known.select(at("u"), at("v")))
    nodes = roots.unionByName(merged.join(roots, "node", "left_anti"))
    return staged(nodes.join(merged.toDF("root", "lower"), "root", "left").select("node", F.coalesce("lower", "root").alias("root")), "roots")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    rows = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    bands = bands_for(percent)
    marked = staged(signed(rows, width, bands, ROWS), "signatures")

    # One row per class of equal sets; its smallest id stands for it.
    named = marked.where(F.col("h").isNotNull() & F.col("id").isNotNull())
    classes = named.groupBy("h").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    member = classes.select(F.explode("bands").alias("band"), "h", "rep", "n")
    size = member.groupBy("band").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("h"), "h", "n")).alias("hub"), F.min(F.struct("n", "h")).alias("least"), F.max(F.struct("n", "h")).alias("most")).where("k > 1")
    shared = staged(member.join(size, "band"), "bands")

    close = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = shared.where((F.col("h") != F.col("hub.h")) & close(F.col("n"), F.col("hub.n")))
    pairs = staged(stars.select(*pair(F.col("h"), F.col("hub.h"))).distinct(), "pairs")

    sets = picked_sets(rows, shared.select("rep").distinct(), width)
    links = staged(verified(pairs, sets, percent), "verified")

    rep_of = shared.select("h", "rep").distinct()
    as_nodes = lambda e: e.join(rep_of.toDF("a", "u"), "a").join(rep_of.toDF("b", "v"), "b").select("u", "v")
    same_id = named.groupBy("id").agg(F.count_distinct("h").alias("k")).where("k > 1").select("id")
    twice = named.join(same_id, "id").join(classes.select("h", "rep"), "h").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    roots = components(as_nodes(links).union(twice))
    with_roots = lambda: shared.join(roots, F.col("rep") == F.col("node"), "left").select("band", "h", "n", "least", "most", F.coalesce("root", "rep").alias("root"))

    # Members apart from the smallest or largest set of their band are compared with it.
    placed = with_roots()
    ends = placed.groupBy("band").agg(*(F.max(F.when(F.col("h") == F.col(f"{e}.h"), F.col("root"))).alias(f"{e}_root") for e in ("least", "most")))
    ended = placed.join(ends, "band").select("h", "n", "root", F.explode(F.array(*(F.struct(f"{e}.h", f"{e}.n", F.col(f"{e}_root").alias("root")) for e in ("least", "most")))).alias("end"))
    apart = ended.where((F.col("root") != F.col("end.root")) & close(F.col("n"), F.col("end.n")))
    second = staged(apart.select(*pair(F.col("h"), F.col("end.h"))).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = staged(verified(second, sets, percent), "verified")
    if not links.isEmpty():
        roots = joined_roots(roots, as_nodes(links))

    # What is still apart inside a band is compared in full.
    placed = with_roots()
    counted = placed.groupBy("band", "root").agg(F.count("*").alias("k"))
    main = counted.groupBy("band").agg(F.max(F.struct("k", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", F.col("main.root").alias("main"))
    # Sketches rule out what is too far apart, so that few pairs but links leave the join.
    apart = staged(placed.select("band", "h", "n", "root").join(main, "band").join(sets.select("h", "sketch"), "h"), "apart")
    rest = apart.where("root <> main").select("band", F.col("h").alias("g"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("sketch").alias("sketch_g"))
    once = (F.col("root") != F.col("other")) & ((F.col("root") == F.col("main")) | (F.col("h") < F.col("g")))
    crossed = apart.join(rest, "band").where(once & close(F.col("n"), F.col("m")) & may_reach(F.col("n"), F.col("sketch"), F.col("m"), F.col("sketch_g"), percent))
    fresh = crossed.select(*pair(F.col("h"), F.col("g"))).distinct().join(pairs.union(second), ["a", "b"], "left_anti")
    more = staged(verified(fresh, sets, percent), "verified")
    if not more.isEmpty():
        roots = joined_roots(roots, as_nodes(more))

    by_class = classes.select("h", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("h", F.coalesce("root", "rep").alias("component"))
    out = marked.select("id", "n", "h").join(by_class, "h", "left")
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )

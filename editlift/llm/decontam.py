"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a few megabytes of documents inside a task. Its words become
symbols; words that no benchmark item uses cannot be part of a match, so only
runs of item words, as long as the shortest window at least, are indexed. The
index has the Burrows-Wheeler transform in a wavelet matrix for ranks, and every
16th suffix position. All windows of the items are searched backwards at once as arrays, occurrences are
located by stepping to a sampled position, and their spans are merged. Items
come as broadcast blocks of bounded size, one after the other, against the
same shard; nothing is shuffled.

Cases: null or empty texts have no words and no hits. An item without words has no
window; one of fewer words than a window is one window. Windows that items
share count for each. Items of equal id count once; a null id counts as an empty one. Texts
of any length: a longer text is a shard of its own. No item: nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlift.llm.bpe import gather
from editlift.llm.common import pieces, text_or_empty

WINDOW = 10
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20
SAMPLED = 16

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


class Windows:
    """Distinct windows of a block of items, as symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW) -> None:
        self.symbol: dict[bytes, int] = {}
        known: dict[tuple[int, ...], dict[int, None]] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        for name, text in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                known.setdefault(tuple(ids[k : k + size]), {})[place[name]] = None
        self.length = np.array([len(w) for w in known], dtype=np.int64)
        self.symbols = np.zeros((len(known), size), dtype=np.int64)
        for k, w in enumerate(known):
            self.symbols[k, size - len(w) :] = w  # aligned at the end, where the search begins
        self.owners = np.array([i for v in known.values() for i in v], dtype=np.int64)
        self.owner_count = np.array([len(v) for v in known.values()], dtype=np.int64)
        self.owner_start = np.cumsum(self.owner_count) - self.owner_count


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = []
        for level in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bit = (sequence >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(128 - len(bit) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)
            self.levels.append((level, packed, before, len(bit) - int(bit.sum())))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each end."""
        start = np.zeros_like(end)
        for level, packed, before, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            start, end = (self._step(x, one, packed, before, zeros) for x in (start, end))
        return end - start

    @staticmethod
    def _step(at: np.ndarray, one: np.ndarray, packed: np.ndarray, before: np.ndarray, zeros: int) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = before[word] + np.bitwise_count(packed[word] & mask)
        return np.where(one, zeros + ones, at - ones)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling the length that ranks tell apart; ``text`` ends with a symbol that is smallest and alone."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Symbols 2 and up; 1 separates runs, 0 ends the text."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.ranks = WaveletMatrix(self.bwt, symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.sampled = order % SAMPLED == 0
        self.place = np.cumsum(self.sampled) - self.sampled
        self.positions = order[self.sampled]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each window; zeros before a window are skipped."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.bwt), np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((windows[:, k] > 0) & (low < high))
            symbol = windows[live, k]
            low[live] = self.smaller[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.ranks.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out, back = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            found = self.sampled[rows[open_]]
            done = open_[found]
            out[done] = self.positions[self.place[rows[done]]] + back[done]
            open_ = open_[~found]
            symbol = self.bwt[rows[open_]]
            rows[open_] = self.smaller[symbol] + self.ranks.rank(symbol, rows[open_])
            back[open_] += 1
        return out


def hits_in_shard(docs: list[list[bytes]], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(positions of hit words in the joined shard, unique (document, item) pairs)."""
    nothing = np.empty(0, np.int64), np.empty((0, 2), np.int64)
    if not len(windows.length):
        return nothing
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    find = windows.symbol.get
    symbols = np.fromiter((find(w, 0) for d in docs for w in d), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(docs)), sizes)

    # Runs of item words inside a document, long enough for a window.
    inside = np.flatnonzero(symbols)
    if not len(inside):
        return nothing
    new_run = np.ones(len(inside), dtype=bool)
    new_run[1:] = (np.diff(inside) > 1) | (np.diff(owner[inside]) > 0)
    run = np.cumsum(new_run) - 1
    long_enough = np.bincount(run)[run] >= windows.length.min()
    inside, run = inside[long_enough], run[long_enough]
    if not len(inside):
        return nothing
    run = np.unique(run, return_inverse=True)[1]
    at = np.arange(len(inside)) + run
    text = np.ones(len(inside) + run[-1] + 2, dtype=np.int64)
    text[at] = symbols[inside] + 1
    text[-1] = 0
    origin = np.full(len(text), -1, dtype=np.int64)
    origin[at] = inside

    index = FMIndex(text, len(windows.symbol) + 1)
    low, high = index.search(np.where(windows.symbols > 0, windows.symbols + 1, 0))
    count = np.maximum(high - low, 0)
    places = index.locate(gather(low, count))
    which = np.repeat(np.arange(len(count)), count)
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + windows.length[which], -1)
    hit = origin[np.flatnonzero(np.cumsum(change)[:-1] > 0)]

    pairs = np.unique(owner[origin[places]] * len(count) + which)
    doc, which = pairs // len(count), pairs % len(count)
    item = windows.owners[gather(windows.owner_start[which], windows.owner_count[which])]
    named = np.unique(np.repeat(doc, windows.owner_count[which]) * len(windows.names) + item)
    return hit, np.stack([named // len(windows.names), named % len(windows.names)], axis=1)


class Blocks:
    """The benchmark in broadcast blocks of about ``BLOCK_BYTES``."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> None:
        sc = benchmark.sparkSession.sparkContext
        items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text_or_empty(text_col).alias("text"))
        total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        n = max(1, -(-total // block_bytes))
        block = F.pmod(F.xxhash64("name", "text"), F.lit(n))
        self.parts = [
            sc.broadcast([(r.name, r.text) for r in items.where(block == k).collect()]) for k in range(n)
        ]

    def search(self, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """Per document the merged spans of hit words and the names of its items."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(int(sizes.sum()) + 1, dtype=bool)
        names: list[set[str]] = [set() for _ in docs]
        for part in self.parts:
            windows = self._windows(part)
            hit, pairs = hits_in_shard(docs, windows)
            mark[hit] = True
            for d, i in pairs.tolist():
                names[d].add(windows.names[i])
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        places = np.flatnonzero(mark)
        if len(places):
            owner = np.searchsorted(starts, places, side="right") - 1
            first = np.ones(len(places), dtype=bool)
            first[1:] = (np.diff(places) > 1) | (np.diff(owner) > 0)
            last = np.append(first[1:], True)
            for d, a, b in zip(owner[first].tolist(), places[first].tolist(), places[last].tolist()):
                spans[d].append((a - int(starts[d]), b - int(starts[d]) + 1))
        return spans, [sorted(n) for n in names]

    def _windows(self, part) -> Windows:  # noqa: ANN001
        if len(self.parts) > 1:
            return Windows(part.value)
        if not hasattr(self, "_one"):
            self._one = Windows(part.value)
        return self._one

    def __getstate__(self) -> dict:
        return {"parts": self.parts}


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, spans of hit words, items) for every row; a span is [start, end) in words."""
    blocks = Blocks(benchmark, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SHARD_BYTES):
            docs = [words_of(t) for t in piece.column(1).to_pylist()]
            spans, items = blocks.search(docs)
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array([len(d) for d in docs], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(items, pa.list_(pa.string())),
            ], ["id", "n_words", "spans", "items"])

    rows = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        rows.schema["id"], T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType())),
    ])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what lies between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with benchmark passages cut out of ``text_col``; the other columns stay."""
    blocks, names = Blocks(benchmark, item_col, item_text_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, SHARD_BYTES):
            k = names.index(text_col)
            texts = piece.column(k).to_pylist()
            spans, _ = blocks.search([words_of(t or "") for t in texts])
            fresh = pa.array([cut_spans(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([*piece.columns[:k], fresh, *piece.columns[k + 1 :]], names)

    return df.mapInArrow(run, df.schema)

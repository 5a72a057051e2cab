"""BPE encoding and decoding with an index of pair occurrences.

All distinct pre-tokens of a piece of a partition lie in one linked symbol
array. The index maps the rank of each mergeable pair to all its positions
there. Ranks are applied in ascending order, each at all its positions at
once, and only the lists of the pairs beside a merge are updated. In a
byte-level vocabulary every merge makes a new symbol, whose own pairs have
higher ranks, so this gives each pre-token the result it has alone.

Cases: a null or empty text has no ids; null or empty ids decode to an empty
text; an id outside the vocabulary raises. Repeated rows each keep their own
result. Other columns are not read and cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from editlift.llm.common import PIECE_BYTES, give_back, pieces, text_or_empty

#: The pre-token pattern of the public byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same on texts of these characters alone, where ``re`` has the same classes and is faster.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN_TOKEN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+"
OTHER = r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]"

#: Below this code point all Unicode versions agree on letters, numbers and blanks.
SETTLED = "՗"

SHIFT = 20

#: From so many positions on, a rank is applied to all of them as arrays.
MANY = 128

#: Text whose new pre-tokens share one index.
INDEX_BYTES = 2 << 20
#: Memory of the pre-tokens whose ids a task keeps (strings, table slots and ids, estimated);
#: beyond it the store starts afresh, and it is freed when the task ends.
STORE_BYTES = 64 << 20
#: Estimated bytes of one stored pre-token besides its own characters and ids.
SLOT_BYTES = 120


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, ranks and bytes of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        ids: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.byte_id = [ids[s] for s in symbols]
        self.rank: dict[int, int] = {}
        self.pair: list[tuple[int, int, int]] = []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pair.append((ids[a], ids[b], ids[a + b]))
            self.rank[ids[a] << SHIFT | ids[b]] = r
        self.keys = np.array(sorted(self.rank), dtype=np.int64)
        self.key_rank = np.array([self.rank[k] for k in self.keys.tolist()], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        byte_of = {s: b for b, s in enumerate(symbols)}
        token = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
        token |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(token) + 1
        parts = [token.get(i, b"") for i in range(self.size)]
        self.known = np.array([i in token for i in range(self.size)])
        self.token_len = np.array([len(p) for p in parts], dtype=np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.unsettled = regex.compile(f"[^\x00-{SETTLED}]")
        self.latin, self.other = re.compile(LATIN_TOKEN).findall, re.compile(OTHER)
        self._library = None

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token is one of them."""
        if self.split is None:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not self.other.search(text):
            return self.latin(text)
        if not self.unsettled.search(text):
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lens + 1)])
        at = np.arange(len(flat)) + np.repeat(np.arange(len(words)), lens) + 1
        symbols = np.full(starts[-1] + 1, -1, dtype=np.int64)
        symbols[at] = np.array(self.byte_id, dtype=np.int64)[flat]

        places, ranks = self.mergeable(symbols[:-1], symbols[1:])
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        index = {int(r[0]): p.tolist() for r, p in zip(np.split(ranks, cuts), np.split(places, cuts)) if len(r)}

        afters, befores = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        sym, after, before = memoryview(symbols), memoryview(afters), memoryview(befores)
        active, rank = sorted(index), self.rank
        find, push = rank.get, heapq.heappush
        while active:
            now = heapq.heappop(active)
            a, b, merged = self.pair[now]
            places = index.pop(now)
            if a != b and len(places) >= MANY:
                p = np.array(places)
                p = p[symbols[p] == a]
                p = np.unique(p[symbols[afters[p]] == b])
                q = afters[p]
                n, left = afters[q], befores[p]
                symbols[p], symbols[q], afters[p], befores[n] = merged, -2, n, p
                at_right, right_ranks = self.mergeable(np.full(len(p), merged), symbols[n])
                at_left, left_ranks = self.mergeable(symbols[left], np.full(len(p), merged))
                where = np.concatenate([p[at_right], left[at_left]])
                found = np.concatenate([right_ranks, left_ranks])
                order = np.argsort(found, kind="stable")
                found, where = found[order], where[order].tolist()
                edges = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(where)]
                for start, end in zip(edges, edges[1:]):
                    if start == end:
                        continue
                    r = int(found[start])
                    if r in index:
                        index[r] += where[start:end]
                    else:
                        index[r] = where[start:end]
                        push(active, r)
                continue
            if a == b:
                places.sort()  # overlapping pairs are taken from the left
            for p in places:
                if sym[p] != a:
                    continue
                q = after[p]
                if sym[q] != b:
                    continue
                n = after[q]
                sym[p] = merged
                sym[q] = -2
                after[p] = n
                before[n] = p
                x = sym[n]
                if x >= 0:
                    r = find(merged << SHIFT | x)
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            push(active, r)
                left = before[p]
                x = sym[left]
                if x >= 0:
                    r = find(x << SHIFT | merged)
                    if r is not None:
                        if r in index:
                            index[r].append(left)
                        else:
                            index[r] = [left]
                            push(active, r)
        owner = np.repeat(np.arange(len(words)), lens)[symbols[at] >= 0]
        return symbols[symbols >= 0], np.bincount(owner, minlength=len(words))

    def mergeable(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair has a rank, and the ranks."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pair = np.where((first >= 0) & (second >= 0), first << SHIFT | second, -1)
        slot = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[slot] == pair)
        return places, self.key_rank[slot[places]]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def word_store(path: str) -> WordStore:
    return WordStore(vocabulary(path))


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1, .. of each run, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


class WordStore:
    """Ids of the pre-tokens seen so far in a task."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.count = np.empty(0, np.int32), np.empty(0, np.int64)
        self.bytes = 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        words: list[str] = []
        ends = []
        for text in texts:
            words += self.vocab.pre_tokens(text or "")
            ends.append(len(words))
        if self.bytes > STORE_BYTES:
            self.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.place]
        special = self.vocab.special
        if fresh:
            plain = [w for w in fresh if w not in special]
            for w in plain:
                self.place[w] = len(self.place)
            ids, count = self.vocab.merge([w.encode() for w in plain]) if plain else (np.empty(0), np.empty(0))
            named = [w for w in fresh if w in special]
            for w in named:
                self.place[w] = len(self.place)
            self.ids = np.concatenate([self.ids, ids, [special[w] for w in named]]).astype(np.int32)
            self.count = np.concatenate([self.count, count, np.ones(len(named))]).astype(np.int64)
            self.bytes += sum(map(len, fresh)) + SLOT_BYTES * len(fresh) + 12 * int(np.sum(count))
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        start = np.cumsum(self.count) - self.count
        length = self.count[at]
        total = np.concatenate([[0], np.cumsum(length)])
        edges = total[np.concatenate([[0], ends]).astype(np.int64)]
        return self.ids[gather(start[at], length)], edges


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): every whole text as the vocabulary at path ``tokenizer`` encodes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_store(tokenizer)
        try:
            for piece in pieces(batches, "text", INDEX_BYTES):
                ids, edges = store.encode(piece.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["id", "ids"])
        finally:
            # The worker process outlives the task: its words go with the task.
            store.clear()
            give_back()

    rows = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", keep: bool = False) -> DataFrame:
    """(id, text), with ``keep`` (id, ids, text): the bytes of the ids read as UTF-8, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from decoded(vocabulary(tokenizer), batches)
        finally:
            give_back()

    def decoded(vocab: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(PIECE_BYTES / 4 * batch.num_rows / max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                lists = piece.column(1)
                sizes = np.array([n or 0 for n in pc.list_value_length(lists).to_pylist()])
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= vocab.size or not vocab.known[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                length = vocab.token_len[ids]
                raw = vocab.token_bytes[gather(vocab.token_start[ids], length)].tobytes()
                total = np.concatenate([[0], np.cumsum(length)])
                edges = total[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([*piece.columns[: 1 + keep], pa.array(texts, pa.string())], names)

    rows = df.select(df[id_col].alias("id"), df[ids_col].cast("array<int>").alias("ids"))
    names = ["id", "ids", "text"] if keep else ["id", "text"]
    schema = T.StructType([*rows.schema.fields[: 1 + keep], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

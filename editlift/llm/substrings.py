"""Removal of byte strings that an earlier document has as well.

A 50-byte string of a document goes if it also starts in a document with a smaller id.

1. Anchors: of every 35 consecutive 16-byte strings the one with the least hash, so that equal
   50-byte strings have equal anchors at equal offsets. A task packs the anchors of a
   few megabytes by bucket of the hash; an anchor that several documents there share is sent
   once. Buckets answer which anchors other documents have too.
2. Around each shared anchor a window of 84 bytes is sent to the anchor's bucket; of equal
   windows of a task only that of the smallest id is sent, since the others are found.
3. In a bucket the windows form a collection of aligned strings, whose Burrows-Wheeler transform
   is built column by column from the right: each round inserts one symbol per window, deals
   the order of the column anew by that symbol, and updates the common prefixes of
   neighbours from the least one in between. Equal strings are aligned at their
   anchor, so suffixes of other columns need not be kept. Runs of
   neighbours with 50 common bytes are equal strings; the smallest id of a run tells who keeps it.
4. Found strings go back to their documents and are merged to spans.

Buckets are as many as the input asks for, so a bucket's windows lie in memory; their
files are Spark's shuffle files, read once in sequence. The columns are built for some anchors of the bucket at a time.

Cases: null or empty text has nothing to remove, as has a text below 50 bytes. A null id is
neither smaller nor larger than others: its text stays whole. Rows of equal id are one document
each way: none is smaller. Texts of any length: all steps are linear in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.llm.common import give_back, pieces, text_or_empty

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
LEFT = SPAN - 1
WIDTH = LEFT + LENGTH
BUCKET_BYTES = 16 << 20
#: Windows put in order at once, some 600 bytes each; those of one anchor stay together.
WINDOWS = 1 << 16
PIECE = 8 << 20

#: Kinds of packed rows.
ANCHORS, SHARED, OWNERS = 0, 1, 2

PACKED = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
PACKED_DDL = "bucket long, piece long, kind int, data binary"
FOUND = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
FOUND_DDL = "bucket long, kind int, data binary"
MARKS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("starts", pa.binary())])
MARKS_DDL = "id long, th long, starts binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length and their types, compressed; numbers by byte planes, windows as text."""
    head = f"{len(arrays[0])};{','.join(a.dtype.str for a in arrays)};".encode()
    body = b"".join(
        a.tobytes() if a.dtype.kind == "V" else np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays
    )
    return zstandard.ZstdCompressor(level=3).compress(head + body)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, kinds, body = raw.split(b";", 2)
    n, at, out = int(n), 0, []
    for kind in kinds.decode().split(","):
        size = np.dtype(kind).itemsize
        if kind[1] == "V":
            out.append(np.frombuffer(body, kind, n, at))
            at += n * size
            continue
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return best(values[:-rest], values[rest:]) if rest else values


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text's bytes."""
    if len(raw) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    eight = np.lib.stride_tricks.as_strided(raw, shape=(len(raw) - 7, 8), strides=(1, 1))
    word = np.ascontiguousarray(eight).view(np.uint64).ravel()
    h = (word[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ (word[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    order = (h >> np.uint64(32)).astype(np.uint32)
    least = slide(order, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint32)
    # Chosen if it is the least of some window, that is of the window with the greatest least.
    chosen = np.flatnonzero(slide(np.concatenate([edge, least, edge]), SPAN, np.maximum) == order)
    return chosen, h[chosen]


class Piece:
    """Some documents of a task: all anchors, with the document and number of each."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.raw = [np.frombuffer(t.encode(), np.uint8) for t in batch.column(2).to_pylist()]
        found = [anchors(r) for r in self.raw]
        counts = [len(p) for p, _ in found]
        self.owner = np.repeat(np.arange(len(found)), counts)
        self.place = np.concatenate([p for p, _ in found]) if found else np.empty(0, np.int64)
        self.hash = np.concatenate([h for _, h in found]) if found else np.empty(0, np.uint64)
        self.first = np.cumsum(counts) - counts
        self.number = np.arange(len(self.owner)) - np.repeat(self.first, counts)


def groups(order: np.ndarray, same: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, least and greatest value) of the runs of an order; ``same`` tells which equal their predecessor."""
    starts = np.flatnonzero(~same)
    v = values[order]
    return starts, np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)


def split_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part):
            yield int(key[part[0]]), part


def pack_anchors(buckets: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            p = Piece(batch)
            if not len(p.hash):
                continue
            name = int((p.ids[0] * 1_000_003 ^ p.hashes.sum() ^ len(p.ids)) & 0x7FFFFFFFFFFFFFFF)
            rows = []
            order = np.argsort(p.hash, kind="stable")
            same = np.zeros(len(order), dtype=bool)
            same[1:] = p.hash[order][1:] == p.hash[order][:-1]
            starts, low, high = groups(order, same, p.ids[p.owner])
            several = np.empty(len(order), dtype=bool)
            several[order] = np.repeat(low < high, np.diff(np.append(starts, len(order))))
            lead = np.zeros(len(order), dtype=bool)
            lead[order[starts]] = True
            send = np.flatnonzero(~several | lead)
            # An anchor that is known to be shared only shows itself, under no number.
            number = np.where(several, 0xFFFFFFFF, p.number).astype(np.uint32)
            for b, part in split_by((p.hash[send] % np.uint64(buckets)).astype(np.int64)):
                at = send[part]
                rows.append((b, name, ANCHORS, packed(p.hash[at], p.owner[at].astype(np.uint32), number[at], p.ids[p.owner[at]])))
            home = name % buckets
            known = np.flatnonzero(several)
            if len(known):
                rows.append((home, name, SHARED, packed(p.owner[known].astype(np.uint32), p.number[known].astype(np.uint32))))
            rows.append((home, name, OWNERS, packed(p.ids, p.hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)

    return run


def answer(table: pa.Table) -> pa.Table:
    """What a bucket knows of its anchors: rows of the pieces, the other kinds as they came."""
    kinds = np.array(table["kind"].to_pylist())
    names = np.array(table["piece"].to_pylist(), dtype=np.int64)
    data = table["data"].to_pylist()
    keep = [(0, int(names[k]), int(kinds[k]), data[k]) for k in np.flatnonzero(kinds != ANCHORS)]
    mine = np.flatnonzero(kinds == ANCHORS)
    if len(mine):
        parts = [unpacked(data[k]) for k in mine]
        hashes, owner, number, ids = (np.concatenate(c) for c in zip(*parts))
        source = np.repeat(np.arange(len(mine)), [len(x[0]) for x in parts])
        order = np.argsort(hashes, kind="stable")
        same = np.zeros(len(order), dtype=bool)
        same[1:] = hashes[order][1:] == hashes[order][:-1]
        starts, low, high = groups(order, same, ids)
        silent = np.maximum.reduceat((number == 0xFFFFFFFF)[order].astype(np.int8), starts) > 0
        shared = np.empty(len(order), dtype=bool)
        shared[order] = np.repeat((low < high) | silent, np.diff(np.append(starts, len(order))))
        at = np.flatnonzero(shared & (number != 0xFFFFFFFF))
        for k, part in split_by(source[at]):
            rows = at[part]
            keep.append((0, int(names[mine[k]]), SHARED, packed(owner[rows], number[rows])))
    if not keep:
        return PACKED.empty_table()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*keep), PACKED)], schema=PACKED)


def to_documents(table: pa.Table) -> pa.Table:
    """(id, th, numbers of shared anchors) of a piece's documents."""
    kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
    ids, hashes = unpacked(next(d for d, k in zip(data, kinds) if k == OWNERS))
    parts = [unpacked(d) for d, k in zip(data, kinds) if k == SHARED]
    if not parts:
        return MARKS.empty_table()
    owner, number = (np.concatenate(c) for c in zip(*parts))
    rows = [(int(ids[o]), int(hashes[o]), packed(np.sort(number[part]))) for o, part in split_by(owner.astype(np.int64))]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MARKS)], schema=MARKS)


def windows_of(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` symbols per place: bytes plus one, 0 outside the text."""
    padded = np.concatenate([np.zeros(LEFT, np.uint16), raw.astype(np.uint16) + np.uint16(1), np.zeros(LENGTH, np.uint16)])
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[places]


def pack_windows(buckets: int):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE // 4):
            p = Piece(batch)
            wanted = [unpacked(x)[0].astype(np.int64) for x in batch.column(3).to_pylist()]
            at = np.concatenate([p.first[d] + w for d, w in enumerate(wanted)])
            if not len(at):
                continue
            symbols = np.concatenate([windows_of(p.raw[d], p.place[p.first[d] + w]) for d, w in enumerate(wanted)])
            owner, place, ids = p.owner[at], p.place[at], p.ids[p.owner[at]]
            h = symbols.view(np.uint64).reshape(len(at), -1)
            key = np.zeros(len(at), np.uint64)
            for c in range(h.shape[1]):
                key = (key ^ h[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            order = np.lexsort((ids, key))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (key[order][1:] == key[order][:-1]) & (symbols[order[1:]] == symbols[order[:-1]]).all(axis=1)
            starts = np.flatnonzero(~same)
            least = np.empty(len(at), np.int64)
            least[order] = np.repeat(ids[order[starts]], np.diff(np.append(starts, len(order))))
            rows = []
            known = np.flatnonzero(least < ids)
            sizes = np.array([len(r) for r in p.raw])[owner[known]]
            first, last = np.maximum(place[known] - LEFT, 0), np.minimum(place[known], sizes - LENGTH)
            rows += marked(buckets, p.ids[owner[known]], p.hashes[owner[known]], first, last)
            # Of one document's equal windows all are sent: each must hear of other documents.
            send = np.flatnonzero(least == ids)
            for b, part in split_by((p.hash[at[send]] % np.uint64(buckets)).astype(np.int64)):
                k = send[part]
                inner = (symbols[k] - np.uint16(1)).astype(np.uint8)  # outside becomes 255, told apart by the two edges
                before = np.minimum(place[k], LEFT).astype(np.uint8)
                after = np.minimum(np.array([len(p.raw[o]) for o in owner[k]]) - place[k], LENGTH).astype(np.uint8)
                rows.append((b, ANCHORS, packed(inner.reshape(-1).view(f"V{WIDTH}"), before, after, p.ids[owner[k]], p.hashes[owner[k]], place[k].astype(np.uint32))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)

    return run


def marked(buckets: int, ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (bucket of the document, kind, packed) of runs of starts."""
    whole = np.flatnonzero(first <= last)
    return [
        (b, SHARED, packed(ids[k], hashes[k], first[k].astype(np.uint32), last[k].astype(np.uint32)))
        for b, part in split_by(hashes[whole] % buckets) for k in [whole[part]]
    ]


def column_wise(columns: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window and start in it: is the 50-byte string there also in a document of a smaller id?

    ``columns`` has a row per column and a symbol per window, 0 outside the text.
    """
    width, m = columns.shape
    found = np.zeros((SPAN, m), dtype=bool)
    order = np.arange(m)
    prefix = np.zeros(m, dtype=np.uint8)  # common symbols with the predecessor, up to LENGTH
    for column in range(width - 1, -1, -1):
        symbol = columns[column][order]  # the transform's column in the present order
        deal = np.argsort(symbol, kind="stable")
        dealt = symbol[deal]
        # Neighbours of one symbol were apart: the least prefix in between, the own one included.
        tables, have = [prefix], 1
        while 2 * have <= m:
            tables.append(np.minimum(tables[-1][:-have], tables[-1][have:]))
            have *= 2
        start, end = deal[:-1] + 1, deal[1:] + 1
        equal = (dealt[1:] == dealt[:-1]) & (dealt[1:] > 0)
        reach = np.where(equal, end - start, 1)
        level = np.frexp(reach)[1] - 1
        fresh = np.zeros(m, dtype=np.uint8)
        for k in np.unique(level[equal]):
            rows = np.flatnonzero(equal & (level == k))
            t = tables[k]
            fresh[rows + 1] = np.minimum(np.minimum(t[start[rows]], t[end[rows] - (1 << int(k))]) + 1, LENGTH)
        order, prefix = order[deal], fresh
        if column < SPAN:
            runs = np.flatnonzero(prefix < LENGTH)
            dealt_ids = ids[order]
            least = np.repeat(np.minimum.reduceat(dealt_ids, runs), np.diff(np.append(runs, m)))
            found[column, order] = least < dealt_ids
    return found


def of_anchor(inner: np.ndarray) -> np.ndarray:
    """A number of each window's anchor; windows of different anchors have no aligned string in common."""
    gram = np.ascontiguousarray(inner.view(np.uint8).reshape(-1, WIDTH)[:, LEFT : LEFT + GRAM]).view(np.uint64)
    h = gram[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ gram[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(31)


def aligned(inner: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Rows of about ``limit`` windows at a time; the windows of one anchor stay together."""
    anchor = of_anchor(inner)
    order = np.argsort(anchor, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(anchor[order])) + 1, len(order))
    start = 0
    while start < len(order):
        # The last end within the limit, or else the next one.
        k = max(np.searchsorted(ends, start + limit, side="right") - 1, np.searchsorted(ends, start, side="right"))
        yield order[start : ends[k]]
        start = int(ends[k])


def find_equal(buckets: int, limit: int = WINDOWS):  # noqa: ANN201
    def run(table: pa.Table) -> pa.Table:
        """Rows for the documents' buckets: runs of starts whose strings an earlier document has."""
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        home = table["bucket"].to_pylist()
        rows = [(b, k, d) for b, k, d in zip(home, kinds, data) if k == SHARED]
        parts = [unpacked(d) for d, k in zip(data, kinds) if k == ANCHORS]
        del data
        if parts:
            inner, before, after, ids, hashes, place = (np.concatenate(c) for c in zip(*parts))
            del parts
            at = np.arange(WIDTH, dtype=np.int16)[:, None] - np.int16(LEFT)
            runs = []
            for k in aligned(inner, limit):
                columns = inner[k].view(np.uint8).reshape(-1, WIDTH).T.astype(np.uint16)
                columns += np.uint16(1)
                columns[(at < -before[k].astype(np.int16)) | (at >= after[k].astype(np.int16))] = 0
                edged = np.zeros((len(k), SPAN + 2), dtype=np.int8)
                edged[:, 1:-1] = column_wise(columns, ids[k]).T
                step = np.diff(edged, axis=1)
                window, first = np.nonzero(step > 0)
                last = np.nonzero(step < 0)[1] - 1
                window = k[window]
                origin = place[window].astype(np.int64) - LEFT
                runs.append((ids[window], hashes[window], origin + first, origin + last))
            rows += marked(buckets, *(np.concatenate(c) for c in zip(*runs)))
            give_back()
        if not rows:
            return FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)

    return run


def by_document(table: pa.Table) -> pa.Table:
    """(id, th, runs) of a bucket of documents; a document is named by its id and the hash of its text."""
    ids, hashes, first, last = (np.concatenate(c) for c in zip(*map(unpacked, table["data"].to_pylist())))
    order = np.lexsort((first, hashes, ids))
    ids, hashes, first, last = ids[order], hashes[order], first[order], last[order]
    edges = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(hashes) != 0)) + 1).tolist(), len(ids)]
    rows = [(int(ids[a]), int(hashes[a]), packed(first[a:b], last[a:b])) for a, b in zip(edges, edges[1:])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MARKS)], schema=MARKS)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of covered bytes and what remains."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in pieces(batches, "text", PIECE // 2):
        sizes, spans, kept = [], [], []
        for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            sizes.append(len(raw))
            if not marks:
                spans.append([])
                kept.append(raw)
                continue
            begin, last = (x.astype(np.int64) for x in unpacked(marks))
            reach = np.maximum.accumulate(last + LENGTH)
            apart = np.flatnonzero(begin[1:] > reach[:-1])
            first, last = begin[np.concatenate([[0], apart + 1])], reach[np.append(apart, len(reach) - 1)]
            spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist())])
            edges = [0, *(x for ab in zip(first.tolist(), last.tolist()) for x in ab), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) for every row; spans are [start, end) in bytes, ``kept`` the other bytes."""
    rows = df.select(df[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    # Both joins take the same rows in the same shape, so that texts are dealt out once.
    texts = rows.where(F.col("id").isNotNull()).select("id", "th", "text")
    answers = texts.mapInArrow(pack_anchors(buckets), PACKED_DDL).groupBy("bucket").applyInArrow(answer, PACKED_DDL)
    shared = answers.groupBy("piece").applyInArrow(to_documents, MARKS_DDL).dropDuplicates(["id", "th"])
    windows = texts.join(shared, ["id", "th"]).select("id", "th", "text", "starts").mapInArrow(pack_windows(buckets), FOUND_DDL)
    found = windows.groupBy("bucket").applyInArrow(find_equal(buckets), FOUND_DDL)
    marks = found.groupBy("bucket").applyInArrow(by_document, MARKS_DDL)
    whole = texts.join(marks, ["id", "th"], "left").select("id", "text", "starts")
    unnamed = rows.where(F.col("id").isNull()).select("id", "text", F.lit(None).cast("binary").alias("starts"))
    return whole.unionByName(unnamed).mapInArrow(
        cut, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    ).withColumnRenamed("id", id_col)

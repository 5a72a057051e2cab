"""Prefix trie of conversations: one node per distinct sequence of first turns.

Input rows are (conv_id, turn, role, text). A conversation's turns are ordered by ``turn`` (null
first; ties by role, then text), and a null role or text is the empty string. A node at depth d is a
distinct sequence of d turns (role, text), the root is the empty sequence, and the members of a node
are the conversations that start with it. Per node the trie reports its smallest member, its
parent's, members, children, childless nodes in its subtree (itself included), the tokens a shared
prefix saves (summed over its subtree: each node's ``(n_convs - 1) * code points of its last text``),
and the conversations that end at it.

Method: a turn is named by two independent 64-bit hashes of (role, text) and a node by a 128-bit chain
of them, so equal keys of different prefixes are not expected at any size. Conversations are range-
sharded on their turn names with ``conv_id`` last, so a hot prefix, even one shared by a third of all
conversations, is spread over many shards; within a shard, rows arrive sorted by Spark's external sort.
Per depth, a change mask OR-accumulated over the columns so far marks where nodes start, and
``reduceat`` aggregates every node of that depth at once (members, smallest member, whether any goes
on). Subtree sums run bottom-up from children to parents inside the shard. Only nodes that touch a
shard's first or last row can span shards; they are recombined by key in one small aggregation, their
subtree sums completed through their boundary descendants, and their children counted once.

Memory per task is linear in the shard's turns (ragged columns, not a padded matrix). The digest of
the conversations ending at a node hashes their ids in order, so it is one sequential pass per node;
the ids themselves stay rows (``ends``) until then.

Cases: rows with a null ``conv_id`` belong to no conversation and are left out; an empty table
gives the root alone only if some conversation exists, else no node. Repeated rows are repeated turns.
Very long texts and conversations are handled whole. Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.llm.common import staged
from editlift.session import broadcast_if_small, ship_package

#: Shards of the range partitioning; None takes ``spark.sql.shuffle.partitions``.
SHARDS = None

_OUT = (
    "kind int, k1 long, k2 long, depth long, p1 long, p2 long, cnt long, minc long, pminc long, longer boolean, "
    "last_len long, children long, inner_saved long, inner_leaves long, boundary boolean, y1 long, y2 long, conv long, ends_sha256 string"
)
NODE, END, ANCESTOR = 0, 1, 2

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(k: np.ndarray, a: np.ndarray, b: np.ndarray, c0: np.uint64, c1: np.uint64, c2: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (k * c0) ^ a
        x = (x ^ (x >> np.uint64(30))) * c1
        x = x ^ b
        x = (x ^ (x >> np.uint64(27))) * c2
        return x ^ (x >> np.uint64(31))


def ordered_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in turn order, null turn first."""
    rows = convs.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"),
                            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _names(turns: Column) -> tuple[Column, Column]:
    path = F.transform(turns, lambda t: F.struct(F.xxhash64(F.lit(1), t["role"], t["text"]).alias("a"), F.xxhash64(F.lit(2), t["role"], t["text"]).alias("b")))
    return path, F.transform(turns, lambda t: F.length(t["text"]).cast("long"))


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    table = pa.Table.from_batches(list(batches))
    if table.num_rows == 0:
        return
    table = table.combine_chunks()
    conv = table.column("conv_id").to_numpy()
    path = table.column("path").chunk(0)
    off = path.offsets.to_numpy().astype(np.int64)
    fa = path.values.field("a").to_numpy().view(np.uint64)
    fb = path.values.field("b").to_numpy().view(np.uint64)
    lens = table.column("lens").chunk(0)
    lens_off = lens.offsets.to_numpy().astype(np.int64)
    fl = lens.values.to_numpy()
    n = len(conv)
    length = np.diff(off)
    last = n - 1

    k1 = np.zeros(n, np.uint64)
    k2 = np.zeros(n, np.uint64)
    chg = np.zeros(n, bool)
    chg[0] = True
    depths = []  # per depth: dict of node arrays
    # Root: every row.
    depths.append(dict(r0=np.array([0]), r1=np.array([last]), cnt=np.array([n]), minc=np.array([conv.min()]),
                       longer=np.array([bool((length > 0).any())]), last_len=np.array([0]), k1=np.zeros(1, np.uint64),
                       k2=np.zeros(1, np.uint64), p1=np.zeros(1, np.uint64), p2=np.zeros(1, np.uint64), pos=np.array([0]), idx=np.arange(n)))
    alive = np.arange(n)
    d = 0
    while True:
        d += 1
        alive = alive[length[alive] >= d]
        if alive.size == 0:
            break
        idx = alive
        at = off[idx] + d - 1
        a, b = fa[at], fb[at]
        prev = idx - 1
        has_prev = prev >= 0
        prev_c = np.where(has_prev, prev, 0)
        prev_ok = has_prev & (length[prev_c] >= d)
        prev_at = off[prev_c] + np.where(prev_ok, d - 1, 0)
        same = prev_ok & (fa[np.minimum(prev_at, len(fa) - 1)] == a) & (fb[np.minimum(prev_at, len(fb) - 1)] == b)
        change = chg[idx] | ~same
        chg[idx] = change
        p1, p2 = k1[idx], k2[idx]
        k1[idx] = _mix(p1, a, b, _C[0], _C[1], _C[2])
        k2[idx] = _mix(p2, b, a, _C[3], _C[4], _C[5])
        pos = np.flatnonzero(change)
        stop = np.append(pos[1:], idx.size)
        r0, r1 = idx[pos], idx[stop - 1]
        depths.append(dict(
            r0=r0, r1=r1, cnt=stop - pos, minc=np.minimum.reduceat(conv[idx], pos),
            longer=np.add.reduceat((length[idx] > d).astype(np.int64), pos) > 0, last_len=fl[lens_off[r0] + d - 1],
            k1=k1[r0], k2=k2[r0], p1=p1[pos], p2=p2[pos], pos=pos, idx=idx,
        ))

    # Bottom-up: children per node and subtree sums over nodes complete in this shard.
    nd = len(depths)
    for level in depths:
        level["boundary"] = (level["r0"] == 0) | (level["r1"] == last)
        own_saved = (level["cnt"] - 1) * level["last_len"]
        own_leaf = (~level["longer"]).astype(np.int64)
        level["sub_saved"] = np.where(level["boundary"], 0, own_saved).astype(np.int64)
        level["sub_leaf"] = np.where(level["boundary"], 0, own_leaf).astype(np.int64)
        level["children"] = np.zeros(level["r0"].size, np.int64)
        level["pminc"] = np.zeros(level["r0"].size, np.int64)
    for d in range(nd - 1, 0, -1):
        child, parent = depths[d], depths[d - 1]
        up = np.searchsorted(parent["r0"], child["r0"], side="right") - 1
        parent["children"] += np.bincount(up, minlength=parent["r0"].size)
        # Children are in row order, so those of one parent are adjacent: exact integer sums by reduceat.
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
        parent["sub_saved"][up[first]] += np.add.reduceat(child["sub_saved"], first)
        parent["sub_leaf"][up[first]] += np.add.reduceat(child["sub_leaf"], first)
        child["pminc"] = parent["minc"][up]

    def batch(**cols) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        full = {}
        for field in pa.schema([pa.field(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]]) for f in _OUT.split(", ")]):
            v = cols.get(field.name)
            full[field.name] = pa.nulls(size, field.type) if v is None else pa.array(v, field.type)
        return pa.RecordBatch.from_pydict(full)

    def signed(x: np.ndarray) -> np.ndarray:
        return x.view(np.int64)

    for d, level in enumerate(depths):
        m = level["r0"].size
        # Conversations ending here: rows of this depth's nodes whose length is d.
        idx, pos = level["idx"], level["pos"]
        ending = length[idx] == d
        node_of = np.repeat(np.arange(m), np.diff(np.append(pos, idx.size)))
        digests = np.array([hashlib.sha256(b"").hexdigest()] * m, dtype=object)
        end_rows, end_nodes = idx[ending], node_of[ending]
        inner_nodes = ~level["boundary"][end_nodes]
        if inner_nodes.any():
            e_conv, e_node = conv[end_rows[inner_nodes]], end_nodes[inner_nodes]
            order = np.lexsort((e_conv, e_node))
            e_conv, e_node = e_conv[order], e_node[order]
            cuts = np.flatnonzero(np.diff(e_node)) + 1
            for group_conv, node in zip(np.split(e_conv, cuts), e_node[np.append(0, cuts)]):
                digests[node] = hashlib.sha256(",".join(map(str, group_conv.tolist())).encode()).hexdigest()
        digests[level["boundary"]] = None
        yield batch(
            kind=np.full(m, NODE, np.int32), k1=signed(level["k1"]), k2=signed(level["k2"]), depth=np.full(m, d, np.int64),
            p1=None if d == 0 else signed(level["p1"]), p2=None if d == 0 else signed(level["p2"]), cnt=level["cnt"].astype(np.int64),
            minc=level["minc"].astype(np.int64), pminc=None if d == 0 else level["pminc"], longer=level["longer"],
            last_len=level["last_len"].astype(np.int64), children=level["children"], inner_saved=level["sub_saved"],
            inner_leaves=level["sub_leaf"], boundary=level["boundary"], ends_sha256=digests.tolist(),
        )
        bnd = ~inner_nodes
        if bnd.any():
            yield batch(kind=np.full(int(bnd.sum()), END, np.int32), k1=signed(level["k1"][end_nodes[bnd]]), k2=signed(level["k2"][end_nodes[bnd]]),
                        conv=conv[end_rows[bnd]].astype(np.int64))
    # Boundary nodes with each boundary ancestor (themselves included), along the first and last row.
    for row in {0, last}:
        chain = [(int(lv["k1"][j]), int(lv["k2"][j])) for lv in depths for j in np.flatnonzero(lv["boundary"] & (lv["r0"] <= row) & (lv["r1"] >= row))]
        xs, ys = [], []
        for j, y in enumerate(chain):
            for x in chain[: j + 1]:
                xs.append(x)
                ys.append(y)
        xa, ya = np.array(xs, np.uint64).reshape(-1, 2), np.array(ys, np.uint64).reshape(-1, 2)
        yield batch(kind=np.full(len(xs), ANCESTOR, np.int32), k1=signed(xa[:, 0].copy()), k2=signed(xa[:, 1].copy()),
                    y1=signed(ya[:, 0].copy()), y2=signed(ya[:, 1].copy()))


def prefix_trie(conversations: DataFrame, shards: int | None = SHARDS) -> DataFrame:
    """One row per node: ``node1, node2`` (key), ``depth, parent1, parent2, conv_id, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` (rebuilt conversations may be given)."""
    spark = conversations.sparkSession
    ship_package(spark)
    turns = conversations if "turns" in conversations.columns and "turn" not in conversations.columns else ordered_turns(conversations)
    return trie_of_turns(turns, shards)


def trie_of_turns(turns: DataFrame, shards: int | None = SHARDS) -> DataFrame:
    spark = turns.sparkSession
    ship_package(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, lens = _names(F.col("turns"))
    named = turns.select("conv_id", path.alias("path"), lens.alias("lens"))
    sharded = named.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = staged(sharded.mapInArrow(_shard_nodes, _OUT), "trie-parts")
    nodes = parts.where(F.col("kind") == NODE).drop("y1", "y2", "conv")
    inner = nodes.where(~F.col("boundary")).select(
        F.col("k1").alias("node1"), F.col("k2").alias("node2"), "depth", F.col("p1").alias("parent1"), F.col("p2").alias("parent2"),
        F.col("minc").alias("conv_id"), F.col("pminc").alias("parent_conv_id"), F.col("cnt").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("inner_leaves").alias("n_leaves"), F.col("inner_saved").alias("saved_tokens"), "ends_sha256",
    )
    edge = staged(
        nodes.where("boundary").groupBy("k1", "k2").agg(
            F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.sum("cnt").alias("cnt"),
            F.min("minc").alias("minc"), F.max("longer").alias("longer"), F.first("last_len").alias("last_len"),
            F.sum("children").alias("children"), F.sum("inner_saved").alias("inner_saved"), F.sum("inner_leaves").alias("inner_leaves"),
            F.count("*").alias("shards"),
        ),
        "trie-boundary",
    )
    own = edge.select(
        F.col("k1").alias("y1"), F.col("k2").alias("y2"), ((F.col("cnt") - 1) * F.col("last_len")).alias("own_saved"),
        (~F.col("longer")).cast("long").alias("own_leaf"),
    )
    links = parts.where(F.col("kind") == ANCESTOR).select("k1", "k2", "y1", "y2").distinct()
    below = links.join(own, ["y1", "y2"]).groupBy("k1", "k2").agg(F.sum("own_saved").alias("b_saved"), F.sum("own_leaf").alias("b_leaf"))
    split_children = edge.where(F.col("p1").isNotNull()).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum(F.col("shards") - 1).alias("extra"))
    parents = edge.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("minc").alias("pmin"))
    ends = parts.where(F.col("kind") == END).groupBy("k1", "k2").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("conv")), ","), 256).alias("digest"))
    bounded = (
        edge.join(below, ["k1", "k2"], "left").join(split_children, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left")
        .join(parents, ["p1", "p2"], "left")
        .select(
            F.col("k1").alias("node1"), F.col("k2").alias("node2"), "depth", F.col("p1").alias("parent1"), F.col("p2").alias("parent2"),
            F.col("minc").alias("conv_id"), F.col("pmin").alias("parent_conv_id"), F.col("cnt").alias("n_convs"),
            (F.col("children") - F.coalesce("extra", F.lit(0))).alias("n_children"),
            (F.col("inner_leaves") + F.coalesce("b_leaf", F.lit(0))).alias("n_leaves"),
            (F.col("inner_saved") + F.coalesce("b_saved", F.lit(0))).alias("saved_tokens"),
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
    # Parents of inner nodes may lie on a boundary: their smallest member comes from the recombined nodes.
    lookup = broadcast_if_small(edge.select(F.col("k1").alias("parent1"), F.col("k2").alias("parent2"), F.col("minc").alias("bmin")))
    inner = inner.join(lookup, ["parent1", "parent2"], "left").withColumn("parent_conv_id", F.coalesce("bmin", "parent_conv_id")).drop("bmin")
    return inner.unionByName(bounded).select(
        "node1", "node2", "depth", "parent1", "parent2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


def rebuilt(convs: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The query's conversations: the first h turns of conversation c - c % group, then c's own after its first h;
    h = crc32(decimal c) % heads. A conversation without rows contributes no turns."""
    own = ordered_turns(convs)
    base = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", h).join(base, "_base", "left")
    head = F.filter(F.coalesce("_head", F.array().cast(own.schema["turns"].dataType)), lambda t, i: i < F.col("_h"))
    rest = F.filter("turns", lambda t, i: i >= F.col("_h"))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))

"""Line dedup, conversation trie and spelling variants against brute force on small cases."""

from __future__ import annotations

import hashlib

import pytest

from editlift.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = "A line that many documents share"
LINE_DOCS = [
    (1, f"intro one\n{SHARED}\n{SHARED}\nshort"), (2, f"  {SHARED.upper()}  \nother text here"), (3, None), (4, ""),
    (2, f"  {SHARED.upper()}  \nother text here"), (None, f"{SHARED}\nonly in null ids x"), (None, "only in null ids x"),
    (5, "\n".join(f"line number {k % 50}" for k in range(3000))), (6, "line number 7\nline number 7"), (7, "ÄÖÜ line éé long"),
    (0, "\t\r\x0b" + "ÄÖÜ line éé long"), (8, "nine char"), (9, "nine char"),
]


def brute_lines(rows, min_chars=10):
    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars and i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        keep = [p for p in parts if not (key(p) in first and (i is None or first[key(p)] < i))]
        out.append((i, len(parts), len(parts) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (8, 3)])
def test_line_dedup_as_brute_force(spark, batches, fanout):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in LINE_DOCS], "doc_id long, text string, kept string, n_lines int").repartition(3)
    got = lines.dedup_lines(df, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]
    rows = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()), key=repr)
    assert rows == brute_lines(LINE_DOCS)


def test_line_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).count() == 0


def brute_variants(rows, min_chars=6, min_count=5, ratio=5):
    import re
    import zlib

    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            counts[w] = counts.get(w, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        s, t = (a, b) if len(a) < len(b) else (b, a)
        return any(t[:k] + t[k + 1:] == s for k in range(len(t)))

    out, form = [], {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o)) if others else None
        form[w] = best if best is not None and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.append((w, f, root, n, sum(near(w, o) for o in words), words[f] if f else None))
    return sorted(out, key=repr)


VARIANT_DOCS = [
    (1, " ".join(["colour"] * 30 + ["color"] * 3 + ["colours"] * 6 + ["Colourr"] * 5 + ["kolour"] * 5)),
    (2, "Grüßen grüßen GRÜSSEN " * 6 + "abcdefg abcdefh abcdefi abcdefj " * 5 + "tiebreak tiebreaks tiebraek"),
    (3, None), (4, ""), (None, "colour colour colour zzzzzz " * 7 + "x" * 5000), (1, "colour tiebreaks " * 5),
    (5, " ".join(f"word{k}" for k in range(50))), (7, "mainland " * 125 + "mainlandx " * 25 + "Mainlandxy " * 5), (6, "variants variant variantz varianta " * 5 + "variants " * 30),
] + [(100 + k, "perturbation perturbation something everything") for k in range(400)]


def test_spelling_variants_as_brute_force(spark):
    from editlift.llm import variants

    df = spark.createDataFrame([(i, t, 1) for i, t in VARIANT_DOCS], "doc_id long, text string, word long").repartition(3)
    got = variants.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_variants(VARIANT_DOCS)
    assert variants.spelling_variants(df.limit(0)).count() == 0


def brute_trie(convs):
    """convs: {conv_id: [(role, text), ...]} -> sorted node rows."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def subtree(key):
        kids = children.get(key, [])
        leaves = sum(subtree(k)[0] for k in kids) if kids else 1
        saved = (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(subtree(k)[1] for k in kids)
        return leaves, saved

    out = []
    for key, members in nodes.items():
        leaves, saved = subtree(key)
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children.get(key, [])), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def conv_rows(convs):
    rows = []
    for c, turns in convs.items():
        rows += [(c, k, r, t, "x") for k, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_trie_as_brute_force(spark, shards):
    from editlift.llm import trie

    hot = [("user", "hello there"), ("assistant", "hi, how can I help?")]
    convs = {k: hot + [("user", f"question {k % 4}")] + ([("assistant", "é" * (k % 3))] if k % 2 else []) for k in range(40)}
    convs |= {100: hot, 101: hot[:1], 102: [("user", "x" * 5000)], 103: [("assistant", "")], 104: [("", "")], -5: hot + hot}
    rows = conv_rows(convs) + [(None, 0, "user", "lost", "x"), (105, None, None, None, "x"), (105, 3, "user", "after null", "x")]
    convs[105] = [("", ""), ("user", "after null")]
    # A repeated row is a repeated turn; equal turn numbers are ordered by role, then text.
    rows += [(7, 0, "user", "hello there", "x")]
    convs[7] = [hot[0]] + convs[7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").repartition(4)
    got = trie.prefix_trie(df, shards=shards)
    got = got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(convs)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_of_rebuilt_conversations(spark):
    import zlib

    from editlift.llm import trie

    convs = {c: [("user", f"t{c}-{k}") for k in range(c % 7)] for c in [0, 1, 2, 3, 50, 99, 100, 101, 150, 203, 299]}
    df = spark.createDataFrame(conv_rows(convs), "conv_id long, turn long, role string, text string, depth string")
    want = {}
    for c in (c for c in convs if convs[c]):
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + convs[c][h:]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in trie.rebuilt(df).collect()}
    assert got == want
    nodes = trie.prefix_trie(trie.rebuilt(df), shards=3).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r) for r in nodes.collect()), key=repr) == brute_trie(want)

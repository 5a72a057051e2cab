"""Small cases of each operator against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import re
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from editlift.llm import bpe, common, decontam, licenses, minhash, quality, secrets, substrings, toxicity, urls, warc
from editlift.llm.tokenizers import BYTE_BPE

BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix strong potions for a tired old king near the river bank today"
TEXTS = [
    (1, BASE + " and sleeps"), (2, BASE + " and sleeps"), (3, BASE + " and rests"), (4, ""), (5, None), (6, "one two"), (7, "One  TWO"),
    (8, "Grüße 漢字 <|endoftext|> it's 123 \t x\x1cy ² \U0001f600 ԱԲՙ"), (9, "a" * 3000), (10, "\n\n" + BASE.upper()),
    (11, " ".join(f"w{k}" for k in range(4000))), (2, BASE + " and sleeps"), (None, BASE + " and sleeps"), (12, "x " * 400),
]
DDL = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", 7, 8, 9) for i, t in TEXTS]
    return spark.createDataFrame(rows, DDL + ", lang string, source string, id long, n long, h long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bpe_as_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    encoded = bpe.encode(docs, BYTE_BPE)
    got = rows_of(bpe.decode(encoded, BYTE_BPE, keep=True))
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.encode(empty, BYTE_BPE).count() == 0


def test_bpe_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), BYTE_BPE).collect()


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, width, percent):
    ids = sorted({i for i, _ in TEXTS if i is not None})
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in TEXTS:
            for j, b in TEXTS:
                x, y = shingles(a, width), shingles(b, width)
                if i and j and x and y and 100 * len(x & y) >= percent * len(x | y) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    want = [(i, len(shingles(t, width)), root.get(i), i is not None and root[i] == i) for i, t in TEXTS]
    assert rows_of(minhash.near_duplicates(docs, width=width, percent=percent)) == sorted(want, key=repr)
    assert minhash.near_duplicates(empty).count() == 0


def test_chain_of_copies_is_one_component(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(100 + k, " ".join([f"x{j}" for j in range(k)] + words[k:])) for k in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DDL), width=3, percent=85).collect()
    sets = {i: shingles(t, 3) for i, t in rows}
    linked = all(100 * len(sets[i] & sets[i + 1]) >= 85 * len(sets[i] | sets[i + 1]) for i in list(sets)[:-1])
    assert linked and {r.component_id for r in got} == {100}


def test_leaks(docs, empty, spark):
    items = [(1, BASE[:80]), (2, "one two"), (3, None), (4, "..."), (5, BASE[:80]), (None, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"), (5, BASE[:80])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if c in string.ascii_uppercase else c for c in t or "")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    want = []
    for i, t in TEXTS:
        w = word.findall(low(t))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    names |= found
                    hit.update(range(k, k + n))
        want.append((i, len(w), len(hit), sorted(names)))
    found = decontam.find_leaks(docs, bench).collect()
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontam.find_leaks(empty, bench).count() == 0
    assert all(not r.spans for r in decontam.find_leaks(docs, bench.limit(0)).collect())
    cut = decontam.remove_leaks(docs, bench)
    assert cut.columns == docs.columns
    assert not [r for r in decontam.find_leaks(cut, bench.where("item_id = 1")).collect() if r.spans]


def test_leaks_in_blocks(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, BASE[:80]), (2, "one two"), (3, "x x x")], "item_id long, text string")
    whole = rows_of(decontam.find_leaks(docs, bench))
    blocks = decontam.Blocks(bench, "item_id", "text", block_bytes=1)
    assert len(blocks.parts) > 1
    spans, items = blocks.search([decontam.words_of(t or "") for _, t in TEXTS])
    assert sorted(((i, s, n) for (i, _), s, n in zip(TEXTS, spans, items)), key=repr) == sorted(
        ((r[0], [tuple(s) for s in r[2]], r[3]) for r in whole), key=repr)


def removed(texts):
    out = []
    for i, t in texts:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        if i is not None:
            seen = {(o or "").encode()[k : k + 50] for j, o in texts if j is not None and j < i for k in range(len((o or "").encode()) - 49)}
            for k in range(len(raw) - 49):
                if raw[k : k + 50] in seen:
                    mark[k : k + 50] = b"\x01" * 50
        runs = sum(1 for k in range(len(raw)) if mark[k] and (k == 0 or not mark[k - 1]))
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out.append((i, len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_bytes(docs, empty, spark):
    digest = lambda d: d.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256))
    assert rows_of(digest(substrings.remove_repeats(docs))) == removed(TEXTS)
    assert substrings.remove_repeats(empty).count() == 0
    mixed = [(k, "zz" * k + BASE[k % 7 : 90 + k] + "\x00é" * (k % 3) + BASE[:49] + str(k)) for k in range(40)]
    assert rows_of(digest(substrings.remove_repeats(spark.createDataFrame(mixed, DDL).repartition(5)))) == removed(mixed)


def test_bucket_of_many_windows_in_bounded_memory():
    m, width = 60_000, substrings.WIDTH
    rng = np.random.default_rng(7)
    inner = rng.integers(97, 123, (m // 3, width), dtype=np.uint8)
    inner = np.concatenate([inner, inner, inner])
    inner[::5, 0] = 64  # near copies
    inner[: m // 6] = inner[0]  # and one large group
    edge = lambda n: np.full(m, n, np.uint8)
    data = substrings.packed(
        inner.reshape(-1).view(f"V{width}"), edge(substrings.LEFT), edge(substrings.LENGTH), rng.permutation(m), np.arange(m), np.full(m, 34, np.uint32)
    )
    rows = pa.table({"bucket": [0], "kind": pa.array([substrings.ANCHORS], pa.int32()), "data": [data]})
    found, peaks = [], []
    for limit in (2000, m):
        tracemalloc.start()
        out = substrings.find_equal(1, limit)(rows)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found.append(sorted(zip(*(x.tolist() for d in out["data"].to_pylist() for x in substrings.unpacked(d)))))
    assert found[0] == found[1] and len(found[0]) > m // 3
    assert peaks[0] < peaks[1] / 2


def test_quality_counts(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(docs).collect()}
    for i, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        hit = {k + j for k, x in enumerate(three) if three.count(x) > 1 for j in range(3)} if len(words) < 1000 else set()
        r = got[(i, len(words))]
        assert (r.word_chars, r.n_repeat_words) == (sum(map(len, words)), len(hit))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(empty).count() == 0


def test_quality_rejects_what_stands_out(spark):
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(words[k % 9 :] + [str(k)]), "en", "a") for k in range(300)] + [(900, " ".join(w + "%%%" for w in words), "en", "a")]
    got = quality.quality_rules(spark.createDataFrame(rows, DDL + ", lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {900}


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 60
    rows = [(5, "http://a/\r\nX: y", long), (3, None, long), (3, "u", long), (9, "u", "short"), (8, "u", "short"), (7, "u", None), (None, "u", long),
            (1, "u", "WARC/1.1\r\n\r\n" * 20 + "\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.resolve_revisits(warc.digested(pages)), str(tmp_path / "w"), "2020-01-01T00:00:00Z", records_per_file=2)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    payload = {r.page_id: bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert payload[1].decode() == rows[-1][2] and payload[3].decode() == long and payload[7] == b""
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.resolve_payloads(records).collect()}
    full = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == {
        (i, *(("revisit", 3) if t == long and i != 3 else ("response", None)), *full(t)) for i, _, t in rows
    }
    warc.write_archives(warc.resolve_revisits(warc.digested(pages.limit(0))), str(tmp_path / "e"))
    assert warc.resolve_payloads(warc.read_archives(spark, str(tmp_path / "e"))).count() == 0


def test_url_rules_and_verdicts(spark):
    rows = [(k, f"http://good{k % 50}.example.com/a/{k}") for k in range(400)] + [(1000 + k, f"https://spam{k % 50}.net/es/{k}") for k in range(400)]
    odd = [(1, None), (2, ""), (3, "HTTP://WWW.Example.COM/en/x?y"), (4, "http://x.example.com/en/1"), (5, "http://com"), (6, "http://notcom/"), (7, "good1.example.com/a/5"), (8, "spam3.net/es/77")]
    df = spark.createDataFrame([(i + 5000, u) for i, u in odd] + rows, "page_id long, url string").withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert len(got) == 808
    assert [got[5000 + k].rule for k in (1, 2, 3, 4, 5, 6)] == [None, None, "www.example.com/en/", "example.com/en/", None, None]
    assert (got[5003].host, got[5003].path, got[5003].verdict) == ("www.example.com", "/en/x", "allow")
    assert (got[5007].verdict, got[5008].verdict) == ("allow", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_licenses_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", mit), ("a/b/c/x.py", "print(1)"), ("a/b/COPYING", gpl), ("a/b/d/e/y.py", None), ("z/w.py", ""), (None, "text"),
        ("q.py", f"# {mit}\n" + "code\n" * 500), ("long.py", "license " + "word " * 5000), ("a/b/c/x.py", "print(1)"), ("/LICENSE.txt", "nothing known"),
    ]
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[k].license for k in range(10)] == ["MIT", "GPL-3.0", "GPL-3.0", "GPL-3.0", None, None, "MIT", None, "GPL-3.0", None]
    assert [got[k].origin for k in (0, 1, 4, 6)] == ["notice", "inherited", None, "notice"]
    assert got[3].license_path == "a/b/COPYING"
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_licenses_in_prose_and_wrapped_headers(spark):
    prose = "we wrote this small tool over some years and it does nothing of note"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n"
    apache = "// Licensed under the Apache License, Version 2.0\n"
    texts = [
        (f"{prose} Released under the MIT License. {prose}", "MIT"), (f"{prose} Licensed under the Apache License, Version 2.0. {prose}", "Apache-2.0"),
        (gpl + "import os\n" * 50, "GPL-3.0"), (gpl.replace("version 3", "version 2"), "GPL-2.0"), (mpl + "int main() {}\n", "MPL-2.0"),
        ("Copyright (c) 2020 Jane Doe. All rights reserved.", "proprietary"), ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("SPDX-License-Identifier: Nobody-1.0", None), (f"{prose} no license {prose} under the terms of {prose}", None), (apache + prose, "Apache-2.0"),
    ]
    whole = [(p.stem, p.read_text()) for p in sorted(licenses.TEXTS.glob("*.txt"))]
    texts += [(f"Copyright (c) 2021, A. N. Other\nAll rights reserved.\n\n{text}", name) for name, text in whole]
    df = spark.createDataFrame([(k, None, t) for k, (t, _) in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.license_scan(df).collect()}
    assert [got[k] for k in range(len(texts))] == [name for _, name in texts]


def test_secrets(spark):
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'some words token = "{key(k)}" and more words here') for k in range(60)]
    rows += [(100 + k, f"number {10**15 + k * 7919} of a thing and hyphen-ated-words-2-be-long {k}") for k in range(60)]
    rows += [(200, None), (201, ""), (202, f'api_key = "{key(7)}" ' + "w " * 20000 + f'x token = "{key(7)}"'), (None, f'token = "{key(9)}"')]
    df = spark.createDataFrame(rows, DDL).withColumn("nth", F.lit(1)).withColumn("path", F.lit(None).cast("string"))
    found = secrets.secret_scan(df.drop("nth"), path_col="path")
    got = [(r.doc_id, r.candidate) for r in found.where("secret").collect()]
    want = [(k, key(k)) for k in range(60)] + [(202, key(7)), (202, key(7)), (None, key(9))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = {r.doc_id: r.text for r in secrets.redact(df, "doc_id", "text", found).collect()}
    assert clean[3] == 'some words token = "<SECRET>" and more words here' and clean[100] == rows[60][1] and clean[200] is None
    assert clean[202].count("<SECRET>") == 2 and len(clean[202]) > 40000
    assert secrets.secret_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [200_000, 3])
def test_secret_dictionary_of_all_texts(spark, monkeypatch, few):
    name = lambda k: "word" + "".join(chr(97 + int(x)) for x in str(k))
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("plain text").alias("text"))
    rare = [(20_000 + 2 * k + j, f"{name(k)} here") for k in range(30) for j in range(2)] + [(30_000, "wordzzz once")]
    tokens = [(40_000, " ".join(f"{name(k)}-0123456789-abc" for k in range(30)) + " wordzzz-0123456789")]
    df = df.unionByName(spark.createDataFrame(rare + tokens, "doc_id long, text string"))
    seen, described = [], secrets.described
    monkeypatch.setattr(secrets, "FEW_WORDS", few, raising=False)
    monkeypatch.setattr(secrets, "described", lambda found, words: seen.append(words) or described(found, words))
    secrets.secret_scan(df)
    got = {r.word for r in seen[0].collect()}
    assert {name(k) for k in range(30)} | {"wordzzz"} <= got and "abc" not in got


def test_toxicity_on_held_out_texts(spark):
    seeds = [w for s in toxicity.SEEDS.values() for w in s]
    calm = ["river", "stone", "light", "paper", "green", "seven", "cloud", "table"]
    text = lambda k: " ".join(calm[(k * p) % 8] for p in (1, 3, 5, 7, 2)) + f" n{chr(97 + k % 26)}{chr(97 + k // 26)}"
    rows = [(k, text(k) + (f" {seeds[k % 10]} {seeds[k // 3 % 10]}" if k % 3 == 0 else "")) for k in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, DDL).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(5, 0), (7777, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.fit_chain(docs, labels).score(docs).collect()
    assert len(got) == 402
    wrong = [r.doc_id for r in got if r.toxic != (r.doc_id < 400 and r.doc_id % 3 == 0)]
    assert len(wrong) <= 4
    none = toxicity.fit_chain(docs, labels.limit(0)).score(docs.limit(3)).collect()
    assert len(none) == 3 and not any(r.toxic for r in none)


def test_toxic_stems_no_list_has(spark):
    calm = ["river", "stone", "light", "paper", "green", "seven", "cloud", "table"]
    ends = ["en", "ung", "heit", "isch", "lich", "bar", "sam", "los", "ig", "haft", "tum", "nis", "ling", "chen", "lein", "er", "el", "e"]
    text = lambda k: " ".join(calm[(k * p) % 8] for p in (1, 3, 5, 7, 2)) + f" n{chr(97 + k % 26)}{chr(97 + k // 26)}"
    rows = [(k, text(k) + (f" grumpf{ends[k % 18]}{ends[k // 18 % 18]}" if k % 3 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, DDL)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = toxicity.fit_chain(docs, labels).score(docs).collect()
    assert len([r for r in got if r.toxic != (r.doc_id % 3 == 0)]) <= 4


def test_links_of_a_large_group_of_near_copies(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(120)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    compared, full = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *rest: (compared.append(pairs.count()), full(pairs, *rest))[1])
    got = minhash.near_duplicates(docs, width=3, percent=85).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 120
    assert sum(compared) < 15 * len(rows)


def test_batches_for_python_workers_are_bounded(spark):
    common.staged(spark.range(1), "bound")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    big = spark.range(400).select(F.repeat(F.lit("x"), 50_000).alias("text")).coalesce(1)
    assert max(r.n for r in big.mapInArrow(sizes, "n long").collect()) < 8 << 20


def test_toxicity_plans_hold_no_attribute_per_word(spark, monkeypatch):
    letter = string.ascii_lowercase
    clean = [f"report{letter[k % 7]} about river{letter[k % 11]} and town{letter[k % 5]}" for k in range(60)]
    rows = [(k, t + (" you idiot scum disgusting" if k % 3 == 0 else "")) for k, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    seen = []

    def stage(df, name, *schema):
        seen.append(common.staged(df, name, *schema))
        return seen[-1]

    monkeypatch.setattr(toxicity, "staged", stage)
    chain = toxicity.fit_chain(docs, labels)
    assert not [f.name for df in seen for f in df.schema if f.metadata]
    # The closed form over the columns is the model on the filled vector.
    rows = toxicity.vectors(chain.vocabulary, docs.select("doc_id", toxicity.words(F.col("text")).alias("words")))
    expected = {}
    for name, model in chain.models.items():
        expected[name] = {r.doc_id: r.p for r in model.transform(rows).select("doc_id", vector_to_array("_prob")[1].alias("p")).collect()}
        if name in toxicity.SLOT:
            filled = toxicity.predicted(rows, model, name)
            rows = common.staged(filled, "filled", toxicity.vector_schema(filled.schema))
    for r in chain.score(docs).collect():
        assert all(abs(r[f"p_{c}"] - expected[c][r.doc_id]) < 1e-8 for c in expected)

import random
import re

from editlift.operators import batches, cleantext, spans
from editlift.plans import queries


def brute(tokens, refs):
    flagged, last = set(), {}
    for d, r in refs:
        before = [t for k, t in tokens if k == d and t <= r]
        last[(d, r)] = max(before) if before else None
        if before:
            flagged.add((d, max(before)))
    return flagged, last


def check(spark, tokens, refs, block):
    t = spark.createDataFrame(tokens, "doc_id long, tok_start int")
    r = spark.createDataFrame(refs, "doc_id long, ref_pos int")
    flagged, last = brute(set(tokens), set(refs))
    got = spans.flag_tokens(t, r, block=block).collect()
    assert {(x["doc_id"], x["tok_start"]): x["reference"] for x in got} == {k: k in flagged for k in set(tokens)}
    got = spans.token_of_reference(t, r, block=block).collect()
    assert {(x["doc_id"], x["ref_pos"]): x["tok_start"] for x in got} == last
    assert sum(x["n_refs"] for x in got) == len(refs)


def test_as_of_across_blocks(spark):
    rng = random.Random(1)
    tokens = sorted({(d, rng.randrange(300)) for d in range(4) for _ in range(25)})
    refs = [(rng.randrange(5), rng.randrange(320)) for _ in range(80)]
    for block in (3, 17, 1 << 16):
        check(spark, tokens, refs, block)


def test_one_document_holds_most(spark):
    rng = random.Random(2)
    tokens = sorted({(0, rng.randrange(5000)) for _ in range(600)} | {(d, 4) for d in range(1, 20)})
    refs = [(0, rng.randrange(5000)) for _ in range(300)] + [(3, 2), (3, 4), (3, 4)]
    check(spark, tokens, refs, 64)


def test_rank_of_any_ids(spark):
    rng = random.Random(3)
    ids = [0, -1, 5, 2**62, -(2**62), 2**22, 2**44, 2**44 + 1] + [rng.randrange(-(2**63), 2**63) for _ in range(500)] + list(range(100, 400))
    df = spark.createDataFrame([(i,) for i in ids + ids[:50] * 20], "id long")
    got = {r["id"]: r["rank"] for r in batches.global_rank(df, "id").collect()}
    assert got == {i: n for n, i in enumerate(sorted(set(ids)))}


def test_batches(spark):
    df = spark.range(7, 130)
    got = {r["batch"]: (r["n"], r["ids"]) for r in batches.id_batches(df, "id", 50).collect()}
    assert [got[k][0] for k in sorted(got)] == [50, 50, 23]
    assert got[0][1] == "|".join(str(i) for i in range(7, 57))


def test_running_starts(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 1, 0), (1, 2, 4), (2, 0, 5)], "rev_id long, pos int, length int")
    got = {(r["rev_id"], r["pos"]): r["start"] for r in spans.running_starts(df, "rev_id", length="length").collect()}
    assert got == {(1, 0): 0, (1, 1): 3, (1, 2): 3, (2, 0): 0}


def test_close_ids_fill_many_windows(spark):
    assert batches.last_digit(None, None) == batches.DIGIT
    assert batches.last_digit(0, 2**62) == batches.DIGIT
    assert batches.last_digit(7, 7) == 0
    ids = list(range(1_000_000, 1_030_000, 3))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    digit = batches.last_digit(min(ids), max(ids))
    assert len({i >> digit for i in ids}) > 400
    got = {r["id"]: r["rank"] for r in batches.global_rank(df, "id").collect()}
    assert got == {i: n for n, i in enumerate(ids)}


def test_rank_of_no_ids(spark):
    df = spark.createDataFrame([(None,)], "id long")
    assert batches.global_rank(df, "id").count() == 0


def test_tokens_cover_the_text(spark):
    texts = {1: "Caf\u00e9s  are 2nd.\n(x)", 2: "  \t", 3: "", 4: None, 5: "\U0001f600 a"}
    df = spark.createDataFrame(list(texts.items()), "rev_id long, text string")
    rows = spans.tokens_of(df, "rev_id").orderBy("rev_id", "tok_start").collect()
    assert [r["token"] for r in rows if r["rev_id"] == 1] == ["Caf\u00e9s", "are", "2nd", ".", "(", "x", ")"]
    assert {r["rev_id"] for r in rows} == {1, 5}
    assert all(texts[r["rev_id"]][r["tok_start"]:].startswith(r["token"]) for r in rows)


def test_text_queries_scan_and_place_once(spark, sf):
    """Each text is scanned once, and rows and blocks of the fill share one exchange of the events."""
    for name in ("j7_text_references", "j6_flagged_text"):
        df = queries.QUERIES[name](spark, sf)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in text, name
        final = text.split("Initial Plan")[0]
        assert "ReusedExchange" in final, name
        assert len(re.findall(r"REPARTITION_BY_COL", final.split("ReusedExchange")[0])) == 1, name


def test_scanned_once_is_the_same(spark):
    texts = {1: "a <ref>x</ref> b {{ref|y}}\n== H ==\nc [[L|m]]", 2: "", 3: None, 4: "<ref>z</ref>"}
    df = spark.createDataFrame(list(texts.items()), "rev_id long, wikitext string")
    text, references = cleantext.text_and_references(df, "rev_id")
    assert sorted(text.collect()) == sorted(cleantext.clean_text(df, "rev_id").collect())
    assert sorted(references.collect()) == sorted(cleantext.reference_offsets(df, "rev_id").collect())
    assert references.count() == 3


def test_tokens_are_placed_without_a_shuffle(spark):
    """Starts come from the row, also across the parts they are read in, and equal the running lengths."""
    rng = random.Random(6)
    letters = "ab1 \t\n\x0b.,é́一​ \x01\U0001f600\U00020000\U00020001\U0001d400'"
    texts = {i: "".join(rng.choice(letters) for _ in range(rng.randrange(40))) for i in range(60)}
    texts |= {100: "x" * 9_000 + " y", 101: "".join(rng.choice(letters) for _ in range(12_500)), 102: None, 103: "", 104: " \n", 105: "\U00020000b " * 3_000}
    df = spark.createDataFrame(list(texts.items()), "rev_id long, text string").cache()
    got = spans.tokens_of(df, "rev_id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, spans._tokens_by_window(df, "rev_id", text_col="text").collect()))
    assert got.schema["tok_start"].dataType.typeName() == "long"
    assert all(texts[r["rev_id"]][r["tok_start"]:].startswith(r["token"]) for r in rows)


def test_texts_of_one_key_are_counted_on(spark):
    data = [(1, "a b"), (1, "a b"), (None, "c d"), (None, "c d"), (2, "e f"), (3, None), (3, " ")]
    df = spark.createDataFrame(data, "rev_id long, text string")
    want = sorted(map(repr, spans._tokens_by_window(df, "rev_id", text_col="text").collect()))
    assert sorted(map(repr, spans.tokens_of(df, "rev_id").collect())) == want and len(want) == 10

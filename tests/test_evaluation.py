import random

import pytest

from editlift.operators import evaluation as V


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    return [(y, min(5, max(0, y + rng.choice([-2, -1, 0, 0, 0, 1, 3])))) for y in (rng.choice([0, 0, 0, 1, 3, 4, 5]) for _ in range(400))]


@pytest.fixture(scope="module")
def df(spark, pairs):
    return spark.createDataFrame(pairs, "actual int, pred int")


def cumulated(k):
    return [int(k <= c) for c in range(6)]


def ordinal(y, p):
    return sum(a == b for a, b in zip(cumulated(y)[:5], cumulated(p)[:5])) / 5


def ordinal_from_one(y, p):
    # Columns 1..5 of the cumulated rows.
    return sum(a == b for a, b in zip(cumulated(y)[1:], cumulated(p)[1:])) / 5


def test_hit_rates(df, pairs):
    row = V.hit_rates(df).first()
    n = len(pairs)
    assert row["exact_hit"] == pytest.approx(sum(sum((y == c) == (p == c) for c in range(6)) / 6 for y, p in pairs) / n)
    assert row["ordinal_hit"] == pytest.approx(sum(ordinal_from_one(y, p) for y, p in pairs) / n)
    assert row["ordinal_score"] == pytest.approx(1 - sum(abs(y - p) / 5 for y, p in pairs) / n)


def test_all_pairs_closed_form(spark):
    grid = [(y, p) for y in range(6) for p in range(6)]
    df = spark.createDataFrame(grid, "actual int, pred int")
    got = df.select("actual", "pred", V.ordinal_hit(df.actual, df.pred).alias("o")).collect()
    assert all(r["o"] == pytest.approx(ordinal_from_one(r["actual"], r["pred"])) for r in got)
    assert all(r["o"] >= (r["actual"] == r["pred"]) for r in got)


def test_report(df, pairs):
    for r in V.class_report(df).collect():
        k = r["class_code"]
        mine, theirs = [(y, p) for y, p in pairs if y == k], [(y, p) for y, p in pairs if p == k]
        for name, rows in (("recall", mine), ("precision", theirs)):
            if rows:
                assert r[f"{name}_exact"] == pytest.approx(sum(y == p for y, p in rows) / len(rows))
                assert r[name] == pytest.approx(sum(ordinal_from_one(y, p) for y, p in rows) / len(rows))
            else:
                assert r[name] is None and r[f"{name}_exact"] is None
        assert (r["n"] or 0) == len(mine)


def test_class_never_seen(spark):
    df = spark.createDataFrame([(0, 1), (1, 1)], "actual int, pred int")
    rows = {r["class_code"]: r for r in V.class_report(df).collect()}
    assert len(rows) == 6 and rows[0]["precision"] is None and rows[0]["recall_exact"] == 0.0
    assert rows[1]["precision_exact"] == 0.5


def test_confusion_is_whole(df, pairs):
    cells = V.confusion(df).collect()
    assert len(cells) == 36 and sum(c["n"] for c in cells) == len(pairs)
    for r in V.confusion_matrix(df).collect():
        total = sum(r[f"p{k}"] for k in range(6))
        assert total == pytest.approx(1.0) or (r["actual"] == 2 and total == 0)


def test_unknown_codes_count_nowhere(spark):
    from editlift.operators import evaluation

    df = spark.createDataFrame([(1, 1), (2, 2), (None, 3), (3, None), (9, 1)], "actual int, pred int")
    row = evaluation.hit_rates(df).first()
    assert (row.exact_hit, row.ordinal_hit, row.ordinal_score) == (1.0, 1.0, 1.0)
    assert evaluation.unknown_pairs(df).first().unknown == 3

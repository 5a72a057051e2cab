import math
import random

from pyspark.sql import functions as F

from editlift.functions import labels as L
from editlift.functions import probability as P


def test_chain_against_logs(spark):
    rng = random.Random(3)
    rows = [[rng.random() for _ in range(5)] for _ in range(200)] + [[0.0] * 5, [1.0] * 5, [1, 0, 1, 0, 1.0]]
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in rows], ", ".join(f"q{k} double" for k in range(5)))
    prob = P.chain_array([F.col(f"q{k}") for k in range(5)])
    got = df.select(prob.alias("p"), *[f"q{k}" for k in range(5)]).select(
        "*", P.median_code(F.col("p"), 6).alias("m"), P.modal_code(F.col("p")).alias("o"), P.expected_code(F.col("p"), 6).alias("e")
    ).collect()
    for r in got:
        q = [r[f"q{k}"] for k in range(5)]
        want = []
        for k in range(6):
            log = sum(math.log(x) if x > 0 else -math.inf for x in q[:k])
            log += (math.log(1 - q[k]) if q[k] < 1 else -math.inf) if k < 5 else 0.0
            want.append(math.exp(log))
        assert all(abs(a - b) < 1e-12 for a, b in zip(r["p"], want))
        assert abs(sum(r["p"]) - 1) < 1e-9
        assert 0 <= r["m"] <= 5
        assert r["o"] == r["p"].index(max(r["p"]))
        assert abs(r["e"] - sum(k * p for k, p in enumerate(want))) < 1e-12


def test_labels(spark):
    df = spark.createDataFrame([("Stub",), ("FA",), ("List",), (None,)], "l string")
    got = df.select(L.label_code(F.col("l")), L.next_label(F.col("l")), L.code_label(L.label_code(F.col("l")))).collect()
    assert [tuple(r) for r in got] == [(0, "Start", "Stub"), (5, None, "FA"), (None, None, None), (None, None, None)]


def test_display_names(spark):
    df = spark.createDataFrame([("GA",), ("List",), ("xyz",)], "l string")
    assert [r[0] for r in df.select(L.display_name(F.col("l"))).collect()] == ["Good article", "List", None]


def test_percent(spark):
    df = spark.createDataFrame([(0.025,), (0.035,), (0.005,), (0.015,)], "p double")
    assert [r[0] for r in df.select(P.percent(F.col("p"))).collect()] == [2, 4, 0, 2]

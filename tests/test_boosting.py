import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from editlift.ml import boosting, selection
from editlift.ml.projection import ModelProjection
from editlift.operators.features import RAW_COLUMNS

SPACE = {"maxIter": [3], "maxDepth": [2, 3], "minInstancesPerNode": [1, 6], "minInfoGain": [0.0, 0.01], "stepSize": [0.1, 0.3]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(240):
        code = rng.randrange(3)
        raw = [rng.randrange(1, 60) + 12 * code * (n % 3 == 0) for n, c in enumerate(RAW_COLUMNS)]
        data.append((i, code, *raw))
    return spark.createDataFrame(data, ["rev_id", "code", *RAW_COLUMNS]).withColumn("code", F.col("code").cast("int")).cache()


def search(rows, n=3, space=SPACE):
    return selection.random_search(rows, space=space, n=n, folds=2, classifier=GBTClassifier(seed=1))


def test_search_together_is_the_search_one_by_one(rows, monkeypatch):
    together = search(rows)
    monkeypatch.setattr(selection, "boosted_losses", lambda *a: None)
    single = search(rows)
    assert together.avgMetrics == pytest.approx(single.avgMetrics, abs=1e-9)
    assert together.stdMetrics == pytest.approx(single.stdMetrics, abs=1e-9)
    probs = [r["prob"] for r in together.bestModel.transform(rows).orderBy("rev_id").collect()]
    assert probs == [r["prob"] for r in single.bestModel.transform(rows).orderBy("rev_id").collect()]
    assert selection.best_classifier(together, GBTClassifier()).getMaxDepth() == selection.best_classifier(single, GBTClassifier()).getMaxDepth()


def test_jobs_do_not_grow_with_the_draws(spark, rows):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    space, taken = {"maxIter": [2], "maxDepth": [2]}, []
    for n in (1, 8):
        before = scheduler.numTotalJobs()
        search(rows, n=n, space=space)
        taken.append(scheduler.numTotalJobs() - before)
    assert taken[1] <= taken[0] + 5, taken


def fits(spark, rows, settings, block):
    dealt = selection.stratified_folds(rows, 2, fold_col="_fold")
    frame = ModelProjection().transform(dealt).select(F.col("code").alias("label"), F.col("_fold").alias("fold"), vector_to_array("features"))
    counts = {(r["fold"], r["label"]): r["count"] for r in frame.groupBy("fold", "label").count().collect()}
    boosting_search = boosting.Search(frame, counts, settings, 32, block, 1)
    boosting_search.fit()
    q = {(r["draw"], r["fold"], r["label"], tuple(round(v, 9) for v in r["q"])) for r in boosting_search.scored().collect()}
    trees = boosting_search.trees
    boosting_search.close()
    return trees, q


def test_rows_in_many_blocks_give_the_same_trees(spark, rows, monkeypatch):
    settings = [boosting.Setting(5, 0.1, 1, 0.0, 1.0, 30, 3), boosting.Setting(3, 0.3, 4, 0.001, 1.0, 30, 2)]
    trees, q = fits(spark, rows, settings, 1000)
    monkeypatch.setattr(boosting, "REBASE", 2)
    many, q_many = fits(spark, rows, settings, 37)
    assert {k: len(v) for k, v in trees.items()} == {((f, k), d): settings[d].rounds for f in (0, 1) for k in (0, 1) for d in (0, 1)}
    for key in trees:
        for a, b in zip(trees[key], many[key]):
            assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
            assert np.allclose(a.value, b.value, atol=1e-9)
    assert len(q ^ q_many) <= len(q) // 20


def test_a_part_of_the_rows_and_features(spark, rows):
    settings = [boosting.Setting(3, 0.1, 1, 0.0, 0.5, 4, 2)]
    for block in (1000, 50):
        trees, _ = fits(spark, rows, settings, block)
        roots = {t.feature[0] for of_fit in trees.values() for t in of_fit}
        assert len(roots) > 1 and max(t.depth for of_fit in trees.values() for t in of_fit) == 2


def test_settings_of_the_learner():
    learner = GBTClassifier(maxIter=7, stepSize=0.2, minInstancesPerNode=3, minInfoGain=0.5, subsamplingRate=0.8, featureSubsetStrategy="0.9", maxDepth=4)
    assert boosting.setting_of(learner, 30) == (7, 0.2, 3, 0.5, 0.8, 27, 4)
    assert [boosting.features_per_node(s, 30) for s in ("all", "auto", "sqrt", "log2", "onethird", "7", "0.81")] == [30, 30, 6, 5, 10, 7, 25]


def test_constant_columns_and_other_learners(spark, rows):
    flat = rows.select("rev_id", "code", *[F.lit(3).alias(c) for c in RAW_COLUMNS])
    found = search(flat, n=1, space={"maxIter": [2], "maxDepth": [2]})
    assert found.avgMetrics[0] == pytest.approx(1.0986, abs=0.05)
    base = GBTClassifier(maxIter=2)
    assert selection.boosted_losses(rows.withColumn("_fold", F.lit(0)), base, [{base.maxIter: 1}], "code", 2, 1) is None
    assert selection.boosted_losses(rows, base, [{base.lossType: "logistic"}], "code", 2, 1) is None

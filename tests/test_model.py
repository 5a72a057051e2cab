import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from editlift import fixtures as fx
from editlift.functions.labels import label_code
from editlift.ml.ordinal import SequentialOrdinal, as_scorer
from editlift.ml.projection import ModelProjection
from editlift.ml.selection import LogLossEvaluator, draw_settings, hash_split, multiclass_model, quality_model, random_search, stratified_split
from editlift.operators.edits import rank_edits, score_edits, score_revisions, suggest_fitted
from editlift.operators.features import RAW_COLUMNS, featurize
from editlift.plans.lifecycle import page_results, train_and_evaluate


@pytest.fixture(scope="module")
def rows(spark, sf):
    df = featurize(fx.load(spark, sf, fx.REVISIONS)).withColumn("code", label_code(F.col("wp10")))
    return df.select("rev_id", "wp10", "code", *RAW_COLUMNS).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return quality_model(LogisticRegression(maxIter=15, regParam=0.01)).fit(rows)


def test_probabilities(rows, fitted):
    out = fitted.transform(rows)
    p = F.col("prob")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    assert out.where((F.abs(total - 1) > 1e-9) | ~F.col("prediction").between(0, 5) | (F.size(p) != 6)).count() == 0
    assert set(rows.columns) <= set(out.columns)
    assert not [c for c in out.columns if c.startswith("_")]
    hit = out.select(F.avg(1 - F.abs(F.col("prediction") - F.col("code")) / 5)).first()[0]
    assert hit > 0.85


def test_saved_model_is_the_same(rows, fitted, tmp_path):
    path = str(tmp_path / "m")
    fitted.save(path)
    again = PipelineModel.load(path).transform(rows).select("rev_id", "prob", "prediction")
    assert again.exceptAll(fitted.transform(rows).select("rev_id", "prob", "prediction")).count() == 0
    chain = SequentialOrdinal(classifier=LogisticRegression(maxIter=3), labelCol="code", decision="mode")
    chain.save(str(tmp_path / "e"))
    loaded = SequentialOrdinal.load(str(tmp_path / "e"))
    assert loaded.getDecision() == "mode" and loaded.classifier.getMaxIter() == 3


def test_output_flag(rows):
    data = ModelProjection().transform(rows)
    for output, present in {"probability": "prob", "prediction": "prediction"}.items():
        chain = SequentialOrdinal(classifier=LogisticRegression(maxIter=2), labelCol="code", output=output)
        cols = chain.fit(data).transform(data).columns
        assert present in cols and not ({"prob", "prediction"} - {present}) & set(cols)


def test_missing_class_raises(rows):
    data = ModelProjection().transform(rows.where("code <> 2"))
    with pytest.raises(ValueError, match=r"\[2\]"):
        SequentialOrdinal(classifier=LogisticRegression(maxIter=2), labelCol="code").fit(data)


def test_default_is_trees(rows):
    data = ModelProjection().transform(rows)
    model = SequentialOrdinal(classifier=GBTClassifier(maxIter=2, maxDepth=2, seed=1), labelCol="code").fit(data)
    assert model.n_classes == 6 and isinstance(SequentialOrdinal().classifier, GBTClassifier)


def test_fitted_model_scores_edits(rows, fitted):
    ranked = rank_edits(score_edits(rows, as_scorer(fitted), "rev_id"), "rev_id")
    assert ranked.count() > 200
    assert ranked.where("gain <= 0").count() == 0
    results = page_results(rows, as_scorer(fitted), "rev_id").first()
    assert [c["class"] for c in results["classes"]] == ["FA", "GA", "B", "C", "Start", "Stub"]


def test_results_of_a_fitted_model_in_one_pass(rows, fitted):
    scorer = as_scorer(fitted)
    gathered = suggest_fitted(score_revisions(rows, scorer), scorer, "rev_id").cache()
    assert gathered.count() == rows.count()
    ranked = rank_edits(score_edits(rows, scorer, "rev_id"), "rev_id")
    longer = gathered.select("rev_id", F.explode("edits").alias("e")).select("rev_id", "e.rank", "e.edit_no", "e.edit", "e.gain")
    ranked = ranked.select("rev_id", "rank", "edit_no", "edit", "gain")
    assert longer.exceptAll(ranked).count() == 0 and ranked.exceptAll(longer).count() == 0
    own = score_revisions(rows, scorer).select("rev_id", "score", "best")
    assert own.exceptAll(gathered.select("rev_id", "score", "best")).count() == 0


def test_multiclass_model_scores_edits(rows):
    score = as_scorer(multiclass_model("forest").fit(rows))
    assert all(len(r["p"]) == 6 and abs(sum(r["p"]) - 1) < 1e-9 for r in score(rows, "p").limit(20).collect())
    ranked = rank_edits(score_edits(rows, score, "rev_id"), "rev_id")
    assert ranked.count() > 0 and ranked.where("gain <= 0").count() == 0


def test_exact_split(spark):
    df = spark.range(1000).select(F.col("id").alias("rev_id"), F.when(F.col("id") < 700, 0).when(F.col("id") < 997, 1).alias("code"))
    both = df.unionByName(df)
    out = stratified_split(both)
    per_class = {r["code"]: (r["n"], r["t"]) for r in out.groupBy("code").agg(
        F.countDistinct("rev_id").alias("n"), F.countDistinct(F.when(F.col("is_train"), F.col("rev_id"))).alias("t")).collect()}
    assert per_class == {0: (700, 560), 1: (297, 237), None: (3, 2)}
    assert out.groupBy("rev_id").agg(F.countDistinct("is_train").alias("n")).where("n > 1").count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    share = hash_split(df).where("is_train").count()
    assert 740 < share < 860


def test_random_search(rows):
    assert draw_settings(n=4) == draw_settings(n=4) and len(draw_settings(n=10)) == 10
    space = {"regParam": [0.001, 0.1], "maxIter": [3, 6]}
    found = random_search(rows, space=space, n=2, folds=2, classifier=LogisticRegression())
    assert len(found.avgMetrics) == 2
    loss = LogLossEvaluator(labelCol="code").evaluate(found.bestModel.transform(rows))
    assert 0 < loss < 1.8


def test_comparison_model(rows):
    out = multiclass_model("forest").fit(rows).transform(rows)
    assert LogLossEvaluator(labelCol="code", probabilityCol="probability").evaluate(out) < 1.8


def test_train_and_evaluate(rows):
    model, tables = train_and_evaluate(rows.withColumnRenamed("rev_id", "revid"), LogisticRegression(maxIter=5, regParam=0.01))
    assert tables["class_report"].count() == 6 and tables["confusion_matrix"].count() == 6
    assert tables["macro_scores"].first()["f1"] > 0.3
    assert isinstance(model, PipelineModel)


def test_stratified_folds_deal_each_class_evenly(spark):
    from editlift.ml.selection import stratified_folds

    rows = [(i, i % 3 if i % 11 else None, "x") for i in range(500)] + [(7, 1, "x"), (None, 2, "x")]
    df = spark.createDataFrame(rows, "rev_id long, code int, fold string")
    out = stratified_folds(df, k=4)
    assert out.columns == ["rev_id", "code", "fold"]
    got = {}
    for r in out.groupBy("code", "fold").count().collect():
        got.setdefault(r["code"], []).append(r["count"])
    for code, counts in got.items():
        assert max(counts) - min(counts) <= 2 and len(counts) == 4, (code, counts)
    # Copies of an id share their fold.
    assert out.where("rev_id = 7").select("fold").distinct().count() == 1
    assert out.count() == len(rows)


@pytest.mark.parametrize("learner", ["trees", "logistic"])
def test_compiled_scorer_equals_transform(rows, learner):
    from editlift.ml.trees import CompiledScorer

    classifier = GBTClassifier(maxIter=8, maxDepth=3, seed=1) if learner == "trees" else LogisticRegression(maxIter=15, regParam=0.01)
    model = quality_model(classifier).fit(rows)
    fitted = score_edits(rows, as_scorer(model), "rev_id").select("rev_id", "edit", "prob")
    compiled_scores = score_edits(rows, CompiledScorer(model), "rev_id")
    compiled = compiled_scores.select("rev_id", "edit", F.col("prob").alias("prob2"))
    joined = fitted.join(compiled, ["rev_id", "edit"])
    assert joined.count() == fitted.count() == compiled.count() > 0
    worst = joined.select(F.max(F.aggregate(F.zip_with("prob", "prob2", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda m, d: F.greatest(m, d)))).first()[0]
    assert worst < 1e-9
    # Scored in the row: no exchange, no Python.
    local = rows.sparkSession.createDataFrame(rows.limit(20).collect(), rows.schema)
    plan = score_edits(local, CompiledScorer(model), "rev_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_compiled_scorer_refuses_other_learners(rows):
    from pyspark.ml.classification import RandomForestClassifier

    from editlift.ml.trees import CompiledScorer

    model = quality_model(RandomForestClassifier(numTrees=2, maxDepth=2, seed=1)).fit(rows)
    with pytest.raises(ValueError, match="cannot compile"):
        CompiledScorer(model).probabilities({c: F.col(c) for c in RAW_COLUMNS})


def test_steps_of_the_chain_share_no_plan_of_the_features(rows):
    """What the threads fit on is written once: no step carries the expressions the features come from."""

    class Recording(LogisticRegression):
        plans: list = []

        def _fit(self, dataset):
            Recording.plans.append(dataset._jdf.queryExecution().toRdd().toDebugString())
            Recording.plans.append(dataset._jdf.queryExecution().optimizedPlan().toString())
            return super()._fit(dataset)

    data = ModelProjection().transform(rows.withColumn("words", F.length(F.regexp_replace(F.col("wp10"), "S", "xx"))))
    SequentialOrdinal(classifier=Recording(maxIter=1), labelCol="code").fit(data)
    assert len(Recording.plans) == 10
    assert not [p for p in Recording.plans if "regexp_replace" in p or "parquet" in p]


def test_training_rows_are_computed_once(spark, sf):
    from editlift.plans.queries import _train

    rows = _train(spark, sf)
    assert "parquet" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 200

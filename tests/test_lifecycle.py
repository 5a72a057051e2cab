from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from editlift import fixtures as fx
from editlift.ml.linear import linear_scorer
from editlift.ml.selection import draw_settings
from editlift.operators.backlog import flatten_catalogue
from editlift.operators.features import featurize
from editlift.plans.lifecycle import answer_requests, build_training_set, train_and_evaluate
from editlift.sources.readers import read_labeled


def page_records(spark, sf):
    rev = fx.load(spark, sf, fx.REVISIONS)
    slots = F.struct(F.struct(F.col("wikitext").alias("*")).alias("main")).alias("slots")
    versions = F.array(F.struct(F.col("rev_id").alias("revid"), slots))
    return rev.select(
        F.col("page_id").alias("pageid"), F.lit(0).alias("ns"), F.lit("T").alias("title"), versions.alias("revisions")
    )


def test_records_to_model(spark, sf, tmp_path):
    labels = fx.load(spark, sf, fx.REVISIONS).select("rev_id", "wp10", F.lit(1).alias("seq"))
    lookup = flatten_catalogue(fx.load(spark, sf, fx.BACKLOG))
    build_training_set(page_records(spark, sf), labels, lookup, str(tmp_path / "set"))
    rows = read_labeled(spark, str(tmp_path / "set"))
    assert rows.count() == 200 and rows.where("words is null or code is null").count() == 0
    model, tables = train_and_evaluate(rows, LogisticRegression(maxIter=5, regParam=0.01))
    assert tables["class_report"].count() == 6
    assert 0 < tables["hit_rates"].first()["exact_hit"] <= 1 and tables["log_loss"].first()["log_loss"] > 0
    assert model.transform(rows).where("prediction is null").count() == 0


def test_search_within_training(spark, sf):
    rows = fx.load(spark, sf, fx.REVISIONS).withColumnRenamed("rev_id", "revid")
    featurized = featurize(rows, "wikitext", None, key="revid")
    search = {"space": {"maxIter": [0, 8]}, "n": 4, "folds": 2, "seed": 1}
    model, _ = train_and_evaluate(featurized, LogisticRegression(regParam=0.01), search=search)
    drawn = {s["maxIter"] for s in draw_settings(search["space"], 4, 1)}
    assert drawn == {0, 8}
    kept = [m.getMaxIter() for m in model.stages[-1].models]
    assert kept and set(kept) == {8}


def test_requests(spark):
    pages = spark.createDataFrame(
        [(1, 10, "A", "2018-01-01T00:00:00Z", "short"), (2, 10, "A", "2018-02-01T00:00:00Z", "== H ==\n{{POV}} [[x]] text")],
        "revid long, pageid long, title string, timestamp string, content string",
    )
    requests = spark.createDataFrame([(1, "A"), (2, "a A"), (3, ""), (4, "A")], "request_id long, title string")
    redirects = spark.createDataFrame([("a A", "A")], "from_title string, to_title string")
    rows = {r["request_id"]: r for r in answer_requests(requests, pages, redirects, None, linear_scorer).collect()}
    assert set(rows) == {1, 2, 4} and all(r["revid"] == 2 for r in rows.values())
    first = rows[1]
    assert first["url"] == "https://en.wikipedia.org/wiki/A"
    assert abs(sum(c["pct"] for c in first["classes"]) - 100) <= 3
    gains = [e["gain_pct"] for e in first["edits"]]
    assert gains == sorted(gains, reverse=True) and all(e["advice"] for e in first["edits"])

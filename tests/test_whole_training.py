"""The registered model queries train as much as the reference does."""

from types import SimpleNamespace

from editlift.ml.ordinal import SequentialOrdinal
from editlift.plans import queries


class Stop(Exception):
    pass


def test_search_takes_its_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "_train", lambda spark, sf: "rows")
    monkeypatch.setattr(queries, "random_search", lambda *a, **k: seen.append((a, k)) or SimpleNamespace(
        bestModel=SimpleNamespace(transform=lambda rows: spark.range(1).selectExpr("id rev_id", "1 code", "1 prediction"))))
    queries.QUERIES["m8_random_search"](spark, "")
    assert seen == [(("rows",), {})]


def test_rounds_of_the_trees(spark, monkeypatch):
    def model(learner):
        assert (learner.getMaxIter(), learner.getMaxDepth(), learner.getStepSize()) == (100, 3, 0.1)
        raise Stop

    monkeypatch.setattr(queries, "_train", lambda spark, sf: "rows")
    monkeypatch.setattr(queries, "quality_model", model)
    try:
        queries.QUERIES["m2_sequential_trees"](spark, "")
    except Stop:
        pass
    assert SequentialOrdinal().classifier.getMaxIter() == 100

from pyspark.sql import functions as F

from editlift import fixtures as fx
from editlift.functions.titles import bare_template_name
from editlift.operators import backlog, features
from editlift.sources import readers, sinks


def test_literals_and_join_agree(spark, sf, monkeypatch):
    lookup = backlog.flatten_catalogue(fx.load(spark, sf, fx.BACKLOG))
    text = spark.createDataFrame(
        [(1, "{{pov}} {{Copyedit}} {{NPOV}} {{copy edit}} {{pov}}"), (2, "none"), (3, "{{make png}}")],
        "rev_id long, wikitext string",
    )
    a = features.featurize(text, "wikitext", lookup)
    monkeypatch.setattr(features, "lookup_literals", lambda _: None)
    b = features.featurize(text, "wikitext", lookup)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 3
    row = b.where("rev_id = 1").first()
    assert (row["backlog_accuracy"], row["backlog_accuracy_templates"]) == (3, "pov npov")
    assert (row["backlog_style"], row["backlog_style_templates"]) == (2, "copyedit copy edit")
    assert b.where("rev_id = 2").first()["backlog_style_templates"] is None


def test_repeated_and_null_keys_and_repeated_names(spark, monkeypatch):
    lookup = spark.createDataFrame([("n1", "Style"), ("n1", "Style"), ("n2", "Style"), ("n3", "Accuracy")], "name string, section string")
    rows = [(1, "{{n1}} {{n2}}"), (1, "{{n3}}"), (None, "{{n1}}"), (None, "{{n1}}"), (2, None)]
    text = spark.createDataFrame(rows, "rev_id long, wikitext string")
    counts = ("rev_id", "backlog_style", "backlog_style_templates", "backlog_accuracy", "backlog_accuracy_templates")
    a = features.featurize(text, "wikitext", lookup).select(*counts)
    monkeypatch.setattr(features, "lookup_literals", lambda _: None)
    b = features.featurize(text, "wikitext", lookup).select(*counts)
    key = lambda r: tuple(str(x) for x in r)
    expected = [(1, 2, "n1 n2", 0, None), (1, 0, None, 1, "n3"), (None, 1, "n1", 0, None), (None, 1, "n1", 0, None)]
    for got in (a, b):
        with_text = [tuple(r) for r in got.collect() if r["rev_id"] != 2]
        assert sorted(with_text, key=key) == sorted(expected, key=key)
    assert a.count() == b.count() == 5 and a.exceptAll(b).count() == 0


def test_large_lookup_is_not_folded(spark):
    lookup = spark.range(50).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"), F.lit("Style").alias("section"))
    assert backlog.lookup_literals(lookup, max_rows=49) is None
    assert len(backlog.lookup_literals(lookup, max_rows=50)["Style"]) == 50


def test_catalogue_round_trip(spark, tmp_path):
    templates = spark.createDataFrame(
        [("Accuracy", "c1", "T:POV"), ("File Quality", "c2", "Template:Png"), ("Layout", "c3", "Split"), ("Style", "Too few wikilinks", "Under")],
        "section string, category string, template string",
    )
    redirects = spark.createDataFrame(
        [("Template:NPOV", "Template:POV"), ("T:Neutral", "Template:POV"), ("Template:NPOV", "Template:POV")],
        "from_title string, to_title string",
    )
    rows = backlog.build_catalogue(templates, redirects)
    assert rows.count() == 5
    sinks.write_catalogue(rows, str(tmp_path / "c"))
    back = backlog.unnest_catalogue(readers.read_catalogue(spark, str(tmp_path / "c"), whole_file=False))
    assert rows.exceptAll(back).count() == 0 and back.count() == 5
    flat = {r["name"]: r["section"] for r in backlog.flatten_catalogue(rows).collect()}
    assert flat == {"pov": "Accuracy", "npov": "Accuracy", "neutral": "Accuracy", "png": "File"}
    assert "under" in {r["name"] for r in backlog.flatten_catalogue(rows, excluded=()).collect()}


def test_whole_file_catalogue(spark, tmp_path):
    path = tmp_path / "backlog.json"
    path.write_text('{"Accuracy": {"c": {"POV": ["NPOV"],\n "Bias": []}}}')
    rows = backlog.unnest_catalogue(readers.read_catalogue(spark, str(path)))
    assert sorted(tuple(r) for r in rows.collect()) == [("Accuracy", "c", "Bias", None), ("Accuracy", "c", "POV", "NPOV")]


def test_bare_names(spark):
    df = spark.createDataFrame([("T:a",), ("Template:b",), ("Talk:c",), ("xT:d",)], "t string")
    assert [r[0] for r in df.select(bare_template_name(F.col("t"))).collect()] == ["a", "b", "Talk:c", "xT:d"]

import gzip
import json

import pytest
from pyspark.sql import functions as F

from editlift.functions.titles import page_url
from editlift.operators import assessment
from editlift.operators.features import featurize
from editlift.session import broadcast_if_small, shared_dir
from editlift.sources import dump, readers, schemas, sinks


def test_gzip_lines(spark, tmp_path):
    path = tmp_path / "r.ndjson.gz"
    with gzip.open(path, "wt") as f:
        for i in range(20):
            f.write(json.dumps({"revid": i, "wikitext": "a\nb", "wp10": "GA", "extra": 1}) + "\n")
    rows = readers.read_ndjson(spark, str(path))
    assert rows.count() == 20 and rows.first()["wikitext"] == "a\nb" and "extra" not in rows.columns
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def labeled(spark):
    rows = [(i, "Stub" if i % 3 else "FA", f"== H ==\n[[a]] {i}") for i in range(30)]
    return featurize(spark.createDataFrame(rows, "revid long, wp10 string, wikitext string"), key="revid")


def test_split_by_class_and_back(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_by_label(labeled(spark), path)
    sinks.write_by_label(labeled(spark), path)
    rows = readers.read_labeled(spark, path)
    assert rows.count() == 60 and "text" not in rows.columns and "wikitext" not in rows.columns
    assert {(r["wp10"], r["code"]) for r in rows.select("wp10", "code").distinct().collect()} == {("Stub", 0), ("FA", 5)}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"wp10=Stub", "wp10=FA"}
    text = rows.where("wp10 = 'FA'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wp10" in text


def test_compact_output(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.write_by_label(labeled(spark), path, compact=True)
    assert readers.read_labeled(spark, path).count() == 30


def test_unknown_class_fails(spark, tmp_path):
    df = spark.createDataFrame([(1, "List")], "revid long, wp10 string")
    with pytest.raises(Exception, match="unknown class: List"):
        sinks.write_by_label(df, str(tmp_path / "a"))
    sinks.write_by_label(df, str(tmp_path / "b"), strict=False)
    assert spark.read.json(str(tmp_path / "b")).count() == 1


def test_existing_output_is_refused(spark, tmp_path):
    df = spark.range(3)
    sinks.write_ndjson(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_ndjson(df, str(tmp_path / "x"))


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("# source: a dump\nclass,articles\nFA,10\n# note\nStub,30\nList,5\nStart,20\n")
    counts = readers.read_class_counts(spark, str(path)).withColumnRenamed("class", "wp10")
    kept = assessment.class_share(assessment.keep_classes(counts))
    assert {r["wp10"]: round(r["pct"], 6) for r in kept.collect()} == {"FA": 16.666667, "Start": 33.333333, "Stub": 50.0}
    assert [r["wp10"] for r in assessment.keep_classes(counts).collect()] == ["FA", "Start", "Stub"]
    both = assessment.share_between(assessment.keep_classes(counts), "Start", "Stub").first()[0]
    assert both == pytest.approx(83.333333)


def test_dump_revision(spark, tmp_path):
    path = tmp_path / "d.json"
    rows = [
        {"id": 1, "page": {"id": 9, "title": "T", "namespace": 0}, "deleted": {"text": False}, "text": "x"},
        {"id": 2, "page": {"id": 9, "title": "T", "namespace": 0, "redirect": "U"}, "user": {"id": 3, "text": "u"}, "comment": "c"},
    ]
    path.write_text("\n".join(json.dumps(r) for r in rows))
    flat = dump.flatten_revisions(spark.read.schema(schemas.DUMP_REVISION).json(str(path))).orderBy("rev_id").collect()
    assert (flat[0]["comment"], flat[0]["user_id"], flat[0]["page_redirect"], flat[0]["is_redirect"]) == ("", None, None, False)
    assert flat[0]["deleted_text"] is False and flat[1]["deleted_text"] is None
    assert (flat[1]["page_title"], flat[1]["user_text"], flat[1]["is_redirect"]) == ("T", "u", True)


def test_page_records(spark, tmp_path):
    path = tmp_path / "p.json"
    page = {"pageid": 5, "ns": 0, "title": "T", "revisions": [
        {"revid": 1, "slots": {"main": {"*": "text"}}}, {"revid": 2, "slots": {"main": {}}}, {"revid": 3}]}
    path.write_text(json.dumps(page))
    rows = dump.page_revisions(spark.read.schema(schemas.PAGE_WITH_REVISIONS).json(str(path))).collect()
    assert [(r["revid"], r["pageid"], r["title"], r["wikitext"]) for r in rows] == [(1, 5, "T", "text")]
    labels = spark.createDataFrame([(1, "C", 1), (1, "B", 2), (7, "FA", 1)], "rev_id long, wp10 string, seq int")
    joined = dump.attach_labels(dump.page_revisions(spark.read.schema(schemas.PAGE_WITH_REVISIONS).json(str(path))), labels)
    assert [(r["revid"], r["wp10"]) for r in joined.collect()] == [(1, "B")]


def test_first_pages(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(20)], "rev_id long, page_id long")
    assert dump.first_pages(df, 2).count() == 10 and dump.first_pages(df).count() == 20


def test_concat(spark):
    a = spark.createDataFrame([(1, "x")], "i int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, i int")
    assert sorted((r["i"], r["a"], r["b"]) for r in readers.concat(a, b).collect()) == [(1, "x", None), (2, None, "y")]


def test_url(spark):
    df = spark.createDataFrame([("A & B é", 5), ("C", None)], "t string, r long")
    got = [r[0] for r in df.select(page_url(F.col("t"), "fr", F.col("r"))).collect()]
    assert got == ["https://fr.wikipedia.org/w/index.php?title=A%20%26%20B%20%C3%A9&oldid=5", "https://fr.wikipedia.org/wiki/C"]


def test_broadcast_is_checked(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    hinted = spark.range(5).join(broadcast_if_small(small, 10), F.col("id") == F.col("k"))
    plain = spark.range(5).join(broadcast_if_small(small, 9), F.col("id") == F.col("k"))
    assert "strategy=broadcast" in hinted._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plain._jdf.queryExecution().analyzed().toString()


def test_shared_dir_from_the_session(spark):
    assert shared_dir(spark)
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before is None or shared_dir(spark) == before


def test_malformed_input_raises(spark, tmp_path):
    from editlift.sources import readers

    (tmp_path / "a.ndjson").write_text('{"revid": 1}\n{broken\n')
    (tmp_path / "c.json").write_text("{broken")
    for read in (lambda: readers.read_ndjson(spark, str(tmp_path / "a.ndjson")), lambda: readers.read_catalogue(spark, str(tmp_path / "c.json"))):
        with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
            read().collect()


def test_tolerant_read_counts_broken_lines(spark, tmp_path):
    from pyspark.sql import Observation

    from editlift.sources import readers

    path = tmp_path / "broken"
    path.mkdir()
    (path / "part.json").write_text('{"revid": 1, "wp10": "B"}\n{"revid": 2, "wp10": \n{"revid": 3}\nnot json\n')
    observation = Observation("reads")
    good, bad = readers.split_corrupt(readers.read_ndjson_tolerant(spark, str(path)), observation)
    assert sorted(r.revid for r in good.collect()) == [1, 3]
    assert observation.get == {"rows": 4, "corrupt": 2}
    assert sorted(r.line for r in bad.collect()) == sorted(['{"revid": 2, "wp10": ', "not json"])
    # The default read still refuses the file.
    with pytest.raises(Exception):
        readers.read_ndjson(spark, str(path)).collect()

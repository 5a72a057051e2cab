from pyspark.sql import functions as F

from editlift import fixtures as fx
from editlift.ml.linear import linear_scorer
from editlift.operators.backlog import flatten_catalogue
from editlift.sources.sinks import write_ndjson
from editlift.streaming.online import revision_stream, suggest_on_stream, write_stream


def test_stream_gives_what_a_batch_gives(spark, sf, tmp_path):
    rows = fx.load(spark, sf, fx.REVISIONS).withColumnRenamed("rev_id", "revid").select("revid", "wp10", "wikitext")
    lookup = flatten_catalogue(fx.load(spark, sf, fx.BACKLOG))
    write_ndjson(rows, str(tmp_path / "in"))
    stream = suggest_on_stream(revision_stream(spark, str(tmp_path / "in"), max_files=3), linear_scorer, lookup)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = suggest_on_stream(rows, linear_scorer, lookup)
    flat = [F.to_json("edits").alias("edits"), "revid", "best", "score"]
    assert got.count() == 200
    assert got.select(*flat).exceptAll(want.select(*flat)).count() == 0

import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from editlift.operators.features import featurize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    path = str(tmp_path / "rev")
    rows = spark.range(40).select(
        F.col("id").alias("rev_id"), F.lit("C").alias("wp10"), F.lit("x").alias("comment"), F.lit("== A ==").alias("wikitext")
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_only_needed_columns_are_read(spark, tmp_path):
    text = plan(featurize(stored(spark, tmp_path)).select("rev_id", "headings"))
    assert re.search(r"ReadSchema: struct<rev_id:bigint,wikitext:string>", text)
    assert "Exchange" not in text and "Python" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    text = plan(featurize(stored(spark, tmp_path)).where("wp10 = 'FA'").select("rev_id", "words"))
    assert "EqualTo(wp10,FA)" in text


def test_no_cross_joins_and_no_python(spark, sf):
    for name in ("e6_top_edit", "j5_edit_variants", "t7_clean_text", "a14_class_report", "j6_flagged_tokens", "a1_template_counts"):
        text = plan(queries()[name](spark, sf))
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python", text), name

from pyspark.sql import functions as F

from editlift.operators import lookup as K
from editlift.operators import talk, usage
from editlift.sources.dump import attach_labels


def test_closure_of_chains_and_cycles(spark):
    hops = [(f"t{i}", f"t{i + 1}") for i in range(23)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("s", "s")]
    hops += [(f"many{i}", "t5") for i in range(300)]
    closed = K.redirect_closure(spark.createDataFrame(hops, "from_title string, to_title string"))
    got = {r["from_title"]: r["to_title"] for r in closed.collect()}
    assert all(got[f"t{i}"] == "t23" for i in range(23))
    assert all(got[f"many{i}"] == "t23" for i in range(300))
    assert not {"a", "b", "c", "x", "s"} & set(got)
    titles = spark.createDataFrame([("x",), ("t3",), ("free",)], "title string")
    assert {r[0] for r in K.follow_redirects(titles, closed).collect()} == {"x", "t23", "free"}


def pages(spark):
    return spark.createDataFrame(
        [(1, 10, "A", "2018-01-01T00:00:00Z", "old"), (2, 10, "A", "2018-02-01T00:00:00Z", "new"),
         (3, 10, "A", "2018-02-01T00:00:00Z", "newest"), (4, 11, "B", "2017-01-01T00:00:00Z", "b")],
        "revid long, pageid long, title string, timestamp string, content string",
    )


def test_lookup(spark):
    requests = spark.createDataFrame([(1, "A"), (2, "Old name"), (3, "gone"), (4, " "), (5, None), (6, "A")], "request_id long, title string")
    redirects = spark.createDataFrame([("Old name", "B")], "from_title string, to_title string")
    got = {r["request_id"]: r for r in K.lookup_pages(requests, pages(spark), redirects).collect()}
    assert set(got) == {1, 2, 3, 6}
    assert got[1]["content"] == got[6]["content"] == "newest" and got[1]["talk_page"] == "Talk:A"
    assert (got[2]["title"], got[2]["revid"]) == ("B", 4)
    assert not got[3]["found"] and got[3]["talk_page"] is None
    missing = K.not_found(requests, pages(spark), redirects).collect()
    assert [r["request_id"] for r in missing] == [3]


def test_talk_page(spark):
    talk_pages = spark.createDataFrame([("Talk:A", "x")], "talk_title string, note string")
    got = {r["revid"]: r["note"] for r in K.with_talk_page(pages(spark), talk_pages).collect()}
    assert got == {1: "x", 2: "x", 3: "x", 4: None}


def test_banners(spark):
    rows = [
        (1, 1, "{{WikiProject X\n| class = Bplus |importance= none}}"),
        (1, 2, "{{WikiProject Y|class=list}}"),
        (1, 3, "{{WikiProject X|class=Stub|class=FA}}"),
        (2, 4, "{{WikiProject X|importance=High}}"),
        (3, 5, "{{Other|class=FA}}"),
        (4, 6, "{{WikiProject X|class=future}}"),
    ]
    df = spark.createDataFrame(rows, "page_id long, seq long, banner string")
    got = {(r["page_id"], r["name"]): (r["class"], r["importance"]) for r in talk.project_map(df).collect()}
    assert got == {
        (1, "WikiProject X"): ("stub", None), (1, "WikiProject Y"): ("list", None),
        (2, "WikiProject X"): (None, "high"), (4, "WikiProject X"): ("future", None),
    }
    quality = {r["page_id"]: r["quality"] for r in talk.quality_by_banner(talk.project_map(df)).collect()}
    assert quality == {1: "stub", 2: None, 4: None}


def test_category_quality(spark):
    rows = [(1, "Category:C-Class x"), (1, "Category:A-Class x"), (2, "Category:fa-Class"), (3, "x Category:FA-Class"), (4, "Category:Start-Classical")]
    df = spark.createDataFrame(rows, "page_id long, category string")
    got = {r["page_id"]: r["quality"] for r in talk.quality_by_category(df).collect()}
    assert got == {1: "GA", 2: None, 3: None, 4: "Start"}


def test_usage(spark):
    text = "{{POV}}{{ npov }}{{Cite}}{{cite}} [[A]][[ A ]][[Category:X]][[category:X|k]][[Media:m]]"
    df = spark.createDataFrame([(1, 7, "T", text), (2, 7, "T", text), (3, 8, "U", "")], "rev_id long, page_id long, title string, wikitext string")
    counts = {(r["rev_id"], r["name"]): r["n"] for r in usage.template_counts(df).collect()}
    assert counts[(1, "POV")] == 1 and counts[(1, "Cite")] == 1 and counts[(2, "npov")] == 1 and len(counts) == 8
    links = {(r["rev_id"], r["name"]): r["n"] for r in usage.link_counts(df).collect()}
    assert links[(1, "A")] == 2 and links[(1, "category:X")] == 1
    aliases = spark.createDataFrame([("NPOV", "POV")], "alias string, template string")
    index = usage.template_index(df, aliases)
    assert sorted(tuple(r) for r in index.collect()) == [("cite", 7), ("pov", 7)]
    assert [r[0] for r in usage.pages_embedding(index, " POV ").collect()] == [7]
    redirects = spark.createDataFrame([("T old", "T"), ("T2", "T")], "from_title string, to_title string")
    members = usage.category_members(df, redirects)
    assert sorted(tuple(r) for r in members.collect()) == [("X", 7, "T", "T old"), ("X", 7, "T", "T2")]
    assert usage.image_links(df).count() == 2 and usage.category_links(df).count() == 4


def test_few_titles_or_labels_do_not_shuffle_the_text(spark, tmp_path):
    pages = spark.range(100).select(
        F.col("id").alias("revid"), F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("title"),
        F.timestamp_seconds("id").alias("timestamp"), F.repeat(F.lit("x"), 50).alias("content"),
    )
    pages.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    asked = spark.createDataFrame([("t3",), ("t3",), ("t7",)], "title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = K.requested_pages(asked, stored)
        labels = spark.createDataFrame([(5, "GA", 1), (5, "FA", 2)], "rev_id long, wp10 string, seq long")
        labelled = attach_labels(stored, labels)
        for df in (found, labelled):
            joins = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in joins and "ShuffledHashJoin" not in joins
        assert sorted(r["revid"] for r in found.collect()) == [93, 97]
        assert [(r["revid"], r["wp10"]) for r in labelled.collect()] == [(5, "FA")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

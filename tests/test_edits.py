import pytest
from pyspark.sql import functions as F

from editlift import fixtures as fx
from editlift.ml.linear import linear_scorer
from editlift.operators import edits as E
from editlift.operators.features import RAW_COLUMNS, featurize, model_projection


def revision(spark, **values):
    row = {c: 0 for c in RAW_COLUMNS} | {"words": 100} | values
    return spark.createDataFrame([(1, *row.values())], "rev_id long, " + ", ".join(f"{c} int" for c in row))


def test_catalogue():
    assert [e.number for e in E.EDITS] == list(range(1, 17))
    assert sum(e.kind == "both" for e in E.EDITS) == 8
    assert not any(e.column in ("backlog_content", "templates", "backlog_files") for e in E.EDITS)


def test_variants(spark):
    rows = {r["edit"]: r for r in E.edit_variants(revision(spark, infoboxes=3), "rev_id").collect()}
    assert len(rows) == 17
    assert rows["unchanged"]["words"] == 100
    assert rows["paragraph"]["words"] == 250
    assert (rows["citation"]["cite_templates"], rows["citation"]["words"], rows["citation"]["templates"]) == (1, 105, 0)
    assert rows["infoboxes"]["infoboxes"] == 1 and rows["ref"]["infoboxes"] == 3
    assert rows["backlog_style"]["backlog_style"] == 0
    assert rows["coordinates"]["coordinates"] == 1


def test_clamped_edit_is_no_suggestion(spark):
    base = E.score_revisions(revision(spark), linear_scorer)
    names = [e["edit"] for e in E.suggest_edits(base, linear_scorer).first()["edits"]]
    assert not any(n.startswith("backlog") for n in names)
    long = {r["edit"]: r["gain"] for r in E.score_edits(revision(spark), linear_scorer, "rev_id").collect()}
    assert long["backlog_style"] == 0


def test_word_floor(spark):
    df = spark.createDataFrame([(5, -10)], "w int, d int")
    assert df.select(E.add_words(F.col("w"), F.col("d")), E.add_count(F.col("w"), F.col("d"))).first() == (1, 0)


def test_both_paths_agree(spark, sf):
    rows = featurize(fx.load(spark, sf, fx.REVISIONS))
    long = E.rank_edits(E.score_edits(rows, linear_scorer, "rev_id"), "rev_id")
    in_row = E.explode_suggestions(E.suggest_edits(E.score_revisions(rows, linear_scorer), linear_scorer), "rev_id")
    a = long.select("rev_id", "rank", "edit_no", "gain")
    b = in_row.select("rev_id", "rank", "edit_no", "gain")
    assert a.count() == b.count() > 1000
    assert a.exceptAll(b).count() == 0
    assert E.gather_edits(long, "rev_id").count() == 200


def test_equal_gains_keep_catalogue_order(spark):
    df = spark.createDataFrame([(1, 5, "b", 0.2), (1, 3, "a", 0.2), (1, 9, "c", 0.3), (1, 2, "z", 0.0)],
                               "rev_id long, edit_no int, edit string, gain double")
    got = [(r["rank"], r["edit"]) for r in E.rank_edits(df, "rev_id").orderBy("rank").collect()]
    assert got == [(1, "c"), (2, "a"), (3, "b")]
    assert E.rank_edits(df, "rev_id", top=1).count() == 1


def test_percent_is_half_even(spark):
    edits = F.array(*[F.struct(F.lit(n).alias("edit"), F.lit(g).alias("gain")) for n, g in (("a", 0.025), ("b", 0.005), ("c", 0.035))])
    shown = spark.range(1).select(E.shown_edits(edits).alias("e")).first()["e"]
    assert [(s["edit"], s["gain_pct"]) for s in shown] == [("a", 2), ("c", 4)]
    advice = spark.range(1).select(E.advice_for(F.lit("ref")), E.advice_for(F.lit("none"))).first()
    assert tuple(advice) == ("Write a footnote", None)


def test_projection_leaves_input_alone(spark):
    df = revision(spark, headings=5, infoboxes=4)
    row = model_projection(df, "rev_id").first()
    assert len(row) == 31 and row["headings_per_word"] == 0.05 and row["infoboxes"] == 1.0
    assert df.first()["infoboxes"] == 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suggestions_need_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "f")
    revision(spark).write.parquet(path)
    scored = E.score_revisions(spark.read.parquet(path), linear_scorer)
    text = plan(E.explode_suggestions(E.suggest_edits(scored, linear_scorer), "rev_id"))
    assert "Exchange" not in text and "Join" not in text
    text = plan(E.score_edits(spark.read.parquet(path), linear_scorer, "rev_id"))
    assert "Exchange" not in text and "Join" not in text


@pytest.mark.parametrize("decision", ["median", "mode"])
def test_decision(spark, decision):
    prob = [0.30, 0.15, 0.10, 0.15, 0.15, 0.15]

    def fixed(df, out):
        return df.withColumn(out, F.array(*[F.lit(p) for p in prob]))

    best = E.score_revisions(revision(spark), fixed, decision).first()["best"]
    assert best == ("C" if decision == "median" else "Stub")

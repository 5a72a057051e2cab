import pytest
from pyspark.sql import functions as F

from editlift import fixtures as fx
from editlift.functions import markup as M
from editlift.operators.backlog import flatten_catalogue
from editlift.operators.features import FEATURES, featurize

CASES = {
    "": {"words": 1, "headings": 0, "templates": 0, "wikilinks": 0, "ref": 0, "external_links": 0},
    "{{cite web|title={{lang|fr|t}}}}": {"templates": 2, "cite_templates": 1},
    "{{{name}}}": {"templates": 0},
    "<!-- {{POV}} --><nowiki>[[a]]</nowiki>": {"templates": 0, "wikilinks": 0},
    "{{ Infobox-Person }}": {"infoboxes": 1},
    "{{Main\n}}{{POV\n|date=May}}": {"main_templates": 1, "backlog_accuracy": 1},
    "{{Main}}{{Main article}}": {"main_templates": 1},
    "[[File format]][[Image format]][[Image:x.png]]": {"images": 2, "wikilinks": 1},
    "<REF>x</REF><ref>y</ref>": {"ref": 1},
    "<ref>a</ref><references/>": {"ref": 1},
    "{{copy-edit}}": {"backlog_style": 0},
    "{{Copy edit}} {{copyedit|x}}": {"backlog_style": 2, "backlog_style_templates": "copy edit copyedit"},
    "{{NPOV}} {{pov}} {{npov}}": {"backlog_accuracy": 3, "backlog_accuracy_templates": "npov pov"},
    "{{Should be PNG}}{{split}}": {"backlog_files": 1, "backlog_files_templates": "should be png"},
    "{{#Coordinates:1|2}}": {"coordinates": True},
    "{{coord}}": {"coordinates": False},
    "http://a.org and [https://b.org b] ftp://c": {"external_links": 3},
    "== A ==\n=== B ===\n==== C ====\n=== D ==": {"headings": 1, "sub_headings": 2},
    "== A ==\n== B ==": {"headings": 2},
    "{|\n|-\n| cell\n|}\n": {"tables": 1, "smartlists": 0, "words": 2},
    "[[Category:X]][[category:y]][[ab|c]]": {"categories": 2, "wikilinks": 1},
    "one two, three": {"words": 4},
}


@pytest.fixture(scope="module")
def featurized(spark, sf):
    lookup = flatten_catalogue(fx.load(spark, sf, fx.BACKLOG))
    df = spark.createDataFrame(list(enumerate(CASES)), "rev_id long, wikitext string")
    return {CASES_KEYS[r["rev_id"]]: r for r in featurize(df, "wikitext", lookup).collect()}


CASES_KEYS = list(CASES)


@pytest.mark.parametrize("text", CASES_KEYS)
def test_hand_written(featurized, text):
    row = featurized[text]
    assert {k: row[k] for k in CASES[text]} == CASES[text]


def test_feature_columns(featurized):
    row = next(iter(featurized.values()))
    assert tuple(row.asDict())[2:] == (*FEATURES, "tables")


def test_closed_form(spark, sf):
    lookup = flatten_catalogue(fx.load(spark, sf, fx.BACKLOG))
    d = F.col("rev_id")
    want = {
        "headings": d % 4, "sub_headings": d % 3, "images": d % 3 + d % 2, "categories": d % 5, "wikilinks": d % 2,
        "external_links": d % 6 + d % 7, "templates": 2 * (d % 6) + 3 * (d % 2), "cite_templates": d % 6,
        "main_templates": d % 2, "infoboxes": d % 2, "backlog_accuracy": d % 2, "ref": 2 * (d % 4),
    }
    rows = featurize(fx.load(spark, sf, fx.REVISIONS), "wikitext", lookup)
    assert rows.count() == 200
    for name, value in want.items():
        assert rows.where(F.col(name) != value).count() == 0, name
    assert rows.where("coordinates").count() == 0


def test_text_column_name_and_overwrite(spark):
    df = spark.createDataFrame([(1, "a {{x}}", 99)], "rev_id long, text string, words int")
    row = featurize(df, "text").first()
    assert (row["words"], row["text"], row["templates"]) == (2, "a ", 1)


def test_features_add_up(spark):
    a = "== H ==\n[[a]] {{cite x|u=http://q.org}} <ref>n</ref>"
    b = "{{pov}} [[Category:c]]\n=== S ===\nword"
    df = spark.createDataFrame([(0, a), (1, b), (2, a + "\n" + b)], "rev_id long, wikitext string")
    r = {x["rev_id"]: x for x in featurize(df).collect()}
    for c in ("headings", "sub_headings", "wikilinks", "categories", "templates", "cite_templates", "external_links", "ref"):
        assert r[2][c] == r[0][c] + r[1][c], c
    assert r[2]["words"] == r[0]["words"] + r[1]["words"] - 1


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("a {{x|{{y|{{z}}}}}} b", "a  b"),
        ("[[Paris|the city]] of [[light]]", "the city of light"),
        ("[[File:a.png|thumb|see [[b|c]] d]]", "thumb|see c d"),
        ("'''bold''' and ''it''", "bold and it"),
        ("<b>x</b><math>\\frac</math>y", "xy"),
        ("[http://e.org here] [http://e.org]", "here "),
        ("== Head ==\n* item", "Head\nitem"),
        ("a&nbsp;b", "a\u00a0b"),
        ("caf&eacute;s &#233;&#xE9; &amp;lt; &bogus; &#0;", "cafés éé &lt; &bogus; &#0;"),
        ("[[a|b &amp; c]]", "b & c"),
        ("{{ unclosed", "{{ unclosed"),
    ],
)
def test_plain_text(spark, raw, plain):
    assert spark.createDataFrame([(raw,)], "t string").select(M.plain_text(F.col("t"))).first()[0] == plain


@pytest.mark.parametrize("depth", [1, 3, 4, 40, 45, 150])
def test_nesting_of_any_depth(spark, depth):
    texts = [
        ("a" + "{{x|" * depth + "}}" * depth + "b", "ab"),
        ("[[x|" * depth + "a" + "]]" * depth, "a"),
        ("{{" + "a {{b}} " * depth + "c", "{{" + "a  " * depth + "c"),
    ]
    got = spark.createDataFrame(texts, "t string, e string").select(M.plain_text(F.col("t")).alias("t"), "e").collect()
    assert [r["t"] for r in got] == [r["e"] for r in got]


def test_long_text_needs_no_stack(spark):
    text = F.concat(F.repeat(F.lit("{{a|b}} [[c|d]] word <ref>x</ref>\n"), 20_000), F.lit("{{|[[|<!-- "))
    row = featurize(spark.range(1).select(F.col("id").alias("rev_id"), text.alias("wikitext"))).first()
    assert (row["templates"], row["wikilinks"], row["ref"]) == (20_000, 20_000, 20_000)


def test_matches_template(spark):
    df = spark.createDataFrame([("Main",), ("Main article",), (" cite-web ",)], "n string")
    got = [tuple(r) for r in df.select(M.matches_template(F.col("n"), "main$"), M.matches_template(F.col("n"), "cite_w")).collect()]
    assert got == [(True, False), (False, False), (False, True)]

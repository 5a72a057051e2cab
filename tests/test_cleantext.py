import pytest

from editlift.operators import cleantext as C


def one(spark, text, rules=C.Rules()):
    df = spark.createDataFrame([(1, text)], "rev_id long, wikitext string")
    found = C.pieces(df, "rev_id", rules=rules).orderBy("pos").collect()
    joined = C.clean_text(df, "rev_id", rules=rules).first()["text"]
    return [(p["kind"], p["name"], p["piece"]) for p in found if p["kind"] != "text"], joined


@pytest.mark.parametrize(
    "text, kinds, joined",
    [
        ("a {{x|{{y}}|[[z]]}} b", [("template", "x", " ")], "a   b"),
        ("a<ref>{{cite|t}}</ref>b<ref name=q />", [("ref", "ref", " "), ("ref", "ref", " ")], "a b "),
        ("{{Note|x}}", [("ref", "note", " ")], " "),
        ("<REF>x</REF>", [("ref", "ref", " ")], " "),
        ("<div>in {{t}} [[a|b]] <b>c</b></div>", [("tag", "div", "in  b c")], "in  b c"),
        ("<div><div>x</div>y</div>z", [("tag", "div", "xy")], "xyz"),
        ("<table><tr><td>x</td></tr></table>y", [("tag", "table", None)], "y"),
        ("{|\n| a {{t}}\n{|\n| n\n|}\n|}\nafter", [("table", "table", None)], "\nafter"),
        ("x<br/>y<br>z", [("tag", "br", ""), ("tag", "br", "")], "xyz"),
        ("[[File:a.png|see [[b]]]] [[Category:C]] [[d|e]]",
         [("image", "File:a.png", None), ("category", "Category:C", None), ("link", "d", "e")], "  e"),
        ("== H ==\ntext", [("heading", None, None)], "\ntext"),
        ("[http://e.org see it]", [("url", None, "see it")], "see it"),
        ("'''b''' &amp; c", [("quotes", None, None), ("quotes", None, None)], "b & c"),
        ("a { b [ c < d ] } {{ open", [], "a { b [ c < d ] } {{ open"),
        ("1 = 2\nx = y", [], "1 = 2\nx = y"),
    ],
)
def test_top_level_pieces(spark, text, kinds, joined):
    assert one(spark, text) == (kinds, joined)


def test_rules(spark):
    text = "<poem>p</poem><gallery>g</gallery>{{Cite web|u}}{{Infobox x}}{{other}}"
    rules = C.Rules(tags_keep=("poem",), tags_remove=("gallery",), templates_keep=("cite",), templates_remove=("infobox",))
    assert one(spark, text, rules)[1] == "<poem>{{cite_web}}  "
    # Empty lists match nothing.
    assert one(spark, text)[1] == "p   "


def test_pieces_hold_the_whole_text(spark, sf):
    from pyspark.sql import functions as F

    from editlift import fixtures as fx
    from editlift.functions import markup as M

    rev = fx.load(spark, sf, fx.REVISIONS)
    raw = C._revision_pieces(rev, "rev_id", text_col="wikitext", rules=C.Rules()).select(
        "rev_id", F.array_join(F.transform("_pieces", lambda p: p["raw"]), "").alias("raw")
    )
    same = raw.join(rev.select("rev_id", M.clean(F.col("wikitext")).alias("clean")), "rev_id")
    assert same.where(F.col("raw") == F.col("clean")).count() == 200


def test_sections(spark):
    text = "lead\n== See also ==\n* x\n=== Sub ===\ny\n= Top =\nz"
    df = spark.createDataFrame([(1, text), (2, "== A ==\nb"), (3, "")], "rev_id long, wikitext string")
    rows = C.sections(df, "rev_id").orderBy("rev_id", "sec_no").collect()
    assert [(r["rev_id"], r["sec_no"], r["heading"]) for r in rows] == [
        (1, 0, None), (1, 1, "See also"), (1, 2, "Sub"), (1, 3, "Top"), (2, 0, None), (2, 1, "A"), (3, 0, None),
    ]
    assert "".join(r["section"] for r in rows if r["rev_id"] == 1) == text
    kept = C.drop_sections(C.sections(df, "rev_id"), ("see also",))
    assert kept.count() == 6
    rules = C.Rules(headings_remove=("see also",))
    assert C.clean_text(df, "rev_id", rules=rules).where("rev_id = 1").first()["text"] == "lead\n\ny\n\nz"


def test_spans_point_into_the_text(spark):
    text = "ab{{Cite web|x}}cd<ref>r</ref>{{pov}}<ref/>e"
    df = spark.createDataFrame([(1, text)], "rev_id long, wikitext string")
    rules = C.Rules(templates_keep=("cite",))
    joined = C.clean_text(df, "rev_id", rules=rules).first()["text"]
    spans = [tuple(r)[1:] for r in C.template_spans(df, "rev_id", rules=rules).orderBy("start").collect()]
    assert spans == [(2, 14, "cite_web"), (17, 18, "pov")]
    assert joined[2:14] == "{{cite_web}}"
    assert [r["offset"] for r in C.reference_offsets(df, "rev_id", rules=rules).orderBy("pos").collect()] == [16, 18]


def test_long_piece(spark):
    from pyspark.sql import functions as F

    text = F.concat(F.lit("{{box|"), F.repeat(F.lit("{{a|b}} [[c]] <b>d</b> "), 30_000), F.lit("}}end"))
    df = spark.range(1).select(F.col("id").alias("rev_id"), text.alias("wikitext"))
    assert C.clean_text(df, "rev_id").first()["text"] == " end"


@pytest.mark.parametrize("depth", [1, 13, 60, 200])
def test_pieces_at_any_depth(depth):
    from editlift.functions.brackets import split_pieces

    text = ("{{a|" * depth + "x" + "}}" * depth + " " + "[[a|" * depth + "y" + "]]" * depth + " " + "<div>" * depth + "z"
            + "</div>" * depth + "\n" + "{|\n" * depth + "c\n" + "|}\n" * depth)
    got = split_pieces(text)
    assert "".join(got) == text
    assert [p for p in got if p[0] in "{[<"] == [
        "{{a|" * depth + "x" + "}}" * depth, "[[a|" * depth + "y" + "]]" * depth, "<div>" * depth + "z" + "</div>" * depth,
        "{|\n" * depth + "c\n" + "|}\n" * (depth - 1) + "|}",
    ]


@pytest.mark.parametrize("text", ["{{open [[x", "}} ]] <b>x", "=a\n=b=\n", "", "<div><div/></div>", "{|\nno close", "x" * 10_000])
def test_unclosed_markup_stays_text(text):
    from editlift.functions.brackets import split_pieces

    got = split_pieces(text)
    assert "".join(got) == text
    assert not any(len(p) > 1 and p[:2] in ("{{", "[[", "{|") for p in got)


def test_pieces_are_scanned_in_slices_of_bounded_bytes():
    import pyarrow as pa

    from editlift.functions.brackets import _slices

    rows = [["é" * 30, "b"], None, [], [None, "c" * 5], ["d" * 500], ["e"], ["f" * 39, "g" * 60]]
    for batch in (pa.array(rows, pa.list_(pa.string())), pa.array([["skipped"], *rows], pa.list_(pa.string())).slice(1)):
        parts = [p.to_pylist() for p in _slices(batch, 100)]
        assert [r for p in parts for r in p] == rows
        size = [sum(len(t.encode()) for r in p if r for t in r if t) for p in parts]
        assert all(s <= 100 or len(p) == 1 for s, p in zip(size, parts)) and len(parts) > 2

"""The same results stated as plain SQL over the given tables.

Written apart from the Spark code: own expressions, own order of steps. Only
the input views, the fixed patterns' meaning and the model weights are shared.
"""

from __future__ import annotations

from html.entities import name2codepoint

from editlift import fixtures as fx
from editlift.functions import markup as M
from editlift.ml.linear import THRESHOLDS, WEIGHTS

ORACLES: dict[str, str] = {}

CLASSES = ("Stub", "Start", "C", "B", "GA", "FA")
PER_WORD = (
    "headings", "sub_headings", "main_templates", "external_links", "wikilinks", "cite_templates",
    "templates", "ref", "images", "categories", "smartlists",
)
MODEL = (
    "words", "backlog_accuracy", "backlog_content", "backlog_other", "backlog_style", "backlog_links",
    *PER_WORD, *(f"{c}_per_word" for c in PER_WORD), "coordinates", "infoboxes",
)
RAW = (
    "words", "backlog_accuracy", "backlog_content", "backlog_other", "backlog_style", "backlog_links",
    *PER_WORD, "coordinates", "infoboxes",
)


def code_of(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CLASSES)) + " END"


def label_of(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLASSES)) + " END"


def gsub(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"


def count(pattern: str, text: str = "clean") -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INT)"


CLEAN = gsub(gsub(gsub("wikitext", r"(?s)<!--.*?-->"), r"(?s)<nowiki>.*?</nowiki>"), r"\{\{\{[^{}]*\}\}\}")

PLAIN = "clean"
for _ in range(3):
    PLAIN = gsub(PLAIN, r"\{\{[^{}]*\}\}")
for _ in range(2):
    PLAIN = gsub(PLAIN, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1")
PLAIN = gsub(PLAIN, r"(?i)\[(?:https?|ftp)://[^\s\[\]]*[ \t]*([^\[\]]*)\]", r"\1")
PLAIN = gsub(PLAIN, r"</?[a-zA-Z][^<>]*>|''{2,}")
PLAIN = gsub(PLAIN, r"(?m)^={1,6}[ \t]*([^=\n][^\n]*?)[ \t]*={1,6}[ \t]*$|^[*#:;]+[ \t]*", r"\1")


def decode_sql(x: str) -> str:
    """Character references replaced in one pass, as ``markup.decode_entities`` does."""
    ref = M.ENTITY_REF
    names = "MAP {" + ", ".join("'{}': '{}'".format(k, chr(v).replace("'", "''")) for k, v in sorted(name2codepoint.items())) + "}"
    r = f"regexp_extract_all({x}, '{ref}')[i]"
    body = f"substr({r}, 2, length({r}) - 2)"
    point = (f"(CASE WHEN lower({body}) LIKE '#x%' THEN ('0x' || substr({body}, 3))::BIGINT "
             f"WHEN {body} LIKE '#%' THEN substr({body}, 2)::BIGINT END)")
    char = (f"coalesce(map_extract({names}, {body})[1], CASE WHEN {point} BETWEEN 1 AND 1114111 "
            f"AND {point} NOT BETWEEN 55296 AND 57343 THEN chr(CAST({point} AS INT)) END, {r})")
    parts = f"string_split_regex({x}, '{ref}')"
    return (f"CASE WHEN contains({x}, '&') THEN {parts}[1] || array_to_string(list_transform("
            f"range(1, len(regexp_extract_all({x}, '{ref}')) + 1), lambda i: {char} || {parts}[i + 1]), '') ELSE {x} END")


PLAIN = decode_sql(PLAIN)

NAME = r"\{\{[ \t\n]*([^{}|<>\[\]]+)"
NOTICE = r"(?i)\{\{[ \t\n]*(?:%s)[ \t\r\n]*[|}]"

VIEWS = {
    "revisions_fx": fx.REVISIONS, "labels_fx": fx.LABELS, "backlog_fx": fx.BACKLOG, "talk_fx": fx.TALK,
    "categories_fx": fx.CATEGORIES, "redirects_fx": fx.REDIRECTS, "pages_fx": fx.PAGES,
    "requests_fx": fx.REQUESTS, "cond_probs_fx": fx.COND_PROBS, "preds_fx": fx.PREDICTIONS,
    "spans_fx": fx.SPANS, "catalogue_fx": fx.CATALOGUE, "template_redirects_fx": fx.TEMPLATE_REDIRECTS,
    "mixed_fx": "SELECT rev_id, CASE WHEN rev_id % 13 = 0 THEN 'List' ELSE wp10 END AS wp10 FROM revisions_fx",
    "clean_fx": f"SELECT *, {CLEAN} AS clean FROM revisions_fx",
    "names_fx": f"SELECT rev_id, page_id, unnest(regexp_extract_all(clean, '{NAME}', 1)) AS raw, "
    f"unnest(range(len(regexp_extract_all(clean, '{NAME}', 1)))) AS pos FROM clean_fx",
}


def feature_view(source: str, text: str, keep: str) -> str:
    """Feature columns over a text column, as SQL."""
    clean = CLEAN.replace("wikitext", text)
    notices = {
        "accuracy": ("pov|npov", ("pov", "npov")), "content": (None, ()), "style": ("copy edit|copyedit", ()),
        "files": ("should be png|make png", ()), "other": (None, ()), "links": ("dead link|broken link", ()),
    }
    cols = []
    for name, (pattern, _) in notices.items():
        cols.append(("CAST(0 AS INT)" if pattern is None else count(NOTICE % pattern)) + f" AS backlog_{name}")
    links = count(r"\[\[[^\[\]|]+")
    images, categories = count(r"(?i)\[\[(?:file|image:)"), count(r"(?i)\[\[category:")
    return f"""
SELECT {keep},
 CAST(len(regexp_extract_all({PLAIN}, '[\\p{{L}}\\p{{N}}]+')) + 1 AS INT) AS words,
 {count(r"(?m)^==[^=\n][^\n]*==[ \t]*$")} AS headings,
 {count(r"(?m)^={3,6}[^=\n][^\n]*={3,6}[ \t]*$")} AS sub_headings,
 {images} AS images, {categories} AS categories, {links} - {images} - {categories} AS wikilinks,
 {count(r'(?i)(?:https?|ftp)://[^\s\[\]<>{}|"]+')} AS external_links,
 {count(r"(?i)\{\{[ \t\n]*main[ \t\r\n]*[|}]")} AS main_templates,
 {count(r"(?i)\{\{[ \t\n]*cite")} AS cite_templates,
 {count(r"(?i)\{\{[ \t\n]*infobox")} AS infoboxes,
 {count(r"\{\{[ \t\n]*[^{}|<>\[\]]+")} AS templates,
 {", ".join(cols)},
 {count(r"<ref(?:[ \t\n][^>]*)?/?>")} AS ref, CAST(0 AS INT) AS smartlists,
 contains(lower({text}), '#coordinates') AS coordinates,
 {count(r"(?m)^[{][|]")} AS tables,
 {PLAIN} AS text
FROM (SELECT *, {clean} AS clean FROM {source}) AS cleaned"""


VIEWS["features_fx"] = feature_view("revisions_fx", "wikitext", "rev_id, page_id, wp10")

_INPUTS = {
    "mixed_fx": ("revisions_fx",), "clean_fx": ("revisions_fx",), "names_fx": ("revisions_fx", "clean_fx"),
    "features_fx": ("revisions_fx",),
}


def oracle(name: str, sql: str, *views: str, extra: dict[str, str] | None = None) -> None:
    """Register a text; named views and what they need come first as CTEs."""
    ordered: list[str] = []
    for v in views:
        for needed in (*_INPUTS.get(v, ()), v):
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in ordered]
    parts += [f"{k} AS ({v.strip()})" for k, v in (extra or {}).items()]
    ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()


# --- scans, sources, sinks: what comes back is what went in ---------------------

oracle("s1_ndjson_scan", "SELECT rev_id AS revid, wp10, CAST(length(wikitext) AS INT) AS n_chars FROM revisions_fx", "revisions_fx")
oracle("s1_tolerant_scan", """
SELECT rev_id AS revid, wp10, CAST(length(wikitext) AS INT) AS n_chars FROM revisions_fx WHERE rev_id % 10 <> 0""", "revisions_fx")
oracle(
    "s2_ndjson_sink",
    "SELECT lang, count(*) AS n, CAST(sum(length(wikitext)) AS BIGINT) AS n_chars FROM revisions_fx GROUP BY lang",
    "revisions_fx",
)
oracle(
    "s3_labeled_without_text",
    "SELECT rev_id AS revid, wp10, words, headings, ref, coordinates FROM features_fx", "features_fx",
)
oracle(
    "s4_labeled_folder",
    f"SELECT wp10, {code_of('wp10')} AS code, count(*) AS n, CAST(sum(templates) AS BIGINT) AS templates "
    "FROM features_fx GROUP BY wp10", "features_fx",
)
oracle(
    "s5_csv_features",
    f"SELECT rev_id AS revid, wp10, {code_of('wp10')} AS code, words, images, "
    "CASE WHEN backlog_accuracy > 0 THEN 'pov' END AS backlog_accuracy_templates FROM features_fx", "features_fx",
)
oracle("s6_csv_comment", "SELECT wp10 AS class, count(*) AS articles FROM revisions_fx GROUP BY wp10", "revisions_fx")
oracle("s7_split_by_label", "SELECT rev_id, wp10, CAST(2 * (rev_id % 4) AS INT) AS ref FROM revisions_fx", "revisions_fx")
oracle("s7_replace_classes", """
SELECT rev_id, wp10, CAST(2 * (rev_id % 4) AS INT) AS ref FROM revisions_fx WHERE rev_id % 2 = 1
UNION ALL SELECT rev_id, wp10, CAST(2 * (rev_id % 4) + 100 AS INT) FROM revisions_fx WHERE rev_id % 4 = 0""", "revisions_fx")
oracle("s8_refuse_existing", "SELECT rev_id, wp10, true AS refused FROM revisions_fx", "revisions_fx")

CATALOGUE_ROWS = r"""
SELECT c.section, c.category, regexp_replace(c.template, '^T(?:emplate)?:', '') AS template,
 regexp_replace(r.from_title, '^T(?:emplate)?:', '') AS alias
FROM catalogue_fx c LEFT JOIN (SELECT DISTINCT * FROM template_redirects_fx) r
 ON r.to_title = 'Template:' || regexp_replace(c.template, '^T(?:emplate)?:', '')
"""
for _name in ("s9_catalogue_file", "b3_build_catalogue"):
    oracle(_name, CATALOGUE_ROWS, "catalogue_fx", "template_redirects_fx")

# --- projection, filter, flattening ---------------------------------------------

oracle("d1_flatten_revision", """
SELECT rev_id, page_id, 'Title ' || page_id AS page_title, CAST(0 AS INT) AS page_namespace,
 CASE WHEN rev_id % 10 = 9 THEN 'Title 0' END AS page_redirect, rev_id % 5 = 0 AS deleted_text,
 false AS deleted_comment, false AS deleted_user,
 CASE WHEN rev_id % 4 > 0 THEN rev_id % 7 END AS user_id, CASE WHEN rev_id % 4 > 0 THEN source END AS user_text,
 CASE WHEN rev_id % 3 > 0 THEN lang ELSE '' END AS comment, rev_id % 10 = 9 AS is_redirect
FROM revisions_fx""", "revisions_fx")
oracle("d2_first_pages", """
SELECT rev_id, page_id FROM revisions_fx
WHERE page_id IN (SELECT DISTINCT page_id FROM revisions_fx ORDER BY page_id LIMIT 10)""", "revisions_fx")
oracle("d3_page_revisions", """
SELECT rev_id AS revid, page_id AS pageid, CAST(0 AS INT) AS ns, 'Title ' || page_id AS title,
 CAST(length(wikitext) AS INT) AS n_chars FROM revisions_fx""", "revisions_fx")
oracle("d4_label_join", """
SELECT r.rev_id, r.page_id, l.wp10 FROM revisions_fx r
JOIN (SELECT rev_id, arg_max(wp10, seq) AS wp10 FROM labels_fx GROUP BY rev_id) l ON l.rev_id = r.rev_id
""", "revisions_fx", "labels_fx")
oracle("d5_label_code", f"SELECT rev_id, wp10, {code_of('wp10')} AS code FROM mixed_fx", "mixed_fx")
oracle(
    "d6_code_label",
    f"SELECT l_orderkey, l_linenumber, {label_of('actual')} AS actual, {label_of('pred')} AS pred FROM preds_fx", "preds_fx",
)
oracle("d7_strict_labels", "SELECT rev_id, wp10 FROM revisions_fx", "revisions_fx")
oracle(
    "d8_keep_classes",
    "SELECT wp10, count(*) AS articles FROM mixed_fx WHERE wp10 <> 'List' GROUP BY wp10", "mixed_fx",
)


def model_sql(source: str, keep: str, digits: int | None = None) -> str:
    """The 30 model columns over a view of raw features."""
    def r(expr: str) -> str:
        return expr if digits is None else f"round({expr}, {digits})"

    cols = []
    for c in MODEL:
        if c.endswith("_per_word"):
            cols.append(r(f"CAST({c[:-9]} AS DOUBLE) / CAST(words AS DOUBLE)") + f" AS {c}")
        elif c in ("coordinates", "infoboxes"):
            cols.append(f"CAST(CASE WHEN CAST({c} AS INT) <> 0 THEN 1 ELSE 0 END AS DOUBLE) AS {c}")
        else:
            cols.append(f"CAST({c} AS DOUBLE) AS {c}")
    return f"SELECT {keep}, " + ", ".join(cols) + f" FROM {source}"


oracle("d9_model_columns", model_sql("features_fx", "rev_id", 6), "features_fx")
oracle("d11_next_class", """
SELECT rev_id, wp10, CASE wp10 WHEN 'Stub' THEN 'Start' WHEN 'Start' THEN 'C' WHEN 'C' THEN 'B'
 WHEN 'B' THEN 'GA' WHEN 'GA' THEN 'FA' END AS next_class FROM mixed_fx""", "mixed_fx")
oracle("d12_id_batches", """
SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch, count(*) AS n,
 string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS ids
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1""")
oracle("d13_page_url", """
SELECT rev_id, CASE WHEN rev_id % 2 = 0
 THEN 'https://' || lang || '.wikipedia.org/w/index.php?title=' || url_encode('Page ' || rev_id || ' & more') || '&oldid=' || rev_id
 ELSE 'https://' || lang || '.wikipedia.org/wiki/' || url_encode('Page ' || rev_id || ' & more') END AS url
FROM revisions_fx""", "revisions_fx")

# --- joins ------------------------------------------------------------------------

SECTIONS = {
    "Accuracy": "Accuracy", "Content": "Content", "Style": "Style", "File Description": "File",
    "File Quality": "File", "Other": "Other", "Links": "Links",
}
FILE_SECTION = "CASE WHEN section IN ('File Description', 'File Quality') THEN 'File' ELSE section END"
USED_SECTIONS = ", ".join(f"'{s}'" for s in SECTIONS)


def flat_sql(source: str, where: str = "true") -> str:
    return f"""
SELECT lower(name) AS name, max(section) AS section FROM (
 SELECT template AS name, {FILE_SECTION} AS section FROM {source} WHERE section IN ({USED_SECTIONS}) AND {where}
 UNION ALL
 SELECT alias AS name, {FILE_SECTION} AS section FROM {source} WHERE section IN ({USED_SECTIONS}) AND {where}
) AS both_names WHERE name IS NOT NULL GROUP BY lower(name)"""


oracle("j1_backlog_hits", r"""
SELECT n.rev_id, CAST(n.pos AS INT) AS pos, f.name, f.section FROM names_fx n
JOIN flat f ON f.name = lower(trim(n.raw, ' ' || chr(9) || chr(10) || chr(13)))""",
       "names_fx", "backlog_fx", extra={"flat": flat_sql("backlog_fx")})
oracle("j2_redirects", """
SELECT q.request_id, coalesce(r.to_title, q.title) AS title
FROM requests_fx q LEFT JOIN redirects_fx r ON r.from_title = q.title""", "requests_fx", "redirects_fx")
oracle("j2_redirect_chains", """
SELECT doc_id AS rev_id, 'Title ' || CASE WHEN doc_id % 10 >= 5 AND doc_id % 50 > 9
 THEN doc_id - doc_id % 10 + 4 ELSE doc_id END AS title FROM documents""")

ASKED = """
SELECT q.request_id, q.title AS asked, coalesce(r.to_title, q.title) AS title
FROM requests_fx q LEFT JOIN redirects_fx r ON r.from_title = q.title
WHERE q.title IS NOT NULL AND trim(q.title) <> ''"""
NEWEST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY timestamp DESC, revid DESC) AS rn FROM pages_fx) AS ranked
WHERE rn = 1"""
oracle("j3_page_lookup", """
SELECT a.request_id, a.asked, a.title, p.revid, p.pageid, p.timestamp,
 CASE WHEN p.revid IS NOT NULL THEN 'Talk:' || a.title END AS talk_page, p.revid IS NOT NULL AS found,
 CAST(length(p.content) AS INT) AS n_chars
FROM asked a LEFT JOIN newest p ON p.title = a.title""",
       "requests_fx", "pages_fx", "redirects_fx", extra={"asked": ASKED, "newest": NEWEST})
oracle("j3_not_found", """
SELECT request_id, asked, title FROM asked a WHERE NOT EXISTS (SELECT 1 FROM pages_fx p WHERE p.title = a.title)
""", "requests_fx", "pages_fx", "redirects_fx", extra={"asked": ASKED})
oracle("j4_talk_page", """
SELECT p.revid, p.title, 'Talk:' || p.title AS talk_title, t.p_name AS note
FROM pages_fx p LEFT JOIN part t ON p.title = 'Title ' || t.p_partkey""", "pages_fx")

# Edit number, name, column, change, words.
EDIT_ROWS = (
    (0, "unchanged", "-", 0, 0), (1, "sentence", "-", 0, 15), (2, "paragraph", "-", 0, 150),
    (3, "headings", "headings", 1, 2), (4, "sub_headings", "sub_headings", 1, 2), (5, "images", "images", 1, 0),
    (6, "categories", "categories", 1, 2), (7, "wikilinks", "wikilinks", 1, 1),
    (8, "external_links", "external_links", 1, 1), (9, "citation", "cite_templates", 1, 5), (10, "ref", "ref", 1, 15),
    (11, "coordinates", "coordinates", 1, 0), (12, "infoboxes", "infoboxes", 1, 0),
    (13, "backlog_accuracy", "backlog_accuracy", -1, 0), (14, "backlog_other", "backlog_other", -1, 0),
    (15, "backlog_style", "backlog_style", -1, 0), (16, "backlog_links", "backlog_links", -1, 0),
)
EDIT_VALUES = ", ".join(f"({n}, '{e}', '{c}', {d}, {w})" for n, e, c, d, w in EDIT_ROWS)


def variants_sql(source: str, keep: str) -> str:
    cols = []
    for c in RAW:
        if c == "words":
            cols.append("CAST(greatest(words + wd, 1) AS INT) AS words")
        elif c in ("coordinates", "infoboxes"):
            cols.append(f"CAST(CASE WHEN col = '{c}' THEN 1 ELSE CAST({c} AS INT) END AS INT) AS {c}")
        else:
            cols.append(f"CAST(CASE WHEN col = '{c}' THEN greatest({c} + d, 0) ELSE {c} END AS INT) AS {c}")
    return (
        f"SELECT {keep}, CAST(edit_no AS INT) AS edit_no, edit, {', '.join(cols)} FROM {source} "
        f"CROSS JOIN (VALUES {EDIT_VALUES}) AS e(edit_no, edit, col, d, wd)"
    )


oracle("j5_edit_variants", variants_sql("features_fx", "rev_id"), "features_fx")

TOKENS = """
SELECT doc_id, tok_start, lead(tok_start) OVER (PARTITION BY doc_id ORDER BY tok_start) AS next_start
FROM (SELECT DISTINCT doc_id, tok_start FROM spans_fx) AS d"""
oracle("j6_flagged_tokens", """
SELECT t.doc_id, t.tok_start, EXISTS (SELECT 1 FROM spans_fx r WHERE r.doc_id = t.doc_id AND r.ref_pos >= t.tok_start
 AND (t.next_start IS NULL OR r.ref_pos < t.next_start)) AS reference FROM toks t""", "spans_fx", extra={"toks": TOKENS})
oracle("j7_reference_tokens", """
SELECT r.doc_id, r.ref_pos, count(DISTINCT r.rid) AS n_refs, max(s.tok_start) AS tok_start
FROM (SELECT *, row_number() OVER () AS rid FROM spans_fx) r
LEFT JOIN spans_fx s ON s.doc_id = r.doc_id AND s.tok_start <= r.ref_pos
GROUP BY r.doc_id, r.ref_pos""", "spans_fx")
oracle("j8_template_pages", r"""
SELECT DISTINCT coalesce(lower(b.template), n.used) AS template, n.page_id
FROM (SELECT page_id, lower(trim(raw, ' ' || chr(9) || chr(10) || chr(13))) AS used FROM names_fx) n
LEFT JOIN backlog_fx b ON lower(b.alias) = n.used""", "names_fx", "backlog_fx")
oracle("j9_category_members", """
SELECT 'Things' AS category, r.rev_id, 'Title ' || r.rev_id AS title, d.from_title AS alias
FROM revisions_fx r LEFT JOIN redirects_fx d ON d.to_title = 'Title ' || r.rev_id
WHERE r.rev_id % 5 > 0""", "revisions_fx", "redirects_fx")

# --- aggregation --------------------------------------------------------------------

WS = "' ' || chr(9) || chr(10) || chr(13)"
oracle("a1_template_counts", f"SELECT rev_id, trim(raw, {WS}) AS name, count(*) AS n FROM names_fx GROUP BY 1, 2", "names_fx")
oracle("a2_link_counts", rf"""
SELECT rev_id, trim(raw, {WS}) AS name, count(*) AS n
FROM (SELECT rev_id, unnest(regexp_extract_all(clean, '\[\[([^\[\]|]+)', 1)) AS raw FROM clean_fx) AS l
GROUP BY 1, 2""", "clean_fx")
BACKLOG_COLUMNS = """
 backlog_accuracy, CASE WHEN backlog_accuracy > 0 THEN 'pov' END AS backlog_accuracy_templates,
 backlog_content, CAST(NULL AS VARCHAR) AS backlog_content_templates,
 backlog_style, CAST(NULL AS VARCHAR) AS backlog_style_templates,
 backlog_files, CAST(NULL AS VARCHAR) AS backlog_files_templates,
 backlog_other, CAST(NULL AS VARCHAR) AS backlog_other_templates,
 backlog_links, CAST(NULL AS VARCHAR) AS backlog_links_templates"""
oracle("a3_backlog_sections", f"SELECT rev_id, {BACKLOG_COLUMNS} FROM features_fx", "features_fx")
oracle("a4_class_frequency", "SELECT wp10, count(*) AS articles FROM revisions_fx GROUP BY wp10", "revisions_fx")
oracle("a5_class_share", """
SELECT wp10, count(*) AS articles, round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM revisions_fx), 6) AS pct
FROM revisions_fx GROUP BY wp10""", "revisions_fx")
oracle("a6_share_between", """
SELECT round(sum(pct), 6) AS pct FROM (
 SELECT CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM revisions_fx) AS pct
 FROM revisions_fx WHERE wp10 IN ('Stub', 'Start') GROUP BY wp10) AS s""", "revisions_fx")

GRID = """
SELECT CAST(a.k AS INT) AS actual, CAST(p.k AS INT) AS pred,
 (SELECT count(*) FROM preds_fx x WHERE x.actual = a.k AND x.pred = p.k) AS n
FROM range(6) AS a(k) CROSS JOIN range(6) AS p(k)"""
SHARES = """
SELECT actual, pred, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM preds_fx) AS p,
 CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY actual) AS p_actual FROM grid"""
oracle("a7_confusion", "SELECT actual, pred, n, round(p, 6) AS p, round(p_actual, 6) AS p_actual FROM shares",
       "preds_fx", extra={"grid": GRID, "shares": SHARES})
oracle(
    "a8_confusion_matrix",
    "SELECT actual, " + ", ".join(f"round(sum(CASE WHEN pred = {k} THEN p_actual ELSE 0 END), 6) AS p{k}" for k in range(6))
    + " FROM shares GROUP BY actual",
    "preds_fx", extra={"grid": GRID, "shares": SHARES},
)
# Each of the cumulated columns 1..5 agrees when both codes lie on the same side of it.
ORD = "(" + " + ".join(
    f"(CASE WHEN (actual <= {c}) = (pred <= {c}) THEN 1.0 ELSE 0.0 END)" for c in range(1, 6)
) + ") / 5.0"
EXACT = "(" + " + ".join(
    f"(CASE WHEN (actual = {c}) = (pred = {c}) THEN 1.0 ELSE 0.0 END)" for c in range(6)
) + ") / 6.0"
SCORED = f"SELECT actual, pred, CAST({ORD} AS DOUBLE) AS o, CAST({EXACT} AS DOUBLE) AS e, CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END AS h FROM preds_fx"
oracle("a9_exact_hit_rate", "SELECT round(avg(e), 6) AS exact_hit FROM scored", "preds_fx", extra={"scored": SCORED})
oracle("a10_ordinal_hit_rate", "SELECT round(avg(o), 6) AS ordinal_hit FROM scored", "preds_fx", extra={"scored": SCORED})
SIDES = {
    "scored": SCORED,
    "by_actual": "SELECT actual AS class_code, count(*) AS n, avg(o) AS recall, avg(h) AS recall_exact FROM scored GROUP BY actual",
    "by_pred": "SELECT pred AS class_code, avg(o) AS precision, avg(h) AS precision_exact FROM scored GROUP BY pred",
}
oracle("a11_ordinal_recall_precision", """
SELECT a.class_code, round(a.recall, 6) AS recall, round(p.precision, 6) AS precision
FROM by_actual a JOIN by_pred p ON a.class_code = p.class_code""", "preds_fx", extra=SIDES)
oracle("a12_exact_recall_precision", """
SELECT a.class_code, round(a.recall_exact, 6) AS recall_exact, round(p.precision_exact, 6) AS precision_exact
FROM by_actual a JOIN by_pred p ON a.class_code = p.class_code""", "preds_fx", extra=SIDES)
REPORT = """
SELECT a.class_code, a.n, p.precision, p.precision_exact, a.recall, a.recall_exact
FROM by_actual a FULL JOIN by_pred p ON a.class_code = p.class_code"""
oracle("a14_class_report", """
SELECT class_code, n, round(precision, 6) AS precision, round(precision_exact, 6) AS precision_exact,
 round(recall, 6) AS recall, round(recall_exact, 6) AS recall_exact FROM report""", "preds_fx", extra={**SIDES, "report": REPORT})
oracle("a13_macro_f1", """
SELECT round(pe, 6) AS precision_exact, round(re, 6) AS recall_exact, round(p, 6) AS precision, round(r, 6) AS recall,
 round(2 * pe * re / (pe + re), 6) AS f1_exact, round(2 * p * r / (p + r), 6) AS f1
FROM (SELECT avg(precision_exact) AS pe, avg(recall_exact) AS re, avg(precision) FILTER (class_code > 0) AS p,
 avg(recall) FILTER (class_code > 0) AS r FROM report) AS m""", "preds_fx", extra={**SIDES, "report": REPORT})
oracle("a15_ordinal_score", "SELECT round(1 - avg(abs(pred - actual) / 5.0), 6) AS ordinal_score FROM preds_fx", "preds_fx")

PROBS = """
SELECT rev_id, 1 - q0 AS p0, q0 * (1 - q1) AS p1, q0 * q1 * (1 - q2) AS p2, q0 * q1 * q2 * (1 - q3) AS p3,
 q0 * q1 * q2 * q3 * (1 - q4) AS p4, q0 * q1 * q2 * q3 * q4 AS p5 FROM cond_probs_fx"""
oracle("a16_log_loss", """
SELECT round(avg(-ln(greatest(CASE CAST(rev_id % 6 AS INT) WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3
 WHEN 4 THEN p4 ELSE p5 END, 1e-15))), 6) AS log_loss FROM probs""", "cond_probs_fx", extra={"probs": PROBS})
oracle("a17_quality_by_category", """
SELECT page_id, CASE min(CASE WHEN category LIKE 'Category:FA-Class%' THEN 1
 WHEN category LIKE 'Category:GA-Class%' OR category LIKE 'Category:A-Class%' THEN 2
 WHEN category LIKE 'Category:B-Class%' THEN 3 WHEN category LIKE 'Category:C-Class%' THEN 4
 WHEN category LIKE 'Category:Start-Class%' THEN 5 WHEN category LIKE 'Category:Stub-Class%' THEN 6 END)
 WHEN 1 THEN 'FA' WHEN 2 THEN 'GA' WHEN 3 THEN 'B' WHEN 4 THEN 'C' WHEN 5 THEN 'Start' WHEN 6 THEN 'Stub' END AS quality
FROM categories_fx GROUP BY page_id""", "categories_fx")

BANNERS = """
SELECT page_id, seq, trim(regexp_extract(banner, '\\{\\{([^|}]+)', 1)) AS name,
 CASE lower(trim(regexp_extract(banner, '\\|class=([^|}]*)', 1))) WHEN 'disambig' THEN 'dab' WHEN 'current' THEN 'cur'
  WHEN 'a' THEN 'ga' WHEN 'bplus' THEN 'b' WHEN 'none' THEN NULL
  ELSE lower(trim(regexp_extract(banner, '\\|class=([^|}]*)', 1))) END AS class,
 nullif(lower(trim(regexp_extract(banner, '\\|importance=([^|}]*)', 1))), 'none') AS importance
FROM talk_fx"""
PROJECTS = """
SELECT page_id, name, class, importance FROM (
 SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY seq DESC) AS rn FROM banners) AS ranked WHERE rn = 1"""
PRIORITY = ("fa", "ga", "b", "c", "start", "stub", "fl", "list", "dab", "book", "template", "category", "draft", "redirect")
oracle(
    "a18_quality_by_banner",
    "SELECT page_id, CASE min(CASE class " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PRIORITY)) + " END) "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(PRIORITY)) + " END AS quality FROM projects GROUP BY page_id",
    "talk_fx", extra={"banners": BANNERS, "projects": PROJECTS},
)
oracle("a19_project_map", "SELECT page_id, name, class, importance FROM projects", "talk_fx",
       extra={"banners": BANNERS, "projects": PROJECTS})

# --- windows, sort, top-k, set operations ----------------------------------------------

oracle("w1_group_total", """
SELECT actual, pred, n, CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS total
FROM (SELECT actual, pred, count(*) AS n FROM preds_fx GROUP BY actual, pred) AS c""", "preds_fx")
oracle("w2_running_class_sum", """
SELECT rev_id, round(p0, 6) AS c0, round(p0 + p1, 6) AS c1, round(p0 + p1 + p2, 6) AS c2, round(p0 + p1 + p2 + p3, 6) AS c3,
 round(p0 + p1 + p2 + p3 + p4, 6) AS c4, round(p0 + p1 + p2 + p3 + p4 + p5, 6) AS c5 FROM probs""",
       "cond_probs_fx", extra={"probs": PROBS})
SECTION_ROWS = r"""
SELECT rev_id, unnest(parts) AS section, unnest(range(len(parts))) AS sec_no FROM (
 SELECT rev_id, string_split(regexp_replace(clean, '(?m)^(={1,6}[^=\n][^\n]*={1,6}[ \t]*)$', chr(1) || '\1', 'g'), chr(1)) AS parts
 FROM clean_fx) AS s"""
HEADED = r"""
SELECT rev_id, CAST(sec_no AS INT) AS sec_no, section,
 nullif(trim(regexp_extract(section, '^={1,6}([^=\n][^\n]*?)={1,6}[ \t]*(?:\n|$)', 1)), '') AS heading FROM split_rows"""
SECTION_VIEWS = {"split_rows": SECTION_ROWS, "headed": HEADED}
oracle("w3_section_offsets", """
SELECT rev_id, sec_no, CAST(length(section) AS INT) AS length,
 CAST(coalesce(sum(length(section)) OVER (PARTITION BY rev_id ORDER BY sec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM headed""", "clean_fx", extra=SECTION_VIEWS)


def scores_sql() -> dict[str, str]:
    """Views for the gains of all edits under the linear scorer."""
    z = " + ".join(f"{c} * CAST({w!r} AS DOUBLE)" for c, w in WEIGHTS.items())
    q = ", ".join(f"1 / (1 + exp(CAST({t!r} AS DOUBLE) - z)) AS q{k}" for k, t in enumerate(THRESHOLDS))
    probs = (
        "1 - q0 AS p0, q0 * (1 - q1) AS p1, q0 * q1 * (1 - q2) AS p2, q0 * q1 * q2 * (1 - q3) AS p3, "
        "q0 * q1 * q2 * q3 * (1 - q4) AS p4, q0 * q1 * q2 * q3 * q4 AS p5"
    )
    return {
        "variants": variants_sql("features_fx", "rev_id"),
        "model": model_sql("variants", "rev_id, edit_no, edit"),
        "latent": f"SELECT rev_id, edit_no, edit, {z} AS z FROM model",
        "steps": f"SELECT rev_id, edit_no, edit, {q} FROM latent",
        "chained": f"SELECT rev_id, edit_no, edit, {probs} FROM steps",
        "expected": "SELECT *, 0 * p0 + p1 + 2 * p2 + 3 * p3 + 4 * p4 + 5 * p5 AS score FROM chained",
        "gains": "SELECT e.rev_id, e.edit_no, e.edit, e.score, round(e.score - b.score, 9) AS gain "
        "FROM expected e JOIN expected b ON b.rev_id = e.rev_id AND b.edit_no = 0 WHERE e.edit_no > 0",
        "ranked": "SELECT rev_id, CAST(row_number() OVER (PARTITION BY rev_id ORDER BY gain DESC, edit_no) AS INT) AS rank, "
        "edit_no, edit, gain FROM gains WHERE gain > 0",
    }


SCORES = scores_sql()
oracle("w4_ranked_edits", "SELECT rev_id, rank, edit_no, edit, gain FROM ranked", "features_fx", extra=SCORES)
oracle("w5_shown_edits", "SELECT rev_id, edit, CAST(round_even(gain * 100, 0) AS INT) AS gain_pct FROM ranked WHERE gain > 0.005",
       "features_fx", extra=SCORES)
oracle("w6_concat", """
SELECT rev_id, wp10, CASE WHEN rev_id % 2 = 0 THEN lang END AS lang, CASE WHEN rev_id % 2 = 1 THEN source END AS source
FROM revisions_fx""", "revisions_fx")
oracle("w7_classes_best_first", "\nUNION ALL\n".join(
    f"SELECT rev_id, CAST({5 - k} AS INT) AS pos, '{c}' AS class, CAST(round_even(p{k} * 100, 0) AS INT) AS pct FROM probs"
    for k, c in enumerate(CLASSES)), "cond_probs_fx", extra={"probs": PROBS})

# --- markup features -----------------------------------------------------------------------

for _name, _columns in {
    "f1_words": "words", "f2_headings": "headings", "f3_sub_headings": "sub_headings", "f4_images": "images",
    "f5_categories": "categories", "f6_wikilinks": "wikilinks", "f7_external_links": "external_links",
    "f8_templates": "templates", "f10_name_matches": "main_templates, cite_templates, infoboxes", "f11_ref": "ref",
    "f12_smartlists": "smartlists, tables", "f13_coordinates": "coordinates", "f14_plain_text": "text",
    "f15_features": "page_id, wp10, words, headings, sub_headings, images, categories, wikilinks, external_links, "
    "main_templates, cite_templates, infoboxes, templates, " + BACKLOG_COLUMNS + ", ref, smartlists, coordinates",
}.items():
    oracle(_name, f"SELECT rev_id, {_columns} FROM features_fx", "features_fx")
oracle(
    "f3_headings_of_level",
    "SELECT rev_id, " + ", ".join(count(rf"(?m)^={{{k}}}[^=\n][^\n]*={{{k}}}[ \t]*$") + f" AS level{k}" for k in (2, 3, 4))
    + " FROM clean_fx", "clean_fx",
)
oracle("f9_template_keys", f"SELECT translate(lower(trim(raw, {WS})), ' -', '__') AS key, count(*) AS n FROM names_fx GROUP BY 1", "names_fx")
oracle("f16_references", "SELECT rev_id, 2 * (rev_id % 4) AS n FROM revisions_fx WHERE rev_id % 4 > 0", "revisions_fx")
LINK_ROWS = r"""
SELECT rev_id, unnest(regexp_extract_all(clean, '\[\[([^\[\]|]+)', 1)) AS title,
 unnest(range(len(regexp_extract_all(clean, '\[\[([^\[\]|]+)', 1)))) AS pos FROM clean_fx"""
for _name, _start in {"f17_image_links": "(?:File|Image|Media):", "f17_category_links": "Category:"}.items():
    oracle(_name, f"SELECT rev_id, CAST(pos AS INT) AS pos, title FROM link_rows WHERE regexp_matches(title, '(?i)^{_start}')",
           "clean_fx", extra={"link_rows": LINK_ROWS})

# --- plain text with spans -----------------------------------------------------------------------

oracle("t1_sections", "SELECT rev_id, sec_no, heading, CAST(length(section) AS INT) AS n_chars FROM headed", "clean_fx", extra=SECTION_VIEWS)
oracle("t2_drop_sections", """
SELECT rev_id, sec_no, heading FROM headed WHERE heading IS NULL OR lower(heading) NOT IN ('early', 'references')""",
       "clean_fx", extra=SECTION_VIEWS)
# The markup of a revision is appended in a fixed order, so its pieces are known in closed form.
oracle("t3_pieces", """
SELECT rev_id, kind, n FROM (
 SELECT rev_id, 'heading' AS kind, rev_id % 4 + rev_id % 3 AS n FROM revisions_fx
 UNION ALL SELECT rev_id, 'image', rev_id % 3 FROM revisions_fx
 UNION ALL SELECT rev_id, 'category', rev_id % 5 FROM revisions_fx
 UNION ALL SELECT rev_id, 'link', 2 * (rev_id % 2) FROM revisions_fx
 UNION ALL SELECT rev_id, 'template', rev_id % 6 + 3 * (rev_id % 2) FROM revisions_fx
 UNION ALL SELECT rev_id, 'ref', 2 * (rev_id % 4) FROM revisions_fx
 UNION ALL SELECT rev_id, 'url', rev_id % 7 FROM revisions_fx) AS k WHERE n > 0""", "revisions_fx")
# Each kind is one balanced top-level piece, whatever its depth.
oracle("t3_deep_pieces", """
SELECT doc_id AS rev_id, 'template' AS kind, CAST(1 AS BIGINT) AS n, CAST(6 * (doc_id % 60 + 1) + 1 AS BIGINT) AS n_chars FROM documents
UNION ALL SELECT doc_id, 'link', 1, 6 * (doc_id % 10 + 1) + 1 FROM documents
UNION ALL SELECT doc_id, 'tag', 1, 11 * (doc_id % 8 + 1) + 1 FROM documents
UNION ALL SELECT doc_id, 'table', 1, 6 * (doc_id % 8 + 1) + 1 FROM documents""")
# A template of any depth leaves one blank, a link its innermost text, equal tags their content, a table nothing.
oracle("t6_deep_template_spans", """
SELECT doc_id AS rev_id, CAST(length(text) + 1 AS BIGINT) AS start, CAST(length(text) + 2 AS BIGINT) AS "end", 'a' AS label FROM documents""")
oracle("t7_deep_text", "SELECT doc_id AS rev_id, concat(text, chr(10), '  y z', chr(10), chr(10)) AS text FROM documents")
oracle("t4_tag_rules", """
SELECT rev_id, CAST(pos AS INT) AS pos, name, piece FROM revisions_fx CROSS JOIN (VALUES
 (0, 'b', 'x'), (1, 'poem', '<poem>'), (2, 'gallery', NULL)) AS t(pos, name, piece)""", "revisions_fx")
oracle("t5_template_rules", """
SELECT rev_id, 'cite_web' AS name, '{{cite_web}}' AS piece, rev_id % 6 AS n FROM revisions_fx WHERE rev_id % 6 > 0
UNION ALL SELECT rev_id, t.name, ' ', 1 FROM revisions_fx CROSS JOIN (VALUES ('pov'), ('infobox_person'), ('main')) AS t(name)
WHERE rev_id % 2 = 1""", "revisions_fx")
LENGTHS = """
SELECT doc_id AS rev_id, length(text) + 1 + doc_id % 4 + doc_id % 3 + doc_id % 3 + doc_id % 5 + (doc_id % 2) * 21 AS cites_at,
 doc_id % 6 AS cites, 2 * (doc_id % 4) AS refs, doc_id % 7 AS urls FROM documents"""
oracle("t6_template_spans", """
SELECT rev_id, CAST(cites_at + k AS BIGINT) AS start, CAST(cites_at + k + 1 AS BIGINT) AS "end", 'cite_web' AS label
FROM (SELECT *, unnest(range(cites)) AS k FROM lengths) AS c
UNION ALL
SELECT rev_id, CAST(cites_at + cites + refs / 2 * 3 + urls * 2 + t.k AS BIGINT), CAST(cites_at + cites + refs / 2 * 3 + urls * 2 + t.k + 1 AS BIGINT), t.label
FROM lengths CROSS JOIN (VALUES (0, 'pov'), (2, 'infobox_person'), (4, 'main')) AS t(k, label) WHERE rev_id % 2 = 1
""", extra={"lengths": LENGTHS})
oracle("t6_reference_offsets", """
SELECT rev_id, CAST(cites_at + cites + 3 * floor(k / 2) + 2 * (k % 2) AS BIGINT) AS "offset"
FROM (SELECT *, unnest(range(refs)) AS k FROM lengths) AS r""", extra={"lengths": LENGTHS})
oracle("t7_clean_text", """
SELECT doc_id AS rev_id, concat(text, chr(10), repeat(chr(10), CAST(doc_id % 4 + doc_id % 3 AS INT)),
 repeat(' ', CAST(doc_id % 3 + doc_id % 5 AS INT)), repeat('file format the city ', CAST(doc_id % 2 AS INT)),
 repeat(' ', CAST(doc_id % 6 AS INT)), repeat('   ', CAST(doc_id % 4 AS INT)), repeat('e ', CAST(doc_id % 7 AS INT)),
 repeat('     ', CAST(doc_id % 2 AS INT))) AS text FROM documents""")
TEXT_TOKENS = r"""
SELECT rev_id, CAST(ahead AS BIGINT) AS tok_start, token FROM (
 SELECT rev_id, token, coalesce(sum(length(token)) OVER (PARTITION BY rev_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
 FROM (SELECT rev_id, unnest(parts) AS token, unnest(range(len(parts))) AS pos
  FROM (SELECT rev_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0B\f\r]|[ \t\n\x0B\f\r]+') AS parts FROM texts) AS p) AS q) AS r
WHERE NOT regexp_matches(token, '^[ \t\n\x0B\f\r]')"""
TEXT_VIEWS = {
    "texts": ORACLES["t7_clean_text"], "toks": TEXT_TOKENS, "lengths": LENGTHS,
    "refs": """SELECT rev_id, cites_at + cites + 3 * floor(k / 2) + 2 * (k % 2) AS ref_pos
 FROM (SELECT *, unnest(range(refs)) AS k FROM lengths) AS r""",
}
oracle("j6_text_tokens", "SELECT rev_id, tok_start, token FROM toks", extra=TEXT_VIEWS)
oracle("j6_flagged_text", """
SELECT t.rev_id, t.tok_start, EXISTS (SELECT 1 FROM refs r WHERE r.rev_id = t.rev_id AND r.ref_pos >= t.tok_start
 AND (t.next_start IS NULL OR r.ref_pos < t.next_start)) AS reference
FROM (SELECT rev_id, tok_start, lead(tok_start) OVER (PARTITION BY rev_id ORDER BY tok_start) AS next_start FROM toks) AS t""",
       extra=TEXT_VIEWS)
oracle("j7_text_references", """
SELECT r.rev_id, CAST(r.ref_pos AS BIGINT) AS ref_pos, r.n_refs, max(t.tok_start) AS tok_start
FROM (SELECT rev_id, ref_pos, count(*) AS n_refs FROM refs GROUP BY rev_id, ref_pos) AS r
LEFT JOIN toks t ON t.rev_id = r.rev_id AND t.tok_start <= r.ref_pos
GROUP BY r.rev_id, r.ref_pos, r.n_refs""", extra=TEXT_VIEWS)
oracle("t8_node_rules", """
SELECT rev_id, kind, name, piece FROM revisions_fx CROSS JOIN (VALUES
 ('heading', NULL, NULL, 4), ('heading', NULL, NULL, 3), ('image', 'File:a.png', NULL, 3), ('category', 'Category:Things', NULL, 5),
 ('link', 'file format', 'file format', 2), ('link', 'Paris', 'the city', 2), ('template', 'cite_web', ' ', 6),
 ('ref', 'ref', ' ', 4), ('url', NULL, 'e', 7), ('template', 'pov', ' ', 2), ('template', 'infobox_person', ' ', 2),
 ('template', 'main', ' ', 2)) AS t(kind, name, piece, m)
WHERE rev_id % m > 0 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY rev_id, kind, name, piece"), "revisions_fx")

# --- catalogues and talk pages ----------------------------------------------------------------------

oracle("b1_flatten_catalogue", "SELECT name, section FROM flat", "catalogue_fx", "template_redirects_fx",
       extra={"built": CATALOGUE_ROWS, "flat": flat_sql("built")})
oracle("b2_excluded_category", "SELECT name, section FROM flat", "catalogue_fx", "template_redirects_fx",
       extra={"built": CATALOGUE_ROWS, "flat": flat_sql("built", "category NOT IN ('Category 1', 'Category 2')")})
oracle("b4_bare_names", """
SELECT from_title, CASE WHEN from_title LIKE 'Template:%' THEN substr(from_title, 10)
 WHEN from_title LIKE 'T:%' THEN substr(from_title, 3) ELSE from_title END AS name FROM template_redirects_fx""", "template_redirects_fx")
oracle("b5_banner_class", "SELECT page_id, seq, class FROM banners", "talk_fx", extra={"banners": BANNERS})
oracle("b6_banner_importance", "SELECT page_id, seq, importance FROM banners", "talk_fx", extra={"banners": BANNERS})
oracle("b7_banner_parameters", """
SELECT seq, 'WikiProject ' || regexp_extract(banner, 'WikiProject ([^|]*)', 1) AS name,
 regexp_extract(banner, 'class=([^|}]*)', 1) AS class, regexp_extract(banner, 'importance=([^|}]*)', 1) AS importance,
 CAST(NULL AS VARCHAR) AS listas FROM talk_fx""", "talk_fx")

# --- edits -----------------------------------------------------------------------------------------------

oracle("e1_edits_per_catalogue", "SELECT edit_no, edit, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM variants GROUP BY 1, 2",
       "features_fx", extra={"variants": SCORES["variants"]})
for _name, _numbers, _columns in (
    ("e2_count_edits", (13, 14, 15, 16), "backlog_accuracy, backlog_links, backlog_other, backlog_style, words"),
    ("e3_word_edits", (1, 2), "words"),
    ("e4_both_edits", tuple(range(3, 11)), "categories, cite_templates, external_links, headings, images, ref, sub_headings, wikilinks, words"),
    ("e5_flag_edits", (11, 12), "coordinates, infoboxes, words"),
):
    oracle(_name, f"SELECT rev_id, edit, {_columns} FROM variants WHERE edit_no IN ({', '.join(map(str, _numbers))})",
           "features_fx", extra={"variants": SCORES["variants"]})
oracle("e6_scored_variants", "SELECT rev_id, edit_no, round(score, 6) AS score, round(gain, 6) AS gain FROM gains", "features_fx", extra=SCORES)
oracle("e6_top_edit", "SELECT rev_id, rank, edit_no, edit, gain FROM ranked WHERE rank = 1", "features_fx", extra=SCORES)

_MEDIAN = (
    "CASE WHEN p0 >= 0.5 THEN 0 WHEN p0 + p1 >= 0.5 THEN 1 WHEN p0 + p1 + p2 >= 0.5 THEN 2 WHEN p0 + p1 + p2 + p3 >= 0.5 THEN 3 "
    "WHEN p0 + p1 + p2 + p3 + p4 >= 0.5 THEN 4 WHEN p0 + p1 + p2 + p3 + p4 + p5 >= 0.5 THEN 5 ELSE 0 END"
)
oracle("e7_page_results", f"""
SELECT a.request_id, a.asked, a.title, p.revid, p.revid IS NOT NULL AS found, {label_of('s.code')} AS best,
 CASE WHEN p.revid IS NOT NULL THEN 'https://en.wikipedia.org/wiki/' || url_encode(a.title) END AS url,
 {", ".join(f"CAST(round_even(s.p{k} * 100, 0) AS INT) AS pct_{c.lower()}" for k, c in enumerate(CLASSES))},
 CASE WHEN p.revid IS NOT NULL THEN CAST(coalesce(t.n_edits, 0) AS INT) END AS n_edits, t.first_edit,
 CAST(round_even(t.first_gain * 100, 0) AS INT) AS first_gain_pct
FROM asked a LEFT JOIN newest p ON p.title = a.title
LEFT JOIN (SELECT *, {_MEDIAN} AS code FROM expected WHERE edit_no = 0) s ON s.rev_id = p.revid
LEFT JOIN (SELECT rev_id, count(*) AS n_edits, arg_min(edit, rank) AS first_edit, arg_min(gain, rank) AS first_gain
 FROM ranked WHERE gain > 0.005 GROUP BY rev_id) t ON t.rev_id = p.revid""",
       "requests_fx", "pages_fx", "redirects_fx",
       extra={"asked": ASKED, "newest": NEWEST, "features_fx": feature_view("newest", "content", "revid AS rev_id"), **SCORES})
oracle("p7_percent", "SELECT event_id, CAST(round_even(CAST(event_id % 400 AS DOUBLE) / CAST(800 AS DOUBLE) * 100, 0) AS INT) AS pct FROM events")

# --- model --------------------------------------------------------------------------------------------------

oracle("m1_split_counts", f"""
SELECT code, count(*) AS n, CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS n_train
FROM (SELECT {code_of('wp10')} AS code FROM mixed_fx) AS c GROUP BY code""", "mixed_fx")
# Ids of a class dealt out in turn: the first n % 5 folds hold one more.
oracle("m1_fold_counts", f"""
SELECT code, fold, CAST(n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM (SELECT {code_of('wp10')} AS code, count(*) AS n FROM mixed_fx GROUP BY 1) AS c
CROSS JOIN (SELECT CAST(range AS INT) AS fold FROM range(5)) AS f
WHERE n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END > 0""", "mixed_fx")
oracle("m2_saturated_chain", f"""
SELECT grp, """ + ", ".join(f"round(CAST(count(*) FILTER (WHERE code = {k}) AS DOUBLE) / count(*), 4) AS p{k}" for k in range(6)) + f"""
FROM (SELECT CAST(rev_id % 5 AS BIGINT) AS grp, {code_of('wp10')} AS code FROM revisions_fx) AS r GROUP BY grp""", "revisions_fx")
oracle("m3_chain_prob", "SELECT rev_id, " + ", ".join(f"round(p{k}, 6) AS p{k}" for k in range(6)) + " FROM probs",
       "cond_probs_fx", extra={"probs": PROBS})
oracle("m4_median_class", f"SELECT rev_id, CAST({_MEDIAN} AS INT) AS code FROM probs", "cond_probs_fx", extra={"probs": PROBS})
oracle("m5_modal_class", """
SELECT rev_id, CAST(CASE greatest(p0, p1, p2, p3, p4, p5) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3
 WHEN p4 THEN 4 ELSE 5 END AS INT) AS code FROM probs""", "cond_probs_fx", extra={"probs": PROBS})
oracle("m10_expected_class", "SELECT rev_id, round(p1 + 2 * p2 + 3 * p3 + 4 * p4 + 5 * p5, 6) AS score FROM probs",
       "cond_probs_fx", extra={"probs": PROBS})

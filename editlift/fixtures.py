"""Input views for tests and registered queries, derived from the given tables.

Each text runs unchanged in Spark SQL and in ANSI engines with the same
functions, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from editlift.session import spread

SOURCES = ("documents", "labels", "events", "lineitem", "part", "orders")

#: Nesting that grows with the id: templates up to 60 deep, links 10, equal tags and tables 8.
NESTED = """
SELECT doc_id AS rev_id, concat(text, chr(10),
 repeat('{{a|', CAST(doc_id % 60 + 1 AS INT)), 'x', repeat('}}', CAST(doc_id % 60 + 1 AS INT)), ' ',
 repeat('[[a|', CAST(doc_id % 10 + 1 AS INT)), 'y', repeat(']]', CAST(doc_id % 10 + 1 AS INT)), ' ',
 repeat('<div>', CAST(doc_id % 8 + 1 AS INT)), 'z', repeat('</div>', CAST(doc_id % 8 + 1 AS INT)), chr(10),
 repeat(concat('{|', chr(10)), CAST(doc_id % 8 + 1 AS INT)), 'c', chr(10), repeat(concat('|}', chr(10)), CAST(doc_id % 8 + 1 AS INT))) AS wikitext
FROM documents"""

REVISIONS = """
SELECT doc_id AS rev_id, doc_id % 97 AS page_id, lang, source,
 CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'Stub' WHEN 1 THEN 'Start' WHEN 2 THEN 'C' WHEN 3 THEN 'B' WHEN 4 THEN 'GA' ELSE 'FA' END AS wp10,
 concat(text, chr(10),
 repeat(concat('== History ==', chr(10)), CAST(doc_id % 4 AS INT)),
 repeat(concat('=== Early ===', chr(10)), CAST(doc_id % 3 AS INT)),
 repeat('[[File:a.png|thumb]] ', CAST(doc_id % 3 AS INT)),
 repeat('[[Category:Things]] ', CAST(doc_id % 5 AS INT)),
 repeat('[[file format]] [[Paris|the city]] ', CAST(doc_id % 2 AS INT)),
 repeat('{{Cite web|url=http://x.org|title={{lang|fr|t}}}}', CAST(doc_id % 6 AS INT)),
 repeat('<ref name="a">z</ref> <ref name="a" />', CAST(doc_id % 4 AS INT)),
 repeat('[http://e.org e] ', CAST(doc_id % 7 AS INT)),
 repeat('{{ POV }} {{Infobox person|name=x}} {{main}}', CAST(doc_id % 2 AS INT))) AS wikitext
FROM documents
"""

LABELS = """
SELECT doc_id AS rev_id, CASE WHEN quality = 1 THEN 'GA' ELSE 'Stub' END AS wp10, 1 AS seq FROM labels
UNION ALL
SELECT doc_id AS rev_id, 'B' AS wp10, 2 AS seq FROM labels WHERE doc_id % 11 = 0
"""

BACKLOG = """
SELECT * FROM (VALUES
 ('Accuracy', 'NPOV disputes', 'POV', 'NPOV'),
 ('Style', 'Articles needing copy edit', 'Copy edit', 'Copyedit'),
 ('Links', 'Articles with dead links', 'Dead link', 'Broken link'),
 ('File Quality', 'Wrong image format', 'Should be PNG', 'Make PNG'),
 ('Layout', 'Articles to be split', 'Split', 'Divide')) AS t(section, category, template, alias)
"""

TALK = """
SELECT doc_id % 331 AS page_id, doc_id AS seq,
 concat('{{WikiProject ', source, '|class=',
 CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'FA' WHEN 1 THEN 'A' WHEN 2 THEN 'bplus' WHEN 3 THEN ' Start ' WHEN 4 THEN 'none' WHEN 5 THEN 'Disambig' ELSE 'C' END,
 '|importance=', CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'High' WHEN 1 THEN 'none' ELSE 'low' END, '}}') AS banner
FROM documents
"""

CATEGORIES = """
SELECT doc_id AS page_id, concat('Category:',
 CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'FA' WHEN 1 THEN 'GA' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN 'C' WHEN 5 THEN 'Start' WHEN 6 THEN 'Stub' ELSE 'List' END,
 '-Class articles') AS category FROM documents
UNION ALL
SELECT doc_id AS page_id, 'Category:C-Class physics articles' AS category FROM documents WHERE doc_id % 3 = 0
"""

REDIRECTS = """
SELECT concat('Title ', CAST(doc_id AS STRING)) AS from_title, concat('Title ', CAST(doc_id - 1 AS STRING)) AS to_title
FROM documents WHERE doc_id % 10 = 9
"""

# Chains of up to five hops, and a two-title cycle at the end of every fifth one.
REDIRECT_CHAINS = """
SELECT concat('Title ', CAST(doc_id AS STRING)) AS from_title, concat('Title ', CAST(doc_id - 1 AS STRING)) AS to_title
FROM documents WHERE doc_id % 10 >= 5 OR doc_id % 50 = 4
UNION ALL
SELECT concat('Title ', CAST(doc_id AS STRING)) AS from_title, concat('Title ', CAST(doc_id + 1 AS STRING)) AS to_title
FROM documents WHERE doc_id % 50 = 3
"""

# Page versions: title, namespace and an ISO timestamp; one title has many versions.
PAGES = """
SELECT doc_id AS revid, doc_id % 97 AS pageid, concat('Title ', CAST(doc_id % 97 AS STRING)) AS title,
 concat('2018-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), 'T00:00:00Z') AS timestamp,
 text AS content
FROM documents
"""

# Requests by title: known, redirected, unknown, blank and null ones.
REQUESTS = """
SELECT doc_id AS request_id,
 CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 17 = 1 THEN '  ' WHEN doc_id % 17 = 2 THEN NULL
 ELSE concat('Title ', CAST(doc_id % 130 AS STRING)) END AS title
FROM documents
"""

COND_PROBS = """
SELECT event_id AS rev_id,
 CAST((event_id * 7) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS q0,
 CAST((event_id * 13) % 103 AS DOUBLE) / CAST(103 AS DOUBLE) AS q1,
 CAST((event_id * 17) % 107 AS DOUBLE) / CAST(107 AS DOUBLE) AS q2,
 CAST((event_id * 19) % 109 AS DOUBLE) / CAST(109 AS DOUBLE) AS q3,
 CAST((event_id * 23) % 113 AS DOUBLE) / CAST(113 AS DOUBLE) AS q4
FROM events
"""

PREDICTIONS = """
SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 6 AS INT) AS actual,
 CAST((l_orderkey + CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE 0 END) % 6 AS INT) AS pred
FROM lineitem
"""

SPANS = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10 AS INT) AS tok_start, CAST(l_partkey % 80 AS INT) AS ref_pos
FROM lineitem
"""

# A maintenance catalogue that grows with the data: thirteen sections, many
# templates, and redirects onto most of them.
CATALOGUE = """
SELECT CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'Accuracy' WHEN 1 THEN 'Content' WHEN 2 THEN 'Style'
  WHEN 3 THEN 'File Description' WHEN 4 THEN 'File Quality' WHEN 5 THEN 'Other' WHEN 6 THEN 'Links'
  WHEN 7 THEN 'Layout' ELSE 'Merge' END AS section,
 concat('Category ', CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING)) AS category,
 concat(CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'T:' WHEN 1 THEN 'Template:' ELSE '' END,
  'Fix ', p_brand, ' ', CAST(p_partkey AS STRING)) AS template
FROM part
"""

TEMPLATE_REDIRECTS = """
SELECT concat('Template:Alias ', CAST(p_partkey AS STRING)) AS from_title,
 concat('Template:Fix ', p_brand, ' ', CAST(p_partkey AS STRING)) AS to_title
FROM part WHERE p_partkey % 4 <> 1
UNION ALL
SELECT concat('T:Short ', CAST(p_partkey AS STRING)) AS from_title,
 concat('Template:Fix ', p_brand, ' ', CAST(p_partkey AS STRING)) AS to_title
FROM part WHERE p_partkey % 5 = 0
"""


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view text over the parquet tables in a folder."""
    for name in SOURCES:
        if not re.search(rf"\b{name}\b", sql):
            continue
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "documents":
            df = spread(df, "doc_id")
        df.createOrReplaceTempView(name)
    return spark.sql(sql)

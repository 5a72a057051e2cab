"""Declared schemas of all inputs; nothing is inferred on read."""

from __future__ import annotations

# Column names and types of the inputs.
LABELED_IDS = "rev_id BIGINT, wp10 STRING"

REVISION_META = (
    "revid BIGINT, parentid BIGINT, user STRING, userid BIGINT, timestamp STRING, size BIGINT, "
    "sha1 STRING, comment STRING, pageid BIGINT, ns INT, title STRING, wp10 STRING"
)
REVISION = REVISION_META + ", wikitext STRING"

FEATURE_COLUMNS = (
    "words INT, headings INT, sub_headings INT, images INT, categories INT, wikilinks INT, "
    "external_links INT, main_templates INT, cite_templates INT, infoboxes INT, templates INT, "
    "backlog_accuracy INT, backlog_accuracy_templates STRING, backlog_content INT, "
    "backlog_content_templates STRING, backlog_style INT, backlog_style_templates STRING, "
    "backlog_files INT, backlog_files_templates STRING, backlog_other INT, "
    "backlog_other_templates STRING, backlog_links INT, backlog_links_templates STRING, "
    "ref INT, smartlists INT, coordinates BOOLEAN, tables INT"
)

#: A featurized revision without its two text columns: they are never parsed.
FEATURIZED = REVISION_META + ", " + FEATURE_COLUMNS
FEATURIZED_WITH_TEXT = FEATURIZED + ", wikitext STRING, text STRING"

DUMP_REVISION = (
    "id BIGINT, page STRUCT<id: BIGINT, title: STRING, namespace: INT, redirect: STRING>, "
    "user STRUCT<id: BIGINT, text: STRING>, "
    "deleted STRUCT<text: BOOLEAN, comment: BOOLEAN, user: BOOLEAN>, "
    "comment STRING, timestamp STRING, text STRING"
)

#: A page as the wiki returns it: versions with their content in slots.
PAGE_WITH_REVISIONS = (
    "pageid BIGINT, ns INT, title STRING, revisions ARRAY<STRUCT<revid: BIGINT, parentid: BIGINT, "
    "user: STRING, userid: BIGINT, timestamp: STRING, size: BIGINT, sha1: STRING, comment: STRING, "
    "slots: STRUCT<main: STRUCT<`*`: STRING>>>>"
)

CLASS_COUNTS = "class STRING, articles BIGINT"
CATALOGUE = "value MAP<STRING, MAP<STRING, MAP<STRING, ARRAY<STRING>>>>"

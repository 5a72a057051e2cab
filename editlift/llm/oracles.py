"""SQL of the queries that SQL can express."""

from __future__ import annotations

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LLM_ORACLES: dict[str, str] = {
    "op13_line_dedup": f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT rid, doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), j AS (
  SELECT k.*, coalesce(length(k.key) >= 10 AND f.first IS NOT NULL AND (k.doc_id IS NULL OR f.first < k.doc_id), false) AS dropped
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
""",
}

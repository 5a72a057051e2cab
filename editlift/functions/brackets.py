"""Top-level pieces of wikitext by counting brackets, at any depth.

A regular expression cannot count, so nested markup is matched by a scan that keeps one depth per kind
of bracket: templates ``{{ }}``, links ``[[ ]]``, tables (``{|`` opens a line, ``|}`` starts one) and
tags with the same name ``<x ...> </x>``. Each kind counts only its own brackets, as the piece patterns
of ``cleantext`` do; the scan is linear in the text. An opener that is never closed is not a piece: its
first character is taken alone and the scan goes on after it.

The scan runs in an Arrow UDF, which holds ``SLICE_BYTES`` of text as Python strings at once, whatever the
batch; it returns the raw pieces, and everything else about a piece (kind, name, what it leaves) stays in
column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values, the same as the piece patterns of cleantext: references and void tags are flat;
# bracketed URLs, heading lines, quotes and text runs end where those patterns end.
VOID_TAGS = ("br", "hr", "img", "wbr")
_FLAT = re.compile(
    r"(?i:<ref(?:\s[^<>]*)?/>|<ref(?:\s[^<>]*)?>(?s:.*?)</ref\s*>)"
    rf"|(?i:<[a-z][a-z0-9]*(?:\s[^<>]*)?/>|<(?:{'|'.join(VOID_TAGS)})(?:\s[^<>]*)?>)",
    re.ASCII,
)
_TAIL = re.compile(r"\[(?i:https?|ftp)://[^\[\]\n]*+\]|'{2,}", re.ASCII)
_HEADING = re.compile(r"={1,6}[^=\n][^\n]*={1,6}[ \t]*(?=\n|$)", re.ASCII)
_TEXT = re.compile(r"(?:[^{\[<'=\n]++|\n(?!=)|(?<!\n)(?<!^)=)++", re.ASCII)
_TAG_OPEN = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?>", re.ASCII)
_TEMPLATE = re.compile(r"\{\{|\}\}")
_LINK = re.compile(r"\[\[|\]\]")
_TABLE_OPEN = re.compile(r"[ \t:]*\{\|[^\n]*\n")
_TABLE_CLOSE = re.compile(r"[ \t]*\|\}(?!\})")
_LINE = re.compile(r"[^\n]*\n")

#: Text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 2 << 20


def _balanced(text: str, start: int, tokens: re.Pattern, opening: str) -> int | None:
    """End of the bracket pair opened at ``start``, or None if it never closes."""
    depth = 0
    for m in tokens.finditer(text, start):
        depth += 1 if m.group() == opening else -1
        if depth == 0:
            return m.end()
    return None


def _table(text: str, start: int) -> int | None:
    """Tables are read by lines: a nested one opens a line, a closer starts one."""
    m = re.compile(r"\{\|[^\n]*\n").match(text, start)
    if m is None:
        return None
    depth, pos = 1, m.end()
    while True:
        if (m := _TABLE_CLOSE.match(text, pos)) is not None:
            depth -= 1
            pos = m.end()
            if depth == 0:
                return pos
        elif (m := _TABLE_OPEN.match(text, pos)) is not None:
            depth += 1
            pos = m.end()
        elif (m := _LINE.match(text, pos)) is not None:
            pos = m.end()
        else:
            return None


def _tag(text: str, start: int) -> int | None:
    m = _TAG_OPEN.match(text, start)
    if m is None:
        return None
    name = re.escape(m.group(1))
    same = re.compile(rf"<{name}(?:\s[^<>]*)?>|</{name}\s*>", re.ASCII | re.IGNORECASE)
    depth = 0
    for t in same.finditer(text, start):
        if t.group().endswith("/>"):
            continue
        depth += -1 if t.group().startswith("</") else 1
        if depth == 0:
            return t.end()
    return None


def split_pieces(text: str | None) -> list[str] | None:
    """The top-level pieces of a text, in order; joined they give the text back."""
    if text is None:
        return None
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        end = None
        if text.startswith("{|", i):
            end = _table(text, i)
        if end is None and text.startswith("{{", i):
            end = _balanced(text, i, _TEMPLATE, "{{")
        if end is None and c == "<":
            m = _FLAT.match(text, i)
            end = m.end() if m else _tag(text, i)
        if end is None and text.startswith("[[", i):
            end = _balanced(text, i, _LINK, "[[")
        if end is None and c in "['":
            m = _TAIL.match(text, i)
            end = m.end() if m else None
        if end is None and c == "=" and (i == 0 or text[i - 1] == "\n"):
            m = _HEADING.match(text, i)
            end = m.end() if m else None
        if end is None:
            m = _TEXT.match(text, i)
            end = m.end() if m and m.end() > i else i + 1
        out.append(text[i:end])
        i = end
    return out


def _all_pieces(texts) -> list[str] | None:
    if texts is None:
        return None
    return [p for t in texts if t is not None for p in split_pieces(t)]


def _slices(batch: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of an array of string lists, of about ``limit`` bytes; a larger row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.values), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[batch.offsets.to_numpy()]
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


@F.arrow_udf(ArrayType(StringType()))
def _pieces_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for part in _slices(batch):
            yield pa.array(map(_all_pieces, part.to_pylist()), pa.list_(pa.string()), size=len(part))


def top_level_pieces(texts: Column) -> Column:
    """The raw top-level pieces of an array of texts (sections), one after another; null for null."""
    from pyspark.sql import SparkSession

    from editlift.session import ship_package

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    return _pieces_udf(texts)

"""Counts and plain text from wiki markup, by pattern.

Opening delimiters are counted, so nested templates and links count as well
and no balanced parse is needed. Each array (names, titles, headings, ...) is
one pass over the text; the counts are then taken from the arrays.

Every pass is guarded by a plain substring test, which is far cheaper than a
regular expression and skips texts without that kind of markup.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from editlift.functions.titles import strip

# The patterns that define each kind of markup. All are valid in
# Java and in RE2; `(?d)` (Java only) makes a line end at \n alone.
COMMENT = r"(?s)<!--.*?-->"
NOWIKI = r"(?s)<nowiki>.*?</nowiki>"
ARGUMENT = r"\{\{\{[^{}]*\}\}\}"
TEMPLATE_NAME = r"\{\{[ \t\n]*([^{}|<>\[\]]+)"
TEMPLATE = r"\{\{[^{}]*\}\}"
LINK_TITLE = r"\[\[([^\[\]|]+)"
LINK = r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]"
URL = r"(?i)(?:https?|ftp)://[^\s\[\]<>{}|\"]+"
BRACKET_URL = r"(?i)\[(?:https?|ftp)://[^\s\[\]]*[ \t]*([^\[\]]*)\]"
REF_TAG = r"<ref(?:[ \t\n][^>]*)?/?>"
HEADING = r"(?dm)^={2,6}[^=\n][^\n]*==[ \t]*$"
TABLE_START = r"(?dm)^\{\|"
TABLE_ROW = r"(?dm)^[ \t]*(?:\{\|[^\n]*|\|[-}][^\n]*|[|!])"
TAG_OR_QUOTES = r"</?[a-zA-Z][^<>]*>|'{2,}"
LINE_MARK = r"(?dm)^={1,6}[ \t]*([^=\n][^\n]*?)[ \t]*={1,6}[ \t]*$|^[*#:;]+[ \t]*"
ENTITY = r"&[#a-zA-Z0-9]+;"
#: A character reference: a name, a decimal or a hexadecimal code point.
ENTITY_REF = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"
WORD = r"[\p{L}\p{N}]+"
COORDINATES = "#coordinates"

# Tags whose content is never visible as text.
INVISIBLE_TAGS = ("gallery", "imagemap", "math", "score", "timeline")
INVISIBLE = rf"(?is)<({'|'.join(INVISIBLE_TAGS)})(?:\s[^<>]*)?>.*?</\1\s*>"

#: Nesting depth done by plain passes; deeper texts go on until nothing changes.
USUAL_DEPTH = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def substitute(text: Column, pattern: str, replacement: str = "", needles: tuple[str, ...] = ()) -> Column:
    """Replace by pattern, only where one of the needles occurs."""
    if not needles:
        return F.regexp_replace(text, pattern, replacement)

    def guarded(t: Column) -> Column:
        present = F.contains(t, F.lit(needles[0]))
        for needle in needles[1:]:
            present = present | F.contains(t, F.lit(needle))
        return F.when(present, F.regexp_replace(t, pattern, replacement)).otherwise(t)

    return let(text, guarded)


def substitute_inward(text: Column, pattern: str, replacement: str, needle: str) -> Column:
    """Replace innermost matches again and again until nothing changes.

    The usual depth is done by a few guarded passes. Only a text that still
    holds the needle goes on, with as many rounds at hand as it has needles, since
    each round that changes it takes one at least; after the first that changes
    nothing, a flag ends the work.
    """

    def one_round(acc: Column) -> Column:
        fresh = F.regexp_replace(acc["now"], pattern, replacement)
        return let(fresh, lambda t: F.struct(t.alias("now"), (t == acc["now"]).alias("done")))

    def fixpoint(t: Column) -> Column:
        needles = F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))
        last = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(needles / len(needle)).cast("int"))),
            F.struct(t.alias("now"), F.lit(False).alias("done")),
            lambda acc, _: F.when(acc["done"], acc).otherwise(one_round(acc)),
        )
        return F.when(F.contains(t, F.lit(needle)), last["now"]).otherwise(t)

    for _ in range(USUAL_DEPTH):
        text = substitute(text, pattern, replacement, (needle,))
    return let(text, fixpoint)


def find_all(text: Column, pattern: str, group: int, needle: str | None) -> Column:
    """All matches as an array; empty without a pass where the needle is absent.

    ``text`` should be a plain column, since it is read twice.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    if needle is None:
        return found
    return F.when(F.contains(text, F.lit(needle)), found).otherwise(F.array().cast("array<string>"))


def clean(text: Column) -> Column:
    """Text without comments, nowiki parts and template arguments."""
    out = substitute(text, COMMENT, "", ("<!--",))
    out = substitute(out, NOWIKI, "", ("<nowiki>",))
    return substitute(out, ARGUMENT, "", ("{{{",))


def template_names(cleaned: Column) -> Column:
    """Raw names of all templates, nested ones too, in order of appearance."""
    return find_all(cleaned, TEMPLATE_NAME, 1, "{{")


def link_titles(cleaned: Column) -> Column:
    return find_all(cleaned, LINK_TITLE, 1, "[[")


def heading_lines(cleaned: Column) -> Column:
    return find_all(cleaned, HEADING, 0, "==")


def external_urls(cleaned: Column) -> Column:
    return find_all(cleaned, URL, 0, "://")


def ref_tags(cleaned: Column) -> Column:
    return find_all(cleaned, REF_TAG, 0, "<ref")


def tables(cleaned: Column) -> Column:
    return find_all(cleaned, TABLE_START, 0, "{|")


def heading_pattern(level: int) -> str:
    marks = "=" * level
    return rf"(?dm)^{marks}[^=\n][^\n]*{marks}[ \t]*$"


def num_headings(cleaned: Column, level: int) -> Column:
    """Number of headings of one level."""
    return F.size(find_all(cleaned, heading_pattern(level), 0, "=" * level))


def count_headings(lines: Column) -> Column:
    """Level-2 headings among the heading lines."""
    return F.size(F.filter(lines, lambda h: ~h.startswith("===")))


def count_sub_headings(lines: Column) -> Column:
    """Headings of level 3 and deeper among the heading lines."""
    return F.size(
        F.filter(lines, lambda h: h.startswith("===") & F.rtrim(h, F.lit(" \t")).endswith("==="))
    )


def is_image_link(title: Column) -> Column:
    """``file`` need not be followed by a colon, ``image`` must."""
    low = F.lower(title)
    return low.startswith("file") | low.startswith("image:")


def is_category_link(title: Column) -> Column:
    return F.lower(title).startswith("category:")


def count_images(titles: Column) -> Column:
    return F.size(F.filter(titles, is_image_link))


def count_categories(titles: Column) -> Column:
    return F.size(F.filter(titles, is_category_link))


def count_wikilinks(titles: Column) -> Column:
    return F.size(titles) - count_images(titles) - count_categories(titles)


def template_key(name: Column) -> Column:
    """Normal form of a template name: trimmed, lower case, `_` for blank and dash."""
    return F.translate(F.lower(strip(name)), " -", "__")


def catalogue_key(name: Column) -> Column:
    """Form in which the maintenance catalogue is keyed: blanks and dashes stay."""
    return F.lower(strip(name))


def matches_template(name: Column, pattern: str) -> Column:
    """Does the normal form of a name match at its start, whatever its case."""
    return template_key(name).rlike(f"(?i)^(?:{pattern})")


def count_main(names: Column) -> Column:
    return F.size(F.filter(names, lambda n: template_key(n) == "main"))


def count_with_prefix(names: Column, prefix: str) -> Column:
    return F.size(F.filter(names, lambda n: template_key(n).startswith(prefix)))


def has_coordinates(text: Column) -> Column:
    """Taken from the uncleaned text."""
    return F.contains(F.lower(text), F.lit(COORDINATES))


def strip_markup(cleaned: Column) -> Column:
    """Visible text: templates go, links and tags leave their content."""
    out = substitute_inward(cleaned, TEMPLATE, "", "{{")
    out = substitute(out, INVISIBLE, "", ("</",))
    out = substitute(out, TABLE_ROW, "", ("{|",))
    out = substitute_inward(out, LINK, "$1", "[[")
    out = substitute(out, BRACKET_URL, "$1", ("://",))
    out = substitute(out, TAG_OR_QUOTES, "", ("<", "''"))
    out = substitute(out, LINE_MARK, "$1")
    return decode_entities(out)


def _entity_char(ref: Column) -> Column:
    """The character of one reference ``&...;``; null for an unknown name or a code point
    that is no character (0, surrogates, beyond U+10FFFF)."""
    body = F.substring(ref, 2, F.length(ref) - 2)
    named = F.try_element_at(F.create_map(*[F.lit(x) for k, v in sorted(name2codepoint.items()) for x in (k, chr(v))]), body)
    digits = F.when(F.lower(body).startswith("#x"), F.conv(F.substring(body, 3, 8), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 8))
    point = digits.cast("long")
    valid = (point >= 1) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    return F.coalesce(named, numeric)


def decode_entities(text: Column) -> Column:
    """Named (HTML 4 names) and numeric character references replaced by their characters, in one pass,
    so ``&amp;lt;`` gives ``&lt;``; unknown names and invalid code points stay as written."""
    parts = F.split(text, ENTITY_REF, -1)
    refs = F.regexp_extract_all(text, F.lit(ENTITY_REF), 0)
    decoded = F.transform(refs, lambda r, i: F.concat(F.coalesce(_entity_char(r), r), parts[i + 1]))
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(decoded, ""))).otherwise(text)


def plain_text(text: Column) -> Column:
    return strip_markup(clean(text))


def count_words(plain: Column) -> Column:
    """Number of words plus one, so never zero."""
    return F.size(F.regexp_extract_all(plain, F.lit(WORD), 0)) + 1

"""Page titles, template names and page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n"


def strip(text: Column) -> Column:
    """Trim blanks, tabs and line breaks on both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(title: Column) -> Column:
    return title.isNull() | (strip(title) == "")


def talk_title(title: Column) -> Column:
    return F.concat(F.lit("Talk:"), title)


def bare_template_name(title: Column) -> Column:
    """Title without its ``T:`` or ``Template:`` prefix."""
    return F.regexp_replace(title, r"^T(?:emplate)?:", "")


def percent_encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def page_url(title: Column, lang: Column | str = "en", revid: Column | None = None) -> Column:
    """Address of a page, or of one revision where ``revid`` is not null."""
    host = F.concat(F.lit("https://"), lang if isinstance(lang, Column) else F.lit(lang), F.lit(".wikipedia.org"))
    encoded = percent_encode(title)
    current = F.concat(host, F.lit("/wiki/"), encoded)
    if revid is None:
        return current
    old = F.concat(host, F.lit("/w/index.php?title="), encoded, F.lit("&oldid="), revid.cast("string"))
    return F.when(revid.isNull(), current).otherwise(old)

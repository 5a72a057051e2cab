"""Project banners on talk pages: parameters and their normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from editlift.functions.titles import strip

# Spellings of a banner class and what they stand for.
CLASS_SYNONYMS = {"disambig": "dab", "current": "cur", "a": "ga", "bplus": "b"}

# Banner classes from best to worst.
BANNER_PRIORITY = (
    "fa", "ga", "b", "c", "start", "stub", "fl", "list", "dab", "book",
    "template", "category", "draft", "redirect",
)

# Class patterns of talk-page categories, best first. The second
# pattern also takes A.
CATEGORY_CLASSES = (
    ("FA", "FA"), ("G?A", "GA"), ("B", "B"), ("C", "C"), ("Start", "Start"), ("Stub", "Stub"),
)


def _word_or_null(value: Column) -> Column:
    return F.nullif(F.lower(strip(value)), F.lit("none"))


def clean_class(value: Column) -> Column:
    word = _word_or_null(value)
    out = word
    for spelled, meant in CLASS_SYNONYMS.items():
        out = F.when(word == spelled, F.lit(meant)).otherwise(out)
    return out


def clean_importance(value: Column) -> Column:
    return _word_or_null(value)


def parameter(banner: Column, name: str) -> Column:
    """First value of a named parameter; null where absent or empty."""
    return F.nullif(F.regexp_extract(banner, rf"\|\s*{name}\s*=([^|{{}}]*)", 1), F.lit(""))


def banner_name(banner: Column) -> Column:
    return strip(F.regexp_extract(banner, r"\{\{[ \t\n]*([^{}|<>\[\]]+)", 1))


def banner_priority(cls: Column) -> Column:
    """1 for the best banner class; null for one outside the list."""
    position = F.array_position(F.array(*[F.lit(c) for c in BANNER_PRIORITY]), cls)
    return F.nullif(position, F.lit(0)).cast("int")


def priority_class(priority: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in BANNER_PRIORITY]), priority)


def category_priority(category: Column) -> Column:
    """1 for the best class named by a category title; null for no class."""
    pick = None
    for i, (pattern, _) in enumerate(CATEGORY_CLASSES, start=1):
        hit = category.rlike(f"^Category:{pattern}-Class")
        pick = F.when(hit, i) if pick is None else pick.when(hit, i)
    return pick


def category_class(priority: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for _, c in CATEGORY_CLASSES]), priority)

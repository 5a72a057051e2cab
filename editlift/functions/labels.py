"""The ordered quality classes and their integer codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six quality classes, lowest first. The code of a class is
# its position.
CLASSES = ("Stub", "Start", "C", "B", "GA", "FA")

# Further class labels that pages carry; shown, never predicted.
DISPLAY_ONLY = ("FL", "List", "Disambig", "Book", "Template", "Category", "Draft", "Redirect")

# What a class is called when shown.
DISPLAY_NAMES = {
    "FA": "Featured article", "GA": "Good article", "B": "B-class article", "C": "C-class article",
    "Start": "Start", "Stub": "Stub",
}

TOP_CODE = len(CLASSES) - 1


def class_array() -> Column:
    return F.array(*[F.lit(c) for c in CLASSES])


def label_code(label: Column) -> Column:
    """Code 0..5 of a class label; null for an unknown or null label."""
    return F.nullif(F.array_position(class_array(), label), F.lit(0)).cast("int") - 1


def code_label(code: Column) -> Column:
    """Class label of a code; null outside 0..5."""
    return F.when(code.between(0, TOP_CODE), F.element_at(class_array(), code.cast("int") + 1))


def next_label(label: Column) -> Column:
    """The class one step up; null for the top class and for unknown labels."""
    return code_label(label_code(label) + 1)


def known_label(label: Column) -> Column:
    """The label itself; the job fails on a label outside the six classes."""
    message = F.concat(F.lit("unknown class: "), F.coalesce(label, F.lit("null")))
    return F.when(label.isin(*CLASSES), label).otherwise(F.raise_error(message))


def display_name(label: Column) -> Column:
    """Name of a class for readers; display-only labels stand for themselves."""
    names = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, label), F.when(label.isin(*DISPLAY_ONLY), label))

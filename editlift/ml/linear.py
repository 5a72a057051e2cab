"""A scorer in closed form: logistic steps over a weighted sum of model columns.

It needs no fitting, so it serves as the default for trying out edits and for
checking results by hand. A fitted model takes its place unchanged.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.functions.markup import let
from editlift.functions.probability import chain_array
from editlift.operators.features import RAW_COLUMNS, model_columns

# Chosen by hand: weight of each model column in the latent quality, and the
# latent quality at which a class is left for the next one.
WEIGHTS = {
    "words": 0.0004,
    "headings": 0.12,
    "sub_headings": 0.08,
    "images": 0.15,
    "categories": 0.02,
    "wikilinks": 0.01,
    "external_links": 0.03,
    "cite_templates": 0.09,
    "templates": -0.01,
    "ref": 0.05,
    "coordinates": 0.2,
    "infoboxes": 0.4,
    "backlog_accuracy": -0.5,
    "backlog_content": -0.3,
    "backlog_other": -0.2,
    "backlog_style": -0.4,
    "backlog_links": -0.1,
    "ref_per_word": 4.0,
    "wikilinks_per_word": 2.0,
    "external_links_per_word": -1.5,
}
THRESHOLDS = (-0.5, 0.3, 0.9, 1.6, 2.4)


class LinearScorer:
    """Class probabilities as plain expressions over one row."""

    def probabilities(self, raw: dict[str, Column]) -> Column:
        columns = model_columns(raw)
        z = reduce(add, [columns[name] * F.lit(w) for name, w in WEIGHTS.items()])
        q = let(z, lambda z: F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(t) - z)) for t in THRESHOLDS]))
        return let(q, lambda q: chain_array([q[k] for k in range(len(THRESHOLDS))]))

    def __call__(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.probabilities({c: F.col(c) for c in RAW_COLUMNS}))


linear_scorer = LinearScorer()

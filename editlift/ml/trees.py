"""A fitted ordinal chain as column expressions: scored in the row, on a stream too.

Each binary step of a ``SequentialOrdinalModel`` becomes one expression over the model columns:
boosted trees (``GBTClassificationModel``) as nested ``CASE WHEN`` per tree, summed with the tree
weights into a margin read by Spark's logistic link ``1 / (1 + exp(-2 margin))``; a binary logistic
regression as its linear form. The tree structure is read from the model's debug text, one call per
model. The chain rule then gives the class probabilities, as ``model.transform`` does, but without
vectors, Python or an exchange, so edit variants are scored where their row is.

A split sends a row left when its value is at most the threshold, else right; a NaN goes right, as in
Spark ML. Categorical splits and other learners are refused.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.functions.markup import let
from editlift.functions.probability import chain_array
from editlift.ml.ordinal import SequentialOrdinalModel
from editlift.operators.features import MODEL_COLUMNS, RAW_COLUMNS, model_columns

_TREE = re.compile(r"Tree (\d+) \(weight (\S+)\):")
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_ELSE = re.compile(r"Else \(feature (\d+) > (\S+)\)")
_LEAF = re.compile(r"Predict: (\S+)")


def parse_trees(debug: str) -> list[tuple[float, tuple]]:
    """(weight, tree) of each tree; a tree is ("leaf", value) or ("split", feature, threshold, left, right)."""
    lines = [line.strip() for line in debug.splitlines()[1:] if line.strip()]
    at = 0

    def node() -> tuple:
        nonlocal at
        line = lines[at]
        at += 1
        if m := _LEAF.fullmatch(line):
            return ("leaf", float(m.group(1)))
        m = _SPLIT.fullmatch(line)
        if m is None:
            raise ValueError(f"only continuous splits can be compiled, not: {line}")
        left = node()
        other = _ELSE.fullmatch(lines[at])
        if other is None or other.groups() != m.groups():
            raise ValueError(f"unexpected line: {lines[at]}")
        at += 1
        return ("split", int(m.group(1)), float(m.group(2)), left, node())

    trees = []
    while at < len(lines):
        head = _TREE.fullmatch(lines[at])
        if head is None:
            raise ValueError(f"unexpected line: {lines[at]}")
        at += 1
        trees.append((float(head.group(2)), node()))
    return trees


def tree_expression(tree: tuple, x: list[Column]) -> Column:
    if tree[0] == "leaf":
        return F.lit(tree[1])
    _, feature, threshold, left, right = tree
    return F.when(x[feature] <= F.lit(threshold), tree_expression(left, x)).otherwise(tree_expression(right, x))


def step_probability(model, x: list[Column]) -> Column:
    """Probability of "above" of one binary step."""
    if isinstance(model, GBTClassificationModel):
        margin = reduce(add, [F.lit(w) * tree_expression(t, x) for w, t in parse_trees(model.toDebugString)])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        weights = model.coefficients.toArray().tolist()
        z = reduce(add, [F.lit(w) * v for w, v in zip(weights, x)], F.lit(model.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    raise ValueError(f"cannot compile {type(model).__name__}")


def _ordinal(model) -> SequentialOrdinalModel:
    if isinstance(model, SequentialOrdinalModel):
        return model
    if isinstance(model, PipelineModel):
        for stage in model.stages:
            if isinstance(stage, SequentialOrdinalModel):
                return stage
    raise ValueError("no ordinal chain in the model")


class CompiledScorer:
    """Class probabilities of a fitted chain as plain expressions over one row."""

    def __init__(self, model) -> None:
        self.steps = _ordinal(model).models

    def probabilities(self, raw: dict[str, Column]) -> Column:
        columns = model_columns(raw)
        x = [columns[c] for c in MODEL_COLUMNS]
        q = F.array(*[step_probability(m, x) for m in self.steps])
        return let(q, lambda q: chain_array([q[k] for k in range(len(self.steps))]))

    def __call__(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.probabilities({c: F.col(c) for c in RAW_COLUMNS}))

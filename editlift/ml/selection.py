"""Stratified split, log-loss evaluation and random search."""

from __future__ import annotations

import random
from statistics import fmean, pstdev

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasProbabilityCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editlift.functions.probability import chain_array, log_loss_term
from editlift.ml.boosting import Search, setting_of
from editlift.ml.ordinal import ROWS_PER_TASK, SequentialOrdinal
from editlift.ml.projection import ModelProjection
from editlift.operators.features import MODEL_COLUMNS
from editlift.session import broadcast_if_small, reliable_checkpoint, ship_package

BUCKET_BITS = 16
MAX_CLASSES = 1_000


def _hash(id_col: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(id_col))


def stratified_split(
    df: DataFrame, label: str = "code", id_col: str = "rev_id", train: float = 0.8, seed: int = 1
) -> DataFrame:
    """Adds ``is_train``: in each class exactly floor(train * ids) ids, chosen by hash.

    Ids are counted per class and leading hash bits, which finds the bucket
    holding the cut. Only that bucket, one in 65,536, is ranked. What remains
    is one cut per class, fetched like a model parameter, so the rows are
    split by an expression: no shuffle, and the same side on every run. Copies
    of an id go to the same side. A null class counts as a class of its own.
    """
    y = F.col(label).cast("string")
    ids = (
        df.select(y.alias("_y"), F.col(id_col).alias("_id"))
        .distinct()
        .withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id")))
        .withColumn("_b", F.shiftright("_h", 64 - BUCKET_BITS))
    )
    per_bucket = ids.groupBy("_y", "_b").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_y")
    cut = (
        per_bucket.withColumn("_cum", F.sum("_n").over(up_to))
        .withColumn("_want", F.floor(F.sum("_n").over(whole) * F.lit(train)))
        .where((F.col("_cum") > F.col("_want")) & (F.col("_cum") - F.col("_n") <= F.col("_want")))
        .select(F.col("_y").alias("_cy"), F.col("_b").alias("_cb"), (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_take"))
    )
    order = Window.partitionBy("_y", "_b").orderBy("_h", "_id")
    first_out = (
        ids.join(cut, F.col("_y").eqNullSafe(F.col("_cy")) & (F.col("_b") == F.col("_cb")))
        .withColumn("_rn", F.row_number().over(order) - 1)
        .where(F.col("_rn") == F.col("_take"))
        .select("_y", "_h", "_id")
    )
    cuts = first_out.limit(MAX_CLASSES + 1).collect()
    if len(cuts) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values; it is no class column")
    h, row_id = _hash(id_col, seed), F.col(id_col)
    is_train = F.lit(True)
    for c in cuts:
        before = (h < c["_h"]) | ((h == c["_h"]) & (row_id < c["_id"]))
        is_train = F.when(y.eqNullSafe(F.lit(c["_y"])), before).otherwise(is_train)
    return df.withColumn("is_train", is_train)


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "code", id_col: str = "rev_id", seed: int = 1, fold_col: str = "fold"
) -> DataFrame:
    """Adds ``fold`` in 0..k-1: in each class the ids are ranked in hash order and dealt out in turn,
    so the folds of a class differ by at most one id.

    No sort of all rows: ids are counted per class and leading hash bits, the counts of the buckets
    before each one are summed per class (at most 65,536 buckets), and only inside a bucket are ids
    ranked. Copies of an id share its fold; a null class counts as a class of its own.
    """
    y = F.col(label).cast("string")
    ids = (
        df.select(y.alias("_y"), F.col(id_col).alias("_id"))
        .distinct()
        .withColumn("_h", _hash("_id", seed))
        .withColumn("_b", F.shiftright("_h", 64 - BUCKET_BITS))
    )
    per_bucket = ids.groupBy("_y", "_b").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_bucket.select(F.col("_y").alias("_oy"), F.col("_b").alias("_ob"), (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_y", "_b").orderBy("_h", "_id")
    ranked = (
        ids.join(broadcast_if_small(offsets), F.col("_y").eqNullSafe(F.col("_oy")) & (F.col("_b") == F.col("_ob")))
        .select("_y", "_id", (F.col("_before") + F.row_number().over(inside) - 1).alias("_rank"))
    )
    folds = ranked.select(F.col("_y").alias("_fy"), F.col("_id").alias("_fid"), F.pmod("_rank", F.lit(k)).cast("int").alias(fold_col))
    own = df.drop(fold_col) if fold_col in df.columns else df
    joined = own.join(folds, y.eqNullSafe(F.col("_fy")) & F.col(id_col).eqNullSafe(F.col("_fid")))
    return joined.drop("_fy", "_fid")


def hash_split(df: DataFrame, id_col: str = "rev_id", train: float = 0.8, seed: int = 1) -> DataFrame:
    """Adds ``is_train`` by a hash bucket alone: near the share, without a shuffle."""
    return df.withColumn("is_train", F.pmod(_hash(id_col, seed), F.lit(10_000)) < int(train * 10_000))


class LogLossEvaluator(Evaluator, HasLabelCol, HasProbabilityCol):
    """Mean log loss of a probability array or vector; smaller is better."""

    def __init__(self, labelCol: str = "label", probabilityCol: str = "prob") -> None:
        super().__init__()
        self._set(labelCol=labelCol, probabilityCol=probabilityCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        name = self.getProbabilityCol()
        prob = F.col(name)
        if dataset.schema[name].dataType.typeName() != "array":
            prob = vector_to_array(prob)
        term = log_loss_term(prob, F.col(self.getLabelCol()).cast("int"))
        return dataset.select(F.avg(term)).first()[0]

    def isLargerBetter(self) -> bool:
        return False


# The ranges the random search draws from.
SEARCH_SPACE = {
    "maxIter": [50, 100, 200],
    "stepSize": [0.1, 0.05, 0.2],
    "minInstancesPerNode": [1, 2, 3, 4],
    "minInfoGain": [0.0, 0.125, 0.25, 0.5, 1.0, 2.0],
    "subsamplingRate": [0.8, 0.9, 0.95, 0.99, 1.0],
    "featureSubsetStrategy": ["0.8", "0.9", "0.95", "0.99", "all"],
    "maxDepth": [2, 3, 4, 5, 6, 7],
}


def draw_settings(space: dict[str, list] = SEARCH_SPACE, n: int = 10, seed: int = 1234) -> list[dict]:
    """Seeded random draws from a search space."""
    rng = random.Random(seed)
    return [{name: rng.choice(values) for name, values in space.items()} for _ in range(n)]


def quality_model(classifier: Estimator | None = None, decision: str = "median", label: str = "code") -> Pipeline:
    """Projection and ordinal chain as one pipeline; saved and loaded as one."""
    return Pipeline(stages=[
        ModelProjection(),
        SequentialOrdinal(classifier=classifier, labelCol=label, decision=decision),
    ])


def multiclass_model(kind: str = "forest", label: str = "code", seed: int = 1) -> Pipeline:
    """The plain six-class comparison model through the same projection."""
    if kind == "forest":
        learner = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=100, maxDepth=8, seed=seed)
    else:
        learner = LogisticRegression(labelCol=label, featuresCol="features", family="multinomial")
    return Pipeline(stages=[ModelProjection(), learner])


def random_search(
    train: DataFrame,
    label: str = "code",
    space: dict[str, list] = SEARCH_SPACE,
    n: int = 10,
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 1234,
    classifier: Estimator | None = None,
    id_col: str = "rev_id",
) -> CrossValidatorModel:
    """Cross-validated choice among random draws by log loss, over folds stratified by class.

    Boosted trees are fitted for all draws, folds and steps together (``boosting``); other learners one by one.
    The setting of the best mean is then fitted on all rows.
    """
    base = classifier or GBTClassifier(seed=seed)
    model = quality_model(base, label=label)
    maps = [
        {base.getParam(name): value for name, value in setting.items()} for setting in draw_settings(space, n, seed)
    ]
    search = CrossValidator(
        estimator=model,
        estimatorParamMaps=maps,
        evaluator=LogLossEvaluator(labelCol=label),
        numFolds=folds,
        foldCol="_fold",
        parallelism=parallelism,
        seed=seed,
    )
    # Every fit reads its folds: they are dealt once, and no fit carries the plan behind them.
    dealt = reliable_checkpoint(stratified_folds(train, folds, label=label, id_col=id_col, seed=seed, fold_col="_fold"))
    losses = boosted_losses(dealt, base, maps, label, folds, seed)
    if losses is None:
        return search.fit(dealt)
    means = [fmean(of_draw) for of_draw in losses]
    best = model.fit(dealt, maps[means.index(min(means))])
    return search._copyValues(CrossValidatorModel(best, means, None, [pstdev(of_draw) for of_draw in losses]))


def boosted_losses(
    dealt: DataFrame, base: Estimator, maps: list[dict], label: str, folds: int, seed: int
) -> list[list[float]] | None:
    """Log loss by draw and fold of boosted chains fitted together; None where they have to be fitted one by one
    (another learner, another parameter, or a class or fold without rows)."""
    together = {base.getParam(name) for name in SEARCH_SPACE} if type(base) is GBTClassifier else set()
    if not together or not maps or not all(together.issuperset(m) for m in maps):
        return None
    if base.isDefined(base.weightCol) or base.isDefined(base.validationIndicatorCol):
        return None
    frame = ModelProjection().transform(dealt).select(
        F.col(label).cast("int").alias("label"), F.col("_fold").alias("fold"), vector_to_array("features").alias("features")
    ).where("label is not null")
    counts = {(r["fold"], r["label"]): r["count"] for r in frame.groupBy("fold", "label").count().limit(folds * MAX_CLASSES + 1).collect()}
    classes = max((c for _, c in counts), default=-1) + 1
    if {f for f, _ in counts} != set(range(folds)) or not 1 < classes <= MAX_CLASSES:
        return None
    if {c for _, c in counts} != set(range(classes)) or any(
        not sum(counts.get((g, c), 0) for g in range(folds) if g != f) for f in range(folds) for c in range(classes)
    ):
        return None
    ship_package(dealt.sparkSession)
    settings = [setting_of(base.copy(m), len(MODEL_COLUMNS)) for m in maps]
    fits = Search(frame, counts, settings, base.getMaxBins(), ROWS_PER_TASK, seed)
    try:
        fits.fit()
        prob = chain_array([F.col("q")[k] for k in range(classes - 1)])
        term = log_loss_term(prob, F.col("label"))
        rows = fits.scored().groupBy("draw", "fold").agg(F.avg(term).alias("loss")).collect()
    finally:
        fits.close()
    loss = {(r["draw"], r["fold"]): r["loss"] for r in rows}
    return [[loss[d, f] for f in range(folds)] for d in range(len(maps))]


def best_classifier(search: CrossValidatorModel, classifier: Estimator) -> Estimator:
    """The searched classifier with the setting of the best mean over folds."""
    pick = max if search.getEvaluator().isLargerBetter() else min
    best = pick(range(len(search.avgMetrics)), key=search.avgMetrics.__getitem__)
    return classifier.copy(search.getEstimatorParamMaps()[best])

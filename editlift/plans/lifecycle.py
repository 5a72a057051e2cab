"""The three whole jobs: build the training set, train, answer requests."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlift.functions.labels import label_code
from editlift.functions.titles import page_url
from editlift.ml.selection import best_classifier, quality_model, random_search, stratified_split
from editlift.operators.edits import (
    Scorer,
    score_revisions,
    shown_classes,
    shown_edits,
    suggest_edits,
    suggest_fitted,
)
from editlift.operators.evaluation import class_report, confusion_matrix, hit_rates, log_loss, macro_scores
from editlift.operators.features import RAW_COLUMNS, featurize
from editlift.operators.lookup import asked_titles, requested_pages
from editlift.sources.dump import attach_labels, page_revisions
from editlift.sources.sinks import write_by_label


def build_training_set(
    pages: DataFrame, labels: DataFrame, lookup: DataFrame | None, path: str, mode: str = "errorifexists"
) -> None:
    """Page records and labels to featurized revisions, one folder per class.

    Only the label join shuffles. An existing set is not added to unless ``mode`` says so.
    """
    revisions = attach_labels(page_revisions(pages), labels)
    write_by_label(featurize(revisions, "wikitext", lookup, key="revid"), path, mode=mode)


def train_and_evaluate(
    featurized: DataFrame,
    classifier: Estimator | None = None,
    id_col: str = "revid",
    seed: int = 1,
    search: dict | None = None,
) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """Holdout tables from an 80/20 split, and the final model fitted on all rows.

    ``search``, if given, holds arguments of ``random_search`` (an empty one its defaults):
    the setting with the best mean over folds of the training part is used from there on.
    The narrow rows are kept until the last fit, so the text is featurized once; the
    holdout pairs stay persisted for the tables.
    """
    data = featurized.withColumn("code", label_code(F.col("wp10"))).where(F.col("code").isNotNull())
    data = data.select(id_col, "code", *RAW_COLUMNS).persist()
    split = stratified_split(data, "code", id_col, seed=seed)
    train = split.where("is_train")
    if search is not None:
        base = classifier or GBTClassifier(seed=seed)
        classifier = best_classifier(random_search(train, classifier=base, **{"label": "code", "id_col": id_col, **search}), base)
    model = quality_model(classifier)
    held = model.fit(train).transform(split.where(~F.col("is_train")))
    pairs = held.select(F.col("code").alias("actual"), F.col("prediction").cast("int").alias("pred"), "prob").persist()
    pairs.count()
    tables = {
        "class_report": class_report(pairs),
        "macro_scores": macro_scores(pairs),
        "confusion_matrix": confusion_matrix(pairs),
        "hit_rates": hit_rates(pairs),
        "log_loss": log_loss(pairs),
    }
    final = model.fit(data)
    data.unpersist()
    return final, tables


def page_results(
    featurized: DataFrame, scorer: Scorer, *key: str, decision: str = "median"
) -> DataFrame:
    """One row per key: best class, class probabilities in percent, edits worth showing."""
    scored = score_revisions(featurized.select(*key, *RAW_COLUMNS), scorer, decision)
    if hasattr(scorer, "probabilities"):
        rows = suggest_edits(scored, scorer)
    else:
        rows = suggest_fitted(scored, scorer, *key)
    return rows.select(
        *key,
        "best",
        "score",
        shown_classes(F.col("prob")).alias("classes"),
        shown_edits(F.col("edits")).alias("edits"),
    )


def answer_requests(
    requests: DataFrame,
    pages: DataFrame,
    redirects: DataFrame,
    lookup: DataFrame | None,
    scorer: Scorer,
    lang: str = "en",
) -> DataFrame:
    """Requested titles with the class of their page and the edits that would raise it.

    A page asked for many times is featurized and scored once.
    """
    asked = asked_titles(requests, redirects)
    newest = requested_pages(asked, pages).select("title", "revid", "content")
    results = page_results(featurize(newest, "content", lookup, key="revid"), scorer, "title", "revid")
    return (
        asked.join(results, "title", "left")
        .withColumn("found", F.col("revid").isNotNull())
        .withColumn("url", F.when(F.col("found"), page_url(F.col("title"), lang)))
    )


def read_saved_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)

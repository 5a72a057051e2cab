"""An ordered-class model as a chain of binary models, as Spark ML stages.

For each class k but the last, the rows of class k or above train a binary
model of "above k". The class probabilities follow by the chain rule.
"""

from __future__ import annotations

from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasParallelism,
    HasPredictionCol,
    HasProbabilityCol,
)
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.functions.probability import chain_array, median_code, modal_code
from editlift.session import reliable_checkpoint


MAX_CLASSES = 1_000

#: Training rows of a task. An iterative learner runs many short jobs, whose cost on few rows is their tasks.
ROWS_PER_TASK = 50_000


class _OrdinalParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasParallelism):
    decision = Param(
        Params._dummy(), "decision", "median or mode of the class distribution", TypeConverters.toString
    )
    output = Param(
        Params._dummy(), "output", "what transform adds: both, probability or prediction", TypeConverters.toString
    )

    def getDecision(self) -> str:
        return self.getOrDefault(self.decision)

    def getOutput(self) -> str:
        return self.getOrDefault(self.output)

    def _defaults(self) -> None:
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction",
            probabilityCol="prob", parallelism=8, decision="median", output="both",
        )


class SequentialOrdinal(_OrdinalParams, Estimator, MLReadable, MLWritable):
    """Fits the chain over integer labels 0..K-1; K is one more than the largest label.

    ``classifier`` is any binary Spark ML classifier with a probability column.
    """

    @keyword_only
    def __init__(self, *, classifier=None, featuresCol="features", labelCol="label",
                 predictionCol="prediction", probabilityCol="prob", parallelism=8,
                 decision="median", output="both") -> None:
        super().__init__()
        self._defaults()
        kwargs = dict(self._input_kwargs)
        self.classifier = kwargs.pop("classifier", None) or GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=1)
        self._set(**kwargs)

    def copy(self, extra=None):
        extra = extra or {}
        new = super().copy(extra)
        new.classifier = self.classifier.copy(extra)
        return new

    def _fit(self, dataset: DataFrame) -> "SequentialOrdinalModel":
        label, features = self.getLabelCol(), self.getFeaturesCol()
        # Written once with its lineage cut, before the threads start: the steps share no plan, their tasks
        # carry none of the expressions behind the features, and a lost block is read, not computed again.
        data = reliable_checkpoint(dataset.select(F.col(label).cast("int").alias("_y"), F.col(features).alias("_x")))
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            per_class = data.where("_y is not null").groupBy("_y").count().limit(MAX_CLASSES + 1).collect()
            if len(per_class) > MAX_CLASSES:
                raise ValueError(f"{label} has more than {MAX_CLASSES} values; it is no class column")
            counts = {r["_y"]: r["count"] for r in per_class}
            n_classes = max(counts) + 1
            missing = [k for k in range(n_classes) if not counts.get(k)]
            if n_classes < 2 or missing:
                raise ValueError(f"classes without rows: {missing or 'fewer than two classes'}")
            tasks = ceil(sum(counts.values()) / ROWS_PER_TASK)

            def fit_step(k: int):
                step = data.where(F.col("_y") >= k).select(
                    (F.col("_y") > k).cast("double").alias("_above"), F.col("_x")
                ).coalesce(tasks)
                binary = self.classifier.copy(
                    {self.classifier.labelCol: "_above", self.classifier.featuresCol: "_x"}
                )
                return binary.fit(step)

            pool = ThreadPool(processes=min(self.getParallelism(), n_classes - 1))
            try:
                models = pool.map(fit_step, range(n_classes - 1))
            finally:
                pool.close()
        finally:
            data.unpersist()
        return self._copyValues(SequentialOrdinalModel(models))

    def write(self) -> MLWriter:
        return _EstimatorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EstimatorReader(cls)


class SequentialOrdinalModel(_OrdinalParams, Model, MLReadable, MLWritable):
    """Adds the probability array and the predicted class."""

    def __init__(self, models=None) -> None:
        super().__init__()
        self._defaults()
        self.models = list(models or [])

    @property
    def n_classes(self) -> int:
        return len(self.models) + 1

    def copy(self, extra=None):
        new = super().copy(extra or {})
        new.models = [m.copy(extra or {}) for m in self.models]
        return new

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = dataset.columns
        out = dataset.withColumn("_x", F.col(self.getFeaturesCol()))
        q = []
        for k, model in enumerate(self.models):
            step = model.copy({
                model.featuresCol: "_x", model.rawPredictionCol: f"_raw{k}",
                model.probabilityCol: f"_prob{k}", model.predictionCol: f"_pred{k}",
            })
            out = step.transform(out)
            q.append(vector_to_array(F.col(f"_prob{k}"))[1].alias(f"_q{k}"))
        out = out.select(*keep, *q)
        prob = chain_array([F.col(f"_q{k}") for k in range(len(q))]).alias(self.getProbabilityCol())
        out = out.select(*keep, prob)
        p = F.col(self.getProbabilityCol())
        code = median_code(p, self.n_classes) if self.getDecision() == "median" else modal_code(p)
        if self.getOutput() != "probability":
            out = out.withColumn(self.getPredictionCol(), code.cast("double"))
        return out.drop(self.getProbabilityCol()) if self.getOutput() == "prediction" else out

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _EstimatorWriter(MLWriter):
    def __init__(self, instance: SequentialOrdinal) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.classifier.save(f"{path}/classifier")


class _EstimatorReader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SequentialOrdinal:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        classifier = DefaultParamsReader.loadParamsInstance(f"{path}/classifier", self.sparkSession)
        instance = self.cls(classifier=classifier)
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


class _ModelWriter(MLWriter):
    def __init__(self, instance: SequentialOrdinalModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        extra = {"steps": len(self.instance.models)}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)
        for k, model in enumerate(self.instance.models):
            model.save(f"{path}/step-{k}")


class _ModelReader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SequentialOrdinalModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        models = [
            DefaultParamsReader.loadParamsInstance(f"{path}/step-{k}", self.sparkSession)
            for k in range(metadata["steps"])
        ]
        instance = self.cls(models)
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


def as_scorer(model, column: str | None = None):
    """A fitted pipeline as a scorer of edits: adds its class probabilities as an array.

    They are taken from ``column``, an array or a vector; by default from ``prob`` of an
    ordinal model, else from ``probability`` of a multi-class one.
    """

    def score(df: DataFrame, out: str) -> DataFrame:
        scored = model.transform(df)
        name = column or ("prob" if "prob" in scored.columns else "probability")
        vector = isinstance(scored.schema[name].dataType, VectorUDT)
        prob = vector_to_array(F.col(name)) if vector else F.col(name)
        return scored.select(*df.columns, prob.alias(out))

    return score

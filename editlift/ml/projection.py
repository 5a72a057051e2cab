"""The 30 model columns as a pipeline stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlift.operators.features import MODEL_COLUMNS, model_columns


class ModelProjection(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the model columns as one vector; the input columns stay as they are."""

    @keyword_only
    def __init__(self, *, outputCol: str = "features") -> None:
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = model_columns()
        values = F.array(*[columns[c] for c in MODEL_COLUMNS])
        return dataset.withColumn(self.getOutputCol(), array_to_vector(values))

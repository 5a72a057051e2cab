"""Featurizing and scoring of a stream of revisions.

All steps are projections of one row, so they run on a stream unchanged, with
no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from editlift.operators.edits import ExpressionScorer, score_revisions, suggest_edits
from editlift.operators.features import featurize
from editlift.sources.schemas import REVISION


def revision_stream(spark: SparkSession, path: str, schema: str = REVISION, max_files: int = 100) -> DataFrame:
    """New ndjson files of a folder as a stream of revisions."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("mode", "FAILFAST").json(path)


def suggest_on_stream(
    revisions: DataFrame, scorer: ExpressionScorer, lookup: DataFrame | None = None,
    text_col: str = "wikitext", key: str = "revid",
) -> DataFrame:
    """Key, predicted class, score and edits of each revision as it arrives."""
    scored = score_revisions(featurize(revisions, text_col, lookup, key), scorer)
    return suggest_edits(scored, scorer).select(key, "best", F.round("score", 9).alias("score"), "edits")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet, process what is there, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

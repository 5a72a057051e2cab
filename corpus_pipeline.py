"""The training-data pipeline over ``documents``: five stages, each one of the operators.

Each stage takes and returns the columns of documents (the last one returns tokens), and its decisions
take effect: rejected documents and near-duplicates go, benchmark passages
are cut out, secrets are redacted, and what remains is encoded.

Cases: rows are judged each, equal rows alike. A null id cannot be linked, so such a row
passes near-duplicate removal. Of rows that share an id one stays. Null texts have no words and fail
the quality rules. Extra columns are carried through. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editlift.llm import bpe, decontam, minhash, quality, secrets
from editlift.llm.common import staged, table
from editlift.llm.tokenizers import BYTE_BPE
from editlift.session import broadcast_if_small, small_batches

#: SQL cannot express MinHash components, forests or BPE; tests compare with brute force.
ORACLE_SQL = None

#: Keys of rows that go are broadcast up to this many (some 40 bytes each).
KEYS = 500_000


def row_key() -> Column:
    """Names a row by its id and content; equal rows have equal keys."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text", "lang", "source").cast("string"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("_row_key", row_key())
    judged = quality.quality_rules(keyed, id_col="_row_key")
    rejected = judged.where(~F.col("kept")).select("_row_key").distinct()
    return keyed.join(broadcast_if_small(rejected, KEYS), "_row_key", "left_anti").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = staged(minhash.near_duplicates(docs).select("doc_id", "kept"), "near-duplicates")
    copies = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rest = docs.join(broadcast_if_small(copies, KEYS), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where(F.col("kept")).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rest
    # Rows that share an id are one group: the one of the smallest text stays.
    again = rest.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", row_key())).alias("row"))
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("row.*").select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("_row_key", row_key())
    found = secrets.secret_scan(keyed, id_col="_row_key")
    hidden = secrets.redact(keyed, "_row_key", "text", found)
    return hidden.select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # Written between: a task then has one Python worker, not an encoder and a decoder with a vocabulary each.
    encoded = staged(bpe.encode(docs, BYTE_BPE), "ids")
    decoded = bpe.decode(encoded, BYTE_BPE, keep=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("bpe_encoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

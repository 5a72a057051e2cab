"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlift.llm import bpe, decontam, licenses, lines, minhash, quality, secrets, substrings, toxicity, trie, urls, variants, warc
from editlift.llm.common import table
from editlift.llm.tokenizers import BYTE_BPE
from editlift.session import scratch_path


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in folders of source, language and 64 ids; one of few words is a licence file."""
    docs = table(spark, sf_dir, "documents")
    short = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+", -1)) <= 40
    name = F.concat(F.when(short, "LICENSE-").otherwise("doc-"), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), name)
    return licenses.license_scan(docs.select("doc_id", "text", path.alias("path")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return secrets.secret_scan(docs, path_col="path")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    # Decoding reads the encoder's rows; the digests of both are taken in one pass.
    decoded = bpe.decode(encoded, BYTE_BPE, keep=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.digested(table(spark, sf_dir, "pages"))
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(records), path)
    return warc.resolve_payloads(warc.read_archives(spark, path))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.fit_chain(docs, table(spark, sf_dir, "labels")).score(docs)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return leaks.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_secret_scan, op3_bpe_round_trip, op4_minhash_dedup, op5_warc_revisits,
        op6_toxicity_chain, op7_decontamination, op8_url_filter, op9_quality_rules, op10_repeated_bytes,
        op11_conversation_trie, op12_spelling_variants, op13_line_dedup,
    )
}

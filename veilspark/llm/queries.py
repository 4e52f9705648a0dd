"""The operators on the given tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, dedup, fingerprint, license_scan, mixture, negatives, quality_model, quality_rules,
    secret_scan, spelling, token_count, topk, toxicity,
)
from .common import fold
from .oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def vocabulary(name: str) -> str:
    """A file of the public tokenizers package, installed alike on driver and executors."""
    import public_tokenizers

    return os.environ.get("VEILSPARK_TOKENIZERS") or public_tokenizers.path(name)


BPE_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_circulant_minhash(spark, sf_dir):
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("places")


def op3_temperature_mixing(spark, sf_dir):
    return mixture.mix(_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark, sf_dir):
    path = vocabulary(BPE_FILE)
    return bpe.digests(_table(spark, sf_dir, "documents"), path)


def op5_secret_ownership(spark, sf_dir):
    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op6_greedy_token_count(spark, sf_dir):
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary(RANKS_FILE))


def op7_line_rules(spark, sf_dir):
    return quality_rules.line_rules(_table(spark, sf_dir, "documents"))


def _scored(scores: DataFrame, held, threshold: float) -> DataFrame:
    held_out = F.coalesce(held(F.col("doc_id")), F.lit(False))
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op8_quality_machine(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")

    def held(doc_id):
        return fold(doc_id, 5) == 0

    model = quality_model.fit(docs, labels, lambda i: ~held(i))
    return _scored(quality_model.score(docs, model), held, quality_model.THRESHOLD)


def op9_subword_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")

    def held(doc_id):
        return fold(doc_id, 3) == 1

    model = toxicity.fit(docs, labels, lambda i: ~held(i))
    return _scored(toxicity.score(docs, model), held, toxicity.THRESHOLD)


def op10_lookup_sketch(spark, sf_dir):
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op11_trie_frontier(spark, sf_dir):
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_cover_tree_top_k(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op13_window_negatives(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved))


QUERIES = {
    f.__name__: f for f in (
        op1_circulant_minhash, op2_license_scan, op3_temperature_mixing, op4_bpe_round_trip,
        op5_secret_ownership, op6_greedy_token_count, op7_line_rules, op8_quality_machine,
        op9_subword_toxicity, op10_lookup_sketch, op11_trie_frontier,
        op12_cover_tree_top_k, op13_window_negatives)
}

"""One query per text operator over its whole table, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm import (ann, fingerprints, language, line_dedup, mixing, near_dedup, pii, quality, secret_scan, sentencepieces,
                           spelling, token_files, whitening)
from monthloom.llm.common import documents, text_or_empty
from monthloom.llm.oracle import LINE_DEDUP, MIXING, NEAR_DEDUP, NEAREST
from monthloom.sources.store import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key="monthloom")
            .withColumn("text_sha256", F.sha2(text_or_empty(), 256)))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix_sources(documents(spark, sf_dir), weights=(5, 2, 1), most=3)
            .select("doc_id", "size", "source_size", "target", "taken"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base),
                        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, end_id=2)
    return (token_files.read_documents(spark, path)
            .select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))


def op10_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(documents(spark, sf_dir).select("doc_id", "text"))
    digested = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                              F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return (sentencepieces.decode(digested)
            .select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), least_words=10, most_repeated=20, reach=3.0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), least_letters=5, least_count=3, every=97, times=2)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), wanted=8)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_line_dedup, op2_near_dedup, op3_pii, op4_nearest, op5_mixing, op6_secrets, op7_fingerprints, op8_language, op9_token_files,
    op10_sentencepieces, op11_quality, op12_spelling, op13_whitening)}
ORACLE: dict[str, str] = {"op1_line_dedup": LINE_DEDUP, "op2_near_dedup": NEAR_DEDUP, "op4_nearest": NEAREST,
                          "op5_mixing": MIXING}

"""The registered queries of the corpus operators: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tag")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.select("rest.doc_id", F.col("n").alias("n_words"), F.col("gone").alias("n_removed"), F.col("kept").alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), unigram=True)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("rest.doc_id", F.col("n").alias("n_lines"), F.col("gone").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, token_folder, write_tokens

    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), token_folder(spark)))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import manifest, tampered, verify

    docs = table(spark, sf_dir, "documents")
    return verify(manifest(docs, also={"given": tampered(docs)}), F.col("given"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import build_index, find

    return find(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), slack=None)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {name: sql for name, sql in oracles.SQL.items() if name in queries()}

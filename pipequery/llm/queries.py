"""The registered queries of the operators, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pipequery.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op7_minhash_near_dedup"] = op7_minhash_near_dedup


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.quality_rules import apply_rules

    out = apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op10_quality_rules"] = op10_quality_rules
ORACLE_SQL["op10_quality_rules"] = oracles.OP10


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.secrets import secret_digest

    return secret_digest(_table(spark, sf_dir, "documents"))


QUERIES["op2_secret_scan"] = op2_secret_scan


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), capacity=1024, end_id=2, ids=False)


QUERIES["op9_best_fit_packing"] = op9_best_fit_packing


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.warc import archive_round_trip

    return archive_round_trip(spark, _table(spark, sf_dir, "pages"))


QUERIES["op5_warc"] = op5_warc


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("places")


QUERIES["op6_license_scan"] = op6_license_scan


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.quality_model import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3, mod=5, held_out=0)


QUERIES["op8_quality_classifier"] = op8_quality_classifier


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, mod=3, held_out=1)


QUERIES["op3_toxicity"] = op3_toxicity


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op4_decontamination"] = op4_decontamination


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pipequery.llm.substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


QUERIES["op1_substring_dedup"] = op1_substring_dedup
ORACLE_SQL |= {"op2_secret_scan": oracles.OP2, "op5_warc": oracles.OP5, "op7_minhash_near_dedup": oracles.OP7}

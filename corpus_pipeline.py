"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipequery.llm import decontaminate, near_dedup, packing, quality_model, secrets
from pipequery.llm.common import by_ids, materialize, unused

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this table's labels, scores at the threshold or more.

    Null and empty texts are scored too; repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels, "quality", mod=5, held_out=0)
    columns, (aside,) = docs.columns, unused(docs, "score_")
    scored = quality_model.score(docs.withColumnRenamed("score", aside), model).where(F.col("score") >= QUALITY_THRESHOLD).drop("score")
    return scored.withColumnRenamed(aside, "score").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Of rows with equal doc_id and text one stays; different texts under one doc_id are one document
    to the operator, and all stay or go. Null and empty texts and rows without doc_id stay.
    """
    found = near_dedup.near_duplicates(docs)
    dropped = materialize(found.where("not kept").select("doc_id").distinct(), "pipeline-dropped")
    kept = by_ids(docs, dropped, "doc_id", "left_anti")
    repeated = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "pipeline-repeated")
    if not repeated.limit(1).count():
        return kept
    return by_ids(kept, repeated, "doc_id", "left_anti").unionByName(by_ids(kept, repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows without doc_id are judged each by its own text. Null and empty texts stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = lambda rows: by_ids(rows, materialize(decontaminate.contaminated(rows, benchmark).select("doc_id").distinct(), "pipeline-leaks"), "doc_id", "left_anti")
    known, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if not nameless.limit(1).count():
        return clean(known)
    numbered = materialize(nameless.withColumn("doc_id", F.monotonically_increasing_id()), "pipeline-nameless")
    return clean(known).unionByName(clean(numbered).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by a mark; null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences; null and empty texts are the end id alone."""
    return packing.pack(docs, capacity=1024, end_id=2, ids=False)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: SQL can't express a trained classifier or a tokenizer; tests compare run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again.

    Columns of any name pass through all stages but the last; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

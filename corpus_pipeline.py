"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and returns the columns of
``documents``; the last returns token ids. Between stages the rows are written as Parquet in the shared folder and read
again, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.llm import bpe, common, langid, minhash, suffix, templates


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the identifier does not accept. Models are learned from the stage's own input."""
    common.release()
    return langid.identify(docs, langid.fit(docs)).filter("accepted").select(*docs.columns)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, of the least ``doc_id``, a null one last; rows without words all stay.

    Rows get numbers first, written with them, so that null and repeated ids are documents of their own.
    """
    common.release()
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = common.staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")
    kept = rows.select(row, "doc_id").join(found, row).groupBy("component_id").agg(first).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand elsewhere too from the texts; every document stays."""
    common.release()
    out = suffix.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    common.release()
    return templates.contaminated(docs, common.table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*docs.columns)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    common.release()
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.tokenizer_path())
    return out.select("doc_id", "lang", "source", "ids", "n_tokens")


STAGES = [
    ("language ID", _language),
    ("MinHash near-dedup", _near_copies),
    ("suffix-array dedup", _repeats),
    ("benchmark decontamination", _leaks),
    ("BPE encoding", _tokens),
]

#: SQL expresses neither the models of the first stage nor the merges of the last; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    at = f"{common.shared_dir(spark)}/loomsight/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs

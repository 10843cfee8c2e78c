"""The corpus pipeline: documents without toxic ones, without lines that repeat across documents, without near copies, without benchmark passages, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next. Rows without an id pass every stage; of rows that repeat an id, each stands or falls by its own text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, decontamination, line_dedup, near_dedup, toxicity
from scanloom.llm.common import table, written

#: SQL expresses neither the classifier nor the signatures; tests hold run() against brute force.
ORACLE_SQL = None
#: Rows and bytes at which a batch of whole texts on its way to a Python worker is closed, and characters of a block of pre-tokens. What
#: a worker has once held stays with it through the later stages, so these bound the memory of all of them; no result depends on them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
BLOCK_CHARS = 8_000_000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session of small batches. They stay set, as the stage's result is computed later."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in BATCH.items():
            spark.conf.set(name, most)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Labels are learned from the rows that op2 learns from."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return docs.where(toxicity.scored(docs, model)["score"] < 0.5)


@in_small_batches
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


@in_small_batches
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest id of each class stays."""
    gone = near_dedup.classes(docs).where("doc_id <> class_id").select("doc_id", F.col("mark").alias("_mark")).distinct()
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    return marked.join(gone.hint("shuffle_hash"), ["doc_id", "_mark"], "left_anti").select(docs.columns)


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return docs.where(~decontamination.contaminated(table(spark, sf_dir, "benchmark"), F.col("text")))


@in_small_batches
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, block_chars=BLOCK_CHARS))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

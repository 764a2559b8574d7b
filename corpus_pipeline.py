"""From raw documents to token ids in five stages: quality, near copies, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet and reads it back as the next stage's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import mixing, prob_minhash, quality, sp_wfst, substring_cm
from parley.llm.common import free_name, materialize

#: Rows of whole documents that go to a Python worker at once: the stages share long-lived
#: workers, and small batches keep each stage's buffers within a small executor.
BATCH_ROWS, BATCH_SETTING = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate class."""
    return prob_minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 20-word windows seen earlier; texts that lose nothing keep
    their spacing, and documents with no word left go."""
    whole = free_name(docs.columns, "_whole")
    out = substring_cm.drop_repeated_windows(docs.withColumn(whole, F.col("text")))
    s = out.columns[-1]
    text = F.when(F.col(f"{s}.n_removed") > 0, F.col(f"{s}.text")).otherwise(F.col(whole))
    chars = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    out = out.where(f"{s}.n_removed < {s}.n_words or {s}.n_words = 0")
    return out.withColumns({**chars, "text": text}).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says: low and toxic text down to its caps."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document."""
    out = sp_wfst.encode(docs, sp_wfst.load(MODEL))
    ids = F.col(f"{out.columns[-1]}.ids")
    return out.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_ids"), ids.alias("ids"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", in_small_batches(quality_rules)),
    ("near_dedup", in_small_batches(near_dedup)),
    ("substring_dedup", in_small_batches(substring_dedup)),
    ("mix_sources", in_small_batches(mix_sources)),
    ("sentencepiece", in_small_batches(encode)),
]

#: No SQL expresses MinHash classes, fitted rates or transducers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs

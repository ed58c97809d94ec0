"""The corpus pipeline: documents through five operators, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.quality import classify, train_on_labels
from tessera.llm.queries import tokenizer
from tessera.llm.sentencepiece_codec import piece_digests
from tessera.llm.shared import materialise, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the source tables, whatever ``docs`` holds."""
    net = train_on_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, net).where("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays.

    A document without an id stays only where no document of its group has one. Rows that
    repeat an id are told apart by their texts.
    """
    found = ngram_jaccard_join(docs).where(~F.col("class_id").eqNullSafe(F.col("doc_id")))
    dropped = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    return docs.join(dropped, same, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens, shared by the target weights; a document is taken once at most.

    Documents stay whole, so the one that a leaf's budget ends in is taken, too.
    """
    return mix(docs, share=0.9, max_epochs=1).where("copies > 0 or cut_tokens > 0").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece round trip."""
    return piece_digests(docs, tokenizer("piece_bpe_32k.model"), carry=["doc_id"])


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("sentencepiece", pieces)]

#: The classifier, the n-gram join and SentencePiece aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{folder}/{k}_{name}")
    return docs

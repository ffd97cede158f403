"""From raw documents to encoded training data in five stages, each written as Parquet before the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm import bpe, minhash, mixing, secrets, toxicity
from wattledger.llm.common import Scratch, remainder, table
from wattledger.llm.queries import DOMAINS, domains_of

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> bytes:
    return bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, with the columns of docs."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, remainder("doc_id", 5) != 0)
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.with_scores(docs, model, name).where(F.col(name) < 0.5).drop(name)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): the one with the least id, null last.

    Rows are compared by themselves, whatever their ids: an id may repeat, and rows without an id take part. Rows
    whose texts have no words stay; rows that are repeated in full are kept once.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    # the hash passes over nulls, so it is told where they are
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))
    groups = minhash.near_duplicates(spark, keyed, doc_id=row, shingle=5, percent=80)
    groups = groups.select(F.col("doc_id").alias(row), "component_id").distinct()
    first = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = keyed.select("doc_id", row).join(groups, row).groupBy("component_id").agg(F.min(first)[row].alias(row))
    # rows of a key are in one partition after the join, so the second step needs no shuffle of its own
    return keyed.join(kept.select(row), row, "left_semi").dropDuplicates().select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced by their kind; n_chars follows the text."""
    clean = secrets.redact(docs, vocabulary())
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says: 90 % of the expected tokens clean, 8 % of low quality, 2 % toxic.

    Documents that are clean beyond doubt are never dropped.
    """
    labelled = domains_of(table(spark, sf_dir, "labels"))
    return mixing.apply_mix(spark, docs, labelled, DOMAINS, anchor="clean", keep="clean")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, their number and digests."""
    return bpe.encode_digest(docs, vocabulary(), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("minhash", minhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# Trained scores, similarity links and token ids have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written below ``spark.checkpoint.dir``."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs

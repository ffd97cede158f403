"""One registered query for every operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm import bpe, codes, covertree, langid, merkle, minhash, mixing, order, quality, secrets, topk, toxicity, urls
from wattledger.llm.common import table
from wattledger.llm.registry import query
from wattledger.llm.twins import codes_sql, merkle_sql, urls_sql

VOCABULARY = "word_bpe_49k.json"


@query()
def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best inner products of every hundredth vector of embeddings with all others."""
    return topk.top_k(spark, table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of every text of documents."""
    return quality.score_documents(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op3_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence of documents in its slot of the training order, with the digest of its record."""
    ranks = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return order.materialise(spark, table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, end=50256, apart=True)


@query()
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encodes and decodes every text of documents."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return bpe.encode_digest(table(spark, folder, "documents"), vocabulary)


RULES: list[urls.Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query(urls_sql(RULES))
def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Judges every url of pages by rules and by its aliases."""
    return urls.judge(spark, table(spark, folder, "pages"), RULES)


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of every text of documents."""
    return toxicity.score_documents(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of documents over distinct 4-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(spark, table(spark, folder, "documents"), shingle=4, percent=80)


DOMAINS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean").alias("domain")
    return labels.where("quality is not null or toxic is not null").select("doc_id", domain)


@query()
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents for target shares of tokens that are clean, of low quality and toxic."""
    labelled = domains_of(table(spark, folder, "labels"))
    mixed = mixing.mix(spark, table(spark, folder, "documents"), labelled, DOMAINS, anchor="clean", keep="clean")
    p = [F.round(F.col("p")[k], 9).alias(f"p_{name}") for k, name in enumerate(sorted(DOMAINS))]
    return mixed.select("doc_id", "tokens", *p, "rate", "copies", "gap")


@query()
def op9_covertree(spark: SparkSession, folder: str) -> DataFrame:
    """Links of embeddings with a cosine of 0.95 or more."""
    return covertree.near_duplicates(spark, table(spark, folder, "embeddings"), least=0.95)


@query()
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text of documents."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return secrets.find_secrets(table(spark, folder, "documents"), vocabulary)


@query()
def op11_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text of documents."""
    return langid.identify(spark, table(spark, folder, "documents"))


@query(codes_sql())
def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product codes of all usable embeddings after two Lloyd rounds, with their errors."""
    return codes.digests(*codes.compress(spark, table(spark, folder, "embeddings")))


@query(merkle_sql())
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of documents, and which rows still verify after tampering."""
    return merkle.verify(merkle.manifest(spark, table(spark, folder, "documents")))

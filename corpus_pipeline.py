"""A corpus pipeline over ``documents``: every stage reads, as a written table, what the one before it kept."""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegrid.llm import bpe, decontaminate, jaccard, language, suffixes
from routegrid.llm.frames import small_batches
from routegrid.plans.staging import checkpoint_root, released, write_once


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not rejected by the language models learned from their own labels."""
    small_batches(spark)
    return language.keep_known(docs, language.fit(language.learned_from(docs)))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of every group of texts linked by a similarity of 0.8 of their five-word shingles."""
    small_batches(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes (any passage of over 50 words holds one) that occur twice."""
    small_batches(spark)
    return suffixes.without_repeats(docs, length=200)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 lies in a benchmark window of 13 words."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from them."""
    small_batches(spark)
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.decode(bpe.encode(docs, vocabulary), vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("language id", known_language),
    ("n-gram jaccard join", one_per_group),
    ("suffix-array dedup", no_repeats),
    ("benchmark decontamination", no_benchmark),
    ("bpe encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        with released(spark):  # nothing but its output is read after a stage
            docs = write_once(stage(spark, docs, sf_dir), f"{root}/{number}")
    return docs

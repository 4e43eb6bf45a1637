"""The corpus pipeline: five stages, each written as Parquet and read again for the next.

All stages but the last return the columns of ``documents`` and drop the rows
that they reject; the last encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import bpe, decontam, langid, neardup, toxicity
from gridloom.llm.store import Store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that score 0.5 or more by a model of all labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, which have no language; the rest are in one of those learned."""
    return langid.keep_known(docs, langid.sample(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more, the document with the least id stays; rows without id stay."""
    judged = neardup.near_duplicates(docs, Store(spark))
    again = judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(again.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain a benchmark item within the edit budget."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document left."""
    found = bpe.encode_documents(docs, bpe.vocabulary_path())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: No SQL gives these rows: the first two stages fit models. tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.keep(stage(spark, docs, sf_dir), name)
        store.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

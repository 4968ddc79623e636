"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return a DataFrame.

Each stage works on all that the one before kept, and its decisions take effect.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import lines, mixing, neardup, quality
from veilspark.llm.common import Sieve, fresh, stored
from veilspark.llm.queries import vocabulary
from veilspark.llm.tokens import encode_digests


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.  Null and empty texts go, as
    they fail the base rules; repeated rows are judged alike; other columns may have any names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.learn(quality.labelled(docs, labels)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier ones; n_chars follows the text (null: null).  Rows
    without doc_id stay as they are; all rows stay, also those whose text is empty now."""
    return lines.without_repeats(docs, counts=None).withColumn("n_chars", F.length("text").cast("long"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; only those that may go are moved.  Rows without
    doc_id, words or text stay, as do all rows of a doc_id that stays."""
    name = fresh(docs.columns)
    gone = neardup.near_duplicates(docs, percent=80).where("NOT kept").select(F.col("doc_id").alias(name("id"))).distinct()
    gone = stored(gone)
    may = F.coalesce(Sieve(gone).holds(F.col("doc_id").cast("long")) & F.col("doc_id").isNotNull(), F.lit(False))
    marked = docs.withColumn(name("may"), may)
    left = marked.where(name("may")).drop(name("may")).join(gone, F.col("doc_id").cast("long") == F.col(name("id")), "left_anti")
    return marked.where(~F.col(name("may"))).drop(name("may")).unionByName(left)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, dealt to shards and shuffled in each.  Null texts
    have size 0, null sources are one source, repeated rows are documents of their own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text of every row (null text: empty)."""
    return encode_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", keep_one),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learned rules, set similarity and tokenizing are not SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

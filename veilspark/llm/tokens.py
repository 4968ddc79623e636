"""Token counts, and encoding with decoding, of whole texts (see bpe.py for the method)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import bpe
from .common import freeing, slices

#: Texts that a worker holds as objects at a time.
TEXTS = 256


def n_tokens(text: Column, vocabulary: str) -> Column:
    """Exact tokens of a text (null or empty: 0), special strings read as the library does by
    default.  Each piece's prefix table is computed once for a worker."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([bpe.count_text(vocabulary, t) for t in some], dtype="int64")

    return count(text)


def prefix_counts(text: Column, vocabulary: str) -> Column:
    """Tokens of every prefix, as an array from the empty prefix to the whole text (null: [0])."""

    @F.pandas_udf("array<int>")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([bpe.load(vocabulary).prefix_counts(t or "") for t in some])

    return counts(text)


def truncated(text: Column, vocabulary: str, budget: int) -> Column:
    """The longest prefix within the budget, read off the prefix table (null stays null)."""

    @F.pandas_udf("string")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([None if t is None else bpe.load(vocabulary).truncate(t, budget) for t in some])

    return cut(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; repeated rows stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, vocabulary).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def encode(text: Column, vocabulary: str) -> Column:
    """struct<ids binary, decoded string>: ids are little-endian, 32 bits each (null: empty)."""

    @F.pandas_udf("ids binary, decoded string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            yield pd.DataFrame([bpe.encode_text(vocabulary, t) for t in some], columns=["ids", "decoded"])

    return run(text)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; the ids and the decoded text
    are digested where they are made, as they are longer than the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in slices(batches, TEXTS):
                n, ids_sha, shown_sha = [], [], []
                for t in b.column(1).to_pylist():
                    ids = bpe.text_ids(vocabulary, t)
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    shown_sha.append(hashlib.sha256(bpe.load(vocabulary).shown(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(shown_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.forget()

    texts = docs.select("doc_id", "text")
    kind = StructType([StructField("doc_id", texts.schema[0].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return texts.mapInArrow(freeing(run), kind)

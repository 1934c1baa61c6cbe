"""Token counts: an exact histogram of encoded lengths, with suffix sums for every context limit.

Texts are encoded where they lie; only ``(length, number)`` pairs move, summed before their shuffle.
The suffix sums take two levels, within blocks of BLOCK lengths and over the blocks, so that no task
holds all lengths: the upper one has a row for each BLOCK tokens of the longest document.
"""

from __future__ import annotations

import base64

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import cut, table

BLOCK = 1024
_loaded: dict = {}


def _encoding(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:  # an installed package's file, the same on every machine
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _count(path: str):
    def run(batches):
        encoding = _encoding(path)
        for batch in batches:
            n = [len(encoding.encode_ordinary(x.as_py() or "")) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens`` for each row; null and empty texts have 0 tokens, repeated rows and null ids stay."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_count(tokenizer), schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length L that occurs: ``n_tokens`` (L), ``n_docs`` of it, ``docs_at_least`` and ``tokens_at_least``
    of documents with L or more, ``docs_at_most``, and ``truncated_total``: all tokens if each document were cut to L.

    An empty table gives an empty histogram.
    """
    own = cut(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))  # used twice, encoded once
    own = own.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(above), zero).alias("docs_above"), F.coalesce(F.sum("block_tokens").over(above), zero).alias("tokens_above"), F.sum("block_docs").over(every).alias("all_docs"), F.sum("block_tokens").over(every).alias("all_tokens"))
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    summed = own.select("n_tokens", "n_docs", "block", F.sum("n_docs").over(within).alias("docs_in"), F.sum("tokens").over(within).alias("tokens_in")).join(blocks, "block")
    docs, tokens = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    return summed.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("all_docs") - docs + F.col("n_docs")).alias("docs_at_most"),
        (F.col("all_tokens") - tokens + docs * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """All tokens if each document were cut to ``limit``, from the first row at or above it."""
    row = histogram.where(F.col("n_tokens") >= limit).orderBy("n_tokens").limit(1).first()
    if row is None:
        last = histogram.orderBy(F.desc("n_tokens")).limit(1).first()
        return 0 if last is None else last["truncated_total"]
    return row["truncated_total"] - row["docs_at_least"] * (row["n_tokens"] - limit)


def quantile(histogram: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of all documents do not exceed."""
    total = histogram.agg(F.max("docs_at_least")).first()[0]
    row = histogram.where(F.col("docs_at_most") >= share * (total or 0)).orderBy("n_tokens").limit(1).first()
    return row and row["n_tokens"]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of the whole ``documents`` under the byte-level vocabulary of 50,256."""
    return length_histogram(token_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")))

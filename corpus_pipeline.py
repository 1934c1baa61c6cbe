"""From raw documents to token ids in five stages, each over all that its predecessor kept.

Null ids are ids like any other, and rows that share an id are judged each by its own text; repeated rows are dropped by the
third stage.  Null and empty texts have no letter and go in the first.  Columns beyond ``doc_id`` and ``text`` pass through the
stages unread (``lang`` trains the first, ``n_chars`` follows the second), whatever their names.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscape.llm import bpe, decontamination, language, line_dedup, ngram_join
from linkscape.llm.common import apart, cut, rows_at_once, table

#: Least posterior of a predicted language.
LANGUAGE_SCORE = 0.5
#: Texts that go to Python at once where languages are predicted.
ROWS = 1_000


def _text_key() -> Column:
    """Tells rows of one ``doc_id`` with different texts apart, as ``text_key`` of the operators does."""
    return F.xxhash64(F.col("text").cast("string"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` (null equals null) and text are not among the rejected ``doc_id, text_key``; the short side is what is rejected."""
    gone_id, gone_key = apart(docs, "gone_id", "gone_key")
    gone = rejected.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[gone_id]) & (_text_key() == gone[gone_key]), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language that is likelier than all others together, go.

    Each row is judged by its own text, also where ``doc_id`` is null or shared.
    """
    with rows_at_once(spark, ROWS):  # written before the texts are shuffled, so that both don't need memory at the same time
        found = language.predict(docs, language.train(docs), with_key=True)
        rejected = cut(found.where((F.col("lang_pred") == "und") | (F.col("score") < LANGUAGE_SCORE)).select("doc_id", "text_key"))
    return _without(docs, rejected)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go from the texts (``n_chars`` follows); a document of which nothing is left goes.

    Rows of the same id and text are one document and keep the same lines; null ids come before all others; other columns stay as they are.
    """
    n_lines, n_removed = apart(docs, "n_lines", "n_removed")
    found = line_dedup.line_dedup(docs, min_words=50, counts=(n_lines, n_removed))
    kept = found.where((F.col(n_removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by four-word shingles at 85 percent, the one with the smallest ``doc_id`` stays.

    Rows with a null or shared ``doc_id`` are documents of their own, null ids after all others and one id's texts in
    the order of their keys; of rows with the same id and text one stays.
    """
    gone_id, row_id, key, number = apart(docs, "gone_id", "row_id", "row_key", "row_number")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty():
        found = ngram_join.ngram_jaccard_join(docs, words=4, percent=85)
        gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
        return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
    # numbers stand for the ids: in the order of ids and keys, fixed by writing them
    keys = docs.select(F.col("doc_id").alias(row_id), _text_key().alias(key)).distinct().orderBy(F.col(row_id).asc_nulls_last(), key)
    keys = cut(keys.withColumn(number, F.monotonically_increasing_id()))
    rows = docs.join(keys, docs["doc_id"].eqNullSafe(keys[row_id]) & (_text_key() == keys[key])).select(number, *[docs[c] for c in docs.columns])
    rows = cut(rows.dropDuplicates([number]))
    found = ngram_join.ngram_jaccard_join(rows.select(F.col(number).alias("doc_id"), "text"), words=4, percent=85)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def unseen_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go.

    Each row is judged by its own text, also where ``doc_id`` is null or shared.
    """
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return _without(docs, found.where("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number."""
    found = bpe.bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", unseen_in_benchmark),
    ("bpe", encoded),
]

#: Learned language models and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

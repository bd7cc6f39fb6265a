"""A corpus pipeline of five operators, from documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
Stages return the columns of ``documents`` except for the last. Nulls, empty texts,
repeated rows and empty tables are as the operators define them; rows that share an
id stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from masterline.llm.common import store, table

RANK_FILE = "byte_bpe_50k.tiktoken"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: texts that are null or have no letter."""
    named = language_id.predict(docs, language_id.fit(docs), name="__language")
    return named.where(F.col("__language.lang_pred") != language_id.UNKNOWN).drop("__language")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a repeated line in the document with the smallest id only; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, counts=("__lines", "__dropped"))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates."""
    return _without(docs, ngram_join.near_duplicates(docs).where(~F.col("kept")))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return _without(docs, decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of the
    ids and of the bytes they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    # Stored, as a task that both encodes and decodes holds two Python workers, and executors
    # keep them all, in turn, as long as they are busy.
    encoded = store(bpe.encode(docs, ranks, public_tokenizers.PATTERN))
    decoded = bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", tokenize),
]

#: Language profiles and edit distances have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}

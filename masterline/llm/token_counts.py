"""Totals and quantiles of encoded lengths for every context limit.

Documents are counted by their exact encoded length. All else follows from
this histogram by running sums over lengths: documents and tokens beyond a limit,
what is left when documents are cut at the limit, and the share of documents that
fit. A limit between two lengths needs the next longer row only (see ``at_limits``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from masterline.llm.common import store

#: Lengths in a block of the running sums: windows run within blocks and over blocks.
BLOCK = 1024


def _lengths(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(t)) for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k != "text"), pa.array(n)], [*(k for k in batch.schema.names if k != "text"), "length"])

    return run


def lengths(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and encoded length of each row's whole text (null or empty: 0)."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    id_type = docs.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(_lengths(shared, pattern), f"doc_id {id_type}, length long")


def context_table(counted: DataFrame) -> DataFrame:
    """One row for each length that occurs, from rows with ``length``.

    length; n_docs of this length; docs_longer and tokens_longer of greater length;
    truncated_total, the tokens left when every document is cut at this length;
    n_total and token_total; share_fitting, the part of documents not above the
    length, whose first row at or above q is the q-quantile. No rows for an empty
    table.
    """
    # Read twice below; stored, so that texts are encoded once.
    hist = store(counted.groupBy("length").agg(F.count("*").alias("n_docs")))
    hist = hist.withColumns({"block": F.expr(f"length div {BLOCK}"), "tokens": F.col("length") * F.col("n_docs")})
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("sum"))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(beyond), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("sum").over(beyond), F.lit(0)).alias("tokens_beyond"),
        F.sum("docs").over(everything).alias("n_total"),
        F.sum("sum").over(everything).alias("token_total"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("docs_beyond") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_beyond") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("tokens_longer"),
        "n_total",
        "token_total",
    )
    return rows.select(
        "length",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("token_total") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_total"),
        "n_total",
        "token_total",
        ((F.col("n_total") - F.col("docs_longer")) / F.col("n_total")).alias("share_fitting"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """docs_longer and truncated_total of any context limits, one aggregate over the table."""
    sums = []
    for limit in limits:
        over = F.col("length") > limit
        sums += [
            F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias(f"longer_{limit}"),
            F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")).alias(f"total_{limit}"),
        ]
    row = table.agg(*sums)
    stacked = ", ".join(f"{limit}L, longer_{limit}, total_{limit}" for limit in limits)
    return row.selectExpr(f"stack({len(limits)}, {stacked}) AS (limit, docs_longer, truncated_total)")

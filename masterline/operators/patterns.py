"""Response patterns as bit words.

A likelihood depends on a respondent only through the answers given, so equal
answer patterns are counted once.  Sixty items fit one pair of BIGINTs: which
items were answered (``a0, a1, ..``) and which were right (``x0, x1, ..``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = 60


class Codec:
    """Encodes long responses to bit words and back, for one list of items."""

    def __init__(self, items: Sequence[int]):
        self.items = [int(i) for i in items]
        self.n_words = (len(self.items) + WORD - 1) // WORD
        self.words = [f"{kind}{w}" for w in range(self.n_words) for kind in ("a", "x")]

    @classmethod
    def of(cls, q: DataFrame) -> "Codec":
        """From the Q-matrix, whose rows (the test's items) go to the driver."""
        return cls([r.item_id for r in q.select("item_id").orderBy("item_id").collect()])

    def _table(self, spark: SparkSession) -> DataFrame:
        n = range(len(self.items))
        table = {
            "item_id": pa.array(self.items, pa.int32()),
            "__w": pa.array([i // WORD for i in n], pa.int32()),
            "__b": pa.array([i % WORD for i in n], pa.int32()),
        }
        return spark.createDataFrame(pa.table(table))

    def encode(self, resp: DataFrame, *keys: str) -> DataFrame:
        """(item_id, score) rows -> one row of words per key; OR has map-side
        partials, so what is shuffled is one short row per key and map task.

        A NULL answer keeps its key.  An item that is not on the list, or one
        answered twice by a key, fails the job."""
        placed = resp.join(F.broadcast(self._table(resp.sparkSession)), "item_id", "left")
        placed = placed.withColumn("__b", F.expr("coalesce(__b, raise_error(concat('not an item of the form: ', item_id)))"))
        aggs = [F.count("score").alias("__answers")]
        for w in range(self.n_words):
            aggs.append(F.expr(f"bit_or(if(__w = {w} AND score IS NOT NULL, shiftleft(1L, __b), 0L)) AS a{w}"))
            aggs.append(F.expr(f"bit_or(if(__w = {w} AND score = 1, shiftleft(1L, __b), 0L)) AS x{w}"))
        held = " + ".join(f"bit_count(a{w})" for w in range(self.n_words))
        once = F.expr(f"if(__answers = {held}, a0, raise_error('an item answered twice by one respondent'))")
        return placed.groupBy(*keys).agg(*aggs).withColumn("a0", once).drop("__answers")

    def encode_wide(self, wide: DataFrame, *keys: str) -> DataFrame:
        """Words from a wide table with one 0/1 column per item: row by row, so
        neither an unpivot nor a shuffle stands between the file and the words."""
        words = []
        for w in range(self.n_words):
            part = list(enumerate(self.items[w * WORD : (w + 1) * WORD]))
            words.append(" | ".join(f"if(`{item}` IS NULL, 0L, {1 << b}L)" for b, item in part) + f" AS a{w}")
            words.append(" | ".join(f"if(`{item}` = 1, {1 << b}L, 0L)" for b, item in part) + f" AS x{w}")
        return wide.selectExpr(*keys, *words)

    def count(self, encoded: DataFrame) -> DataFrame:
        """Distinct patterns with the number of respondents ``n``."""
        return encoded.groupBy(*self.words).agg(F.count(F.lit(1)).alias("n"))

    def right(self, i: int) -> str:
        """0/1: item number i (0-based) answered right, as SQL text."""
        return f"(shiftright(x{i // WORD}, {i % WORD}) & 1L)"

    def answered(self, i: int) -> str:
        return f"(shiftright(a{i // WORD}, {i % WORD}) & 1L)"

    def decode(self, df: DataFrame) -> DataFrame:
        """Back to one row per answered item, keeping every other column."""
        rows = ", ".join(
            f"struct({item} AS item_id, {self.answered(i)} AS __a, cast({self.right(i)} AS int) AS score)"
            for i, item in enumerate(self.items)
        )
        return df.selectExpr("*", f"inline(array({rows}))").filter("__a = 1").drop("__a")

    def unpacker(self) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
        """Function from an Arrow batch of patterns to (answered, right) as 0/1
        matrices, patterns by items.  It holds plain numbers only, so tasks can
        run it on machines where this package is not installed."""
        n_words, n_items, word = self.n_words, len(self.items), WORD

        def unpack(batch):
            out = []
            for kind in ("a", "x"):
                words = [batch.column(f"{kind}{w}").to_numpy() for w in range(n_words)]
                out.append(np.column_stack([words[i // word] >> (i % word) & 1 for i in range(n_items)]).astype(float))
            return out[0], out[1]

        return unpack

    def total_score(self) -> Column:
        return F.expr(" + ".join(f"bit_count(x{w})" for w in range(self.n_words)))

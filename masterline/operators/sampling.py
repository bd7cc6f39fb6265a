"""Repeatable sampling; every random number is a hash of row keys and a salt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.functions.hashing import PRIME, array_uniforms, u01
from masterline.operators.joins import left_join, neighbours
from masterline.operators.ranking import cumulative_sum, dense_index, rowid
from masterline.plans.lineage import BROADCAST_ROWS

BUCKETS = 1 << 16


def sample_n(df: DataFrame, n: int, key: str, salt: int) -> DataFrame:
    """Exactly n rows (all, if fewer) without replacement; ``key`` is unique.

    Rows keep a uniform; a count of rows in 65,536 equal slices of [0, 1) tells
    which slices are wholly in and which one the n-th row falls into, and only
    that slice is ordered.  The rest is a filter, with no shuffle of the table.
    """
    u = u01(key, 1, salt)
    rows = df.withColumns({"__u": u, "__slice": F.floor(u * BUCKETS).cast("int")})
    upto = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = (
        rows.groupBy("__slice").agg(F.count(F.lit(1)).alias("__c"))
        .select("__slice", (F.lit(n) - (F.sum("__c").over(upto) - F.col("__c"))).alias("__room"), "__c")
        .filter(F.col("__room") > 0)
    )
    rows = rows.join(F.broadcast(slices), "__slice")  # at most BUCKETS rows
    whole = rows.filter(F.col("__room") >= F.col("__c"))
    rank = F.row_number().over(Window.partitionBy("__slice").orderBy("__u", key))
    edge = (
        rows.filter(F.col("__room") < F.col("__c"))
        .withColumn("__rank", rank)
        .filter(F.col("__rank") <= F.col("__room"))
    )
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def shuffle_rows(df: DataFrame, key: str, salt: int, name: str = "position") -> DataFrame:
    """All rows with a random position 1..N."""
    u = u01(key, 1, salt)
    return rowid(df.withColumn("__u", u), name, ["__u", key]).drop("__u")


def sample_repl(spark: SparkSession, df: DataFrame, n: int, order: list[str], salt: int, name: str = "sample_id") -> DataFrame:
    """n rows with replacement, numbered 0..n-1."""
    numbered = rowid(df, "__row", order)
    total = numbered.agg(F.count(F.lit(1))).scalar()
    picks = spark.range(n).select(
        F.col("id").alias(name), (F.floor(u01("id", 2, salt) * total) + 1).alias("__row")
    )
    return picks.join(numbered, "__row").drop("__row")


def sample_weighted(
    spark: SparkSession, df: DataFrame, n: int, weight: str, key: str, salt: int, name: str = "sample_id"
) -> DataFrame:
    """n rows with replacement, each with chance proportional to its weight.

    Rows own intervals of the cumulative weight; a pick belongs to the interval
    whose upper end is the first one beyond it.
    """
    ends = cumulative_sum(df.filter(F.col(weight) > 0), weight, "__end", [key])
    total = df.filter(F.col(weight) > 0).agg(F.sum(weight)).scalar()
    ends = ends.withColumn("__start", F.col("__end") - F.col(weight))
    picks = spark.range(n).select(
        F.col("id").alias(name), (u01("id", 3, salt) * total).alias("__x")
    )
    picks = picks.withColumn("__g", F.lit(0))
    owner = neighbours(picks, ends.withColumn("__g", F.lit(0)), ["__g"], "__x", "__start", key)
    owner = owner.select(name, F.col("before.id").alias(key))
    return left_join(owner, df, [key])


def sample_one(df: DataFrame, keys: list[str], item: str, weight: str, r: str, k: str, salt: int) -> DataFrame:
    """One row per group with chance proportional to its weight.

    Exponential race: the row with the smallest -ln(u)/weight wins, which is a
    plain minimum with map-side partials and needs no group gathered or sorted.
    """
    clock = -F.ln(F.greatest(u01(r, k, salt), F.lit(1.0 / PRIME))) / F.col(weight)
    return (
        df.filter(F.col(weight) > 0)
        .groupBy(*keys)
        .agg(F.min_by(F.col(item), F.struct(clock.alias("t"), F.col(item).alias("i"))).alias(item))
    )


def sample_index(df: DataFrame, weights: str, r: str, salt: int, name: str) -> DataFrame:
    """Adds ``name`` in place of ``weights``: a 0-based index drawn from the row's array of weights
    by the same race as :func:`sample_one`, NULL when no weight is positive.

    ``r`` (SQL text) identifies the row.  Arrays are of one length; groups are rows
    here, so nothing is exploded or shuffled.
    """
    least, uniforms = 1.0 / PRIME, array_uniforms()

    def drawn(keys: np.ndarray, w: np.ndarray) -> pa.Array:
        with np.errstate(divide="ignore"):
            clock = -np.log(np.maximum(uniforms(keys[:, None], np.arange(w.shape[1])[None, :], salt), least)) / w
        clock[~(w > 0)] = np.inf
        return pa.array(clock.argmin(axis=1), pa.int32(), mask=~(w > 0).any(axis=1))

    return _by_row(df, weights, r, name, drawn)


def bernoulli_total(df: DataFrame, probs: str, items: list[int], r: str, salt: int, name: str) -> DataFrame:
    """Adds ``name`` in place of ``probs``: how many answers are 1, each with its probability in the
    row's array, in the order of ``items``; drawn as :func:`masterline.functions.hashing.bernoulli`."""
    k, uniforms = np.array(items, np.int64)[None, :], array_uniforms()

    def total(keys: np.ndarray, p: np.ndarray) -> pa.Array:
        return pa.array((uniforms(keys[:, None], k, salt) < p).sum(axis=1), pa.int32())

    return _by_row(df, probs, r, name, total)


def _by_row(df: DataFrame, array: str, r: str, name: str, value) -> DataFrame:
    """``name``, of ``value(keys, arrays)``, in place of the column ``array``; batch by batch."""
    keep = [f for f in df.schema.fields if f.name not in (array, name)]
    names = [f.name for f in keep]
    own = next((f.name for f in keep if f.name == r and isinstance(f.dataType, T.LongType)), "__r")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("__array")
                if pa.types.is_binary(column.type):
                    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + batch.num_rows + 1]
                    cells = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<f8")
                else:
                    cells = column.flatten().to_numpy(zero_copy_only=False)
                found = value(batch.column(own).to_numpy(zero_copy_only=False), cells.reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], [*names, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], f"`{name}` int"])
    key = [F.expr(f"cast({r} as bigint) AS __r")] if own == "__r" else []
    return df.select(*[f"`{c}`" for c in names], F.col(array).alias("__array"), *key).mapInArrow(task, schema)


def packed(df: DataFrame, array: str) -> DataFrame:
    """The column ``array`` of doubles as their bytes, which :func:`sample_index` and
    :func:`bernoulli_total` take as well: what a join repeats many times over then goes to
    Python as one value for each row, not number by number."""
    keep = [f for f in df.schema.fields if f.name != array]
    names = [f.name for f in keep]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(array)
            values = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32) * 8
            cells = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], cells], [*names, array])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], f"`{array}` binary"])
    return df.select(*[f"`{c}`" for c in names], f"`{array}`").mapInArrow(task, schema)


def assign_labels(df: DataFrame, labels: DataFrame, key: str, label: str, label_key: str, salt: int) -> DataFrame:
    """Give each row its own label, in shuffled order; too few labels fail.

    ``label_key`` is a unique integer column of the label table.
    """
    if labels.count() < df.count():
        raise ValueError("fewer labels than rows")
    shuffled = shuffle_rows(labels.select(label, label_key), label_key, salt, "__row")
    return rowid(df, "__row", [key]).join(shuffled.select("__row", label), "__row").drop("__row")


def merge_chains(draws: DataFrame, chain: str = "chain", iteration: str = "iteration", name: str = "draw") -> DataFrame:
    """(chain, iteration) -> one draw number, chains laid end to end."""
    per_chain = draws.agg(F.max(iteration)).scalar()
    number = (F.col(chain) - 1) * per_chain + F.col(iteration)
    return draws.withColumn(name, number.cast("bigint")).drop(chain, iteration)


def count_draws(draws: DataFrame, draw: str = "draw") -> DataFrame:
    return draws.agg(F.countDistinct(draw).alias("n_draws"))


def thin_draws(draws: DataFrame, n: int, salt: int, draw: str = "draw") -> DataFrame:
    """Keep n whole draws and renumber them 1..n in their old order."""
    kept = sample_n(draws.select(draw).distinct(), n, draw, salt)
    index = dense_index(kept, draw, "__new")
    index = F.broadcast(index) if n <= BROADCAST_ROWS else index
    return draws.join(index, draw).withColumn(draw, F.col("__new")).drop("__new")

"""Grouped aggregation with the original's NULL and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masterline.operators.joins import left_join


def sum_strict(x: Column) -> Column:
    """Sum that is NULL as soon as one value is NULL."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))


def sum_skip(x: Column) -> Column:
    """Sum over the values that are there; 0 when there is none."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def add_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Attach the size of its group to each row.

    Counted with map-side partials and joined back; a window would gather each
    group, however large, in one task.
    """
    return left_join(df, count_by(df, *keys, name=name), list(keys))


def arg_max(x: Column, y: Column) -> Column:
    """The ``x`` at the largest ``y``; the smallest ``x`` when tied."""
    return F.min_by(x, F.struct((-y).alias("y"), x.alias("x")))


def collapse_unique(
    df: DataFrame, key: str, value: str, position: Column, sep: str = ",", name: str | None = None
) -> DataFrame:
    """The distinct values of a group in one string, in first-seen order.

    Repeats are folded into (key, value, first position) before anything is
    gathered, so a group's size is its number of distinct values.
    """
    seen = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(position).alias("__pos"))
    ordered = F.sort_array(F.collect_list(F.struct("__pos", value)))
    return seen.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s[value].cast("string")), sep).alias(name or value)
    )


def histogram(df: DataFrame, x: str, width: float = 2.0, boundary: float = 0.0) -> DataFrame:
    """Counts in right-closed bins (lo, hi] of one width, lo on the boundary grid."""
    bin_no = F.ceil((F.col(x) - boundary) / width)
    return (
        df.filter(F.col(x).isNotNull())
        .groupBy(bin_no.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            ((F.col("bin") - 1) * width + boundary).alias("lo"),
            (F.col("bin") * width + boundary).alias("hi"),
            "n",
        )
    )

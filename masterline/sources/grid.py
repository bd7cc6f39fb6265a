"""Generated axes, always by exploding a sequence: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def n_points(lo: float, hi: float, step: float) -> int:
    return int(round((hi - lo) / step)) + 1


def grid(spark: SparkSession, lo: float, hi: float, step: float, name: str = "x") -> DataFrame:
    """lo, lo + step, ..., hi; computed as lo + index * step to avoid drift."""
    return spark.range(n_points(lo, hi, step)).select((lo + F.col("id") * step).alias(name))


def with_axis(df: DataFrame, n: int | Column, name: str) -> DataFrame:
    """Each row once per index 0..n-1."""
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), last.cast("int"))))

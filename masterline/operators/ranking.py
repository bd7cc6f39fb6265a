"""Row numbers, dense indexes and first/last rows without one-task windows."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masterline.operators.joins import left_join
from masterline.plans.lineage import cut, n_partitions, range_parts


#: Rows that one part numbers; a smaller table is one part.
ROWS_PER_PART = 50_000
#: Sampled keys per part that its bounds are picked from.
SAMPLED = 60


class Down(NamedTuple):
    """A column to order by from the highest value down, NULL last."""

    col: str


def _place(order: list) -> tuple[list[Column], list[str], list[Column]]:
    """Key columns, their SQL test of coming after a bound, and their sort order."""
    keys, tests, sort = [], [], []
    for i, o in enumerate(order):
        down = isinstance(o, Down)
        col = F.col(o.col) if down else F.col(o) if isinstance(o, str) else o
        keys.append(col.alias(f"__k{i}"))
        low, high = ("__k{i}", "b.__k{i}") if down else ("b.__k{i}", "__k{i}")
        tests.append(f"coalesce({high} > {low}, {low} IS NULL AND {high} IS NOT NULL)".format(i=i))
        sort.append(F.desc(f"__k{i}") if down else F.asc(f"__k{i}"))
    return keys, tests, sort


def _part_number(tests: list[str], n_parts: int) -> Column:
    """How many of the sorted ``__bounds`` a row's key reaches, by bisection."""
    reached = "true"
    for i, test in reversed(list(enumerate(tests))):
        reached = f"({test} OR (__k{i} <=> b.__k{i} AND {reached}))"
    at = "(s.lo + s.hi) div 2"
    step = (
        f"transform(array(get(__bounds, cast({at} as int))), b -> if({reached}, named_struct('lo', {at} + 1, 'hi', s.hi), "
        f"named_struct('lo', s.lo, 'hi', {at})))[0]"
    )
    start = "named_struct('lo', 0L, 'hi', cast(size(__bounds) as bigint))"
    return F.expr(f"aggregate(sequence(1, {n_parts.bit_length() + 1}), {start}, (s, i) -> if(s.lo >= s.hi, s, {step})).lo")


def rowid(df: DataFrame, name: str, order: list, within: list[str] | None = None) -> DataFrame:
    """Number rows 1, 2, ... by ``order`` (columns, or :class:`Down`), over the table or within groups.

    The order is required (a Spark table has none) and should end in a unique
    column.  Only the columns it needs are stored: bounds picked from a sample of them
    cut the table into parts of about ``ROWS_PER_PART`` rows, and counts by part tell how
    many rows lie in earlier ones.  A row finds its part by its key, so the other
    columns pass through one shuffle and are never stored, and ``df`` must give
    the same rows when it is read again.  Of a group's rows in earlier parts only
    the first group of a part has any, so the offsets are one row per part at
    most; neither the table nor a hot group passes through a single task.
    """
    groups = within or []
    keys, tests, sort = _place([*groups, *order])
    stored = cut(df.select(*keys))
    n_rows = stored.count()
    n_parts = max(1, min(n_partitions(df.sparkSession), -(-n_rows // ROWS_PER_PART)))
    own = [f"__k{i}" for i in range(len(groups))]
    number = F.row_number().over(Window.partitionBy("__part", *own).orderBy(*sort))
    rows = df.select("*", *keys)
    if n_parts == 1:
        rows = rows.withColumn("__part", F.lit(0)).withColumn("__number", number)
        return rows.select(F.col("__number").cast("bigint").alias(name), *[f"`{c}`" for c in df.columns])
    sample = stored.sample(fraction=min(1.0, SAMPLED * n_parts / n_rows), seed=n_rows)
    # The window runs over the sample, and its result has a row per part.
    at = F.row_number().over(Window.orderBy(*sort))
    picked = cut(sample.withColumn("__at", at).where(F.col("__at") % SAMPLED == 0))
    bound = F.struct(*[f"__k{i}" for i in range(len(keys))])
    bounds = picked.agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", bound.alias("b")))), lambda x: x["b"]).alias("b"))
    part = _part_number(tests, n_parts * 2)
    placed = stored.withColumn("__bounds", bounds.scalar()).withColumn("__part", part)
    sizes = placed.groupBy(*own, "__part").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", *[F.col(c).alias(f"{c}r") for c in own], F.sum("__size").over(earlier).alias("__shift")).where("__shift IS NOT NULL")
    rows = rows.withColumn("__bounds", bounds.scalar()).withColumn("__part", part).drop("__bounds").withColumn("__number", number)
    starts = starts.withColumnRenamed("__part", "__partr")
    match = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"{c}r")), own, F.col("__part") == F.col("__partr"))
    numbered = rows.join(F.broadcast(starts), match, "left")
    total = F.col("__number") + F.coalesce("__shift", F.lit(0))
    return numbered.select(total.cast("bigint").alias(name), *[f"`{c}`" for c in df.columns])


def cumulative_sum(df: DataFrame, value: str, name: str, order: list) -> DataFrame:
    """Running total over the whole table in ``order``, by part and offset."""
    rows = range_parts(df, order)
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    own = F.sum(value).over(
        Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("__own", own)
        .join(starts, "__part")
        .withColumn(name, F.col("__own") + F.col("__start"))
        .select(*df.columns, name)
    )


def top_with_ties(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The rows holding the largest value of their group, ties kept."""
    best = df.groupBy(*keys).agg(F.max(by).alias("__best"))
    return left_join(df, best, keys).filter(F.col(by) == F.col("__best")).drop("__best")


def bottom_one(df: DataFrame, keys: list[str], by: Column, tie: str) -> DataFrame:
    """One row per group: smallest ``by``, then smallest ``tie``."""
    row = F.struct(*df.columns)
    best = df.filter(by.isNotNull()).groupBy(*keys).agg(F.min_by(row, F.struct(by.alias("b"), F.col(tie).alias("t"))).alias("__row"))
    return best.select("__row.*")


def dense_index(df: DataFrame, col: str, name: str) -> DataFrame:
    """Re-index the distinct values of a column as 1, 2, ... in value order."""
    return left_join(df, rowid(df.select(col).distinct(), name, [col]), [col])


def first_seen(df: DataFrame, label: str, position: Column, name: str = "level") -> DataFrame:
    """Labels numbered by the order in which they first appear."""
    seen = df.groupBy(label).agg(F.min(position).alias("position"))
    return rowid(seen, name, ["position", label])


def rows_at(df: DataFrame, positions: list[int], order: list) -> DataFrame:
    """Rows by 1-based position in ``order``."""
    return rowid(df, "__row", order).filter(F.col("__row").isin(positions)).drop("__row")

"""Joins with the original's NULL rule (a NULL key matches a NULL key),
completion, and nearest match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masterline.plans.lineage import BROADCAST_ROWS, is_small, n_partitions, range_parts

On = list  # of "name" or ("left name", "right name")


def _pairs(on: On) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def _prepare(right: DataFrame, on: On) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Rename the right keys apart so both sides can be told from each other."""
    pairs = [(left, f"__r_{r}") for left, r in _pairs(on)]
    return right.withColumnsRenamed({r: f"__r_{r}" for _, r in _pairs(on)}), pairs


def _match(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(l).eqNullSafe(F.col(r)) for l, r in pairs])


def left_join(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """Left join on one or more keys, named alike or as (left, right) pairs."""
    right, pairs = _prepare(right, on)
    return left.join(right, _match(pairs), "left").drop(*[r for _, r in pairs])


def semi_join(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    right, pairs = _prepare(right, on)
    return left.join(right.select(*[r for _, r in pairs]), _match(pairs), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    right, pairs = _prepare(right, on)
    return left.join(right.select(*[r for _, r in pairs]), _match(pairs), "left_anti")


def full_join(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """Full outer join; a key column takes its value from whichever side has it."""
    right, pairs = _prepare(right, on)
    keys = {l: F.coalesce(F.col(l), F.col(r)) for l, r in pairs}
    joined = left.join(right, _match(pairs), "outer")
    return joined.withColumns(keys).drop(*[r for _, r in pairs])


def full_join_all(dfs: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of many tables, each with unique keys and own columns.

    One stacked aggregation, so one shuffle however many tables there are.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    values = [c for c in stacked.columns if c not in on]
    return stacked.groupBy(*on).agg(*[F.max(f"`{c}`").alias(c) for c in values])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int | None = None, how: str = "inner") -> DataFrame:
    """Join where few keys hold most of the left rows: the smaller right side
    is repeated once per salt and each left row meets one copy of it, so one
    key is worked on by up to ``salts`` tasks, by default one for each shuffle
    partition.

    The salt is a hash of the row, not a random number: a task run again after
    a lost executor sends its rows to the same places.
    """
    salts = salts or n_partitions(left.sparkSession)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", salt).join(copies, [*on, "__salt"], how).drop("__salt")


def lookup_join(left: DataFrame, table: DataFrame, on: list[str], rows: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """Join of a large table with parameters on few distinct keys: broadcast
    when counted small, otherwise salted."""
    if is_small(table, rows):
        return left.join(F.broadcast(table), on, how)
    return salted_join(left, table, on, how=how)


def expand_grid(left: DataFrame, right: DataFrame, salts: int | None = None) -> DataFrame:
    """Every left row with every row of the (smaller) right table; the product
    is the result asked for, and the salts are what it is distributed by."""
    return salted_join(left, right, [], salts)


def complete(df: DataFrame, cols: list[str], fill: dict[str, object]) -> DataFrame:
    """Add the missing combinations of the distinct values of ``cols``."""
    grid = reduce(expand_grid, [df.select(c).distinct() for c in cols])
    return left_join(grid, df, cols).fillna(fill)


def _carry(rows: DataFrame, keys: list[str], value: str, payload: Column) -> DataFrame:
    """Fill in the last payload at or before, and the first at or after, each row.

    ``rows`` is range-partitioned by (keys, value).  Windows stay inside one
    part; what crosses a part boundary comes from one summary row per part and
    key, so no key is ever gathered in one task.
    """
    # Both windows grow from the start of their order: a frame that ends at the last
    # row is worked out anew for every row, one that begins at the first is not.
    part = Window.partitionBy("__part", *keys)
    back = part.orderBy(F.asc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = part.orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edges = rows.groupBy("__part", *keys).agg(F.max(payload).alias("__hi"), F.min(payload).alias("__lo"))
    parts = Window.partitionBy(*keys)
    earlier = parts.orderBy(F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        "__part",
        *keys,
        F.max("__hi").over(earlier).alias("__prev"),
        F.min("__lo").over(later).alias("__next"),
    )
    inside = rows.withColumns({"__at_or_before": F.max(payload).over(back), "__at_or_after": F.min(payload).over(ahead)})
    right, pairs = _prepare(edges, ["__part", *keys])
    return inside.join(right, _match(pairs), "left").select(
        *[c for c in rows.columns if c != "__part"],
        F.coalesce("__at_or_before", "__prev").alias("before"),
        F.coalesce("__at_or_after", "__next").alias("after"),
    )


def neighbours(
    left: DataFrame, right: DataFrame, on: list[str], l_val: str, r_val: str, r_id: str
) -> DataFrame:
    """Each left row with the right record at or before its value (``before``)
    and at or after it (``after``), both structs of (value, id), smallest id
    first among equal values; NULL where there is none."""
    targets = left.select(*on, F.col(l_val).cast("double").alias("__v"), F.struct(*left.columns).alias("__row"))
    candidates = (
        right.filter(F.col(r_val).isNotNull())
        .groupBy(*on, F.col(r_val).cast("double").alias("__v"))
        .agg(F.min(r_id).alias("__id"))
    )
    both = targets.unionByName(candidates, allowMissingColumns=True)
    rows = range_parts(both.withColumn("__h", F.xxhash64("__row")), [*on, "__v", "__h"])
    payload = F.when(F.col("__id").isNotNull(), F.struct(F.col("__v").alias("value"), F.col("__id").alias("id")))
    found = _carry(rows, on, "__v", payload).filter(F.col("__row").isNotNull())
    return found.select("__row.*", "before", "after")


def _closest(l_val: str) -> Column:
    """The nearer of ``before`` and ``after`` (value, id), then the smaller id."""
    def scored(side: str) -> Column:
        record = F.struct(
            F.abs(F.col(f"{side}.value") - F.col(l_val)).alias("d"),
            F.col(f"{side}.id").alias("id"),
            F.col(f"{side}.value").alias("value"),
        )
        return F.when(F.col(f"{side}.id").isNotNull() & F.col(l_val).isNotNull(), record)

    return F.array_min(F.array_compact(F.array(scored("before"), scored("after"))))


def _few_neighbours(left: DataFrame, right: DataFrame, on: list[str], l_val: str, r_val: str, r_id: str) -> DataFrame:
    """As :func:`neighbours` for a handful of left values.

    The left values of a key cut the line into gaps.  A right row only needs to
    know its gap, and a gap only its two end records, so the right side is
    read once, not sorted, and shuffles as a few rows per task.
    """
    cuts = left.groupBy(*on).agg(F.sort_array(F.collect_set(F.col(l_val).cast("double"))).alias("__cuts"))
    value = F.col(r_val).cast("double")
    rows, pairs = _prepare(right.filter(value.isNotNull()).select(*on, value.alias("__v"), F.col(r_id).alias("__id")), on)
    keyed = rows.join(F.broadcast(cuts), _match(pairs)).drop(*[r for _, r in pairs])
    gap = F.expr("size(filter(__cuts, __c -> __c <= __v))")
    ends = keyed.groupBy(*on, gap.alias("__gap")).agg(
        F.expr("min(struct(__v AS value, __id AS id)) AS __lo"), F.expr("min(struct(-__v AS neg, __id AS id)) AS __hi")
    )
    at = F.expr(f"size(filter(__cuts, __c -> __c <= cast({l_val} as double))) AS __at")
    targets = left_join(left.select(*on, l_val).distinct(), cuts, on).select(*on, l_val, at)
    tails, pairs = _prepare(ends, on)
    # At most (few values) x (few gaps) rows.
    met = targets.join(F.broadcast(tails), _match(pairs), "left").groupBy(*on, l_val).agg(
        F.expr("min(if(__gap < __at, __hi, NULL)) AS hi"), F.expr("min(if(__gap >= __at, __lo, NULL)) AS after")
    )
    before = F.expr("if(hi IS NULL, NULL, struct(-hi.neg AS value, hi.id AS id)) AS before")
    return left_join(left, met.select(*on, l_val, before, "after"), [*on, l_val])


FEW = 256


def nearest_join(
    left: DataFrame, right: DataFrame, on: list[str], l_val: str, r_val: str, r_id: str, few: int = FEW
) -> DataFrame:
    """Per left row, the right row with equal keys and the smallest distance
    |r_val - l_val|; ties go to the smallest ``r_id``; no candidate gives NULLs.

    Up to ``few`` left rows (counted), the right side is scanned once;
    beyond, both sides are sorted together.  Either way only the neighbours of
    a value are compared with it, never all pairs of a key.
    """
    find = _few_neighbours if is_small(left, few) else neighbours
    near = find(left, right, on, l_val, r_val, r_id).withColumn("__best", _closest(l_val))
    return near.select(*left.columns, F.col("__best.id").alias(r_id), F.col("__best.value").alias(r_val))

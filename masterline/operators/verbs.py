"""Column selection, renaming, reshaping and nesting."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.operators.aggregates import add_count


def mutate(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns one after another, so a later one may use an earlier one."""
    for name, expr in exprs.items():
        df = df.withColumn(name, expr)
    return df


def select_cols(
    df: DataFrame,
    *names: str,
    between: tuple[str, str] | None = None,
    prefix: str | None = None,
    suffix: str | None = None,
    drop: tuple[str, ...] | list[str] = (),
) -> DataFrame:
    """Keep columns by name, positional range, prefix or suffix, in that order,
    then drop some.  With only ``drop`` given, all others are kept."""
    cols, keep = df.columns, list(names)
    if between:
        keep += cols[cols.index(between[0]) : cols.index(between[1]) + 1]
    if prefix is not None:
        keep += [c for c in cols if c.startswith(prefix)]
    if suffix is not None:
        keep += [c for c in cols if c.endswith(suffix)]
    keep = list(dict.fromkeys(keep or cols))
    return df.select([F.col(f"`{c}`") for c in keep if c not in set(drop)])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``{old: new}``; a name that is not there is an error."""
    missing = set(mapping) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumnsRenamed(mapping)


def relocate(df: DataFrame, *cols: str, after: str | None = None) -> DataFrame:
    """Move columns behind ``after``, or to the front."""
    rest = [c for c in df.columns if c not in cols]
    at = 0 if after is None else rest.index(after) + 1
    return df.select([F.col(f"`{c}`") for c in [*rest[:at], *cols, *rest[at:]]])


def across(df: DataFrame, cols: list[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in cols})


def across_type(df: DataFrame, kind: type[T.DataType], fn: Callable[[Column], Column]) -> DataFrame:
    return across(df, [f.name for f in df.schema if isinstance(f.dataType, kind)], fn)


def replace_na(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in types.items()})


def to_long(
    df: DataFrame, ids: list[str], prefix: str | None = None, name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide to long: every column but the ids, or those with a prefix."""
    cols = [c for c in df.columns if c not in ids and (prefix is None or c.startswith(prefix))]
    return df.unpivot([f"`{c}`" for c in ids], [f"`{c}`" for c in cols], name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """Long to wide in one aggregation over a given list of names.

    A cell filled twice fails the job instead of keeping one of the values.
    """
    cells = []
    for n in names:
        hit = F.col(name) == F.lit(n)
        cells.append(
            F.when(F.count_if(hit) <= 1, F.max(F.when(hit, F.col(value))))
            .otherwise(F.raise_error(F.lit(f"more than one value for column {n}")))
            .alias(str(n))
        )
    return df.groupBy(*ids).agg(*cells)


def nest(df: DataFrame, keys: list[str], cols: list[str], name: str = "data") -> DataFrame:
    """One row per key with all its records in a sorted array.

    The array is a value of one row, so this is for keys whose records fit one;
    ``nest_parts`` is for keys of any size.
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))


def nest_parts(df: DataFrame, keys: list[str], cols: list[str], parts: int, name: str = "data") -> DataFrame:
    """As :func:`nest`, with every key's records dealt out by their hash to rows
    numbered ``part``, 0 to parts - 1 (a part without records has no row)."""
    part = F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int").alias("part")
    return df.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))


def unnest(df: DataFrame, col: str) -> DataFrame:
    """Array of records back to rows; a key with no record disappears."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != col]
    return df.select(*rest, F.inline(col))


def split_regex(df: DataFrame, col: str, pattern: str, names: list[str], keep: bool = False) -> DataFrame:
    """Split a string column by the groups of a pattern matching all of it.
    A value that does not match gives NULLs."""
    if re.compile(pattern).groups != len(names):
        raise ValueError("one name per capture group is needed")
    whole = f"^(?:{pattern})$"
    hit = F.col(col).rlike(whole)
    out = df.withColumns(
        {n: F.when(hit, F.regexp_extract(col, whole, g)) for g, n in enumerate(names, start=1)}
    )
    return out if keep else out.drop(col)


INTERCEPT = "(Intercept)"


def design_columns(attrs: list[str], order: int = 2) -> dict[str, Column]:
    """Parameter name -> 0/1 product column, in intercept, main, interaction order."""
    cols = {INTERCEPT: F.lit(1)}
    for size in range(1, order + 1):
        for group in combinations(attrs, size):
            product = F.col(group[0])
            for a in group[1:]:
                product = product * F.col(a)
            cols[":".join(group)] = product.cast("int")
    return cols


def dcm_design(df: DataFrame, attrs: list[str], order: int = 2, value: str = "needed") -> DataFrame:
    """Expand 0/1 attribute columns into the parameters they switch on, long."""
    ids = [c for c in df.columns if c not in attrs]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("parameter"), c.alias(value))
            for n, c in design_columns(attrs, order).items()
        ]
    )
    return df.select(*ids, F.inline(rows)).filter(F.col(value) == 1)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns missing on one side become NULL."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def map_union(fn: Callable[[object], DataFrame], values: list) -> DataFrame:
    """Apply a table-valued function to each value and stack the results.

    Meant for a short list known on the driver; a function of a column's values
    belongs in one grouped query instead.
    """
    return union_all([fn(v) for v in values])

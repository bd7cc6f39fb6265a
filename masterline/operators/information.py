"""Relative fit: pointwise log-likelihoods, WAIC, PSIS-LOO and comparison.

Equal response patterns have equal log-likelihoods, so everything is worked
out per pattern with its count ``n``; a table without ``n`` counts each row once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masterline.operators.joins import lookup_join
from masterline.operators.patterns import Codec
from masterline.operators.verbs import union_all
from masterline.plans.draws import block_posterior, draw_blocks
from masterline.plans.lineage import cut, spread


def pointwise_loglik(patterns: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame) -> DataFrame:
    """(words.., n, ll): log-likelihood of each pattern under every draw, as an
    array in draw order.  Row-wise over the patterns, which are spread first, as
    every row is worth many draws; draws are parameters.

    Blocks of draws come one at a time; where there are several, each one's part is stored
    before the next is fetched."""
    patterns = spread(patterns, *codec.words)
    parts = []
    blocks = draw_blocks(pi, nu, codec.items)
    block = next(blocks)
    while block is not None:
        part, block = _block_loglik(patterns, codec, block), next(blocks, None)
        if block is None and not parts:
            return part
        parts.append(cut(part.withColumn("part", F.lit(len(parts)))))
    arrays = F.sort_array(F.collect_list(F.struct("part", "ll")))
    return union_all(parts).groupBy(*codec.words, "n").agg(F.flatten(arrays["ll"]).alias("ll"))


def _block_loglik(patterns: DataFrame, codec: Codec, block) -> DataFrame:
    solve = block_posterior(codec, block)
    keep = [*codec.words, "n"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, ll in solve(batch):
                ends = pa.array(np.arange(0, ll.size + 1, ll.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(ll.ravel()))
                some = batch.slice(rows.start, ll.shape[0])
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in keep], lists], [*keep, "ll"])

    schema = ", ".join(f"{c} bigint" for c in keep) + ", ll array<double>"
    return patterns.select(*keep).mapInArrow(task, schema)


def by_respondent(pointwise: DataFrame, people: DataFrame, codec: Codec, id_col: str = "resp_id") -> DataFrame:
    """(id, draw, ll): pointwise values back on respondents.  A pattern row
    is as long as the number of draws, hence the lower limit for a broadcast."""
    long = lookup_join(people, pointwise.drop("n"), codec.words, rows=10_000).select(id_col, F.posexplode("ll").alias("position", "ll"))
    return long.select(id_col, (F.col("position") + 1).alias("draw"), "ll")


def _weight(df: DataFrame) -> Column:
    return F.col("n") if "n" in df.columns else F.lit(1)


def _with_lppd(df: DataFrame) -> DataFrame:
    """Adds lppd, the log mean likelihood; the maximum is a column of its own,
    so it is found once per row and not once per draw."""
    df = df.withColumn("__top", F.expr("array_max(ll)"))
    text = "__top + ln(aggregate(ll, 0D, (a, x) -> a + exp(x - __top)) / size(ll))"
    return df.withColumn("lppd", F.expr(text)).drop("__top")


def waic_pointwise(pointwise: DataFrame) -> DataFrame:
    """Adds lppd, p (variance of the log-likelihood over draws) and elpd to
    each row.  Row-wise."""
    df = _with_lppd(pointwise).withColumn("__mean", F.expr("aggregate(ll, 0D, (a, x) -> a + x) / size(ll)"))
    df = df.withColumn("p", F.expr("aggregate(ll, 0D, (a, x) -> a + (x - __mean) * (x - __mean)) / (size(ll) - 1)"))
    return df.withColumn("elpd", F.col("lppd") - F.col("p")).drop("__mean")


def _sum_and_se(df: DataFrame, value: str) -> tuple[Column, Column]:
    """Weighted total and its standard error sqrt(N var_samp)."""
    n, x = _weight(df), F.col(value)
    count, total = F.sum(n), F.sum(n * x)
    spread = F.sum(n * x * x) - total * total / count
    return total, F.sqrt(count * F.greatest(spread, F.lit(0.0)) / (count - 1))


def waic(pointwise: DataFrame) -> DataFrame:
    """One row: elpd, its standard error, effective parameters, and -2 elpd."""
    return _criterion(waic_pointwise(pointwise), "waic")


def _criterion(rows: DataFrame, name: str) -> DataFrame:
    total, se = _sum_and_se(rows, "elpd")
    return rows.agg(
        total.alias(f"elpd_{name}"), se.alias("se"), F.sum(_weight(rows) * F.col("p")).alias(f"p_{name}")
    ).withColumn(name, -2 * F.col(f"elpd_{name}"))


def _let(**names: str) -> Callable[[str], str]:
    """SQL text with names for values used more than once: each is worked out once per row,
    which a column of its own would not assure inside a lambda."""

    def inside(body: str) -> str:
        for name, value in reversed(names.items()):
            body = f"transform(array({value}), {name} -> {body})[0]"
        return body

    return inside


def _sum(array: str, term: str) -> str:
    return f"aggregate({array}, 0D, (acc, x) -> acc + {term})"


def _log_sum(array: str) -> str:
    return _let(most=f"array_max({array})")(f"most + ln({_sum(array, 'exp(x - most)')})")


# Zhang and Stephens' estimate (k, sigma) of the generalised Pareto for the sorted positive
# excesses ``e``, n of them.
_PARETO = _let(
    n="size(e)",
    m="30 + cast(floor(sqrt(size(e))) as int)",
    b="transform(sequence(1, m), j -> (1 - sqrt(m / (j - 0.5D))) / (3 * e[greatest(n div 4 - 1, 0)]) + 1 / e[n - 1])",
    profile=f"transform(b, y -> {_sum('e', 'log1p(-y * x)')} / n)",
    fit="zip_with(b, profile, (y, k) -> n * (ln(-y / k) - k - 1))",
    most="array_max(fit)",
    weight="transform(fit, x -> exp(x - most))",
    best=f"{_sum('zip_with(b, weight, (y, w) -> y * w)', 'x')} / {_sum('weight', 'x')}",
    mean=f"{_sum('e', 'log1p(-best * x)')} / n",
)("named_struct('k', (n * mean + 5) / (n + 10), 'sigma', -mean / best)")

# Raw weights sorted (then by draw, as ties stay in order), the tail smoothed, and the
# leave-one-out density by the weights.
_PSIS = _let(
    top="-array_min(ll)",
    s="size(ll)",
    tail="cast(ceil(least(s / 5, 3 * sqrt(s))) as int)",
    raw="array_sort(transform(ll, (x, i) -> named_struct('lw', -x - top, 'i', i)))",
    fits="tail >= 5 AND tail < s",
    low="if(fits, exp(raw[s - tail - 1].lw), NULL)",
    e="if(fits, transform(slice(raw, s - tail + 1, tail), x -> exp(x.lw) - low), NULL)",
    varies="coalesce(e[0] > 0 AND e[tail - 1] > e[0] * (1 + 1e-12D), false)",
    gpd=f"if(varies, {_PARETO}, named_struct('k', if(fits, 0D, double('Infinity')), 'sigma', 0D))",
    smooth="""if(varies, transform(raw, (x, i) -> if(i < s - tail, x, named_struct('lw', least(0D, ln(low + gpd.sigma * if(abs(gpd.k) > 1e-12D,
      expm1(-gpd.k * log1p(-(i - s + tail + 0.5D) / tail)) / gpd.k, -log1p(-(i - s + tail + 0.5D) / tail)))), 'i', x.i))), raw)""",
)(f"named_struct('elpd', {_log_sum('transform(smooth, x -> x.lw + ll[x.i])')} - {_log_sum('smooth.lw')}, 'pareto_k', gpd.k)")


def psis_pointwise(pointwise: DataFrame) -> DataFrame:
    """Adds elpd (leave-one-out) and pareto_k to each row, on built-in functions in the row."""
    out = pointwise.withColumn("__loo", F.expr(_PSIS)).select("*", "__loo.elpd", "__loo.pareto_k").drop("__loo")
    return _with_lppd(out).withColumn("p", F.col("lppd") - F.col("elpd")).drop("lppd")


def psis_loo(pointwise: DataFrame) -> DataFrame:
    """One row: elpd_loo, se, p_loo, looic and the largest Pareto k."""
    rows = psis_pointwise(pointwise).select(_weight(pointwise).alias("n"), "elpd", "p", "pareto_k")
    total, se = _sum_and_se(rows, "elpd")
    return rows.agg(
        total.alias("elpd_loo"), se.alias("se"), F.sum(F.col("n") * F.col("p")).alias("p_loo"), F.max("pareto_k").alias("max_k")
    ).withColumn("loo", -2 * F.col("elpd_loo"))


def loo_compare(models: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Models ordered by elpd, with the paired difference to the best, its
    standard error, and whether the first is preferred (|diff| > 2.5 SE).

    Each table is (keys.., n, elpd) over the same patterns or respondents; they
    are brought together by one stacked aggregation, not by joins.
    """
    names = list(models)
    stacked = union_all(
        [df.select(*keys, _weight(df).alias("n"), F.lit(k).alias("k"), "elpd") for k, df in enumerate(models.values())]
    )
    wide = stacked.groupBy(*keys, "n").agg(F.array(*[F.expr(f"max(if(k = {k}, elpd, NULL))") for k in range(len(names))]).alias("e"))
    cells = wide.select("n", F.posexplode("e").alias("k", "elpd"), "e")
    # Differences to every candidate for first place: models squared columns.
    parts = [F.sum(F.col("n") * F.col("elpd")).alias("elpd"), F.sum("n").alias("count")]
    for b in range(len(names)):
        diff = f"(elpd - get(e, {b}))"
        parts += [F.expr(f"sum(n * {diff}) AS d{b}"), F.expr(f"sum(n * {diff} * {diff}) AS s{b}")]
    sums = cells.groupBy("k").agg(*parts)
    best = sums.agg(F.max_by("k", F.struct("elpd", (-F.col("k")).alias("first")))).scalar()
    pick = lambda c: F.get(F.array(*[f"{c}{b}" for b in range(len(names))]), F.col("best"))
    rows = sums.withColumn("best", best)
    rows = rows.withColumns({"elpd_diff": pick("d"), "sq": pick("s")})
    spread = F.col("sq") - F.col("elpd_diff") * F.col("elpd_diff") / F.col("count")
    rows = rows.withColumn("se_diff", F.sqrt(F.col("count") * F.greatest(spread, F.lit(0.0)) / (F.col("count") - 1)))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("k"))
    return rows.select(
        label.alias("model"), "elpd", "elpd_diff", "se_diff", (F.abs("elpd_diff") > 2.5 * F.col("se_diff")).alias("first_preferred")
    ).orderBy(F.desc("elpd"))

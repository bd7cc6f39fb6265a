"""Posterior draws of item probabilities and class proportions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.functions.hashing import PRIME, array_uniforms
from masterline.operators.joins import lookup_join
from masterline.operators.patterns import Codec
from masterline.operators.scoring import attribute_probs
from masterline.operators.sampling import merge_chains
from masterline.functions.scalar import CLIP
from masterline.plans.em import DcmFit, add_up, batch_posterior, class_groups, n_tasks, parameters_on_driver
from masterline.plans.lineage import cut, spread


class Draws(NamedTuple):
    pi: DataFrame
    nu: DataFrame


def load_draws(spark: SparkSession, pi_path: str, nu_path: str) -> Draws:
    """Stored draws with (chain, iteration) merged into one draw number."""
    return Draws(merge_chains(spark.read.parquet(pi_path)), merge_chains(spark.read.parquet(nu_path)))


class DrawBlock(NamedTuple):
    """Draws as arrays, draws x items x classes, sent along with tasks."""

    ids: np.ndarray
    pi: np.ndarray
    nu: np.ndarray


def draw_blocks(
    pi: DataFrame, nu: DataFrame, items: list[int], sums: int = 0, max_cells: int = 8_000_000
) -> Iterator[DrawBlock]:
    """Draws in blocks of at most ``max_cells`` numbers (64 MB), one at a time.

    A draw takes items x classes probabilities or, where that is more, the
    ``sums`` that a task keeps for it.  Draws are parameters and do not grow
    with the respondents; each block is fetched by its own filter when it is
    asked for.
    """
    shares = nu.select("draw", "class_id", "nu").toPandas().sort_values(["draw", "class_id"])
    ids = np.unique(shares["draw"].to_numpy())
    shares = shares["nu"].to_numpy().reshape(len(ids), -1)
    n_classes = shares.shape[1]
    step = max(1, max_cells // max(len(items) * n_classes, sums))
    for at in range(0, len(ids), step):
        part = ids[at : at + step]
        wanted = F.col("draw").between(int(part[0]), int(part[-1])) & F.col("item_id").isin(items)
        p = pi.filter(wanted).select("draw", "item_id", "class_id", "pi").toPandas()
        p = p.sort_values(["draw", "item_id", "class_id"])["pi"].to_numpy()
        yield DrawBlock(part, p.reshape(len(part), len(items), n_classes), shares[at : at + step])


#: Numbers of a task's product of patterns and a block of draws.
PRODUCT = 2_000_000


def block_posterior(codec: Codec, block: DrawBlock) -> Callable[[pa.RecordBatch], Iterator[tuple[slice, np.ndarray, np.ndarray]]]:
    """Function from a batch of patterns to (rows, weights, loglik), some rows at a time:
    weights are rows x draws x classes, loglik rows x draws.  A batch's words are unpacked
    once, and its rows meet all draws of the block in one product."""
    unpack = codec.unpacker()
    n_draws, n_items, n_classes = block.pi.shape
    cells = np.clip(block.pi, CLIP, 1 - CLIP).transpose(1, 0, 2).reshape(n_items, n_draws * n_classes)
    base = np.log1p(-cells)
    slope, log_nu = np.log(cells) - base, np.log(np.maximum(block.nu, 1e-300))
    step = max(1, PRODUCT // (n_draws * n_classes))

    def solve(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        answered, right = unpack(batch)
        for start in range(0, len(right), step):
            rows = slice(start, start + step)
            lw = (right[rows] @ slope + answered[rows] @ base).reshape(-1, n_draws, n_classes) + log_nu
            top = lw.max(axis=2, keepdims=True)
            lw -= top
            np.exp(lw, out=lw)
            s = lw.sum(axis=2, keepdims=True)
            lw /= s
            yield rows, lw, (top + np.log(s))[:, :, 0]

    return solve


def pattern_posterior(patterns: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame) -> DataFrame:
    """(words.., w): class probabilities of distinct patterns, averaged over the draws and
    stored.  Blocks of draws come one at a time, and each adds to ``w`` in a job of its own."""
    n_draws = nu.select("draw").distinct().count()
    schema = ", ".join([*[f"{c} bigint" for c in codec.words], "w array<double>"])
    out = patterns.select(*codec.words)
    for k, block in enumerate(draw_blocks(pi, nu, codec.items)):
        solve, words, first = block_posterior(codec, block), codec.words, k == 0

        def task(batches: Iterator[pa.RecordBatch], solve=solve, words=words, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                w = np.concatenate([weights.sum(axis=1) for _, weights, _ in solve(batch)]) / n_draws
                if not first:
                    w += batch.column("w").flatten().to_numpy().reshape(w.shape)
                ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in words], lists], [*words, "w"])

        out = cut(out.mapInArrow(task, schema))
    return out


def draw_posterior(patterns: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame) -> DataFrame:
    """(words.., draw, w): class probabilities of distinct patterns under each draw, stored
    block by block."""
    patterns = spread(patterns.select(*codec.words), *codec.words)
    words, out = codec.words, []
    schema = ", ".join([*[f"{c} bigint" for c in words], "draw int, w array<double>"])
    for block in draw_blocks(pi, nu, codec.items):
        solve, ids = block_posterior(codec, block), pa.array(block.ids, pa.int32())

        def task(batches: Iterator[pa.RecordBatch], solve=solve, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, weights, _ in solve(batch):
                    some, (n, n_draws, n_classes) = batch.slice(rows.start, len(weights)), weights.shape
                    at = np.repeat(np.arange(n), n_draws)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, weights.size + 1, n_classes), pa.int32()), pa.array(weights.ravel()))
                    columns = [some.column(c).take(pa.array(at)) for c in words]
                    yield pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(np.tile(np.arange(n_draws), n))), lists], [*words, "draw", "w"])

        out.append(cut(patterns.mapInArrow(task, schema)))
    return reduce(DataFrame.union, out)


def mean_posterior(people: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame, n_attr: int) -> DataFrame:
    """(other columns.., w, p): class and attribute probabilities of encoded
    respondents, averaged over the draws.

    Only distinct patterns meet the draws; respondents find theirs by its words.
    """
    keep = [f"`{c}`" for c in people.columns if c not in codec.words]
    patterns = spread(people.select(*codec.words).distinct(), *codec.words)
    post = pattern_posterior(patterns, codec, pi, nu).withColumn("p", attribute_probs("w", n_attr))
    return lookup_join(people, post, codec.words).select(*keep, "w", "p")


class ScoreInfo(NamedTuple):
    """Sum of scores and of their outer products, and the parameter layout."""

    mean: np.ndarray
    info: np.ndarray
    groups: list[np.ndarray]
    offsets: list[int]


def score_information(fit: DcmFit, patterns: DataFrame) -> ScoreInfo:
    """First and second moments of the respondents' scores, summed in Spark.

    Parameters are the logits of each item's group probabilities and
    ln(nu_c / nu_0).  Every task adds up its own outer products, so what is
    shuffled is parameters squared per task.
    """
    codec = Codec(list(fit.q_masks))
    pi, nu = parameters_on_driver(fit.pi, fit.nu, codec)
    groups = []
    for mask in fit.q_masks.values():
        _, dense = np.unique(class_groups(fit.model, mask, fit.n_attr), return_inverse=True)
        groups.append(dense)
    members = [np.eye(g.max() + 1)[g] for g in groups]
    offsets = np.cumsum([0, *[m.shape[1] for m in members]]).tolist()
    size = offsets[-1] + len(nu) - 1
    probs = [np.array([row[g == k][0] for k in range(g.max() + 1)]) for row, g in zip(pi, groups)]
    posterior = batch_posterior(codec, pi, np.log(np.maximum(nu, 1e-300)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            answered, right, w, _ = posterior(batch)
            n = batch.column("n").to_numpy().astype(float)
            parts = [
                (w @ m) * (answered[:, [i]] * (right[:, [i]] - p)) for i, (m, p) in enumerate(zip(members, probs))
            ]
            s = np.hstack([*parts, w[:, 1:] - nu[1:]])
            first += n @ s
            second += s.T @ (s * n[:, None])
        cells = np.r_[first, second.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size), pa.int32()), pa.array(cells)], ["cell", "v"])

    (cells,) = add_up(patterns.mapInArrow(task, "cell int, v double"), ["v"], size + size * size, n_tasks(patterns))
    return ScoreInfo(cells[:size], cells[size:].reshape(size, size), groups, offsets)


DRAWS_PER_TASK = 64


def normal_draws(spark: SparkSession, at: np.ndarray, root: np.ndarray, n: int, salt: int, names: str, rows_of: Callable) -> DataFrame:
    """Draws 1..n of a normal vector with mean ``at`` and precision ``root`` root', made in tasks.

    The standard normal of (draw, parameter) is a hash of the two and the salt, as
    :func:`masterline.functions.hashing.normal`, so a task that is run again makes the
    same draws.  A task takes some draws, solves root' x = z by back substitution and
    returns ``rows_of(draws, x)``, a batch with the columns ``names``; x has a column
    per draw.  The triangular factor travels by broadcast: parameters squared numbers.
    """
    factor = spark.sparkContext.broadcast((np.ascontiguousarray(at), np.ascontiguousarray(root)))
    prime, uniforms = PRIME, array_uniforms()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = factor.value
        k = np.arange(len(at), dtype=np.int64)[:, None]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start in range(0, len(ids), DRAWS_PER_TASK):
                some = ids[start : start + DRAWS_PER_TASK]
                first = np.maximum(uniforms(some[None, :], k, salt), 1.0 / prime)
                x = np.sqrt(-2 * np.log(first)) * np.cos(2 * np.pi * uniforms(some[None, :], k, salt + 1))
                for i in range(len(at) - 1, -1, -1):
                    x[i] = (x[i] - root[i + 1 :, i] @ x[i + 1 :]) / root[i, i]
                yield rows_of(some, at[:, None] + x)

    return spark.range(1, n + 1, numPartitions=max(1, -(-n // DRAWS_PER_TASK))).mapInArrow(task, names)


def approx_draws(fit: DcmFit, patterns: DataFrame, n: int, salt: int, ridge: float = 1e-3) -> Draws:
    """n draws from the normal approximation at the estimate.

    Its precision is the ridged outer-product information; the square root of
    a parameters x parameters matrix is taken on the driver, the draws are made in
    tasks and stored: no draw passes through the driver.
    """
    spark = patterns.sparkSession
    moments = score_information(fit, patterns)
    codec = Codec(list(fit.q_masks))
    pi, nu = parameters_on_driver(fit.pi, fit.nu, codec)
    lam = np.concatenate([np.array([row[g == k][0] for k in range(g.max() + 1)]) for row, g in zip(pi, moments.groups)])
    nu = np.maximum(nu, 1e-300)
    at = np.r_[np.log(lam / (1 - lam)), np.log(nu[1:] / nu[0])]
    root = np.linalg.cholesky(moments.info + ridge * np.eye(len(at)))
    items, n_lam, n_classes = codec.items, len(lam), len(nu)
    # Where in x an item's class finds its log-odds.
    cells = np.stack([o + g for o, g in zip(moments.offsets, moments.groups)])

    def rows_of(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        prob = 1 / (1 + np.exp(-x[:n_lam]))[cells]  # items x classes x draws
        share = np.exp(np.vstack([np.zeros(len(ids)), x[n_lam:]]) - np.maximum(x[n_lam:].max(axis=0, initial=0), 0))
        share = share / share.sum(axis=0)
        lists = np.concatenate([prob, share[None]]).transpose(2, 0, 1).ravel()
        ends = pa.array(np.arange(0, len(lists) + 1, n_classes), pa.int32())
        columns = [
            pa.array(np.repeat(ids, len(items) + 1), pa.int32()),
            pa.array([*items, None] * len(ids), pa.int32()),
            pa.ListArray.from_arrays(ends, pa.array(lists)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["draw", "item_id", "p"])

    # One row per draw and item, and one without item for the class proportions.
    rows = cut(normal_draws(spark, at, root, n, salt, "draw int, item_id int, p array<double>", rows_of))
    return Draws(
        rows.where("item_id IS NOT NULL").select("draw", "item_id", F.posexplode("p").alias("class_id", "pi")),
        rows.where("item_id IS NULL").select("draw", F.posexplode("p").alias("class_id", "nu")),
    )

"""Marginal maximum likelihood by EM over counted response patterns.

The patterns are aggregated once and checkpointed.  An iteration is one Spark
job over them: each task turns its patterns into posterior class weights with
two matrix products and returns its expected counts, items x nodes numbers,
which Spark adds up.  Only those sums reach the driver, where the M-step is a
few operations per item; new parameters travel with the next job's tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.functions.scalar import CLIP
from masterline.operators.patterns import Codec
from masterline.operators.scoring import ID, attribute_probs
from masterline.plans.lineage import cut


#: Iterations after which a fit that has not converged is given up as an error.
GIVE_UP, NEWTON_STEPS = 5000, 200
#: A fall of the log-likelihood by more than this share of it isn't rounding.
ROUNDING = 1e-11


class DcmFit(NamedTuple):
    """``loglik`` is that of ``pi`` and ``nu`` if ``converged``; a fit stopped by
    ``max_iter`` has taken one more M-step since.  ``n_iter`` counts E-steps, each a
    Spark job; ``history`` has the log-likelihoods of the points kept."""

    pi: DataFrame
    nu: DataFrame
    loglik: float
    n_iter: int
    history: list[float]
    model: str
    q_masks: dict[int, int]
    n_attr: int
    converged: bool = True


class Irt2plFit(NamedTuple):
    items: DataFrame
    loglik: float
    n_iter: int
    history: list[float]
    converged: bool = True


PATTERNS_PER_TASK = 50_000


def pattern_table(resp: DataFrame, codec: Codec, id_col: str = ID) -> DataFrame:
    """Distinct patterns with counts, from long responses or encoded ones,
    checkpointed: later iterations never go back to the responses.  The number of tasks follows the number of patterns,
    so a short table is not scattered and a long one is not lumped."""
    encoded = resp if set(codec.words) <= set(resp.columns) else codec.encode(resp, id_col)
    stored = cut(codec.count(encoded))
    tasks = max(1, -(-stored.count() // PATTERNS_PER_TASK))
    if tasks <= n_tasks(stored):
        return stored.coalesce(tasks)
    return cut(stored.repartition(tasks, *codec.words))


def batch_posterior(
    codec: Codec, pi: np.ndarray, log_nu: np.ndarray
) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Function from a batch of patterns to (answered, right, weights, loglik)."""
    unpack = codec.unpacker()
    lp, lq = np.log(np.clip(pi, CLIP, 1 - CLIP)), np.log1p(-np.clip(pi, CLIP, 1 - CLIP))

    def solve(batch: pa.RecordBatch):
        answered, right = unpack(batch)
        lw = right @ (lp - lq) + answered @ lq + log_nu
        top = lw.max(axis=1, keepdims=True)
        e = np.exp(lw - top)
        s = e.sum(axis=1, keepdims=True)
        return answered, right, e / s, (top + np.log(s))[:, 0]

    return solve


def posterior_encoded(people: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame, n_attr: int) -> DataFrame:
    """(other columns.., w, p, loglik) of encoded respondents or patterns.

    Row by row: with words made from a wide table, scoring is one scan.
    """
    keep = [f for f in people.schema.fields if f.name not in codec.words]
    cells, shares = parameters_on_driver(pi, nu, codec)
    posterior = batch_posterior(codec, cells, np.log(np.maximum(shares, 1e-300)))
    names = [f.name for f in keep]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, w, loglik = posterior(batch)
            ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists, pa.array(loglik)], [*names, "w", "loglik"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "w array<double>", "loglik double"])
    post = people.mapInArrow(task, schema)
    return post.select(*[f"`{c}`" for c in names], "w", attribute_probs("w", n_attr).alias("p"), "loglik")


COUNTS = "cell int, total double, right double"
DIRECT_CELLS = 1_000_000


def add_up(parts: DataFrame, columns: list[str], n_cells: int, tasks: int) -> list[np.ndarray]:
    """Sum the tasks' (cell, value..) vectors of parameter size.

    Few tasks times few cells: fetched as they are and added here, which saves
    a stage per iteration.  Beyond a million numbers Spark adds them first.
    """
    if tasks * n_cells > DIRECT_CELLS:
        parts = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in columns])
    got = parts.toArrow()
    cells = got["cell"].to_numpy()
    return [np.bincount(cells, weights=got[c].to_numpy(), minlength=n_cells) for c in columns]


def n_tasks(patterns: DataFrame) -> int:
    """Tasks of a job over a stored pattern table."""
    return patterns.rdd.getNumPartitions()


def expected_counts(
    patterns: DataFrame, codec: Codec, pi: np.ndarray, log_nu: np.ndarray, tasks: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """E-step: (respondents by item and node, right answers by item and node,
    respondents by node, log-likelihood)."""
    n_items, n_nodes = pi.shape
    posterior = batch_posterior(codec, pi, log_nu)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, right = np.zeros((n_items + 2, n_nodes)), np.zeros((n_items + 2, n_nodes))
        for batch in batches:
            a, x, w, loglik = posterior(batch)
            n = batch.column("n").to_numpy().astype(float)
            w *= n[:, None]
            total[:n_items] += a.T @ w
            right[:n_items] += x.T @ w
            total[n_items] += w.sum(axis=0)
            total[n_items + 1, 0] += n @ loglik
        cells = pa.array(np.arange(total.size), pa.int32())
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel()), pa.array(right.ravel())], ["cell", "total", "right"])

    sums = add_up(patterns.mapInArrow(task, COUNTS), ["total", "right"], (n_items + 2) * n_nodes, tasks)
    total, right = (v.reshape(n_items + 2, n_nodes) for v in sums)
    return total[:n_items], right[:n_items], total[n_items], float(total[n_items + 1, 0])


def class_groups(model: str, q_mask: int, n_attr: int) -> np.ndarray:
    """The class groups an item tells apart, as a group number per class."""
    held = np.arange(2**n_attr) & q_mask
    if model == "dina":
        return (held == q_mask).astype(int)
    if model == "dino":
        return (held != 0).astype(int)
    return held


def model_start(model: str, q_masks: list[int], n_attr: int) -> np.ndarray:
    """.2 + .6 * share held: monotone, so attributes keep their labels."""
    if model in ("dina", "dino"):
        return np.array([0.2 + 0.6 * class_groups(model, m, n_attr) for m in q_masks])
    held = np.array([[(c & m).bit_count() for c in range(2**n_attr)] for m in q_masks])
    return 0.2 + 0.6 * held / np.array([m.bit_count() for m in q_masks])[:, None]


def grouped_ratio(total: np.ndarray, right: np.ndarray, groups: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Closed-form M-step of one item: the same ratio for classes of a group."""
    t, r = np.bincount(groups, total)[groups], np.bincount(groups, right)[groups]
    return np.where(t > 0, r / np.where(t > 0, t, 1.0), old)


def main_effects(total: np.ndarray, right: np.ndarray, q_mask: int, n_attr: int) -> np.ndarray:
    """M-step of one item without interactions: binomial regression of its
    expected counts on the attributes it measures, by Newton's method."""
    classes = np.arange(2**n_attr)
    bits = [k for k in range(n_attr) if q_mask >> k & 1]
    x = np.column_stack([np.ones(len(classes)), *[(classes >> k) & 1 for k in bits]])
    mean = np.clip(right.sum() / max(total.sum(), 1e-12), 0.01, 0.99)
    beta = np.r_[np.log(mean / (1 - mean)), np.zeros(len(bits))]
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-x @ beta))
        info = (x * (total * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(len(beta))
        slope = x.T @ (right - total * p)
        move = np.clip(np.linalg.solve(info, slope), -2, 2)
        beta = beta + move
        # What the step can gain is the measure: near 0 and 1 the effects move on
        # by rounding alone.
        if abs(move @ slope) < 1e-12 * max(1.0, total.sum()) or np.abs(move).max() < 1e-10:
            return 1 / (1 + np.exp(-x @ beta))
    raise ArithmeticError(f"no maximum for an item's main effects in {NEWTON_STEPS} steps")


def q_masks_of(q: DataFrame) -> dict[int, int]:
    return {r.item_id: r.q_mask for r in q.select("item_id", "q_mask").orderBy("item_id").collect()}


class Climb(NamedTuple):
    point: tuple[np.ndarray, ...]
    value: float
    history: list[float]
    jobs: int
    converged: bool


def climb(
    step: Callable[..., tuple[float, tuple[np.ndarray, ...]]],
    start: tuple[np.ndarray, ...],
    flat: Callable[..., np.ndarray],
    back: Callable[[np.ndarray], tuple[np.ndarray, ...]],
    tol: float,
    step_tol: float | None = None,
    max_iter: int | None = None,
    accelerate: bool = True,
    halve: bool = False,
) -> Climb:
    """Repeat ``step``, which takes a point to its value and to the next point, until a
    step gains less than ``tol`` and, where given, moves nothing by more than ``step_tol``.

    Each step is a Spark job, so after every two of them the point is thrown on by
    squared extrapolation along their difference, in the coordinates of ``flat`` and
    ``back``; it stays there only if the value is no lower, and is thrown less far after
    a failure.  A step that lowers the value is an error, unless ``halve`` says that steps
    are only directions: then it is halved.  Getting nowhere in ``GIVE_UP`` steps is an
    error too; ``max_iter`` stops earlier.
    """
    value, ahead = step(*start)
    point, history, jobs, reach = start, [value], 1, 1.0
    while jobs < (max_iter or GIVE_UP):
        after, beyond = step(*ahead)
        jobs += 1
        if halve and after < value and np.abs(flat(*ahead) - flat(*point)).max() > 1e-9:
            ahead = back((flat(*point) + flat(*ahead)) / 2)
            continue
        if after < value - ROUNDING * max(1.0, abs(value)):
            raise ArithmeticError(f"the log-likelihood fell from {value!r} to {after!r}")
        history.append(after)
        here, there = flat(*point), flat(*ahead)
        small = step_tol is None or np.abs(there - here).max() < step_tol
        if after - value < tol and small:
            return Climb(ahead, after, history, jobs, True)
        if accelerate and jobs < (max_iter or GIVE_UP):
            first = there - here
            turn = flat(*beyond) - there - first
            length = np.clip(np.linalg.norm(first) / max(np.linalg.norm(turn), 1e-300), 1.0, reach)
            thrown = back(here + 2 * length * first + length * length * turn) if length > 1 else beyond
            landed, next_one = step(*thrown)
            jobs += 1
            if length == reach:
                reach *= 4
            if landed >= after:
                point, value, ahead = thrown, landed, next_one
                history.append(landed)
                continue
            reach = max(1.0, reach / 8)
        point, value, ahead = ahead, after, beyond
    if max_iter is None:
        raise ArithmeticError(f"no convergence in {GIVE_UP} iterations")
    return Climb(ahead, value, history, jobs, False)


def _coordinates(model: str, shape: tuple[int, int]) -> tuple[Callable, Callable]:
    """Between (pi, nu) and one vector: as they are, where classes of a group share a
    probability; on the logit scale, where main effects add."""
    cells = shape[0] * shape[1]
    additive = model == "crum"

    def flat(pi: np.ndarray, nu: np.ndarray) -> np.ndarray:
        return np.r_[np.log(pi / (1 - pi)).ravel() if additive else pi.ravel(), nu]

    def back(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi, nu = x[:cells].reshape(shape), np.maximum(x[cells:], 1e-12)
        pi = 1 / (1 + np.exp(-np.clip(pi, -700, 700))) if additive else pi
        return np.clip(pi, CLIP, 1 - CLIP), nu / nu.sum()

    return flat, back


def fit_dcm(
    resp: DataFrame,
    q: DataFrame,
    n_attr: int,
    model: str = "lcdm",
    tol: float = 1e-6,
    max_iter: int | None = None,
    patterns: DataFrame | None = None,
    step_tol: float | None = None,
    accelerate: bool = True,
    id_col: str = ID,
) -> DcmFit:
    """Estimate class proportions and item probabilities.

    Stops when an EM step raises the log-likelihood by less than ``tol`` and, where
    given, moves no parameter by more than ``step_tol``; not getting there in
    ``GIVE_UP`` E-steps is an error, as is a fall of the log-likelihood.  ``max_iter``
    stops earlier, with ``converged`` false.  ``accelerate`` as in :func:`climb`.
    """
    spark = resp.sparkSession
    q_masks = q_masks_of(q)
    codec, masks = Codec(list(q_masks)), list(q_masks.values())
    patterns = pattern_table(resp, codec, id_col) if patterns is None else patterns
    tasks = n_tasks(patterns)
    groups = [class_groups(model, m, n_attr) for m in masks]

    def step(pi: np.ndarray, nu: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
        total, right, mass, loglik = expected_counts(patterns, codec, pi, np.log(np.maximum(nu, 1e-300)), tasks)
        if model == "crum":
            pi = np.array([main_effects(t, r, m, n_attr) for t, r, m in zip(total, right, masks)])
        else:
            pi = np.array([grouped_ratio(*row) for row in zip(total, right, groups, pi)])
        return loglik, (np.clip(pi, CLIP, 1 - CLIP), mass / mass.sum())

    start = model_start(model, masks, n_attr), np.full(2**n_attr, 0.5**n_attr)
    got = climb(step, start, *_coordinates(model, start[0].shape), tol, step_tol, max_iter, accelerate)
    tables = pi_table(spark, codec.items, got.point[0]), nu_table(spark, got.point[1])
    return DcmFit(*tables, got.value, got.jobs, got.history, model, q_masks, n_attr, got.converged)


def pi_table(spark: SparkSession, items: list[int], pi: np.ndarray) -> DataFrame:
    table = {
        "item_id": pa.array(np.repeat(items, pi.shape[1]), pa.int32()),
        "class_id": pa.array(np.tile(np.arange(pi.shape[1]), len(items)), pa.int32()),
        "pi": pa.array(pi.ravel()),
    }
    return spark.createDataFrame(pa.table(table))


def nu_table(spark: SparkSession, nu: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"class_id": pa.array(np.arange(len(nu)), pa.int32()), "nu": pa.array(nu)}))


def parameters_on_driver(pi: DataFrame, nu: DataFrame, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """Items x classes probabilities and class proportions as arrays."""
    cells = pi.select("item_id", "class_id", "pi").toPandas().pivot(index="item_id", columns="class_id", values="pi")
    shares = nu.select("class_id", "nu").toPandas().sort_values("class_id")["nu"].to_numpy()
    return cells.loc[codec.items].to_numpy(), shares


NODES = np.linspace(-6.0, 6.0, 61)


def node_log_weights() -> np.ndarray:
    """Log of a standard normal on the quadrature nodes, summing to one."""
    lw = -0.5 * NODES**2
    return lw - np.log(np.exp(lw).sum())


#: Points of the quadrature about each pattern's mode, and numbers of a task's array of
#: patterns x points x items.
POINTS, CUBE = 21, 1_000_000


def curve_sums(patterns: DataFrame, codec: Codec, a: np.ndarray, d: np.ndarray, tasks: int, points: int = POINTS) -> tuple[np.ndarray, float]:
    """Of two-parameter curves: by item the sums e theta, e, v theta^2, v theta and v over the posterior of
    ability, with e = answer - p and v = p (1 - p), and the log-likelihood.

    Each pattern's integral takes Gauss-Hermite points about the mode of its own posterior, as
    wide as the curvature there says, so a long form, whose posteriors are narrow, needs
    no more points than a short one.
    """
    unpack, n_items = codec.unpacker(), len(codec.items)
    x_gh, w_gh = np.polynomial.hermite.hermgauss(points)
    rows_at_once = max(1, CUBE // (points * max(1, n_items)))

    def sums_of(answered: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        mode = np.zeros(len(right))
        for _ in range(50):  # the posterior is log-concave; steps of one at most cannot run away
            p = 1 / (1 + np.exp(-(mode[:, None] * a + d)))
            slope = ((right - answered * p) * a).sum(axis=1) - mode
            curve = (answered * p * (1 - p) * a * a).sum(axis=1) + 1
            move = np.clip(slope / curve, -1, 1)
            mode += move
            if np.abs(move).max() < 1e-10:
                break
        width = np.sqrt(2 / curve)
        theta = mode[:, None] + width[:, None] * x_gh
        z = theta[:, :, None] * a + d
        soft = np.logaddexp(0, z)
        joint = (z * right[:, None, :] - soft * answered[:, None, :]).sum(axis=2) - theta * theta / 2
        joint += np.log(w_gh) + x_gh * x_gh + np.log(width / np.sqrt(2 * np.pi))[:, None]
        top = joint.max(axis=1, keepdims=True)
        w = np.exp(joint - top)
        total = w.sum(axis=1, keepdims=True)
        w *= n[:, None] / total
        p = np.exp(z - soft)
        e = right[:, None, :] - answered[:, None, :] * p
        v = answered[:, None, :] * p * (1 - p)
        wt = w * theta
        return np.stack(
            [
                np.einsum("pq,pqi->i", wt, e),
                np.einsum("pq,pqi->i", w, e),
                np.einsum("pq,pqi->i", wt * theta, v),
                np.einsum("pq,pqi->i", wt, v),
                np.einsum("pq,pqi->i", w, v),
            ]
        ), float(n @ (top + np.log(total))[:, 0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loglik = np.zeros((5, n_items)), 0.0
        for batch in batches:
            answered, right = unpack(batch)
            n = batch.column("n").to_numpy().astype(float)
            for start in range(0, len(n), rows_at_once):
                some = slice(start, start + rows_at_once)
                one, ll = sums_of(answered[some], right[some], n[some])
                sums, loglik = sums + one, loglik + ll
        cells = np.r_[sums.ravel(), loglik]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size), pa.int32()), pa.array(cells)], ["cell", "v"])

    (cells,) = add_up(patterns.mapInArrow(task, "cell int, v double"), ["v"], 5 * n_items + 1, tasks)
    return cells[:-1].reshape(5, n_items), float(cells[-1])


def curve_step(sums: np.ndarray, a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One scoring step for every curve on (log slope, intercept), with slopes lognormal(0, 1)
    and intercepts normal(0, 2) beforehand; the log kernel of a = e^s is -s^2/2 - s."""
    e_theta, e, v_theta2, v_theta, v = sums
    s = np.log(a)
    grad_s, grad_d = a * e_theta - s - 1, e - d / 4
    ss, sd, dd = a * a * v_theta2 + 1, a * v_theta, v + 0.25
    det = ss * dd - sd * sd
    return np.exp(s + np.clip((dd * grad_s - sd * grad_d) / det, -1, 1)), d + np.clip((ss * grad_d - sd * grad_s) / det, -2, 2)


def fit_2pl(
    resp: DataFrame,
    items: list[int],
    tol: float = 1e-4,
    max_iter: int | None = None,
    accelerate: bool = True,
    id_col: str = ID,
    points: int = POINTS,
) -> Irt2plFit:
    """Two-parameter curves, logit = a * theta + d, theta ~ N(0, 1), by marginal maximum
    likelihood with quadrature about each pattern's mode.  A step is one pass over the
    patterns; ``history`` is the penalised log-likelihood.  ``tol``, ``max_iter``,
    ``accelerate`` and ``converged`` as in :func:`fit_dcm`."""
    spark = resp.sparkSession
    codec = Codec(sorted(items))
    patterns = pattern_table(resp, codec, id_col)
    tasks = n_tasks(patterns)

    def step(a: np.ndarray, d: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
        sums, loglik = curve_sums(patterns, codec, a, d, tasks, points)
        return float(loglik + (-np.log(a) ** 2 / 2 - np.log(a) - d**2 / 8).sum()), curve_step(sums, a, d)

    n = len(codec.items)
    start = np.ones(n), np.zeros(n)
    got = climb(step, start, lambda a, d: np.r_[np.log(a), d], lambda x: (np.exp(x[:n]), x[n:]), tol, None, max_iter, accelerate, halve=True)
    a, d = got.point
    table = pa.table({"item_id": pa.array(codec.items, pa.int32()), "a": pa.array(a), "d": pa.array(d)})
    return Irt2plFit(spark.createDataFrame(table), got.value, got.jobs, got.history, got.converged)

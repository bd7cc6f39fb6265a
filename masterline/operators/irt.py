"""Two-parameter item curves, grid scores and factor scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masterline.functions.scalar import CLIP, inv_logit
from masterline.operators.patterns import Codec
from masterline.plans.em import NODES, node_log_weights
from masterline.sources.grid import n_points, with_axis


def icc_grid(items: DataFrame, lo: float = -3.0, hi: float = 3.0, step: float = 0.01) -> DataFrame:
    """(item.., node, theta, log_odds, prob_1, prob_0): every item's curve over
    the grid.  The grid is exploded next to each item: no join, no shuffle."""
    points = with_axis(items, n_points(lo, hi, step), "node")
    points = points.withColumn("theta", lo + F.col("node") * step)
    points = points.withColumn("log_odds", F.col("a") * (F.col("theta") - F.col("b")))
    points = points.withColumn("prob_1", inv_logit(F.col("log_odds")))
    return points.withColumn("prob_0", 1.0 - F.col("prob_1"))


def _score_encoded(people: DataFrame, codec: Codec, prob: np.ndarray, pick: Callable, schema: str) -> DataFrame:
    """Row by row over encoded respondents: log-likelihood at every node by two
    matrix products, of which ``pick`` keeps what is asked for."""
    unpack = codec.unpacker()
    p = np.clip(prob, CLIP, 1 - CLIP)
    slope, base = np.log(p) - np.log1p(-p), np.log1p(-p)
    keep = [f for f in people.schema.fields if f.name not in codec.words]
    names = [f.name for f in keep]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answered, right = unpack(batch)
            found = pick(right @ slope + answered @ base)
            columns = [*[batch.column(c) for c in names], *[pa.array(v) for v in found.values()]]
            yield pa.RecordBatch.from_arrays(columns, [*names, *found])

    return people.mapInArrow(task, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], schema]))


def _curves_on_driver(curves: DataFrame, *columns: str) -> tuple[Codec, list[np.ndarray]]:
    """The test's curves, one row per item, as arrays in order of the items."""
    rows = curves.select("item_id", *columns).orderBy("item_id").collect()
    return Codec([r.item_id for r in rows]), [np.array([r[c] for r in rows], float)[:, None] for c in columns]


def theta_grid_score(resp: DataFrame, curves: DataFrame, keys: list[str], lo: float = -3.0, hi: float = 3.0, step: float = 0.01) -> DataFrame:
    """(keys.., theta, likelihood): the grid point where the product of a
    respondent's item curves peaks, the first one when tied.

    ``curves`` is (item_id, a, b).  Answers are shuffled once, as one short row
    of bit words per respondent; a respondent without an answer gets the first
    point and likelihood 1.
    """
    codec, (a, b) = _curves_on_driver(curves, "a", "b")
    theta = lo + np.arange(n_points(lo, hi, step)) * step

    def pick(ll):
        # Peaks closer than rounding are one; the first of them is taken.
        at = (ll >= ll.max(axis=1, keepdims=True) - 1e-13).argmax(axis=1)
        return {"theta": theta[at], "likelihood": np.exp(ll.max(axis=1))}

    prob = 1 / (1 + np.exp(-a * (theta - b)))
    return _score_encoded(codec.encode(resp, *keys), codec, prob, pick, "theta double, likelihood double")


def eap_theta(resp: DataFrame, items: DataFrame, id_col: str = "resp_id") -> DataFrame:
    """(id, theta): posterior mean ability under curves (item_id, a, d),
    logit = a theta + d, and a standard normal prior on 61 nodes; a respondent
    without an answer gets the prior's mean."""
    codec, (a, d) = _curves_on_driver(items, "a", "d")
    nodes, weights = NODES, node_log_weights()

    def pick(ll):
        lw = ll + weights
        w = np.exp(lw - lw.max(axis=1, keepdims=True))
        return {"theta": w @ nodes / w.sum(axis=1)}

    return _score_encoded(codec.encode(resp, id_col), codec, 1 / (1 + np.exp(-(a * nodes + d))), pick, "theta double")

"""M2: fit to the first- and second-order margins of the responses.

Spark reduces the respondents to one number per item pair; what is left is
algebra on the test form, done on the driver in arrays of items x classes squared.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masterline.operators.patterns import Codec
from masterline.operators.ppmc import pair_counts
from masterline.plans.em import class_groups, parameters_on_driver


class M2Fit(NamedTuple):
    m2: float
    df: int
    p_value: float
    rmsea: float
    srmsr: float
    acceptable: bool


def pair_margins(patterns: DataFrame, codec: Codec) -> DataFrame:
    """(item_i, item_j, n, p_i, p_j, p_ij) over respondents who answered both."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    counts = pair_counts(patterns, codec).withColumn("n", n).filter("n > 0")
    return counts.selectExpr(
        "item_i", "item_j", "n", "(n11 + n10) / n AS p_i", "(n11 + n01) / n AS p_j", "n11 / n AS p_ij"
    )


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail by the incomplete gamma function: its series below the mean,
    its continued fraction above."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _gram(p: np.ndarray, share: np.ndarray, groups: list[np.ndarray], first: np.ndarray, second: np.ndarray):
    """Inner products, weighted by the inverse of the margins' diagonal variances, of
    everything M2 is made of: (products, n_factors, n_parameters); the last column is the residual.

    Given the class, items are independent.  With every pair's margin taken less
    alpha_ij x_i + alpha_ji x_j, its best prediction from the two items within classes,
    single margins are uncorrelated with pairs, and two pairs only meet through an item they
    share.  The covariance is then a diagonal, plus for each item one factor per
    class over the pairs that hold it, plus one factor per class over all margins.  An item's
    factors and parameters are columns that are zero off the item's own margins, so
    two items' columns meet in one margin, that of their pair.
    """
    n_items, n_classes = p.shape
    v = p * (1 - p)
    single = v @ share
    pair = (v * share) @ v.T
    if single.min() <= 0 or pair.min() <= 0:
        raise ArithmeticError("a margin without variance: probabilities of 0 or 1")
    weight = 1 / pair
    np.fill_diagonal(weight, 0)
    alpha = (v * share) @ p.T / single[:, None]
    left = p[None, :, :] - alpha[:, :, None]  # of item i's effect on pair (i, j), by class
    width = max(len(np.unique(g)) for g in groups)
    own = np.zeros((n_items, n_items, n_classes + width))
    own_single = np.zeros((n_items, n_classes + width))
    own[:, :, :n_classes] = np.sqrt(share * v)[:, None, :] * left
    used = np.zeros((n_items, n_classes + width), bool)
    used[:, :n_classes] = True
    for i, g in enumerate(groups):
        for k, value in enumerate(np.unique(g)):
            member = (g == value) * share
            own[i, :, n_classes + k] = left[i] @ member
            own_single[i, n_classes + k] = member.sum()
            used[i, n_classes + k] = True
    mean = p[:, None, :] * p[None, :, :] - alpha[:, :, None] * p[:, None, :] - alpha.T[:, :, None] * p[None, :, :]
    gap = first - p @ share
    gap_pair = second - (p * share) @ p.T - alpha * gap[:, None] - alpha.T * gap[None, :]
    root = np.sqrt(share)
    shared_pair = np.concatenate([root * (mean - (mean @ share)[:, :, None]), mean[:, :, 1:] - mean[:, :, :1], gap_pair[:, :, None]], axis=2)
    shared_single = np.concatenate([root * (p - (p @ share)[:, None]), p[:, 1:] - p[:, :1], gap[:, None]], axis=1)
    weighted = weight[:, :, None] * own
    between = np.einsum("ijm,jin->imjn", weighted, own)
    at = np.arange(n_items)
    between[at, :, at, :] = weighted.transpose(0, 2, 1) @ own + own_single[:, :, None] * (own_single / single[:, None])[:, None, :]
    across = weighted.transpose(0, 2, 1) @ shared_pair + own_single[:, :, None] * (shared_single / single[:, None])[:, None, :]
    rest = np.einsum("ijk,ijl->kl", weight[:, :, None] * shared_pair, shared_pair) / 2 + shared_single.T @ (shared_single / single[:, None])
    columns = np.flatnonzero(used.ravel())
    between = between.reshape(used.size, used.size)[np.ix_(columns, columns)]
    across = across.reshape(used.size, -1)[columns]
    # Factors first, then parameters, then the residual.
    factor = np.r_[(columns % (n_classes + width)) < n_classes, np.ones(n_classes, bool), np.zeros(n_classes, bool)]
    order = np.r_[np.flatnonzero(factor), np.flatnonzero(~factor)]
    products = np.block([[between, across], [across.T, rest]])[np.ix_(order, order)]
    n_factors = int(factor.sum())
    return products, n_factors, len(order) - n_factors - 1


def m2_statistic(p: np.ndarray, share: np.ndarray, groups: list[np.ndarray], first: np.ndarray, second: np.ndarray, total: float) -> tuple[float, int]:
    """M2 and its degrees of freedom from observed shares right of items and pairs.

    ``p`` is items x classes, ``groups`` says which classes share an estimated
    probability.  No array of margins x margins is built: the inverse covariance is applied by
    the matrix inversion lemma to the factors of :func:`_gram`, and memory grows with the
    square of items x classes.
    """
    n_items = len(p)
    n_margins = n_items * (n_items + 1) // 2
    n_parameters = sum(len(np.unique(g)) for g in groups) + len(share) - 1
    if n_margins <= n_parameters:
        raise ValueError("M2 needs more margins than parameters")
    products, k, _ = _gram(p, share, groups, first, second)
    inner = np.eye(k) + products[:k, :k]
    left = products[k:, k:] - products[k:, :k] @ np.linalg.solve(inner, products[:k, k:])
    info, slope, own = left[:-1, :-1], left[:-1, -1], left[-1, -1]
    return float(total * (own - slope @ np.linalg.pinv(info, hermitian=True) @ slope)), n_margins - n_parameters


def srmsr(p: np.ndarray, share: np.ndarray, first: np.ndarray, second: np.ndarray) -> float:
    """Root mean square of the differences between observed and modelled correlations of pairs."""

    def corr(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        sd = np.sqrt(one * (1 - one))
        return ((two - np.outer(one, one)) / np.outer(sd, sd))[np.triu_indices(len(one), 1)]

    gap = corr(first, second) - corr(p @ share, (p * share) @ p.T)
    return float(np.sqrt((gap**2).mean()))


def fit_m2(patterns: DataFrame, pi: DataFrame, nu: DataFrame, q_masks: dict[int, int], n_attr: int, model: str = "lcdm") -> M2Fit:
    """M2 with its p-value, RMSEA2 and SRMSR; complete responses only.

    ``model`` names the class groups whose probabilities were estimated, which
    fixes the parameters and so the degrees of freedom.
    """
    codec = Codec(list(q_masks))
    n_items = len(codec.items)
    place = {item: k for k, item in enumerate(codec.items)}
    held = " + ".join(f"bit_count(a{w})" for w in range(codec.n_words))
    if not patterns.filter(F.expr(f"{held} < {n_items}")).isEmpty():
        raise ValueError("M2 needs complete responses")
    rows = pair_margins(patterns, codec).collect()
    if not rows:
        raise ValueError("M2 needs responses to at least two items")
    total = rows[0].n
    first, second = np.zeros(n_items), np.zeros((n_items, n_items))
    for r in rows:
        i, j = place[r.item_i], place[r.item_j]
        first[i], first[j] = r.p_i, r.p_j
        second[i, j] = second[j, i] = r.p_ij
    p, share = parameters_on_driver(pi, nu, codec)
    groups = [class_groups(model, mask, n_attr) for mask in q_masks.values()]
    m2, df = m2_statistic(p, share, groups, first, second, total)
    p_value = chi_square_tail(m2, df)
    rmsea = math.sqrt(max(0.0, (m2 - df) / (total * df)))
    return M2Fit(m2, df, p_value, rmsea, srmsr(p, share, first, second), p_value > 0.05)


def margin_residuals(patterns: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame) -> DataFrame:
    """(item_i, item_j, n, p_ij, model_ij, r_ij, model_r_ij): observed and modelled share of
    respondents with both items right, and the correlations they imply.  Parameters only
    are joined with themselves: items x items x classes rows."""
    cells = pi.join(nu, "class_id").select("item_id", "class_id", "pi", "nu")
    one = cells.select(F.col("item_id").alias("item_i"), "class_id", F.col("pi").alias("a"), "nu")
    two = cells.select(F.col("item_id").alias("item_j"), "class_id", F.col("pi").alias("b"))
    fitted = (
        one.join(two, "class_id")
        .where("item_i < item_j")
        .groupBy("item_i", "item_j")
        .agg(F.expr("sum(a * nu) AS m_i"), F.expr("sum(b * nu) AS m_j"), F.expr("sum(a * b * nu) AS model_ij"))
    )
    corr = "({ij} - {i} * {j}) / sqrt({i} * (1 - {i}) * {j} * (1 - {j}))"
    return pair_margins(patterns, codec).join(fitted, ["item_i", "item_j"]).selectExpr(
        "item_i",
        "item_j",
        "n",
        "p_ij",
        "model_ij",
        corr.format(ij="p_ij", i="p_i", j="p_j") + " AS r_ij",
        corr.format(ij="model_ij", i="m_i", j="m_j") + " AS model_r_ij",
    )

"""Classification reliability from class posteriors and attribute probabilities.

Each operator is one aggregation whose result is the size of the model (classes
squared, or attributes), whatever the number of respondents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masterline.operators.scoring import first_class


def class_confusion(post: DataFrame, n_attr: int) -> DataFrame:
    """(assigned, class_id, mass): posterior mass of each class among the
    respondents placed in each class."""
    sums = ", ".join(f"sum(get(w, {c}))" for c in range(2**n_attr))
    rows = post.select(first_class(F.col("w")).alias("assigned"), "w").groupBy("assigned").agg(F.expr(f"array({sums}) AS m"))
    return rows.select("assigned", F.posexplode("m").alias("class_id", "mass"))


def pattern_reliability(post: DataFrame, n_attr: int) -> DataFrame:
    """One row: accuracy P_a and consistency P_c of the profile placement."""
    cells = class_confusion(post, n_attr)
    by_class = cells.groupBy("class_id").agg(
        F.sum("mass").alias("size"),
        F.sum(F.when(F.col("assigned") == F.col("class_id"), F.col("mass")).otherwise(0.0)).alias("hit"),
        F.sum(F.col("mass") * F.col("mass")).alias("sq"),
    )
    total = F.sum("size")
    return by_class.agg(
        (F.sum("hit") / total).alias("p_a"), (F.sum(F.try_divide("sq", "size")) / total).alias("p_c")
    )


def attribute_table(post: DataFrame, n_attr: int, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """(attribute, n, t11, t10, t01, t00): expected counts by true state (first
    digit) and classification (second digit)."""
    op = ">=" if inclusive else ">"
    # Attributes become rows after the aggregation, not before it.
    sums = ", ".join(
        f"struct(sum(if({p} {op} {threshold}D, {p}, 0D)) AS t11, sum(if({p} {op} {threshold}D, 0D, {p})) AS t10, "
        f"sum(if({p} {op} {threshold}D, 1D - {p}, 0D)) AS t01, sum(if({p} {op} {threshold}D, 0D, 1D - {p})) AS t00)"
        for p in (f"get(p, {k})" for k in range(n_attr))
    )
    row = post.agg(F.expr(f"array({sums}) AS rows"))
    return row.select(F.posexplode("rows").alias("k", "t")).select((F.col("k") + 1).alias("attribute"), "t.*")


def tetrachoric(p11: float, p10: float, p01: float, p00: float) -> float:
    """Correlation of the normal pair whose quadrants have these probabilities,
    by bisection; +-1 when a cell is empty."""
    if min(p10, p01) <= 1e-12:
        return 1.0
    if min(p11, p00) <= 1e-12:
        return -1.0

    def quantile(p: float) -> float:
        lo, hi = -10.0, 10.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
        return (lo + hi) / 2

    h, k = quantile(p01 + p00), quantile(p10 + p00)
    nodes, weights = np.polynomial.legendre.leggauss(64)

    def upper(rho: float) -> float:
        """P(X > h, Y > k): independence plus the integral of the density over
        the correlation, with r = sin(t) to tame the ends."""
        end = math.asin(rho)
        t = end / 2 * (nodes + 1)
        s, c = np.sin(t), np.cos(t)
        f = np.exp(-(h * h - 2 * h * k * s + k * k) / (2 * c * c))
        return (p11 + p10) * (p11 + p01) + end / 2 * (weights @ f) / (2 * math.pi)

    lo, hi = -1 + 1e-12, 1 - 1e-12
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper(mid) < p11 else (lo, mid)
    return (lo + hi) / 2


AGREEMENT = {
    "n": "t11 + t10 + t01 + t00",
    # Accuracy: true state against classification.
    "acc": "(t11 + t00) / n",
    "true1": "(t11 + t10) / n",
    "flag1": "(t11 + t01) / n",
    "sensitivity": "try_divide(t11, t11 + t10)",
    "specificity": "try_divide(t00, t00 + t01)",
    "youden": "sensitivity + specificity - 1",
    "acc_chance": "true1 * flag1 + (1 - true1) * (1 - flag1)",
    "acc_kappa": "try_divide(acc - acc_chance, 1 - acc_chance)",
    "acc_lambda": "try_divide(acc - greatest(true1, 1 - true1), 1 - greatest(true1, 1 - true1))",
    # Consistency: two classifications, independent given the true state.
    "c11": "true1 * sensitivity * sensitivity + (1 - true1) * (1 - specificity) * (1 - specificity)",
    "c10": "true1 * sensitivity * (1 - sensitivity) + (1 - true1) * (1 - specificity) * specificity",
    "c00": "1 - c11 - 2 * c10",
    "consist": "c11 + c00",
    "con_chance": "flag1 * flag1 + (1 - flag1) * (1 - flag1)",
    "con_kappa": "try_divide(consist - con_chance, 1 - con_chance)",
    "con_lambda": "try_divide(consist - greatest(flag1, 1 - flag1), 1 - greatest(flag1, 1 - flag1))",
    "con_youden": "try_divide(c11, c11 + c10) + try_divide(c00, c00 + c10) - 1",
}
MAP_COLUMNS = [
    "attribute", "acc", "acc_kappa", "acc_lambda", "youden", "sensitivity", "specificity",
    "consist", "con_kappa", "con_lambda", "con_youden",
]


def map_reliability(post: DataFrame, n_attr: int, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """Accuracy and consistency of the attribute classification, one row per attribute."""
    return _agreement(post, n_attr, threshold, inclusive).select(*MAP_COLUMNS)


def _agreement(post: DataFrame, n_attr: int, threshold: float, inclusive: bool) -> DataFrame:
    df = attribute_table(post, n_attr, threshold, inclusive)
    for name, text in AGREEMENT.items():
        df = df.withColumn(name, F.expr(text))
    return df


def map_reliability_tetrachoric(post: DataFrame, n_attr: int, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """As :func:`map_reliability` with the tetrachoric correlations, solved on
    the driver for one row per attribute."""
    rows = _agreement(post, n_attr, threshold, inclusive).toPandas()
    rows["acc_tetra"] = [
        tetrachoric(*(v / r["n"] for v in (r["t11"], r["t10"], r["t01"], r["t00"]))) for _, r in rows.iterrows()
    ]
    rows["con_tetra"] = [tetrachoric(r["c11"], r["c10"], r["c10"], r["c00"]) for _, r in rows.iterrows()]
    return post.sparkSession.createDataFrame(rows[[*MAP_COLUMNS, "acc_tetra", "con_tetra"]])


def eap_reliability(post: DataFrame, n_attr: int) -> DataFrame:
    """Reliability of the attribute probabilities, one row per attribute.

    ``rho_pf``: squared correlation of the true state with its probability,
    Var(p) / (m (1 - m)); ``rho_tb``: the same from the mean probabilities of
    holders and others; ``rho_i``: 1 - exp(-2 mutual information).
    """
    entropy = "-(if({p} > 0, {p} * ln({p}), 0D) + if({p} < 1, (1 - {p}) * ln(1 - {p}), 0D))"
    sums = ", ".join(
        f"struct(avg({p}) AS m, avg({p} * {p}) AS m2, avg({entropy.format(p=p)}) AS left_over)"
        for p in (f"get(p, {k})" for k in range(n_attr))
    )
    rows = post.agg(F.expr(f"array({sums}) AS rows")).select(F.posexplode("rows").alias("k", "t"))
    rows = rows.select((F.col("k") + 1).alias("attribute"), "t.*")
    steps = {
        "var": "m2 - m * m",
        "rho_pf": "try_divide(var, m * (1 - m))",
        "e1": "try_divide(m2, m)",
        "e0": "try_divide(m - m2, 1 - m)",
        "rho_tb": "try_divide(m * (1 - m) * (e1 - e0) * (e1 - e0), var)",
        "rho_i": f"1 - exp(-2 * ({entropy.format(p='m')} - left_over))",
    }
    for name, text in steps.items():
        rows = rows.withColumn(name, F.expr(text))
    return rows.select("attribute", "rho_pf", "rho_tb", "rho_i")

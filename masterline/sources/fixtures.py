"""Test inputs derived from the driver's tables by hash uniforms.

Every table here grows with the customer, orders, part or supplier table; only
the twelve-item test form and its parameters are constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.functions.hashing import u01, u01_text, uniform
from masterline.functions.scalar import bit
from masterline.sources.grid import with_axis

# The test form (attribute mask by item 1..12) and attribute shares.
Q_MASKS = (1, 1, 1, 2, 2, 2, 4, 4, 4, 3, 6, 5)
SHARES = (0.6, 0.5, 0.4)
N_ATTR = 3
N_CLASSES = 8
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def qmatrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, m in enumerate(Q_MASKS, start=1)], "item_id int, q_mask int")


def known_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resp_id, class_id): one respondent per customer, bits by share."""
    bits = " + ".join(
        f"if({u01_text('c_custkey', 101 + k, 17)} < {s}D, {1 << k}, 0)" for k, s in enumerate(SHARES)
    )
    return read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) AS resp_id", f"{bits} AS class_id")


def held_share(class_id: Column, q_mask: Column) -> Column:
    return F.bit_count(class_id.bitwiseAND(q_mask)) / F.bit_count(q_mask)


def _items() -> Column:
    rows = ", ".join(f"struct({i} AS item_id, {m} AS q_mask)" for i, m in enumerate(Q_MASKS, start=1))
    return F.expr(f"array({rows})")


def true_probs(classes: DataFrame) -> DataFrame:
    """(resp_id, item_id, p) for known classes; an explode, not a join."""
    share = held_share(F.col("class_id"), F.col("q_mask"))
    p = F.when(share == 1, 0.9).when(share == 0, 0.15).otherwise(0.45)
    return classes.select("resp_id", "class_id", F.inline(_items())).select("resp_id", "item_id", p.alias("p"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: (resp_id, item_id, score), twelve answers per customer."""
    # As an IF the score is never NULL to Catalyst, which then drops NULL tests on it.
    score = F.expr(f"if({u01_text('resp_id', 'item_id', 29)} < p, 1, 0) AS score")
    return true_probs(known_classes(spark, sf_dir)).select("resp_id", "item_id", score)


def observed_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: score 1 when a customer has two or more orders of a priority."""
    counts = [F.expr(f"count_if(o_orderpriority = '{p}') AS n{i}") for i, p in enumerate(PRIORITIES, start=1)]
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(*counts)
    both = read(spark, sf_dir, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    items = ", ".join(
        f"struct({i} AS item_id, if(coalesce(n{i}, 0) >= 2, 1, 0) AS score)" for i in range(1, len(PRIORITIES) + 1)
    )
    return both.selectExpr("cast(c_custkey as bigint) AS resp_id", f"inline(array({items}))")


def start_pi(spark: SparkSession, n_classes: int = N_CLASSES) -> DataFrame:
    """(item_id, class_id, pi) with pi = .2 + .6 * held/required."""
    cells = with_axis(qmatrix(spark), n_classes, "class_id")
    return cells.select("item_id", "class_id", (0.2 + 0.6 * held_share(F.col("class_id"), F.col("q_mask"))).alias("pi"))


def start_nu(spark: SparkSession) -> DataFrame:
    return spark.range(N_CLASSES).select(F.col("id").cast("int").alias("class_id"), F.lit(1.0 / N_CLASSES).alias("nu"))


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("draw"))


def draws_pi(spark: SparkSession, n: int) -> DataFrame:
    """(draw, item_id, class_id, pi), a deterministic jitter of start_pi."""
    return jittered_pi(_numbers(spark, n))


def jittered_pi(numbers: DataFrame) -> DataFrame:
    """(columns.., item_id, class_id, pi) for each row of a table with a column ``draw``."""
    cells = with_axis(numbers.select("*", F.inline(_items())), N_CLASSES, "class_id")
    jitter = u01("draw * 1000L + class_id", "item_id", 41) - 0.5
    pi = 0.2 + 0.6 * held_share(F.col("class_id"), F.col("q_mask")) + 0.04 * jitter
    return cells.select(*numbers.columns, "item_id", "class_id", pi.alias("pi"))


def draws_nu(spark: SparkSession, n: int) -> DataFrame:
    return jittered_nu(_numbers(spark, n))


def jittered_nu(numbers: DataFrame) -> DataFrame:
    raw = lambda c: f"(0.125D + 0.02D * ({u01_text('draw', c, 43)} - 0.5D))"
    cells = with_axis(numbers, N_CLASSES, "class_id")
    total = " + ".join(raw(c) for c in range(N_CLASSES))
    return cells.select(*numbers.columns, "class_id", F.expr(f"{raw('class_id')} / ({total})").alias("nu"))


def supplier_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw, chain, iteration): one draw per supplier, dealt to four chains."""
    place = "cast(s_suppkey as bigint) - 1"
    return read(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as int) AS draw", f"cast(({place}) % 4 + 1 as int) AS chain", f"cast(({place}) div 4 + 1 as int) AS iteration"
    )


BANK_ATTRS = ["att1", "att2", "att3", "att4"]


def raw_bank(spark: SparkSession, sf_dir: str, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """Item candidates, one per row of a table: all fifteen non-empty masks occur."""
    mask = (F.col(key) % 15 + 1).cast("int")
    bits = [bit(mask, k).alias(a) for k, a in enumerate(BANK_ATTRS)]
    return read(spark, sf_dir, table).select(F.col(key).alias("item_id"), mask.alias("q_mask"), *bits)


def bank_probs(params: DataFrame) -> DataFrame:
    """Success probabilities for the parameters of bank items: low for the
    intercept, middling for main effects, high for interactions."""
    size = F.when(F.col("parameter") == "(Intercept)", 0).otherwise(F.size(F.split("parameter", ":")))
    u = lambda lo, hi: uniform(lo, hi, "item_id", "length(parameter) * 7 + ascii(substring(parameter, -1, 1))", 53)
    return params.withColumn("prob", F.when(size == 0, u(0.05, 0.45)).when(size == 1, u(0.5, 0.7)).otherwise(u(0.7, 0.95)))


def irt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, a, b): one curve per supplier."""
    a, b = uniform(0.7, 3.0, "s_suppkey", 1, 61), uniform(-1.2, 1.2, "s_suppkey", 2, 61)
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), a.alias("a"), b.alias("b"))


def test_curves(spark: SparkSession) -> DataFrame:
    """(item_id, a, b) for the twelve-item form."""
    a, b = uniform(0.7, 2.0, "item_id", 1, 67), uniform(-1.5, 1.0, "item_id", 2, 67)
    return qmatrix(spark).select("item_id", a.alias("a"), b.alias("b"))

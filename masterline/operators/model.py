"""Profiles, items, parameters and class-conditional probabilities.

A class id is the bitmask of the attributes held, an item's ``q_mask`` the
bitmask of those it measures, a parameter's ``mask`` the attributes it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masterline.functions.hashing import bernoulli
from masterline.functions.scalar import bit, held_all, inv_logit, logit
from masterline.operators.joins import lookup_join
from masterline.operators.verbs import INTERCEPT, dcm_design
from masterline.sources.grid import with_axis

MODELS = ("lcdm", "dina", "dino", "crum")


def attributes(n_attr: int) -> list[str]:
    return [f"att{k}" for k in range(1, n_attr + 1)]


def profiles(spark: SparkSession, n_attr: int) -> DataFrame:
    """All 2^A profiles: (class_id, alpha array<int>)."""
    c = F.col("id").cast("int")
    return spark.range(2**n_attr).select(c.alias("class_id"), profile_bits(c, n_attr).alias("alpha"))


def profile_bits(class_id: Column, n_attr: int) -> Column:
    return F.array(*[bit(class_id, k) for k in range(n_attr)])


def possible_items(items: DataFrame, lo: int = 1, hi: int = 2) -> DataFrame:
    """Items that measure between lo and hi attributes."""
    return items.filter(F.bit_count("q_mask").between(lo, hi))


def item_structure(q: DataFrame) -> DataFrame:
    """Number of attributes an item measures and its kind of structure."""
    n = F.bit_count("q_mask")
    return q.withColumns({"n_attributes": n, "structure": F.when(n == 1, "simple").when(n >= 2, "complex")})


def item_parameters(q: DataFrame, attrs: list[str], order: int = 2) -> DataFrame:
    """(item_id, parameter, needed): the parameters each item's masks call for."""
    bits = [bit(F.col("q_mask"), k).alias(a) for k, a in enumerate(attrs)]
    return dcm_design(q.select("item_id", *bits), attrs, order)


def parameter_mask(parameter: Column, attrs: list[str]) -> Column:
    """Parameter name -> attribute mask ("(Intercept)" is 0)."""
    parts = F.split(parameter, ":")
    return sum((F.array_contains(parts, a).cast("int") * (1 << k) for k, a in enumerate(attrs)), F.lit(0))


def parameter_name(mask: Column, attrs: list[str]) -> Column:
    names = F.array_compact(F.array(*[F.when(bit(mask, k) == 1, a) for k, a in enumerate(attrs)]))
    return F.when(mask == 0, INTERCEPT).otherwise(F.array_join(names, ":"))


def params_from_probs(df: DataFrame, attrs: list[str]) -> DataFrame:
    """(item_id, parameter, prob) -> log-odds values.

    Intercept logit(p); main effect logit(p) less the intercept; interaction
    logit(p) less the intercept and the main effects it contains.  The windows
    run over one item's parameters, at most 2^A rows.
    """
    item = Window.partitionBy("item_id")
    mask, lg = parameter_mask(F.col("parameter"), attrs), logit(F.col("prob"))
    df = df.withColumns({"__mask": mask, "__lg": lg})
    base = F.max(F.when(F.col("__mask") == 0, F.col("__lg"))).over(item)
    df = df.withColumn("__base", base)
    mains = [
        F.when(
            bit(F.col("__mask"), k) == 1,
            F.max(F.when(F.col("__mask") == 1 << k, F.col("__lg"))).over(item) - F.col("__base"),
        ).otherwise(0.0)
        for k in range(len(attrs))
    ]
    df = df.withColumn("__mains", sum(mains, F.lit(0.0)))
    value = (
        F.when(F.col("__mask") == 0, F.col("__lg"))
        .when(F.bit_count("__mask") == 1, F.col("__lg") - F.col("__base"))
        .otherwise(F.col("__lg") - F.col("__base") - F.col("__mains"))
    )
    return df.select("item_id", "parameter", value.alias("value"))


def with_masks(params: DataFrame, attrs: list[str]) -> DataFrame:
    return params.select("item_id", parameter_mask(F.col("parameter"), attrs).alias("mask"), "value")


def constrain(params: DataFrame, model: str) -> DataFrame:
    """The same parameters under a restricted model: (item_id, mask, value).

    DINA keeps the intercept and the highest interaction; C-RUM drops the
    interactions; DINO sets every main effect to their mean and lets the
    interactions alternate in sign, so that one attribute is as good as all.
    """
    if model == "lcdm":
        return params.select("item_id", "mask", "value")
    if model == "crum":
        return params.filter(F.bit_count("mask") <= 1).select("item_id", "mask", "value")
    per_item = params.groupBy("item_id").agg(
        F.bit_or("mask").alias("q"),
        F.max(F.when(F.col("mask") == 0, F.col("value"))).alias("base"),
        F.avg(F.when(F.bit_count("mask") == 1, F.col("value"))).alias("main"),
        F.max_by("value", "mask").alias("top"),
    )
    if model == "dina":
        rows = F.array(
            F.struct(F.lit(0).alias("mask"), F.col("base").alias("value")),
            F.struct(F.col("q").alias("mask"), F.col("top").alias("value")),
        )
        return per_item.select("item_id", F.inline(rows))
    if model == "dino":
        sign = F.when(F.bit_count("mask") % 2 == 1, 1.0).otherwise(-1.0)
        subsets = with_axis(per_item, F.col("q") + 1, "mask").filter(held_all(F.col("q"), F.col("mask")))
        value = F.when(F.col("mask") == 0, F.col("base")).otherwise(sign * F.col("main"))
        return subsets.select("item_id", "mask", value.alias("value"))
    raise ValueError(f"model must be one of {MODELS}")


def over_subsets(v: str, n_attr: int, sign: str = "+") -> str:
    """The array ``v`` by attribute set turned into sums over all subsets of each set
    (``+``) or, the inverse, into signed sums (``-``), one attribute at a time."""
    step = f"transform(acc, (x, c) -> if(shiftright(c, k) & 1 = 1, x {sign} get(acc, c - shiftleft(1, k)), x))"
    return f"aggregate(sequence(0, {n_attr - 1}), {v}, (acc, k) -> {step})" if n_attr else v


def item_class_logodds(params: DataFrame, n_attr: int) -> DataFrame:
    """(item_id, class_id, log_odds): a class's log-odds on an item is the sum
    of the parameters whose attributes it holds.  One aggregation by item; the sums
    run over the lattice of attribute sets in the row, so the plan is the same
    for any number of attributes."""
    rows = params.where("mask IS NOT NULL").groupBy("item_id").agg(F.collect_list(F.struct("mask", "value")).alias("cells"))
    placed = "aggregate(cells, array_repeat(0D, {n}), (acc, p) -> transform(acc, (x, c) -> if(c = p.mask, x + coalesce(p.value, 0D), x)))"
    rows = rows.select("item_id", F.expr(placed.format(n=2**n_attr)).alias("v"))
    return rows.select("item_id", F.posexplode(F.expr(over_subsets("v", n_attr))).alias("class_id", "log_odds"))


def item_class_probs(params: DataFrame, model: str, n_attr: int) -> DataFrame:
    """(item_id, class_id, pi) under a model."""
    cells = item_class_logodds(constrain(params, model), n_attr)
    return cells.select("item_id", "class_id", inv_logit(F.col("log_odds")).alias("pi"))


def lambda_from_pi(pi: DataFrame, q: DataFrame, n_attr: int) -> DataFrame:
    """Inverse of the above: (item_id, mask, value) by signed sums over the
    subsets of each mask, again one aggregation by item.  An item needs a
    probability for each of the 2^A classes."""
    cells = pi.select("item_id", "class_id", logit(F.col("pi")).alias("lg")).groupBy("item_id")
    wide = cells.agg(F.array_sort(F.collect_list(F.struct("class_id", "lg"))).alias("cells")).join(q.select("item_id", "q_mask"), "item_id")
    whole = f"size(cells) = {2**n_attr} AND cells[0].class_id = 0 AND cells[{2**n_attr - 1}].class_id = {2**n_attr - 1}"
    v = F.expr(f"if({whole}, cells.lg, raise_error(concat('not all classes of item ', item_id)))")
    wide = wide.select("item_id", "q_mask", v.alias("v"))
    long = wide.select("item_id", "q_mask", F.posexplode(F.expr(over_subsets("v", n_attr, "-"))).alias("mask", "value"))
    return long.filter(held_all(F.col("q_mask"), F.col("mask"))).drop("q_mask")


def response_probs(people: DataFrame, params: DataFrame, n_attr: int, id_col: str = "resp_id") -> DataFrame:
    """(id, item_id, log_odds, prob) of every person on every item.

    Log-odds depend on the class only, so they are worked out per class and
    looked up; a class holding most of the people costs nothing extra.
    """
    cells = item_class_logodds(params, n_attr)
    cells = cells.withColumn("prob", inv_logit(F.col("log_odds")))
    people = people.select(id_col, "class_id")
    joined = lookup_join(people, cells, ["class_id"])
    return joined.select(id_col, "item_id", "log_odds", "prob")


def score_responses(probs: DataFrame, salt: int, p: str = "prob", id_col: str = "resp_id") -> DataFrame:
    """Bernoulli scores: (id, item_id, score); the id is an integer."""
    score = bernoulli(F.col(p), f"`{id_col}`", "item_id", salt)
    return probs.select(id_col, "item_id", score.alias("score"))

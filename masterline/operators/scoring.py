"""Likelihoods, class posteriors and classification of respondents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masterline.functions.scalar import clip_prob, mastered
from masterline.operators.joins import left_join, nearest_join, salted_join
from masterline.operators.patterns import WORD
from masterline.operators.sampling import assign_labels
from masterline.operators.verbs import across
from masterline.plans.lineage import BROADCAST_ROWS, cut, small

BLOCK = 64
#: The respondent column of every table here, unless another is named.
ID = "resp_id"


def node_table(pi: DataFrame, node: str = "class_id") -> DataFrame:
    """(item_id, at, block, lp, lq): log probabilities of right and wrong
    over latent nodes (classes, or grid points), 64 to a row; ``at`` numbers the items."""
    p = clip_prob(F.col("pi"))
    cell = F.struct(F.col(node).alias("node"), F.ln(p).alias("lp"), F.ln(1.0 - p).alias("lq"))
    rows = pi.select("item_id", F.floor(F.col(node) / BLOCK).cast("int").alias("block"), cell.alias("cell"))
    blocks = rows.groupBy("item_id", "block").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    # The window runs over the form's items.
    at = F.dense_rank().over(Window.orderBy("item_id")) - 1
    return blocks.select("item_id", at.alias("at"), "block", F.col("cells.lp").alias("lp"), F.col("cells.lq").alias("lq"))


def node_blocks(resp: DataFrame, pi: DataFrame, keys: list[str], n_nodes: int, node: str = "class_id") -> DataFrame:
    """(keys.., block, ll): log-likelihood of each key's answers at the nodes.

    One aggregation with a column per node, so answers are not multiplied by
    the number of nodes, only by the number of 64-node blocks.  A NULL answer
    adds nothing but keeps its respondent; an item without parameters fails, and so does
    an item that one key has answered twice: the same aggregation counts
    answers and marks items in bit words.
    """
    n_blocks = -(-n_nodes // BLOCK)
    n_items = pi.select("item_id").distinct().count()
    table = node_table(pi, node)
    if n_items * n_blocks <= BROADCAST_ROWS:
        answers = resp.join(F.broadcast(table), "item_id", "left")
    else:
        answers = salted_join(resp, table, ["item_id"], how="left")
    known = F.expr("coalesce(lp, raise_error(concat('no parameters for item ', item_id)))")
    answers = answers.withColumn("lp", known)
    marks = (f"bit_or(if(score IS NOT NULL AND at div {WORD} = {w}, shiftleft(1L, at % {WORD}), 0L))" for w in range(max(1, -(-n_items // WORD))))
    once = f"count(score) = {' + '.join(f'bit_count({m})' for m in marks)}"
    sums = (f"sum(if(score IS NULL, 0D, if(score = 1, get(lp, {j}), get(lq, {j}))))" for j in range(min(n_nodes, BLOCK)))
    ll = F.expr(f"if({once}, array_compact(array({', '.join(sums)})), raise_error('an item answered twice by one respondent')) AS ll")
    if n_nodes <= BLOCK:
        # Grouped by the keys alone: the result stays partitioned by them, and
        # a later join on them needs no shuffle of this side.
        return answers.groupBy(*keys).agg(ll).withColumn("block", F.lit(0))
    return answers.groupBy(*keys, "block").agg(ll)


def node_loglik(resp: DataFrame, pi: DataFrame, keys: list[str], n_nodes: int) -> DataFrame:
    """(keys.., ll) with all nodes in one array; blocks are put together per key."""
    blocks = node_blocks(resp, pi, keys, n_nodes)
    if n_nodes <= BLOCK:
        return blocks.drop("block")
    parts = F.sort_array(F.collect_list(F.struct("block", "ll")))
    return blocks.groupBy(*keys).agg(F.flatten(parts["ll"]).alias("ll"))


def log_weights(nu: DataFrame) -> DataFrame:
    """One row: class proportions as one array of logs."""
    cell = F.struct("class_id", F.ln(F.greatest(F.col("nu"), F.lit(1e-300))).alias("v"))
    return nu.agg(F.sort_array(F.collect_list(cell))["v"].alias("log_nu"))


def with_posterior(df: DataFrame, log_nu: Column) -> DataFrame:
    """Add ``w`` (class posterior) and ``loglik`` (marginal) from ``ll``."""
    df = df.withColumn("__nu", log_nu)
    df = df.withColumn("__lw", F.expr("zip_with(ll, __nu, (a, b) -> a + b)"))
    df = df.withColumn("__top", F.expr("array_max(__lw)"))
    df = df.withColumn("__e", F.expr("transform(__lw, x -> exp(x - __top))"))
    df = df.withColumn("__s", F.expr("aggregate(__e, 0D, (acc, x) -> acc + x)"))
    return df.withColumns(
        {"w": F.expr("transform(__e, x -> x / __s)"), "loglik": F.expr("__top + ln(__s)")}
    ).drop("__nu", "__lw", "__top", "__e", "__s")


def attribute_probs(w: str, n_attr: int) -> Column:
    """p_a: the posterior mass of the classes that hold attribute a."""
    mass = "transform({w}, (x, c) -> if(shiftright(c, {k}) & 1 = 1, x, 0D))"
    sums = (f"aggregate({mass.format(w=w, k=k)}, 0D, (acc, x) -> acc + x)" for k in range(n_attr))
    return F.expr(f"array({', '.join(sums)})")


def class_loglik(resp: DataFrame, pi: DataFrame, nu: DataFrame, n_attr: int, id_col: str = ID) -> DataFrame:
    """(id, ll array by class, w, loglik) in one shuffle by respondent."""
    ll = node_loglik(resp, pi, [id_col], 2**n_attr)
    return with_posterior(ll, log_weights(nu).scalar())


class Prediction(NamedTuple):
    class_probabilities: DataFrame
    attribute_probabilities: DataFrame


def posterior(resp: DataFrame, pi: DataFrame, nu: DataFrame, n_attr: int, id_col: str = ID) -> DataFrame:
    """(id, w, p, loglik) for every respondent; one whose answers are all
    NULL has the class proportions."""
    post = class_loglik(resp, pi, nu, n_attr, id_col)
    return post.select(id_col, "w", attribute_probs("w", n_attr).alias("p"), "loglik")


def predict_dcm(resp: DataFrame, pi: DataFrame, nu: DataFrame, n_attr: int, id_col: str = ID) -> Prediction:
    post = posterior(resp, pi, nu, n_attr, id_col)
    return Prediction(post.select(id_col, "w"), post.select(id_col, "p"))


def draw_mean(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Expectation over posterior draws of a long table."""
    return draws.groupBy(*keys).agg(F.avg(value).alias(value))


def map_profile(post: DataFrame, id_col: str = ID) -> DataFrame:
    """(id, class_id, prob) of the most likely class; ties all kept.

    The posterior is an array, so this is a row-wise step without a shuffle.
    """
    top = post.withColumn("__top", F.expr("array_max(w)"))
    cells = "transform(w, (x, c) -> struct(c AS class_id, x AS prob))"
    return top.select(id_col, F.expr(f"inline(filter({cells}, s -> s.prob = __top))"))


def first_class(w: Column) -> Column:
    """The most likely class, the lowest number when tied."""
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")


def classify(post: DataFrame, attrs: list[str], threshold: float = 0.5, inclusive: bool = True, id_col: str = ID) -> DataFrame:
    """(id, one 1/0 column per attribute) from attribute probabilities."""
    wide = post.select(id_col, *[F.get("p", F.lit(k)).alias(a) for k, a in enumerate(attrs)])
    return across(wide, attrs, lambda p: mastered(p, threshold, inclusive))


def select_exemplars(targets: DataFrame, people: DataFrame, id_col: str = ID) -> DataFrame:
    """Per target (profile and theta), the respondent of that profile whose
    theta is nearest: adds the id and ``theta``, NULL when there is none.
    Stored, as relabelling and the result table both start from it."""
    return cut(nearest_join(targets, people, ["class_id"], "target_theta", "theta", id_col))


def relabel(people: DataFrame, exemplars: DataFrame, labels: DataFrame, salt: int, id_col: str = ID) -> DataFrame:
    """Exemplars take their own name, everybody else a shuffled label.

    ``exemplars`` is (id, name), ``labels`` (label_id, label).
    """
    named = assign_labels(people, labels, id_col, "label", "label_id", salt)
    named = left_join(named, exemplars.select(id_col, "name"), [id_col])
    return named.withColumn("label", F.when(F.col("name").isNull(), F.col("label")).otherwise(F.col("name"))).drop("name")


def result_table(
    classified: DataFrame, exemplars: DataFrame, catalog: DataFrame, key: str, attrs: list[str], order: str
) -> DataFrame:
    """Classified respondents that are exemplars, with theta (where the profile
    agrees) and catalog columns, sorted by date."""
    kept = classified.join(small(exemplars.select(key).distinct()), key, "left_semi")
    with_theta = left_join(kept, exemplars, [key, *attrs])
    return left_join(with_theta, catalog, [key]).orderBy(order, key)

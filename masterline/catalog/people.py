"""Queries of the diagnostic models: items and parameters, classification of
respondents, estimation, and the item-response companion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.catalog import fragments as sql
from masterline.catalog.verbs import r6
from masterline.functions.hashing import bernoulli
from masterline.operators import irt, model, sampling, scoring, verbs
from masterline.operators.joins import left_join, lookup_join
from masterline.plans import draws as pd_draws
from masterline.plans import em
from masterline.plans.lineage import large, spread
from masterline.sources import fixtures as fx
from masterline.sources import io

QUERIES: dict[str, tuple] = {}


def query(oracle: str | None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, oracle)
        return fn

    return register


# --- flagship --------------------------------------------------------------------


@query(
    f"""{sql.F1_POST},
{sql.ATTR},
wide AS (SELECT resp_id, {', '.join(f'max(CASE WHEN attribute = {k} AND round(p, 6) >= 0.5 THEN 1 ELSE 0 END) AS m{k}' for k in (1, 2, 3))} FROM attr GROUP BY 1)
SELECT c_mktsegment, count(*) AS n, {', '.join(f'CAST(sum(m{k}) AS BIGINT) AS mastered_{k}' for k in (1, 2, 3))}
FROM wide JOIN customer ON c_custkey = resp_id GROUP BY 1"""
)
def mastery_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Responses -> class posterior -> attribute mastery -> counts by segment."""
    post = scoring.posterior(fx.responses(spark, sf), fx.start_pi(spark), fx.start_nu(spark), fx.N_ATTR)
    post = post.withColumn("p", F.expr("transform(p, x -> round(x, 6))"))
    attrs = ["mastered_1", "mastered_2", "mastered_3"]
    classes = scoring.classify(post, attrs)
    people = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("resp_id"), "c_mktsegment")
    return (
        classes.join(large(people), "resp_id")
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in attrs])
        .orderBy("c_mktsegment")
    )


# --- items and parameters ----------------------------------------------------------


@query(f"WITH {sql.CLS} SELECT resp_id, '[' || (class_id & 1) || ',' || ((class_id >> 1) & 1) || ',' || ((class_id >> 2) & 1) || ']' AS profile FROM cls")
def profile_labels(spark, sf):
    alpha = model.profiles(spark, fx.N_ATTR)
    people = left_join(fx.known_classes(spark, sf), alpha, ["class_id"])
    label = F.concat(F.lit("["), F.array_join(F.col("alpha").cast("array<string>"), ","), F.lit("]"))
    return people.select("resp_id", label.alias("profile"))


@query(f"WITH {sql.BANK} SELECT item_id, q_mask FROM items2")
def possible_items(spark, sf):
    return model.possible_items(fx.raw_bank(spark, sf)).select("item_id", "q_mask")


@query(
    f"""WITH {sql.BANK} SELECT item_id, CAST(bit_count(q_mask) AS INTEGER) AS n_attributes,
  CASE WHEN bit_count(q_mask) = 1 THEN 'simple' ELSE 'complex' END AS structure FROM bank"""
)
def item_structure(spark, sf):
    return model.item_structure(fx.raw_bank(spark, sf)).select("item_id", "n_attributes", "structure")


@query(
    """SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS item_id, """
    + ", ".join(f"CAST(((p_partkey % 15 + 1) >> {k}) & 1 AS INTEGER) AS {a}" for k, a in enumerate(("songwriting", "production", "vocals", "cohesion")))
    + ", CAST(p_partkey % 15 + 1 AS INTEGER) AS q_mask FROM part"
)
def qmatrix_items(spark, sf):
    named = dict(zip(fx.BANK_ATTRS, ("songwriting", "production", "vocals", "cohesion")))
    q = verbs.rename(fx.raw_bank(spark, sf).drop("q_mask"), named)
    return io.number_items(q, ["item_id"], list(named.values()))


@query(f"WITH {sql.BANK} SELECT item_id, parameter, 1 AS needed FROM design")
def qmatrix_design(spark, sf):
    return model.item_parameters(model.possible_items(fx.raw_bank(spark, sf)), fx.BANK_ATTRS)


def bank_params(spark, sf, *source: str) -> DataFrame:
    needed = model.item_parameters(model.possible_items(fx.raw_bank(spark, sf, *source)), fx.BANK_ATTRS)
    return model.params_from_probs(fx.bank_probs(needed), fx.BANK_ATTRS)


def bank_masks(spark, sf, *source: str) -> DataFrame:
    return model.with_masks(bank_params(spark, sf, *source), fx.BANK_ATTRS)


@query(f"WITH {sql.BANK_PARAMS} SELECT item_id, parameter, round(value, 6) AS value FROM params")
def params_from_probs(spark, sf):
    return bank_params(spark, sf).select("item_id", "parameter", r6("value"))


_PI_SUM = {
    "lcdm": "sum(CASE WHEN class_id & mask = mask THEN value ELSE 0 END)",
    "crum": "sum(CASE WHEN class_id & mask = mask AND bit_count(mask) <= 1 THEN value ELSE 0 END)",
    "dina": "sum(CASE WHEN class_id & mask = mask AND mask IN (0, q_mask) THEN value ELSE 0 END)",
    "dino": "max(CASE WHEN mask = 0 THEN value END) + CASE WHEN class_id & max(q_mask) <> 0 THEN avg(CASE WHEN bit_count(mask) = 1 THEN value END) ELSE 0 END",
}


def _pi_query(name: str):
    def run(spark, sf):
        return model.item_class_probs(bank_masks(spark, sf), name, 4).select("item_id", "class_id", r6("pi"))

    run.__name__ = f"pi_{name}"
    query(
        f"WITH {sql.BANK_PARAMS} SELECT item_id, class_id, round(1 / (1 + exp(-({_PI_SUM[name]}))), 6) AS pi FROM params, sixteen GROUP BY 1, 2"
    )(run)


for _name in model.MODELS:
    _pi_query(_name)


@query(
    f"""WITH {sql.BANK_PARAMS}
SELECT item_id, mask, 'dina' AS model, round(value, 6) AS value FROM params WHERE mask IN (0, q_mask)
UNION ALL SELECT item_id, mask, 'crum', round(value, 6) FROM params WHERE bit_count(mask) <= 1
UNION ALL SELECT item_id, mask, 'dino', round(CASE WHEN mask = 0 THEN value ELSE (2 * (bit_count(mask) % 2) - 1)
  * avg(CASE WHEN bit_count(mask) = 1 THEN value END) OVER (PARTITION BY item_id) END, 6) FROM params"""
)
def constrained_params(spark, sf):
    masks = bank_masks(spark, sf)
    one = lambda m: model.constrain(masks, m).select("item_id", "mask", F.lit(m).alias("model"), r6("value"))
    return verbs.map_union(one, ["dina", "crum", "dino"])


@query(f"WITH {sql.BANK_PARAMS} SELECT item_id, parameter, round(value, 6) AS value FROM params")
def lambda_from_pi(spark, sf):
    pi = model.item_class_probs(bank_masks(spark, sf), "lcdm", 4)
    q = fx.raw_bank(spark, sf).select("item_id", "q_mask")
    back = model.lambda_from_pi(pi, q, 4)
    return back.select("item_id", model.parameter_name(F.col("mask"), fx.BANK_ATTRS).alias("parameter"), r6("value"))


@query(
    f"""WITH {sql.bank_params('nation', 'n_nationkey')},
{sql.CLS},
lo AS (SELECT resp_id, item_id, sum(CASE WHEN class_id & mask = mask THEN value ELSE 0 END) AS lo FROM cls, params GROUP BY 1, 2)
SELECT resp_id, item_id, round(lo, 6) AS log_odds, round(1 / (1 + exp(-lo)), 6) AS prob,
  CASE WHEN {sql.u('resp_id', 'item_id', 71)} < 1 / (1 + exp(-lo)) THEN 1 ELSE 0 END AS score
FROM lo"""
)
def response_probs(spark, sf):
    """Every respondent on every item of a form with one item per nation."""
    masks = bank_masks(spark, sf, "nation", "n_nationkey")
    probs = model.response_probs(fx.known_classes(spark, sf), masks, 4)
    score = bernoulli(F.col("prob"), "resp_id", "item_id", 71)
    return probs.select("resp_id", "item_id", r6("log_odds"), r6("prob"), score.alias("score"))


@query(
    f"""WITH {sql.bank_params('nation', 'n_nationkey')},
{sql.CLS},
lo AS (SELECT resp_id, item_id, sum(CASE WHEN class_id & mask = mask THEN value ELSE 0 END) AS lo FROM cls, params GROUP BY 1, 2),
sc AS (SELECT item_id, CASE WHEN {sql.u('resp_id', 'item_id', 71)} < 1 / (1 + exp(-lo)) THEN 1 ELSE 0 END AS score FROM lo)
SELECT item_id, count(*) AS n, CAST(sum(score) AS BIGINT) AS n_right FROM sc GROUP BY 1"""
)
def scored_responses(spark, sf):
    probs = model.response_probs(fx.known_classes(spark, sf), bank_masks(spark, sf, "nation", "n_nationkey"), 4)
    scores = model.score_responses(probs, 71)
    return scores.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("n_right"))


# --- classification ------------------------------------------------------------------


DRAWS = 500


def mean_post(spark, sf) -> DataFrame:
    """(resp_id, w, p) averaged over all draws: what classification starts from."""
    codec = em.Codec.of(fx.qmatrix(spark))
    people = codec.encode(fx.responses(spark, sf), "resp_id")
    return pd_draws.mean_posterior(people, codec, fx.draws_pi(spark, DRAWS), fx.draws_nu(spark, DRAWS), fx.N_ATTR)


@query(f"{sql.F1_POST} SELECT resp_id, class_id, round(ll, 6) AS ll, round(loglik, 6) AS loglik FROM post")
def class_loglik(spark, sf):
    ll = scoring.class_loglik(fx.responses(spark, sf), fx.start_pi(spark), fx.start_nu(spark), fx.N_ATTR)
    return ll.select("resp_id", r6("loglik"), F.posexplode("ll").alias("class_id", "ll")).select("resp_id", "class_id", r6("ll"), "loglik")


@query(f"{sql.F1_POST} SELECT resp_id, class_id, round(w, 6) AS w FROM post")
def class_posterior(spark, sf):
    pred = scoring.predict_dcm(fx.responses(spark, sf), fx.start_pi(spark), fx.start_nu(spark), fx.N_ATTR)
    return pred.class_probabilities.select("resp_id", F.posexplode("w").alias("class_id", "w")).select("resp_id", "class_id", r6("w"))


@query(f"{sql.F1_POST},\n{sql.ATTR} SELECT resp_id, attribute, round(p, 6) AS p FROM attr")
def attribute_probs(spark, sf):
    pred = scoring.predict_dcm(fx.responses(spark, sf), fx.start_pi(spark), fx.start_nu(spark), fx.N_ATTR)
    long = pred.attribute_probabilities.select("resp_id", F.posexplode("p").alias("k", "p"))
    return long.select("resp_id", (F.col("k") + 1).alias("attribute"), r6("p"))


@query(f"{sql.F1_POST},\n{sql.ATTR} SELECT resp_id, attribute, round(p, 6) AS p, round(loglik, 6) AS loglik FROM attr JOIN marg USING (resp_id)")
def posterior_from_wide(spark, sf):
    """The same probabilities from the wide table, row by row."""
    wide = verbs.to_wide(fx.responses(spark, sf), ["resp_id"], "item_id", "score", list(range(1, 13)))
    codec = em.Codec.of(fx.qmatrix(spark))
    post = em.posterior_encoded(codec.encode_wide(wide, "resp_id"), codec, fx.start_pi(spark), fx.start_nu(spark), fx.N_ATTR)
    long = post.select("resp_id", r6("loglik"), F.posexplode("p").alias("k", "p"))
    return long.select("resp_id", (F.col("k") + 1).alias("attribute"), r6("p"), "loglik")


_MEAN_POST = f"WITH {sql.RESP},\n{sql.draws(DRAWS)},\n{sql.DRAW_POST},\n{sql.MEAN_POST}"


@query(
    f"""{_MEAN_POST},
{sql.ATTR}
SELECT resp_id, {', '.join(f'max(CASE WHEN attribute = {k} AND p > 0.5 THEN 1 ELSE 0 END) AS strict_{k}, max(CASE WHEN attribute = {k} AND p >= 0.8 THEN 1 ELSE 0 END) AS high_{k}' for k in (1, 2, 3))}
FROM attr GROUP BY 1"""
)
def attribute_class(spark, sf):
    post = mean_post(spark, sf)
    strict = scoring.classify(post, ["strict_1", "strict_2", "strict_3"], inclusive=False)
    high = scoring.classify(post, ["high_1", "high_2", "high_3"], threshold=0.8)
    return strict.join(high, "resp_id")


@query(f"{_MEAN_POST} SELECT resp_id, class_id, round(w, 6) AS prob FROM (SELECT *, rank() OVER (PARTITION BY resp_id ORDER BY w DESC) AS rk FROM post) WHERE rk = 1")
def map_profile(spark, sf):
    return scoring.map_profile(mean_post(spark, sf)).select("resp_id", "class_id", r6("prob"))


def people(spark, sf) -> DataFrame:
    """(resp_id, class_id, theta): known class and a theta from the balance."""
    theta = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("resp_id"), ((F.col("c_acctbal") - 4500) / 2000).alias("theta"))
    return fx.known_classes(spark, sf).join(large(theta), "resp_id")


def targets(spark, sf) -> DataFrame:
    """One target profile and theta per supplier."""
    return fx.read(spark, sf, "supplier").select(
        F.concat(F.lit("era "), F.col("s_suppkey")).alias("name"),
        (F.col("s_suppkey") % 8).cast("int").alias("class_id"),
        ((F.col("s_acctbal") - 4500) / 2000).alias("target_theta"),
    )


_EXEMPLARS = f"""{sql.CLS},
ppl AS (SELECT resp_id, class_id, (c_acctbal - 4500) / 2000 AS theta FROM cls JOIN customer ON c_custkey = resp_id),
tgt AS (SELECT 'era ' || s_suppkey AS name, CAST(s_suppkey % 8 AS INTEGER) AS class_id, (s_acctbal - 4500) / 2000 AS target_theta FROM supplier),
cand AS (SELECT name, class_id, target_theta, resp_id, theta,
  row_number() OVER (PARTITION BY name ORDER BY abs(theta - target_theta), resp_id) AS rn FROM tgt JOIN ppl USING (class_id)),
ex AS (SELECT name, class_id, target_theta, resp_id, theta FROM cand WHERE rn = 1)"""


@query(f"WITH {_EXEMPLARS} SELECT name, class_id, resp_id, round(target_theta, 6) AS target_theta, round(theta, 6) AS theta FROM tgt LEFT JOIN (SELECT name, resp_id, theta FROM ex) e USING (name)")
def exemplars(spark, sf):
    found = scoring.select_exemplars(targets(spark, sf), people(spark, sf))
    return found.select("name", "class_id", "resp_id", r6("target_theta"), r6("theta"))


_UNIQUE_EX = "exu AS (SELECT resp_id, min(name) AS name FROM ex GROUP BY 1)"


@query(
    f"""WITH {_EXEMPLARS},
{_UNIQUE_EX},
lab AS (SELECT p_name || ' ' || p_partkey AS label, row_number() OVER (ORDER BY {sql.u('p_partkey', 1, 43)}, p_partkey) AS rn FROM part),
num AS (SELECT resp_id, row_number() OVER (ORDER BY resp_id) AS rn FROM cls)
SELECT resp_id, coalesce(name, label) AS label FROM num JOIN lab USING (rn) LEFT JOIN exu USING (resp_id)"""
)
def relabel(spark, sf):
    found = scoring.select_exemplars(targets(spark, sf), people(spark, sf)).filter("resp_id IS NOT NULL")
    unique = found.groupBy("resp_id").agg(F.min("name").alias("name"))
    labels = fx.read(spark, sf, "part").select(F.col("p_partkey").alias("label_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("label"))
    return scoring.relabel(fx.known_classes(spark, sf).select("resp_id"), unique, labels, 43)


@query(
    f"""{_MEAN_POST},
{sql.ATTR},
{_EXEMPLARS.replace(sql.CLS + ',', '')},
{_UNIQUE_EX},
got AS (SELECT resp_id, {', '.join(f'max(CASE WHEN attribute = {k} AND p >= 0.5 THEN 1 ELSE 0 END) AS att{k}' for k in (1, 2, 3))} FROM attr GROUP BY 1),
named AS (SELECT exu.resp_id, name, theta, {', '.join(f'CAST((class_id >> {k - 1}) & 1 AS INTEGER) AS b{k}' for k in (1, 2, 3))} FROM exu JOIN ppl USING (resp_id))
SELECT g.resp_id, att1, att2, att3, m.name, round(m.theta, 6) AS theta, o.first_order
FROM got g SEMI JOIN named k ON k.resp_id = g.resp_id
LEFT JOIN named m ON m.resp_id = g.resp_id AND b1 = att1 AND b2 = att2 AND b3 = att3
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) o ON o_custkey = g.resp_id"""
)
def result_table(spark, sf):
    attrs = ["att1", "att2", "att3"]
    classified = scoring.classify(mean_post(spark, sf), attrs)
    found = scoring.select_exemplars(targets(spark, sf), people(spark, sf)).filter("resp_id IS NOT NULL")
    unique = found.groupBy("resp_id").agg(F.min("name").alias("name"), F.first("class_id").alias("class_id"), F.first("theta").alias("theta"))
    bits = [F.expr(f"cast(shiftright(class_id, {k}) & 1 as int) AS {a}") for k, a in enumerate(attrs)]
    chosen = unique.select("resp_id", "name", r6("theta"), *bits)
    catalog = fx.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("resp_id")).agg(F.min("o_orderdate").alias("first_order"))
    return scoring.result_table(classified, chosen, catalog, "resp_id", attrs, "first_order")


# --- long-form sampling of classes and answers ------------------------------------------


@query(
    f"""WITH {sql.RESP},
{sql.draws(DRAWS)},
{sql.DRAW_POST},
race AS (SELECT draw, resp_id, class_id, row_number() OVER (PARTITION BY draw, resp_id
  ORDER BY -ln(greatest({sql.u(sql.fold('resp_id', 'draw'), 'class_id', 83)}, 1.0 / 2147483647)) / exp(lw - ll), class_id) AS rn
  FROM dlw JOIN dmarg USING (draw, resp_id)),
scored AS (SELECT draw, resp_id, item_id, CASE WHEN {sql.u(sql.fold('resp_id', 'draw'), 'item_id', 84)} <= pi THEN 1 ELSE 0 END AS score
  FROM race JOIN draw_pi USING (draw, class_id) WHERE rn = 1)
SELECT draw, score, count(*) AS n FROM (SELECT draw, resp_id, CAST(sum(score) AS INTEGER) AS score FROM scored GROUP BY 1, 2) GROUP BY 1, 2"""
)
def long_form_replicates(spark, sf):
    """The predictive check's steps as separate verbs: posteriors by pattern and draw, a
    many-to-many join that gives respondents x draws rows, a weighted class draw and
    the Bernoulli answers within each row, counts of totals."""
    codec = em.Codec.of(fx.qmatrix(spark))
    pi, nu = fx.draws_pi(spark, DRAWS), fx.draws_nu(spark, DRAWS)
    encoded = codec.encode(fx.responses(spark, sf), "resp_id")
    post = sampling.packed(pd_draws.draw_posterior(encoded.select(*codec.words).distinct(), codec, pi, nu), "w")
    key = F.expr("resp_id + draw * 1000003").alias("key")
    # A respondent becomes a row for each draw: parts are fixed before, and each holds its
    # respondents, by pattern, while the far longer list of draws streams past.
    each = spread(encoded, *codec.words).hint("shuffle_hash").join(post, codec.words).select("draw", key, "w")
    held = sampling.sample_index(each, "w", "key", 83, "class_id")
    forms = pi.groupBy("draw", "class_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "pi")))["pi"].alias("form"))
    asked = lookup_join(held, sampling.packed(forms, "form"), ["draw", "class_id"]).select("draw", "key", "form")
    totals = sampling.bernoulli_total(asked, "form", codec.items, "key", 84, "score")
    return totals.groupBy("draw", "score").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {sql.RESP},
{sql.draws(DRAWS)},
{sql.DRAW_POST}
SELECT resp_id, class_id, round(avg(exp(lw - ll)), 6) AS w FROM dlw JOIN dmarg USING (draw, resp_id) GROUP BY 1, 2"""
)
def draw_mean(spark, sf):
    """Posterior expectation of class probabilities over draws."""
    return mean_post(spark, sf).select("resp_id", F.posexplode("w").alias("class_id", "w")).select("resp_id", "class_id", r6("w"))


# One draw per supplier in place of a fixed number.
SUPPLIER_DRAWS = f"WITH {sql.ITEMS},\n" + sql.draws(DRAWS).replace(
    f"SELECT CAST(range AS INTEGER) AS draw FROM range(1, {DRAWS + 1})", "SELECT CAST(s_suppkey AS INTEGER) AS draw FROM supplier"
)


@query(
    f"""{SUPPLIER_DRAWS}
SELECT item_id, class_id, round(avg(pi), 6) AS pi, round(max(nu), 6) AS nu
FROM draw_pi JOIN (SELECT class_id, avg(nu) AS nu FROM draw_nu GROUP BY 1) USING (class_id) GROUP BY 1, 2"""
)
def draw_mean_parameters(spark, sf):
    """Posterior means of the parameters, from a long table of draws, one per supplier."""
    numbers = fx.supplier_draws(spark, sf).select("draw")
    pi = scoring.draw_mean(fx.jittered_pi(numbers), ["item_id", "class_id"], "pi")
    nu = scoring.draw_mean(fx.jittered_nu(numbers), ["class_id"], "nu")
    return pi.join(nu, "class_id").select("item_id", "class_id", r6("pi"), r6("nu"))


@query(
    f"""{sql.F1_POST}
SELECT c_name AS resp_id, class_id, round(w, 6) AS w FROM post JOIN customer ON c_custkey = resp_id"""
)
def class_posterior_by_name(spark, sf):
    """Respondents known by a text id, in a column of their own name."""
    names = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("resp_id"), "c_name")
    resp = fx.responses(spark, sf).join(large(names), "resp_id").drop("resp_id")
    post = scoring.posterior(resp, fx.start_pi(spark), fx.start_nu(spark), fx.N_ATTR, id_col="c_name")
    return post.select(F.col("c_name").alias("resp_id"), F.posexplode("w").alias("class_id", "w")).select("resp_id", "class_id", r6("w"))


# --- estimation --------------------------------------------------------------------------


@query(
    f"""{sql.F1_POST},
m AS (SELECT item_id, class_id & q_mask AS g, sum(w * score) / sum(w) AS pi FROM resp JOIN items USING (item_id) JOIN post USING (resp_id) GROUP BY 1, 2),
v AS (SELECT class_id, avg(w) AS nu FROM post GROUP BY 1)
SELECT item_id, class_id, round(m.pi, 6) AS pi, round(nu, 6) AS nu, round((SELECT sum(loglik) FROM marg), 4) AS loglik
FROM items CROSS JOIN classes JOIN m USING (item_id) JOIN v USING (class_id) WHERE class_id & q_mask = g"""
)
def em_one_step(spark, sf):
    fit = em.fit_dcm(fx.responses(spark, sf), fx.qmatrix(spark), fx.N_ATTR, max_iter=1, accelerate=False)
    both = fit.pi.join(fit.nu, "class_id")
    return both.select("item_id", "class_id", r6("pi"), r6("nu"), F.lit(round(fit.loglik, 4)).alias("loglik"))


_GROUP = {"lcdm": "class_id & q_mask", "dina": "CAST(class_id & q_mask = q_mask AS INTEGER)", "dino": "CAST(class_id & q_mask <> 0 AS INTEGER)"}


def _em_steps_sql(name: str, steps: int = 3) -> str:
    """EM written out: one block of common tables per iteration."""
    g = _GROUP[name]
    start = "0.2 + 0.6 * bit_count(class_id & q_mask) / bit_count(q_mask)" if name == "lcdm" else f"0.2 + 0.6 * {g}"
    parts = [
        sql.RESP,
        sql.CLASSES,
        f"pi0 AS (SELECT item_id, class_id, {g} AS g, {start} AS pi FROM items, classes)",
        "nu0 AS (SELECT class_id, 0.125 AS nu FROM classes)",
    ]
    for k in range(steps):
        parts.append(
            f"""lw{k} AS (SELECT resp_id, class_id, ln(max(nu)) + sum(CASE WHEN score = 1 THEN ln(pi) ELSE ln(1 - pi) END) AS lw
  FROM resp JOIN pi{k} USING (item_id) JOIN nu{k} USING (class_id) GROUP BY 1, 2),
mg{k} AS (SELECT resp_id, max(lw) + ln(sum(exp(lw - (SELECT max(lw) FROM lw{k})))) + (SELECT max(lw) FROM lw{k}) - max(lw) AS m FROM lw{k} GROUP BY 1),
w{k} AS (SELECT resp_id, class_id, exp(lw - m) AS w FROM lw{k} JOIN mg{k} USING (resp_id)),
up{k} AS (SELECT item_id, g, sum(w * score) / sum(w) AS pi FROM resp JOIN w{k} USING (resp_id) JOIN pi{k} USING (item_id, class_id) GROUP BY 1, 2),
pi{k + 1} AS (SELECT item_id, class_id, g, u.pi FROM pi{k} p JOIN up{k} u USING (item_id, g)),
nu{k + 1} AS (SELECT class_id, avg(w) AS nu FROM w{k} GROUP BY 1)"""
        )
    return (
        f"WITH {', '.join(parts)} SELECT item_id, class_id, round(pi, 6) AS pi, round(nu, 6) AS nu, "
        f"round((SELECT sum(m) FROM mg{steps - 1}), 4) AS loglik FROM pi{steps} JOIN nu{steps} USING (class_id)"
    )


def _em_steps_query(name: str):
    def run(spark, sf):
        fit = em.fit_dcm(fx.responses(spark, sf), fx.qmatrix(spark), fx.N_ATTR, name, max_iter=3, accelerate=False)
        both = fit.pi.join(fit.nu, "class_id")
        return both.select("item_id", "class_id", r6("pi"), r6("nu"), F.lit(round(fit.loglik, 4)).alias("loglik"))

    run.__name__ = f"em_three_steps_{name}"
    query(_em_steps_sql(name))(run)


for _name in _GROUP:
    _em_steps_query(_name)


# One Newton step from the probabilities at hand for an item on two attributes without an
# interaction; t, r by (first, second) attribute held.  EM with such steps has the same optimum.
_CRUM = """ef AS (SELECT item_id, q_mask,
    (SELECT min(k) FROM range(3) b(k) WHERE (q_mask >> k) & 1 = 1) AS k1, (SELECT max(k) FROM range(3) b(k) WHERE (q_mask >> k) & 1 = 1) AS k2
    FROM items WHERE bit_count(q_mask) = 2),
  gr AS (SELECT item_id, (c.class_id >> k1) & 1 AS g1, (c.class_id >> k2) & 1 AS g2, sum(t) AS t, sum(r) AS r, max(c.pi) AS p
    FROM cnt c JOIN ef USING (item_id) GROUP BY 1, 2, 3),
  nw AS (SELECT item_id, sum(t * p * (1 - p)) AS a, sum(g1 * t * p * (1 - p)) AS b, sum(g2 * t * p * (1 - p)) AS c, sum(g1 * g2 * t * p * (1 - p)) AS d,
      sum(r - t * p) AS e, sum(g1 * (r - t * p)) AS f, sum(g2 * (r - t * p)) AS h,
      max(CASE WHEN g1 = 0 AND g2 = 0 THEN ln(p / (1 - p)) END) AS l0, max(CASE WHEN g1 = 1 AND g2 = 0 THEN ln(p / (1 - p)) END) AS l1,
      max(CASE WHEN g1 = 0 AND g2 = 1 THEN ln(p / (1 - p)) END) AS l2 FROM gr GROUP BY 1),
  dt AS (SELECT *, a * (b * c - d * d) - b * (b * c - d * c) + c * (b * d - b * c) AS det FROM nw),
  mv AS (SELECT item_id, l0, l1, l2, (e * (b * c - d * d) - b * (f * c - d * h) + c * (f * d - b * h)) / det AS m0,
      (a * (f * c - d * h) - e * (b * c - d * c) + c * (b * h - f * c)) / det AS m1,
      (a * (b * h - f * d) - b * (b * h - f * c) + e * (b * d - b * c)) / det AS m2 FROM dt),
  two AS (SELECT c.item_id, c.class_id, 1 / (1 + exp(-(l0 + m0 + ((c.class_id >> k1) & 1) * (l1 - l0 + m1) + ((c.class_id >> k2) & 1) * (l2 - l0 + m2)))) AS pi
    FROM cnt c JOIN ef USING (item_id) JOIN mv USING (item_id)),"""


def _em_fit_sql(name: str) -> str:
    """Plain EM as a recursive table over the distinct patterns, until nothing moves."""
    g = _GROUP["lcdm" if name == "crum" else name]
    start = f"0.2 + 0.6 * {g}" if name in ("dina", "dino") else "0.2 + 0.6 * bit_count(class_id & q_mask) / bit_count(q_mask)"
    pi = "coalesce(two.pi, ratio.pi)" if name == "crum" else "ratio.pi"
    pi = f"greatest(least({pi}, 0.999999), 0.000001)"
    return f"""WITH RECURSIVE {sql.RESP},
{sql.CLASSES},
pat AS (SELECT x, count(*) AS n FROM (SELECT resp_id, CAST(sum(score << (item_id - 1)) AS BIGINT) AS x FROM resp GROUP BY 1) GROUP BY 1),
em(it, item_id, class_id, pi, nu, moved) AS (
  SELECT 0, item_id, class_id, CAST({start} AS DOUBLE), CAST(0.125 AS DOUBLE), CAST(1 AS DOUBLE) FROM items, classes
  UNION ALL
  (WITH cur AS (SELECT * FROM em WHERE moved > 1e-11 AND it < 3000),
  lw AS (SELECT x, n, class_id, ln(max(nu)) + sum(CASE WHEN (x >> (item_id - 1)) & 1 = 1 THEN ln(pi) ELSE ln(1 - pi) END) AS lw FROM pat, cur GROUP BY 1, 2, 3),
  w AS (SELECT x, class_id, n * exp(lw - max(lw) OVER p) / sum(exp(lw - top)) OVER p AS w
    FROM (SELECT *, max(lw) OVER (PARTITION BY x) AS top FROM lw) WINDOW p AS (PARTITION BY x)),
  cnt AS (SELECT c.item_id, q_mask, c.class_id, max(c.pi) AS pi, sum(w) AS t, sum(CASE WHEN (x >> (c.item_id - 1)) & 1 = 1 THEN w ELSE 0 END) AS r
    FROM cur c JOIN items USING (item_id) JOIN w USING (class_id) GROUP BY 1, 2, 3),
  {_CRUM if name == 'crum' else ''}
  ratio AS (SELECT item_id, class_id, sum(r) OVER g / sum(t) OVER g AS pi FROM cnt WINDOW g AS (PARTITION BY item_id, {g})),
  shares AS (SELECT class_id, sum(w) / (SELECT sum(n) FROM pat) AS nu FROM w GROUP BY 1),
  new AS (SELECT c.it + 1 AS it, c.item_id, c.class_id, {pi} AS pi, s.nu, greatest(abs({pi} - c.pi), abs(s.nu - c.nu)) AS moved
    FROM cur c JOIN ratio USING (item_id, class_id) JOIN shares s USING (class_id) {'LEFT JOIN two USING (item_id, class_id)' if name == 'crum' else ''})
  SELECT it, item_id, class_id, pi, nu, max(moved) OVER () FROM new)),
fit AS (SELECT * FROM em WHERE it = (SELECT max(it) FROM em)),
ll AS (SELECT x, n, class_id, ln(max(nu)) + sum(CASE WHEN (x >> (item_id - 1)) & 1 = 1 THEN ln(pi) ELSE ln(1 - pi) END) AS lw FROM pat, fit GROUP BY 1, 2, 3),
one AS (SELECT x, max(n) AS n, max(lw) AS top FROM ll GROUP BY 1),
mll AS (SELECT sum(n * m) AS loglik FROM (SELECT x, max(one.n) AS n, max(top) + ln(sum(exp(lw - top))) AS m FROM ll JOIN one USING (x) GROUP BY 1))"""


EM_TOL = {"tol": 1e-8, "step_tol": 1e-9}


def _em_query(name: str):
    def run(spark, sf):
        fit = em.fit_dcm(fx.responses(spark, sf), fx.qmatrix(spark), fx.N_ATTR, name, **EM_TOL)
        both = fit.pi.join(fit.nu, "class_id")
        return both.select("item_id", "class_id", F.round("pi", 5).alias("pi"), F.round("nu", 5).alias("nu"), F.lit(round(fit.loglik, 4)).alias("loglik"))

    run.__name__ = f"em_fit_{name}"
    query(f"{_em_fit_sql(name)} SELECT item_id, class_id, round(pi, 5) AS pi, round(nu, 5) AS nu, round(loglik, 4) AS loglik FROM fit, mll")(run)


for _name in model.MODELS:
    _em_query(_name)


def _hash_normal(r: str, k: str, salt: int) -> str:
    return f"(sqrt(-2 * ln(greatest({sql.u(r, k, salt)}, 1.0 / 2147483647))) * cos(2 * pi() * {sql.u(r, k, salt + 1)}))"


# Scores at the estimate, their information, its Cholesky factor column by column, the
# factor's inverse row by row, and draws from both.
_DRAWN = f"""{_em_fit_sql('lcdm')},
par AS (SELECT CAST(row_number() OVER (ORDER BY item_id, g) - 1 AS INTEGER) AS p, item_id, g, pi
  FROM (SELECT item_id, class_id & q_mask AS g, max(pi) AS pi FROM fit JOIN items USING (item_id) GROUP BY 1, 2)),
shr AS (SELECT CAST((SELECT count(*) FROM par) + class_id - 1 AS INTEGER) AS p, class_id, nu FROM (SELECT DISTINCT class_id, nu FROM fit) WHERE class_id > 0),
wt AS (SELECT x, max(n) OVER (PARTITION BY x) AS n, class_id, exp(lw - top) / sum(exp(lw - top)) OVER (PARTITION BY x) AS w
  FROM (SELECT *, max(lw) OVER (PARTITION BY x) AS top FROM ll)),
score AS (
  SELECT x, max(n) AS n, p, sum(w) * (max((x >> (item_id - 1)) & 1) - max(pi)) AS s
  FROM wt JOIN items ON true JOIN par USING (item_id) WHERE class_id & q_mask = g GROUP BY x, p
  UNION ALL SELECT x, n, p, w - nu FROM wt JOIN shr USING (class_id)),
info AS (SELECT a.p AS i, b.p AS j, sum(a.n * a.s * b.s) + CASE WHEN a.p = b.p THEN 0.001 ELSE 0 END AS v FROM score a JOIN score b USING (x) GROUP BY 1, 2),
chol(k, i, j, v) AS (
  SELECT 0, i, j, v FROM info
  UNION ALL
  (WITH c AS (SELECT * FROM chol), l AS (SELECT i, v / sqrt((SELECT v FROM c WHERE i = k AND j = k)) AS l FROM c WHERE j = k)
  SELECT c.k + 1, c.i, c.j, c.v - a.l * b.l FROM c JOIN l a ON a.i = c.i JOIN l b ON b.i = c.j WHERE c.i > c.k AND c.j > c.k)),
root AS (SELECT c.i, c.k AS j, c.v / sqrt(d.v) AS v FROM chol c JOIN chol d ON d.k = c.k AND d.i = c.k AND d.j = c.k WHERE c.j = c.k),
inv(k, i, j, v) AS (
  SELECT 0, 0, 0, 1 / v FROM root WHERE i = 0 AND j = 0
  UNION ALL
  (WITH m AS (SELECT * FROM inv), r AS (SELECT root.* FROM root WHERE i = (SELECT max(k) + 1 FROM m)),
  made AS (SELECT m.j, -sum(r.v * m.v) / (SELECT v FROM r WHERE i = j) AS v FROM m JOIN r ON r.j = m.i GROUP BY 1)
  SELECT k + 1, i, j, v FROM m WHERE EXISTS (FROM r)
  UNION ALL SELECT (SELECT max(k) + 1 FROM m), (SELECT max(k) + 1 FROM m), j, v FROM made
  UNION ALL SELECT i, i, i, 1 / v FROM r WHERE i = j)),
back AS (SELECT i, j, v FROM inv WHERE k = (SELECT max(k) FROM inv)),
drw AS (SELECT CAST(range AS INTEGER) AS draw FROM range(1, 501)),
noise AS (SELECT draw, q.i AS q, {_hash_normal('draw', 'q.i', 89)} AS z FROM drw, (SELECT DISTINCT i FROM back) q),
theta AS (SELECT draw, back.j AS p, sum(back.v * z) AS dev FROM noise JOIN back ON back.i = noise.q GROUP BY 1, 2),
cells AS (SELECT draw, par.item_id, c.class_id, 1 / (1 + exp(-(ln(par.pi / (1 - par.pi)) + dev))) AS pi
  FROM theta JOIN par USING (p) JOIN items USING (item_id), classes c WHERE c.class_id & q_mask = g),
lognu AS (SELECT draw, class_id, ln(nu / (SELECT max(nu) FROM fit WHERE class_id = 0)) + dev AS v FROM theta JOIN shr USING (p) UNION ALL SELECT draw, 0, 0 FROM drw),
shares2 AS (SELECT draw, class_id, exp(v) / sum(exp(v)) OVER (PARTITION BY draw) AS nu FROM lognu)"""


@query(
    f"""{_DRAWN}
SELECT c.item_id, c.class_id, round(avg(c.pi), 4) AS mean, round(stddev_samp(c.pi), 4) AS sd, round(avg(s.nu), 4) AS mean_nu, round(stddev_samp(s.nu), 4) AS sd_nu
FROM cells c JOIN shares2 s USING (draw, class_id) GROUP BY 1, 2"""
)
def approx_draws(spark, sf):
    """Mean and spread of 500 normal-approximation draws of every probability and share."""
    codec = em.Codec.of(fx.qmatrix(spark))
    patterns = em.pattern_table(fx.responses(spark, sf), codec)
    fit = em.fit_dcm(fx.responses(spark, sf), fx.qmatrix(spark), fx.N_ATTR, patterns=patterns, **EM_TOL)
    made = pd_draws.approx_draws(fit, patterns, 500, 89)
    spread = lambda t, keys, c, a, b: t.groupBy(*keys).agg(F.round(F.avg(c), 4).alias(a), F.round(F.stddev_samp(c), 4).alias(b))
    cells = spread(made.pi, ["item_id", "class_id"], "pi", "mean", "sd")
    return cells.join(spread(made.nu, ["class_id"], "nu", "mean_nu", "sd_nu"), "class_id")


# --- item-response companion ---------------------------------------------------------------

_IRT = f"""SELECT s_suppkey AS item, 0.7 + (3.0 - 0.7) * {sql.u('s_suppkey', 1, 61)} AS a, -1.2 + (1.2 - -1.2) * {sql.u('s_suppkey', 2, 61)} AS b FROM supplier"""


@query(
    f"""WITH it AS ({_IRT})
SELECT item, CAST(range AS INTEGER) AS node, round(CAST(-3 + range * 0.01 AS DOUBLE), 6) AS theta, round(a * ((-3 + range * 0.01) - b), 6) AS log_odds,
  round(1 / (1 + exp(-(a * ((-3 + range * 0.01) - b)))), 6) AS prob_1, round(1 - 1 / (1 + exp(-(a * ((-3 + range * 0.01) - b)))), 6) AS prob_0
FROM it, range(601)"""
)
def icc_grid(spark, sf):
    return irt.icc_grid(fx.irt_items(spark, sf)).select("item", "node", r6("theta"), r6("log_odds"), r6("prob_1"), r6("prob_0"))


_CURVES = f"curves AS (SELECT item_id, 0.7 + (2.0 - 0.7) * {sql.u('item_id', 1, 67)} AS a, -1.5 + (1.0 - -1.5) * {sql.u('item_id', 2, 67)} AS b FROM items)"


@query(
    f"""WITH {sql.RESP},
{_CURVES},
ll AS (SELECT resp_id, range AS node, sum(CASE WHEN score = 1 THEN ln(1 / (1 + exp(-(a * ((-3 + range * 0.01) - b)))))
  ELSE ln(1 - 1 / (1 + exp(-(a * ((-3 + range * 0.01) - b))))) END) AS ll FROM resp JOIN curves USING (item_id), range(601) GROUP BY 1, 2),
pk AS (SELECT resp_id, node, ll, row_number() OVER (PARTITION BY resp_id ORDER BY ll DESC, node) AS rn FROM ll)
SELECT resp_id, round(CAST(-3 + node * 0.01 AS DOUBLE), 6) AS theta, round(exp(ll), 9) AS likelihood FROM pk WHERE rn = 1"""
)
def theta_grid_score(spark, sf):
    best = irt.theta_grid_score(fx.responses(spark, sf), fx.test_curves(spark), ["resp_id"])
    return best.select("resp_id", r6("theta"), F.round("likelihood", 9).alias("likelihood"))


@query(
    f"""WITH {sql.RESP},
{_CURVES},
nodes AS (SELECT -6 + range * 0.2 AS t, exp(-0.5 * (-6 + range * 0.2) * (-6 + range * 0.2)) AS g FROM range(61)),
ll AS (SELECT resp_id, t, g, sum(CASE WHEN score = 1 THEN -ln(1 + exp(-(a * t - a * b))) ELSE -ln(1 + exp(a * t - a * b)) END) AS ll
  FROM resp JOIN curves USING (item_id), nodes GROUP BY 1, 2, 3)
SELECT resp_id, round(sum(t * g * exp(ll)) / sum(g * exp(ll)), 5) AS theta FROM ll GROUP BY 1"""
)
def eap_theta(spark, sf):
    items = fx.test_curves(spark).select("item_id", "a", (-F.col("a") * F.col("b")).alias("d"))
    return irt.eap_theta(fx.responses(spark, sf), items).select("resp_id", F.round("theta", 5).alias("theta"))


def _quadrature(step: float) -> str:
    """Integrals over ability by an even grid so fine that its rule is exact to rounding."""
    n = round(16 / step)
    return f"""nodes AS (SELECT -8 + range * {step} AS t, exp(-0.5 * (-8 + range * {step}) * (-8 + range * {step})) * {step} / sqrt(2 * pi()) AS g FROM range({n + 1})),
pat AS (SELECT x, count(*) AS n FROM (SELECT resp_id, CAST(sum(score << (item_id - 1)) AS BIGINT) AS x FROM resp GROUP BY 1) GROUP BY 1)"""


@query(
    f"""WITH {sql.RESP},
{_CURVES},
{_quadrature(0.05)},
lw AS (SELECT x, n, t, ln(max(g)) + sum(CASE WHEN (x >> (item_id - 1)) & 1 = 1 THEN -ln(1 + exp(-a * (t - b))) ELSE -ln(1 + exp(a * (t - b))) END) AS lw
  FROM pat, nodes, curves GROUP BY 1, 2, 3),
tp AS (SELECT *, max(lw) OVER (PARTITION BY x) AS top FROM lw),
w AS (SELECT x, n, t, n * exp(lw - top) / sum(exp(lw - top)) OVER (PARTITION BY x) AS w FROM tp),
ll AS (SELECT sum(n * m) AS loglik FROM (SELECT x, max(n) AS n, max(top) + ln(sum(exp(lw - top))) AS m FROM tp GROUP BY 1)),
c AS (SELECT item_id, w, t, ((x >> (item_id - 1)) & 1) - 1 / (1 + exp(-a * (t - b))) AS e,
  1 / (1 + exp(-a * (t - b))) * (1 - 1 / (1 + exp(-a * (t - b)))) AS v FROM w, curves)
SELECT item_id, round(sum(w * e * t), 4) AS e_theta, round(sum(w * e), 4) AS e, round(sum(w * v * t * t), 4) AS v_theta2, round(sum(w * v * t), 4) AS v_theta,
  round(sum(w * v), 4) AS v, round(max(loglik), 4) AS loglik FROM c, ll GROUP BY 1"""
)
def curve_sums(spark, sf):
    """What one step of the curves' estimation adds up, at given curves."""
    rows = fx.test_curves(spark).orderBy("item_id").collect()
    a, d = np.array([r.a for r in rows]), np.array([-r.a * r.b for r in rows])
    codec = em.Codec([r.item_id for r in rows])
    patterns = em.pattern_table(fx.responses(spark, sf), codec)
    sums, loglik = em.curve_sums(patterns, codec, a, d, em.n_tasks(patterns))
    names = ["e_theta", "e", "v_theta2", "v_theta", "v"]
    cells = [(i, *map(float, v), loglik) for i, v in zip(codec.items, sums.T, strict=True)]
    made = spark.createDataFrame(cells, "item_id int, " + ", ".join(f"{c} double" for c in [*names, "loglik"]))
    return made.select("item_id", *[F.round(c, 4).alias(c) for c in [*names, "loglik"]])


@query(None)
def fit_2pl(spark, sf):
    fit = em.fit_2pl(fx.responses(spark, sf), list(range(1, 13)))
    return fit.items.withColumns({"loglik": F.lit(fit.loglik), "n_iter": F.lit(fit.n_iter)})

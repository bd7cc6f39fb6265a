"""Queries of model evaluation: predictive checks, margins, information
criteria and reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.catalog import fragments as sql
from masterline.catalog.people import _MEAN_POST, DRAWS, EM_TOL, _em_fit_sql, mean_post
from masterline.catalog.verbs import r6
from masterline.operators import aggregates, information, limited_fit, ppmc, reliability
from masterline.operators.patterns import Codec
from masterline.plans import em
from masterline.plans.lineage import cut
from masterline.sources import fixtures as fx

QUERIES: dict[str, tuple] = {}
SALT = 47


def query(oracle: str | None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, oracle)
        return fn

    return register


def form(spark: SparkSession) -> Codec:
    return Codec.of(fx.qmatrix(spark))


def f1_people(spark, sf) -> DataFrame:
    return ppmc.encode_people(fx.responses(spark, sf), form(spark))


def f1_patterns(spark, sf) -> DataFrame:
    codec = form(spark)
    return codec.count(codec.encode(fx.responses(spark, sf), "resp_id"))


def raw_scores(spark, people: DataFrame) -> DataFrame:
    return ppmc.ppmc_raw_scores(people, form(spark), fx.draws_pi(spark, DRAWS), fx.draws_nu(spark, DRAWS), SALT)


_REP = f"WITH {sql.RESP},\n{sql.draws(DRAWS)},\n{sql.replicates(SALT)}"
_RAW = f"""{_REP},
raw AS (SELECT draw, score, count(*) AS n FROM (SELECT draw, resp_id, CAST(sum(score) AS INTEGER) AS score FROM rep GROUP BY 1, 2) GROUP BY 1, 2),
expd AS (SELECT score, avg(n) AS exp FROM raw GROUP BY 1),
obs AS (SELECT score, count(*) AS n FROM (SELECT resp_id, CAST(sum(score) AS INTEGER) AS score FROM resp GROUP BY 1) GROUP BY 1),
chisq AS (
  SELECT d.draw, sum((coalesce(n, 0) - exp) * (coalesce(n, 0) - exp) / exp) AS chisq
  FROM (SELECT DISTINCT draw FROM raw) d CROSS JOIN expd LEFT JOIN raw ON raw.draw = d.draw AND raw.score = expd.score GROUP BY 1),
obsq AS (
  SELECT CASE WHEN count(*) = count(exp) THEN sum((coalesce(n, 0) - exp) * (coalesce(n, 0) - exp) / exp) END AS chisq
  FROM obs FULL JOIN expd USING (score))"""


@query(f"{_RAW} SELECT draw, score, n FROM raw")
def ppmc_raw_scores(spark, sf):
    return raw_scores(spark, f1_people(spark, sf))


_NOT_ASKED = "resp_id % 2 = 0 AND item_id > 6"


@query(
    _RAW.replace("AS score FROM truth)", f"AS score FROM truth WHERE NOT ({_NOT_ASKED}))")
    .replace("FROM held JOIN draw_pi USING (draw, class_id))", f"FROM held JOIN draw_pi USING (draw, class_id) WHERE NOT ({_NOT_ASKED}))")
    + " SELECT draw, score, n FROM raw"
)
def ppmc_raw_scores_missing(spark, sf):
    """Every second respondent was not given items 7 to 12."""
    resp = fx.responses(spark, sf).filter(f"NOT ({_NOT_ASKED})")
    return raw_scores(spark, ppmc.encode_people(resp, form(spark)))


@query(f"{_RAW} SELECT score, round(exp, 6) AS n, round((SELECT sum(n) FROM raw r WHERE r.score = expd.score) / {DRAWS}.0, 6) AS n_all FROM expd")
def score_expected(spark, sf):
    raw = raw_scores(spark, f1_people(spark, sf))
    every = ppmc.expected_scores(raw, "all").select("score", F.round("n", 6).alias("n_all"))
    return ppmc.expected_scores(raw).select("score", r6("n")).join(every, "score")


@query(f"WITH {sql.RESP} SELECT score, count(*) AS n FROM (SELECT resp_id, CAST(sum(score) AS INTEGER) AS score FROM resp GROUP BY 1) GROUP BY 1")
def score_observed(spark, sf):
    return ppmc.observed_scores(fx.responses(spark, sf))


@query(f"{_RAW} SELECT draw, round(chisq, 6) AS chisq FROM chisq")
def ppmc_chisq(spark, sf):
    raw = raw_scores(spark, f1_people(spark, sf))
    return ppmc.ppmc_chisq(raw, ppmc.expected_scores(raw)).select("draw", r6("chisq"))


@query(f"{_RAW} SELECT floor(ceil(chisq / 2) - 1) * 2.0 AS lo, ceil(chisq / 2) * 2.0 AS hi, count(*) AS n FROM chisq GROUP BY 1, 2")
def chisq_histogram(spark, sf):
    raw = raw_scores(spark, f1_people(spark, sf))
    return aggregates.histogram(ppmc.ppmc_chisq(raw, ppmc.expected_scores(raw)), "chisq")


@query(f"{_RAW} SELECT round(chisq, 6) AS chisq FROM obsq")
def obs_chisq(spark, sf):
    people = f1_people(spark, sf)
    expected = ppmc.expected_scores(raw_scores(spark, people))
    return ppmc.observed_chisq(ppmc.observed_scores_encoded(people, form(spark)), expected).select(r6("chisq"))


@query(
    f"""{_RAW}, p AS (SELECT avg(CASE WHEN chisq.chisq > obsq.chisq THEN 1.0 ELSE 0.0 END) AS ppp FROM chisq, obsq)
SELECT round(ppp, 6) AS ppp, ppp > 0.025 AND ppp < 0.975 AS acceptable FROM p"""
)
def ppp(spark, sf):
    people = f1_people(spark, sf)
    raw = raw_scores(spark, people)
    expected = ppmc.expected_scores(raw)
    observed = ppmc.observed_chisq(ppmc.observed_scores_encoded(people, form(spark)), expected)
    return ppmc.ppp(ppmc.ppmc_chisq(raw, expected), observed).select(r6("ppp"), "acceptable")


@query(
    f"""{_REP},
{sql.MEAN_POST},
best AS (SELECT resp_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY resp_id ORDER BY w DESC, class_id) AS rn FROM post) WHERE rn = 1),
obs AS (SELECT item_id, class_id, avg(score) AS obs FROM resp JOIN best USING (resp_id) GROUP BY 1, 2),
r AS (SELECT draw, item_id, class_id, avg(score) AS rep FROM rep GROUP BY 1, 2, 3)
SELECT item_id, class_id, round(max(obs), 6) AS obs, round(avg(rep), 6) AS rep_mean, round(quantile_cont(rep, 0.025), 6) AS rep_low,
  round(quantile_cont(rep, 0.975), 6) AS rep_high, round(avg(CASE WHEN rep > obs THEN 1.0 WHEN rep <= obs THEN 0.0 END), 6) AS ppp
FROM r LEFT JOIN obs USING (item_id, class_id) GROUP BY 1, 2"""
)
def ppmc_conditional(spark, sf):
    codec, pi, nu = form(spark), fx.draws_pi(spark, DRAWS), fx.draws_nu(spark, DRAWS)
    people = f1_people(spark, sf)
    replicated = ppmc.replicated_conditional(people, codec, pi, nu, SALT)
    observed = ppmc.observed_conditional(people, codec, pi, nu, fx.N_ATTR)
    out = ppmc.ppmc_conditional(replicated, observed)
    return out.select("item_id", "class_id", *[r6(c) for c in ("obs", "rep_mean", "rep_low", "rep_high", "ppp")])


_F2 = (
    "f2 AS (SELECT c_custkey AS resp_id, item_id, CASE WHEN coalesce(n, 0) >= 2 THEN 1 ELSE 0 END AS score FROM customer CROSS JOIN "
    "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(fx.PRIORITIES, 1)) + ") k(item_id, pr) "
    "LEFT JOIN (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) o ON o_custkey = c_custkey AND o_orderpriority = pr)"
)


def _pairs(table: str, by: str = "") -> str:
    same = f" AND a.{by} = b.{by}" if by else ""
    lead = f"a.{by}, " if by else ""
    return f"""SELECT {lead}a.item_id AS item_i, b.item_id AS item_j, CAST(sum(a.score * b.score) AS BIGINT) AS n11,
  CAST(sum(a.score * (1 - b.score)) AS BIGINT) AS n10, CAST(sum((1 - a.score) * b.score) AS BIGINT) AS n01,
  CAST(sum((1 - a.score) * (1 - b.score)) AS BIGINT) AS n00
  FROM {table} a JOIN {table} b ON a.resp_id = b.resp_id{same} AND a.item_id < b.item_id GROUP BY {lead}item_i, item_j"""


@query(
    f"""WITH {_F2}, p AS ({_pairs('f2')})
SELECT *, round(CASE WHEN n10 * n01 > 0 THEN CAST(n11 AS DOUBLE) * n00 / (CAST(n10 AS DOUBLE) * n01) END, 6) AS odds_ratio FROM p"""
)
def observed_odds_ratio(spark, sf):
    codec = Codec(range(1, 6))
    patterns = codec.count(codec.encode(fx.observed_behaviour(spark, sf), "resp_id"))
    return ppmc.observed_odds_ratio(patterns, codec).withColumn("odds_ratio", F.round("odds_ratio", 6))


_OR = "CASE WHEN n10 * n01 > 0 THEN CAST(n11 AS DOUBLE) * n00 / (CAST(n10 AS DOUBLE) * n01) END"


@query(
    f"""{_REP},
o AS (SELECT item_i, item_j, {_OR} AS obs FROM ({_pairs('resp')})),
r AS (SELECT draw, item_i, item_j, {_OR} AS rep FROM ({_pairs('rep', 'draw')}))
SELECT item_i, item_j, round(max(obs), 6) AS obs, round(avg(rep), 6) AS rep_mean, round(quantile_cont(rep, 0.025), 6) AS rep_low,
  round(quantile_cont(rep, 0.975), 6) AS rep_high, count(*) - count(rep) AS n_undefined,
  round(avg(CASE WHEN rep > obs THEN 1.0 WHEN rep <= obs THEN 0.0 END), 6) AS ppp
FROM r LEFT JOIN o USING (item_i, item_j) GROUP BY 1, 2"""
)
def ppmc_odds_ratio(spark, sf):
    codec = form(spark)
    people = f1_people(spark, sf)
    replicated = ppmc.replicated_odds_ratio(people, codec, fx.draws_pi(spark, DRAWS), fx.draws_nu(spark, DRAWS), SALT)
    out = ppmc.ppmc_odds_ratio(replicated, ppmc.observed_odds_ratio(codec.count(people), codec))
    return out.select("item_i", "item_j", "n_undefined", *[r6(c) for c in ("obs", "rep_mean", "rep_low", "rep_high", "ppp")])


@query(
    f"""WITH {sql.RESP}, p AS ({_pairs('resp')}), t AS (SELECT *, n11 + n10 + n01 + n00 AS n FROM p)
SELECT item_i, item_j, n, round((n11 + n10) / n, 6) AS p_i, round((n11 + n01) / n, 6) AS p_j, round(n11 / n, 6) AS p_ij FROM t"""
)
def pair_margins(spark, sf):
    out = limited_fit.pair_margins(f1_patterns(spark, sf), form(spark))
    return out.select("item_i", "item_j", "n", r6("p_i"), r6("p_j"), r6("p_ij"))


def _m2_fits(spark, sf) -> list:
    codec, q = form(spark), fx.qmatrix(spark)
    resp = fx.responses(spark, sf)
    patterns = em.pattern_table(resp, codec)
    out = []
    for name in ("lcdm", "dina"):
        fit = em.fit_dcm(resp, q, fx.N_ATTR, name, patterns=patterns, **EM_TOL)
        out.append((name, limited_fit.fit_m2(patterns, fit.pi, fit.nu, fit.q_masks, fx.N_ATTR, name)))
    return out


@query(None)
def m2(spark, sf):
    """M2 of the general model and of its conjunctive restriction."""
    rows = [(name, *map(float, got[:5]), got.acceptable) for name, got in _m2_fits(spark, sf)]
    return spark.createDataFrame(rows, "model string, m2 double, df double, p_value double, rmsea double, srmsr double, acceptable boolean")


@query(
    f"""{sql.F1_POST}, p AS ({_pairs('resp')}),
o AS (SELECT item_i, item_j, n11 + n10 + n01 + n00 AS n, (n11 + n10) / (n11 + n10 + n01 + n00) AS a, (n11 + n01) / (n11 + n10 + n01 + n00) AS b,
  n11 / (n11 + n10 + n01 + n00) AS ab FROM p),
m AS (SELECT x.item_id AS item_i, y.item_id AS item_j, sum(x.pi * nu) AS a, sum(y.pi * nu) AS b, sum(x.pi * y.pi * nu) AS ab
  FROM pi x JOIN pi y ON x.class_id = y.class_id AND x.item_id < y.item_id JOIN nu ON nu.class_id = x.class_id GROUP BY 1, 2)
SELECT o.item_i, o.item_j, o.n, round(o.ab, 6) AS p_ij, round(m.ab, 6) AS model_ij,
  round((o.ab - o.a * o.b) / sqrt(o.a * (1 - o.a) * o.b * (1 - o.b)), 6) AS r_ij,
  round((m.ab - m.a * m.b) / sqrt(m.a * (1 - m.a) * m.b * (1 - m.b)), 6) AS model_r_ij
FROM o JOIN m USING (item_i, item_j)"""
)
def margin_residuals(spark, sf):
    """Observed and modelled second-order margins at given parameters."""
    out = limited_fit.margin_residuals(f1_patterns(spark, sf), form(spark), fx.start_pi(spark), fx.start_nu(spark))
    return out.select("item_i", "item_j", "n", *[r6(c) for c in ("p_ij", "model_ij", "r_ij", "model_r_ij")])


_FITTED = {name: _em_fit_sql(name) for name in ("lcdm", "dina")}


def _srmsr_sql(name: str) -> str:
    groups = {"lcdm": "1 << bit_count(q_mask)", "dina": "2"}[name]
    return f"""(SELECT '{name}' AS model, 78 - 7 - CAST((SELECT sum({groups}) FROM items) AS INTEGER) AS df, round(sqrt(avg((r - mr) * (r - mr))), 6) AS srmsr FROM (
  {_FITTED[name]},
  p AS ({_pairs('resp')}),
  o AS (SELECT item_i, item_j, n11 / t AS ab, (n11 + n10) / t AS a, (n11 + n01) / t AS b FROM (SELECT *, n11 + n10 + n01 + n00 AS t FROM p)),
  m AS (SELECT x.item_id AS item_i, y.item_id AS item_j, sum(x.pi * x.nu) AS a, sum(y.pi * x.nu) AS b, sum(x.pi * y.pi * x.nu) AS ab
    FROM fit x JOIN fit y ON x.class_id = y.class_id AND x.item_id < y.item_id GROUP BY 1, 2)
  SELECT (o.ab - o.a * o.b) / sqrt(o.a * (1 - o.a) * o.b * (1 - o.b)) AS r, (m.ab - m.a * m.b) / sqrt(m.a * (1 - m.a) * m.b * (1 - m.b)) AS mr
  FROM o JOIN m USING (item_i, item_j)))"""


@query(f"WITH {sql.ITEMS} {_srmsr_sql('lcdm')} UNION ALL {_srmsr_sql('dina')}")
def m2_srmsr(spark, sf):
    """Degrees of freedom and SRMSR of two fitted models."""
    got = [(name, fit.df, round(fit.srmsr, 6)) for name, fit in _m2_fits(spark, sf)]
    return spark.createDataFrame(got, "model string, df int, srmsr double")


# --- relative fit -------------------------------------------------------------------

_DLL = f"WITH {sql.RESP},\n{sql.draws(DRAWS)},\n{sql.DRAW_POST}"


def pointwise(spark, sf, n: int = DRAWS) -> DataFrame:
    return information.pointwise_loglik(f1_patterns(spark, sf), form(spark), fx.draws_pi(spark, n), fx.draws_nu(spark, n))


@query(f"{_DLL} SELECT resp_id, draw, round(ll, 6) AS ll FROM dmarg")
def pointwise_loglik(spark, sf):
    codec = form(spark)
    people = codec.encode(fx.responses(spark, sf), "resp_id")
    return information.by_respondent(pointwise(spark, sf), people, codec).select("resp_id", "draw", r6("ll"))


_WAIC = """top AS (SELECT resp_id, max(ll) AS top FROM dmarg GROUP BY 1),
pw AS (SELECT resp_id, max(top) + ln(avg(exp(ll - top))) - var_samp(ll) AS elpd, var_samp(ll) AS p FROM dmarg JOIN top USING (resp_id) GROUP BY 1)"""


@query(
    f"""{_DLL},
{_WAIC}
SELECT round(sum(elpd), 4) AS elpd_waic, round(sqrt(count(*) * var_samp(elpd)), 4) AS se, round(sum(p), 4) AS p_waic, round(-2 * sum(elpd), 4) AS waic FROM pw"""
)
def waic(spark, sf):
    out = information.waic(pointwise(spark, sf))
    return out.select(*[F.round(c, 4).alias(c) for c in ("elpd_waic", "se", "p_waic", "waic")])


def _psis_sql(source: str, prefix: str) -> str:
    """{prefix}loo(resp_id, elpd, p, k) from {source}(resp_id, draw, ll), once per answer pattern."""
    p = prefix
    return f"""{p}rows AS (SELECT x AS pid, draw, ll FROM {source} JOIN pid USING (resp_id) WHERE resp_id = rid),
{p}raw AS (SELECT pid, draw, ll, -ll - max(-ll) OVER (PARTITION BY pid) AS lw FROM {p}rows),
{p}num AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY lw, draw) AS rn, count(*) OVER (PARTITION BY pid) AS s FROM {p}raw),
{p}tl AS (SELECT *, CAST(ceil(least(s / 5.0, 3 * sqrt(s))) AS INTEGER) AS tail FROM {p}num),
{p}low AS (SELECT pid, exp(lw) AS low FROM {p}tl WHERE rn = s - tail),
{p}exc AS (SELECT pid, rn - s + tail AS t, tail AS n, exp(lw) - low AS e FROM {p}tl JOIN {p}low USING (pid) WHERE rn > s - tail),
{p}ends AS (SELECT pid, max(n) AS n, 30 + CAST(floor(sqrt(max(n))) AS INTEGER) AS m, max(e) AS last, max(CASE WHEN t = greatest(n // 4 - 1, 0) + 1 THEN e END) AS q FROM {p}exc GROUP BY 1),
{p}grid AS (SELECT pid, n, j, (1 - sqrt(m / (j - 0.5))) / (3 * q) + 1 / last AS b FROM {p}ends, range(1, 200) r(j) WHERE j <= m),
{p}prof AS (SELECT g.pid, g.j, max(g.n) AS n, max(b) AS b, sum(ln(1 - b * e)) / max(g.n) AS k FROM {p}grid g JOIN {p}exc USING (pid) GROUP BY 1, 2),
{p}fitted AS (SELECT pid, b, n * (ln(-b / k) - k - 1) AS f, max(n * (ln(-b / k) - k - 1)) OVER (PARTITION BY pid) AS most FROM {p}prof),
{p}best AS (SELECT pid, sum(b * exp(f - most)) / sum(exp(f - most)) AS best FROM {p}fitted GROUP BY 1),
{p}mean AS (SELECT pid, max(best) AS best, max(n) AS n, sum(ln(1 - best * e)) / max(n) AS mean FROM {p}exc JOIN {p}best USING (pid) GROUP BY 1),
{p}gpd AS (SELECT pid, (n * mean + 5) / (n + 10) AS k, -mean / best AS sigma, low FROM {p}mean JOIN {p}low USING (pid)),
{p}sm AS (SELECT pid, ll, k, CASE WHEN rn <= s - tail THEN lw ELSE least(0, ln(low + sigma * (exp(-k * ln(1 - (rn - s + tail - 0.5) / tail)) - 1) / k)) END AS lw
  FROM {p}tl JOIN {p}gpd USING (pid)),
{p}tops AS (SELECT pid, max(lw + ll) AS a, max(lw) AS b, max(ll) AS c FROM {p}sm GROUP BY 1),
{p}one AS (SELECT pid, max(a) + ln(sum(exp(lw + ll - a))) - max(b) - ln(sum(exp(lw - b))) AS elpd, max(c) + ln(avg(exp(ll - c))) AS lppd, max(k) AS k
  FROM {p}sm JOIN {p}tops USING (pid) GROUP BY 1),
{p}loo AS (SELECT resp_id, elpd, lppd - elpd AS p, k FROM {p}one JOIN pid ON x = pid)"""


_PID = """pid AS (SELECT resp_id, x, min(resp_id) OVER (PARTITION BY x) AS rid
  FROM (SELECT resp_id, CAST(sum(score << (item_id - 1)) AS BIGINT) AS x FROM resp GROUP BY 1))"""


@query(
    f"""{_DLL}, {_PID}, {_psis_sql('dmarg', 'a')}
SELECT round(sum(elpd), 4) AS elpd_loo, round(sqrt(count(*) * var_samp(elpd)), 4) AS se, round(sum(p), 4) AS p_loo, round(max(k), 4) AS max_k, round(-2 * sum(elpd), 4) AS loo FROM aloo"""
)
def psis_loo(spark, sf):
    out = information.psis_loo(pointwise(spark, sf))
    return out.select(*[F.round(c, 4).alias(c) for c in ("elpd_loo", "se", "p_loo", "max_k", "loo")])


def second_pi(spark) -> DataFrame:
    """Draws of a rival model: the same jitter around flatter probabilities."""
    return fx.draws_pi(spark, DRAWS).withColumn("pi", 0.2 + 0.75 * (F.col("pi") - 0.1))


_RIVAL = f"""rival AS (SELECT draw, item_id, class_id, 0.2 + 0.75 * (pi - 0.1) AS pi FROM draw_pi),
{sql.DRAW_POST.replace('draw_pi', 'rival').replace('dll', 'ell').replace('dlw', 'elw').replace('dtop', 'etop').replace('dmarg', 'emarg')}"""

# Two models side by side, from joint(resp_id, e0, e1).
_COMPARED = """s AS (SELECT sum(e0) AS s0, sum(e1) AS s1, sqrt(count(*) * var_samp(e1 - e0)) AS se FROM joint)
SELECT 'first' AS model, round(s0, 4) AS elpd, round(least(s0 - s1, 0), 4) AS elpd_diff, CASE WHEN s0 >= s1 THEN 0 ELSE round(se, 4) END AS se_diff,
  s0 < s1 AND abs(s0 - s1) > 2.5 * se AS first_preferred FROM s
UNION ALL SELECT 'rival', round(s1, 4), round(least(s1 - s0, 0), 4), CASE WHEN s1 > s0 THEN 0 ELSE round(se, 4) END, s1 <= s0 AND abs(s1 - s0) > 2.5 * se FROM s"""


@query(
    f"""{_DLL},
{_WAIC},
{_RIVAL},
{_WAIC.replace('dmarg', 'emarg').replace('top AS (', 'top2 AS (').replace('JOIN top', 'JOIN top2').replace('pw AS', 'pw2 AS')},
joint AS (SELECT resp_id, pw.elpd AS e0, pw2.elpd AS e1 FROM pw JOIN pw2 USING (resp_id)),
{_COMPARED}"""
)
def loo_compare(spark, sf):
    codec = form(spark)
    patterns = cut(f1_patterns(spark, sf))
    one = information.waic_pointwise(
        information.pointwise_loglik(patterns, codec, fx.draws_pi(spark, DRAWS), fx.draws_nu(spark, DRAWS))
    )
    two = information.waic_pointwise(information.pointwise_loglik(patterns, codec, second_pi(spark), fx.draws_nu(spark, DRAWS)))
    out = information.loo_compare({"first": one, "rival": two}, codec.words)
    return out.select("model", *[F.round(c, 4).alias(c) for c in ("elpd", "elpd_diff", "se_diff")], "first_preferred")


@query(
    f"""{_DLL}, {_PID}, {_psis_sql('dmarg', 'a')}, {_RIVAL}, {_psis_sql('emarg', 'b')},
joint AS (SELECT resp_id, aloo.elpd AS e0, bloo.elpd AS e1 FROM aloo JOIN bloo USING (resp_id)),
{_COMPARED}"""
)
def loo_compare_psis(spark, sf):
    """As ``loo_compare``, on leave-one-out values."""
    codec = form(spark)
    patterns = cut(f1_patterns(spark, sf))
    rivals = {"first": fx.draws_pi(spark, DRAWS), "rival": second_pi(spark)}
    values = {
        name: information.psis_pointwise(information.pointwise_loglik(patterns, codec, pi, fx.draws_nu(spark, DRAWS)))
        for name, pi in rivals.items()
    }
    out = information.loo_compare(values, codec.words)
    return out.select("model", *[F.round(c, 4).alias(c) for c in ("elpd", "elpd_diff", "se_diff")], "first_preferred")


# --- reliability -------------------------------------------------------------------------


@query(
    f"""{_MEAN_POST},
best AS (SELECT resp_id, class_id AS k FROM (SELECT *, row_number() OVER (PARTITION BY resp_id ORDER BY w DESC, class_id) AS rn FROM post) WHERE rn = 1),
c AS (SELECT class_id, k, sum(w) AS m FROM post JOIN best USING (resp_id) GROUP BY 1, 2),
s AS (SELECT class_id, sum(m) AS size, sum(CASE WHEN k = class_id THEN m ELSE 0 END) AS hit, sum(m * m) AS sq FROM c GROUP BY 1)
SELECT round(sum(hit) / sum(size), 6) AS p_a, round(sum(sq / size) / sum(size), 6) AS p_c FROM s"""
)
def pattern_reliability(spark, sf):
    return reliability.pattern_reliability(mean_post(spark, sf), fx.N_ATTR).select(r6("p_a"), r6("p_c"))


_AGREE = f"""{_MEAN_POST},
{sql.ATTR},
t AS (SELECT attribute, count(*) AS n, sum(CASE WHEN p >= 0.5 THEN p ELSE 0 END) AS t11, sum(CASE WHEN p < 0.5 THEN p ELSE 0 END) AS t10,
  sum(CASE WHEN p >= 0.5 THEN 1 - p ELSE 0 END) AS t01, sum(CASE WHEN p < 0.5 THEN 1 - p ELSE 0 END) AS t00 FROM attr GROUP BY 1),
a AS (SELECT attribute, (t11 + t00) / n AS acc, (t11 + t10) / n AS m, (t11 + t01) / n AS f, t11 / (t11 + t10) AS se, t00 / (t00 + t01) AS sp FROM t),
c AS (SELECT *, m * se * se + (1 - m) * (1 - sp) * (1 - sp) AS c11, m * (1 - se) * (1 - se) + (1 - m) * sp * sp AS c00,
  m * f + (1 - m) * (1 - f) AS pe, f * f + (1 - f) * (1 - f) AS ce FROM a)"""


@query(
    f"""{_AGREE}
SELECT attribute, round(acc, 6) AS acc, round((acc - pe) / (1 - pe), 6) AS acc_kappa, round((acc - greatest(m, 1 - m)) / (1 - greatest(m, 1 - m)), 6) AS acc_lambda,
  round(se + sp - 1, 6) AS youden, round(se, 6) AS sensitivity, round(sp, 6) AS specificity, round(c11 + c00, 6) AS consist,
  round((c11 + c00 - ce) / (1 - ce), 6) AS con_kappa, round((c11 + c00 - greatest(f, 1 - f)) / (1 - greatest(f, 1 - f)), 6) AS con_lambda,
  round(c11 / f + c00 / (1 - f) - 1, 6) AS con_youden FROM c"""
)
def map_reliability(spark, sf):
    out = reliability.map_reliability(mean_post(spark, sf), fx.N_ATTR)
    return out.select("attribute", *[r6(c) for c in reliability.MAP_COLUMNS[1:]])


@query(None)
def map_reliability_tetrachoric(spark, sf):
    return reliability.map_reliability_tetrachoric(mean_post(spark, sf), fx.N_ATTR)


@query(
    f"""{_MEAN_POST},
{sql.ATTR},
s AS (SELECT attribute, avg(p) AS m, var_pop(p) AS v, sum(p * p) / sum(p) AS e1, sum(p * (1 - p)) / sum(1 - p) AS e0,
  avg(-(p * ln(p) + (1 - p) * ln(1 - p))) AS h FROM attr GROUP BY 1)
SELECT attribute, round(v / (m * (1 - m)), 6) AS rho_pf, round(m * (1 - m) * (e1 - e0) * (e1 - e0) / v, 6) AS rho_tb,
  round(1 - exp(-2 * (-(m * ln(m) + (1 - m) * ln(1 - m)) - h)), 6) AS rho_i FROM s"""
)
def eap_reliability(spark, sf):
    out = reliability.eap_reliability(mean_post(spark, sf), fx.N_ATTR)
    return out.select("attribute", r6("rho_pf"), r6("rho_tb"), r6("rho_i"))

"""SQL fragments of the oracles.

They restate the fixtures and likelihoods in plain SQL, independently of the
package's own expressions.
"""

from __future__ import annotations


def u(r: str, k: str | int, salt: int) -> str:
    m = 2147483647
    r, k = f"CAST({r} AS BIGINT)", f"CAST({k} AS BIGINT)"
    x1 = f"(({r} * 48271 + {k} * 69621 + {salt}) % {m})"
    x2 = f"(({x1} * {x1} + {salt}) % {m})"
    return f"(CAST((({x2} * {x2} + {k} * 7919) % {m}) AS DOUBLE) / {m}.0)"


def fold(r: str, k: str) -> str:
    return f"({r} + {k} * 1000003)"


MASKS = (1, 1, 1, 2, 2, 2, 4, 4, 4, 3, 6, 5)

ITEMS = "items(item_id, q_mask) AS (VALUES " + ", ".join(f"({i}, {m})" for i, m in enumerate(MASKS, 1)) + ")"

CLS = f"""cls AS (
  SELECT c_custkey AS resp_id,
         CASE WHEN {u('c_custkey', 101, 17)} < 0.6 THEN 1 ELSE 0 END
       + CASE WHEN {u('c_custkey', 102, 17)} < 0.5 THEN 2 ELSE 0 END
       + CASE WHEN {u('c_custkey', 103, 17)} < 0.4 THEN 4 ELSE 0 END AS class_id
  FROM customer)"""

RESP = f"""{ITEMS},
{CLS},
truth AS (
  SELECT resp_id, item_id,
         CASE WHEN class_id & q_mask = q_mask THEN 0.9 WHEN class_id & q_mask = 0 THEN 0.15 ELSE 0.45 END AS p
  FROM cls, items),
resp AS (
  SELECT resp_id, item_id, CASE WHEN {u('resp_id', 'item_id', 29)} < p THEN 1 ELSE 0 END AS score FROM truth)"""

CLASSES = "classes(class_id) AS (SELECT CAST(range AS INTEGER) FROM range(8))"

START = f"""{CLASSES},
pi AS (
  SELECT item_id, class_id, 0.2 + 0.6 * bit_count(class_id & q_mask) / bit_count(q_mask) AS pi FROM items, classes),
nu AS (SELECT class_id, 0.125 AS nu FROM classes)"""

# The oracle of a posterior, for tables pi(item_id, class_id, pi), nu(class_id, nu).
POST = """ll AS (
  SELECT resp_id, class_id, sum(CASE WHEN score = 1 THEN ln(pi) ELSE ln(1 - pi) END) AS ll
  FROM resp JOIN pi USING (item_id) GROUP BY 1, 2),
lw AS (SELECT resp_id, class_id, ll, ll + ln(nu) AS lw FROM ll JOIN nu USING (class_id)),
top AS (SELECT resp_id, max(lw) AS top FROM lw GROUP BY 1),
marg AS (SELECT resp_id, top + ln(sum(exp(lw - top))) AS loglik FROM lw JOIN top USING (resp_id) GROUP BY resp_id, top),
post AS (SELECT resp_id, class_id, ll, loglik, exp(lw - loglik) AS w FROM lw JOIN marg USING (resp_id))"""

ATTR = """attr AS (
  SELECT resp_id, k + 1 AS attribute, sum(CASE WHEN (class_id >> k) & 1 = 1 THEN w ELSE 0 END) AS p
  FROM post, (SELECT CAST(range AS INTEGER) AS k FROM range(3)) GROUP BY 1, 2)"""

F1_POST = f"WITH {RESP},\n{START},\n{POST}"


def draws(n: int) -> str:
    """draw_pi and draw_nu of fixture F3."""
    return f"""{CLASSES},
drw AS (SELECT CAST(range AS INTEGER) AS draw FROM range(1, {n + 1})),
draw_pi AS (
  SELECT draw, item_id, class_id, 0.2 + 0.6 * bit_count(class_id & q_mask) / bit_count(q_mask)
         + 0.04 * ({u('draw * 1000 + class_id', 'item_id', 41)} - 0.5) AS pi
  FROM drw, items, classes),
draw_raw AS (SELECT draw, class_id, 0.125 + 0.02 * ({u('draw', 'class_id', 43)} - 0.5) AS v FROM drw, classes),
draw_nu AS (SELECT draw, class_id, v / sum(v) OVER (PARTITION BY draw) AS nu FROM draw_raw)"""


DRAW_POST = """dll AS (
  SELECT draw, resp_id, class_id, sum(CASE WHEN score = 1 THEN ln(pi) ELSE ln(1 - pi) END) AS ll
  FROM resp JOIN draw_pi USING (item_id) GROUP BY 1, 2, 3),
dlw AS (SELECT draw, resp_id, class_id, ll + ln(nu) AS lw FROM dll JOIN draw_nu USING (draw, class_id)),
dtop AS (SELECT draw, resp_id, max(lw) AS top FROM dlw GROUP BY 1, 2),
dmarg AS (SELECT draw, resp_id, top + ln(sum(exp(lw - top))) AS ll
          FROM dlw JOIN dtop USING (draw, resp_id) GROUP BY draw, resp_id, top)"""


# Class posterior averaged over the draws, one row per respondent and class.
MEAN_POST = """post AS (
  SELECT resp_id, class_id, avg(exp(lw - ll)) AS w FROM dlw JOIN dmarg USING (draw, resp_id) GROUP BY 1, 2)"""


def replicates(salt: int) -> str:
    """rep(draw, resp_id, class_id, item_id, score): replicated answers."""
    return f"""{DRAW_POST},
dcum AS (
  SELECT draw, resp_id, class_id, sum(exp(lw - top)) OVER (PARTITION BY draw, resp_id ORDER BY class_id) AS cum,
         sum(exp(lw - top)) OVER (PARTITION BY draw, resp_id) AS total
  FROM dlw JOIN dtop USING (draw, resp_id)),
held AS (
  SELECT draw, resp_id, CAST(least(count(CASE WHEN cum <= {u(fold('resp_id', 'draw'), 0, salt)} * total THEN 1 END), 7) AS INTEGER) AS class_id
  FROM dcum GROUP BY draw, resp_id),
rep AS (
  SELECT draw, resp_id, class_id, item_id,
         CASE WHEN {u(fold('resp_id', 'draw'), 'item_id', salt + 1)} < pi THEN 1 ELSE 0 END AS score
  FROM held JOIN draw_pi USING (draw, class_id))"""


def bank(table: str = "part", key: str = "p_partkey") -> str:
    return f"""bank AS (
  SELECT {key} AS item_id, CAST({key} % 15 + 1 AS INTEGER) AS q_mask FROM {table}),
items2 AS (SELECT * FROM bank WHERE bit_count(q_mask) BETWEEN 1 AND 2),
par(parameter, mask) AS (VALUES ('(Intercept)', 0), ('att1', 1), ('att2', 2), ('att3', 4), ('att4', 8),
  ('att1:att2', 3), ('att1:att3', 5), ('att1:att4', 9), ('att2:att3', 6), ('att2:att4', 10), ('att3:att4', 12)),
design AS (SELECT item_id, q_mask, parameter, mask FROM items2, par WHERE q_mask & mask = mask)"""


_UB = u("item_id", "(length(parameter) * 7 + ascii(right(parameter, 1)))", 53)


def bank_params(table: str = "part", key: str = "p_partkey") -> str:
    return f"""{bank(table, key)},
probs AS (
  SELECT item_id, q_mask, parameter, mask,
         CASE bit_count(mask) WHEN 0 THEN 0.05 + (0.45 - 0.05) * {_UB} WHEN 1 THEN 0.5 + (0.7 - 0.5) * {_UB}
              ELSE 0.7 + (0.95 - 0.7) * {_UB} END AS prob
  FROM design),
lg AS (SELECT *, ln(prob / (1 - prob)) AS lg FROM probs),
base AS (SELECT item_id, lg AS base FROM lg WHERE mask = 0),
mains AS (SELECT item_id, sum(lg - base) AS mains FROM lg JOIN base USING (item_id) WHERE bit_count(mask) = 1 GROUP BY 1),
params AS (
  SELECT item_id, q_mask, parameter, mask,
         CASE bit_count(mask) WHEN 0 THEN lg WHEN 1 THEN lg - base ELSE lg - base - mains END AS value
  FROM lg JOIN base USING (item_id) JOIN mains USING (item_id)),
sixteen(class_id) AS (SELECT CAST(range AS INTEGER) FROM range(16))"""


BANK = bank()
BANK_PARAMS = bank_params()

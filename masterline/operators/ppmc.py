"""Posterior-predictive checks: raw scores, conditional probabilities, odds ratios.

Replicated data are draws x respondents x items cells.  They never exist as
rows: encoded respondents are spread over the cluster once, and each task goes
through its respondents draw by draw (class posterior, class drawn, answers
drawn) and keeps only the sums a check needs, which Spark then adds up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from masterline.functions.hashing import PRIME, array_uniforms
from masterline.functions.scalar import CLIP
from masterline.operators.aggregates import sum_strict
from masterline.operators.joins import complete, full_join, left_join, lookup_join
from masterline.operators.patterns import Codec
from masterline.operators.scoring import first_class
from masterline.operators.verbs import union_all
from masterline.plans.draws import DrawBlock, draw_blocks, pattern_posterior
from masterline.plans.lineage import cut, spread


def encode_people(resp: DataFrame, codec: Codec, id_col: str = "resp_id") -> DataFrame:
    """(id, draw_key, words..), spread evenly for the draws to multiply and
    stored: every check starts from it and none goes back to the responses.

    Random numbers hang on ``draw_key``, which is the id itself or, where that
    is no integer, its hash."""
    whole = isinstance(resp.schema[id_col].dataType, IntegralType)
    key = F.col(id_col).cast("bigint") if whole else F.pmod(F.xxhash64(id_col), F.lit(PRIME))
    return cut(spread(codec.encode(resp, id_col), id_col).withColumn("draw_key", key))


def _replicator(codec: Codec, block: DrawBlock, salt: int) -> Callable:
    """Function from a batch of respondents to (draw index, class, answers,
    answered); only what a respondent was asked and answered is replicated."""
    unpack, items = codec.unpacker(), np.array(codec.items, dtype=np.int64)
    ids, pi, nu = block.ids, block.pi, block.nu
    clipped = np.clip(pi, CLIP, 1 - CLIP)
    slope, base = np.log(clipped) - np.log1p(-clipped), np.log1p(-clipped)
    log_nu, uniforms = np.log(np.maximum(nu, 1e-300)), array_uniforms()

    def replicate(batch):
        answered, right = unpack(batch)
        resp = batch.column("draw_key").to_numpy().astype(np.int64)
        asked = answered > 0
        for d, draw in enumerate(ids):
            lw = right @ slope[d] + answered @ base[d] + log_nu[d]
            w = np.exp(lw - lw.max(axis=1, keepdims=True))
            cum = np.cumsum(w, axis=1)
            r = resp + int(draw) * 1000003
            u = uniforms(r, np.int64(0), salt)
            held = (cum[:, :-1] <= (u * cum[:, -1])[:, None]).sum(axis=1)
            p = pi[d].T[held]
            yield d, held, (uniforms(r[:, None], items[None, :], salt + 1) < p) & asked, asked

    return replicate


def _summed(people: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame, salt: int, shape: Callable, add: Callable) -> DataFrame:
    """Run ``add(sums, class, answers, answered)`` over all replicates: (draw, cell, v).

    The result is of parameter size and several statistics read it, so it is
    stored: the replicates are drawn once.
    """
    out = []
    n_classes = nu.select("class_id").distinct().count()
    size = shape(len(codec.items), n_classes)
    for block in draw_blocks(pi, nu, codec.items, size):
        replicate, ids = _replicator(codec, block, salt), block.ids

        def task(batches: Iterator[pa.RecordBatch], replicate=replicate, ids=ids, size=size) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(ids), size))
            for batch in batches:
                for d, held, answers, asked in replicate(batch):
                    add(sums[d], held, answers, asked)
            d, cell = np.nonzero(sums)
            cols = [pa.array(ids[d], pa.int32()), pa.array(cell, pa.int32()), pa.array(sums[d, cell].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["draw", "cell", "v"])

        parts = people.mapInArrow(task, "draw int, cell int, v bigint")
        # Stored block by block, so that the driver lets go of each before the next.
        out.append(cut(parts.groupBy("draw", "cell").agg(F.sum("v").alias("v"))))
    return union_all(out)


def ppmc_raw_scores(people: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame, salt: int) -> DataFrame:
    """(draw, score, n): respondents at each total score over the items they
    answered, per draw; a score no respondent reaches has no row."""

    def add(sums, held, answers, asked):
        sums += np.bincount(answers.sum(axis=1), minlength=len(sums))

    cells = _summed(people, codec, pi, nu, salt, lambda items, classes: items + 1, add)
    return cells.select("draw", F.col("cell").alias("score"), F.col("v").alias("n"))


def observed_scores_encoded(people: DataFrame, codec: Codec) -> DataFrame:
    """(score, n) of encoded respondents, over the items they answered."""
    return people.groupBy(codec.total_score().cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))


def observed_scores(resp: DataFrame, id_col: str = "resp_id") -> DataFrame:
    """(score, n) of the data; an unanswered (NULL) score makes a NULL total."""
    totals = resp.groupBy(id_col).agg(sum_strict(F.col("score")).cast("int").alias("score"))
    return totals.groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def expected_scores(raw: DataFrame, mode: str = "present") -> DataFrame:
    """(score, n): mean count over the draws where the score occurs ("present")
    or over all draws ("all")."""
    if mode == "present":
        return raw.groupBy("score").agg(F.avg("n").alias("n"))
    n_draws = raw.agg(F.countDistinct("draw")).scalar()
    return raw.groupBy("score").agg(F.sum("n").alias("t")).select("score", (F.col("t") / n_draws).alias("n"))


def _piece() -> Column:
    return F.try_divide((F.col("n") - F.col("exp")) * (F.col("n") - F.col("exp")), F.col("exp"))


def ppmc_chisq(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """(draw, chisq) of each replicate against the expectation."""
    filled = complete(raw, ["draw", "score"], {"n": 0})
    joined = full_join(filled, expected.select("score", F.col("n").alias("exp")), ["score"])
    return joined.groupBy("draw").agg(sum_strict(_piece()).alias("chisq"))


def observed_chisq(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row, one column; NULL when an observed score was never replicated."""
    joined = full_join(observed, expected.select("score", F.col("n").alias("exp")), ["score"]).fillna({"n": 0})
    return joined.agg(sum_strict(_piece()).alias("chisq"))


def ppp(replicated: DataFrame, observed: DataFrame, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Share of draws whose statistic exceeds the observed one, and whether it
    lies strictly between the limits of acceptable fit."""
    share = replicated.agg(F.avg((F.col("chisq") > observed.select("chisq").scalar()).cast("double")).alias("ppp"))
    return share.withColumn("acceptable", (F.col("ppp") > lo) & (F.col("ppp") < hi))


def replicated_conditional(people: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame, salt: int) -> DataFrame:
    """(draw, item_id, class_id, rep): share right by drawn class, among those
    who answered the item."""
    n = len(codec.items)

    def add(sums, held, answers, asked):
        table = sums.reshape(-1, 2 * n)
        member = np.eye(len(table))[held]
        table[:, :n] += member.T @ asked
        table[:, n:] += member.T @ answers

    cells = _summed(people, codec, pi, nu, salt, lambda items, classes: 2 * classes * items, add)
    items = "array(" + ", ".join(str(i) for i in codec.items) + ")"
    placed = cells.groupBy("draw", F.expr(f"cast(cell div {2 * n} as int) AS class_id"), F.expr(f"cast(cell % {n} as int) AS i"))
    rows = placed.agg(
        F.expr(f"sum(if(cell % {2 * n} < {n}, v, 0L)) AS total"), F.expr(f"sum(if(cell % {2 * n} < {n}, 0L, v)) AS hits")
    )
    return rows.selectExpr("draw", f"get({items}, i) AS item_id", "class_id", "hits / total AS rep")


def observed_conditional(people: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame, n_attr: int) -> DataFrame:
    """(item_id, class_id, obs): share right among the encoded respondents
    placed in the class that is most likely on average over the draws.

    Patterns are counted and placed, and each task adds up answers by class and item."""
    unpack, items = codec.unpacker(), np.array(codec.items)
    n_classes = 2**n_attr

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n_classes, len(items)))
        for batch in batches:
            answered, right = unpack(batch)
            member = np.eye(n_classes)[batch.column("class_id").to_numpy()] * batch.column("n").to_numpy()[:, None]
            sums += np.stack([member.T @ answered, member.T @ right])
        c, i = np.nonzero(sums[0])
        columns = [pa.array(items[i], pa.int32()), pa.array(c, pa.int32()), pa.array(sums[0][c, i]), pa.array(sums[1][c, i])]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "class_id", "total", "hits"])

    counted = cut(codec.count(people))
    post = pattern_posterior(spread(counted, *codec.words), codec, pi, nu)
    placed = lookup_join(counted, post, codec.words)
    rows = placed.select("n", *codec.words, first_class(F.col("w")).alias("class_id")).mapInArrow(task, "item_id int, class_id int, total double, hits double")
    return rows.groupBy("item_id", "class_id").agg((F.sum("hits") / F.sum("total")).alias("obs"))


def _interval(value: str) -> list[Column]:
    return [
        F.avg(value).alias("rep_mean"),
        F.percentile(value, F.lit(0.025)).alias("rep_low"),
        F.percentile(value, F.lit(0.975)).alias("rep_high"),
    ]


def ppmc_conditional(replicated: DataFrame, observed: DataFrame) -> DataFrame:
    """Per item and class: observed share, replicated mean and 95% limits, ppp."""
    joined = left_join(replicated, observed, ["item_id", "class_id"])
    return joined.groupBy("item_id", "class_id").agg(
        F.first("obs").alias("obs"), *_interval("rep"), F.avg((F.col("rep") > F.col("obs")).cast("double")).alias("ppp")
    )


def pair_counts(patterns: DataFrame, codec: Codec) -> DataFrame:
    """(item_i, item_j, n11, n10, n01, n00) for i < j from counted patterns, for each
    item i that someone answered.

    Each task adds up co-occurrences, three items x items products a batch, and
    returns a row per pair; the plan is the same for any number of items.
    """
    if not codec.items:
        raise ValueError("no items")
    unpack = codec.unpacker()
    first, second = np.triu_indices(len(codec.items), 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = 0
        for batch in batches:
            answered, right = unpack(batch)
            n = batch.column("n").to_numpy().astype(float)[:, None]
            sums = sums + np.stack([right.T @ (right * n), right.T @ (answered * n), answered.T @ (answered * n)])
        if isinstance(sums, int):
            return
        both, mixed, asked = sums
        n11 = both[first, second]
        n10, n01 = mixed[first, second] - n11, mixed[second, first] - n11
        n00 = asked[first, second] - n11 - n10 - n01
        seen = asked[first, first] > 0
        columns = [pa.array(v[seen].astype(np.int64)) for v in (first, second, n11, n10, n01, n00)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n11", "n10", "n01", "n00"])

    counts = ("n11", "n10", "n01", "n00")
    parts = patterns.select(*codec.words, "n").mapInArrow(task, "i bigint, j bigint, n11 bigint, n10 bigint, n01 bigint, n00 bigint")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in counts])
    items = "array(" + ", ".join(str(i) for i in codec.items) + ")"
    low, high = (f"{f}(get({items}, cast(i as int)), get({items}, cast(j as int)))" for f in ("least", "greatest"))
    # Items need not be listed in rising order: i < j is by item number.
    swapped = f"get({items}, cast(i as int)) > get({items}, cast(j as int))"
    return sums.selectExpr(
        f"{low} AS item_i", f"{high} AS item_j", "n11", f"if({swapped}, n01, n10) AS n10", f"if({swapped}, n10, n01) AS n01", "n00"
    )


def odds_ratio() -> Column:
    """n11 n00 / (n10 n01); NULL when undefined."""
    return F.expr("try_divide(cast(n11 as double) * n00, cast(n10 as double) * n01)")


def observed_odds_ratio(patterns: DataFrame, codec: Codec) -> DataFrame:
    return pair_counts(patterns, codec).withColumn("odds_ratio", odds_ratio())


def replicated_odds_ratio(people: DataFrame, codec: Codec, pi: DataFrame, nu: DataFrame, salt: int) -> DataFrame:
    """(draw, item_i, item_j, rep), one row per pair and draw."""
    n = len(codec.items)

    def add(sums, held, answers, asked):
        x = answers.astype(float)
        y = asked - x
        sums += np.concatenate([(x.T @ x).ravel(), (x.T @ y).ravel(), (y.T @ y).ravel()])

    cells = _summed(people, codec, pi, nu, salt, lambda items, classes: 3 * items * items, add)
    items = "array(" + ", ".join(str(i) for i in codec.items) + ")"
    pairs = cells.withColumns(
        {
            "kind": F.expr(f"cell div {n * n}"),
            "i": F.expr(f"cast(cell % {n * n} div {n} as int)"),
            "j": F.expr(f"cast(cell % {n} as int)"),
        }
    )
    # n01 of (i, j) is n10 of (j, i): put both under the pair with i < j.
    counts = pairs.filter("i <> j").groupBy("draw", F.expr("least(i, j) AS i"), F.expr("greatest(i, j) AS j")).agg(
        F.expr("sum(if(kind = 0 AND i < j, v, 0L)) AS n11"),
        F.expr("sum(if(kind = 1 AND i < j, v, 0L)) AS n10"),
        F.expr("sum(if(kind = 1 AND i > j, v, 0L)) AS n01"),
        F.expr("sum(if(kind = 2 AND i < j, v, 0L)) AS n00"),
    )
    return counts.select(
        "draw", F.expr(f"get({items}, i) AS item_i"), F.expr(f"get({items}, j) AS item_j"), odds_ratio().alias("rep")
    )


def ppmc_odds_ratio(replicated: DataFrame, observed: DataFrame) -> DataFrame:
    """Per item pair: observed ratio, replicated mean and 95% limits over the
    draws where it is defined, how many are not, and ppp."""
    joined = left_join(replicated, observed.select("item_i", "item_j", F.col("odds_ratio").alias("obs")), ["item_i", "item_j"])
    return joined.groupBy("item_i", "item_j").agg(
        F.first("obs").alias("obs"),
        *_interval("rep"),
        F.count_if(F.col("rep").isNull()).alias("n_undefined"),
        F.avg((F.col("rep") > F.col("obs")).cast("double")).alias("ppp"),
    )

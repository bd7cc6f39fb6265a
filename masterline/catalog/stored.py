"""Queries of what is kept on disk: the catalogue of files, result tables, draws and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masterline.catalog import people
from masterline.operators import sampling, scoring
from masterline.operators.joins import left_join
from masterline.plans import draws, em
from masterline.plans.lineage import scratch
from masterline.sources import fixtures as fx
from masterline.sources import io, store

QUERIES: dict[str, tuple] = {}


def query(oracle: str | None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, oracle)
        return fn

    return register


# What each given table is about.
KINDS = {
    "trade": "region nation customer supplier part orders lineitem",
    "stream": "events",
    "text": "documents pages benchmark labels conversations",
    "vectors": "embeddings",
}
_TABLES = [(name, kind) for kind, names in KINDS.items() for name in names.split()]


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{name.capitalize()}' AS title, '{kind}' AS kind, count(*) AS n_rows FROM {name}" for name, kind in _TABLES
    )
)
def file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The given tables by their files: names cleaned, rows counted, kinds joined on."""
    files = io.catalogue_files(spark, f"{sf}/*.parquet")
    table = F.regexp_extract("path", r"([^/]+)\.parquet(?:/|$)", 1)
    rows = files.withColumn("name", table).groupBy("name").agg(F.sum("n_rows").alias("n_rows"))
    kinds = io.literal_table(spark, _TABLES, "name string, kind string")
    return left_join(rows, kinds, ["name"]).select("name", F.initcap("name").alias("title"), "kind", "n_rows")


@query(f"SELECT *, theta AS x, CAST(0.02 AS DOUBLE) AS y FROM ({people.QUERIES['result_table'][1]})")
def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    """The result table written, and read back with its plotting position."""
    path = f"{scratch(spark)}/results"
    io.write_table(people.result_table(spark, sf), path)
    return io.read_results(spark, path)


@query(
    f"""{people.SUPPLIER_DRAWS},
place AS (SELECT draw, (draw - 1) % 4 + 1 AS chain, (draw - 1) // 4 + 1 AS iteration FROM drw),
merged AS (SELECT draw AS old, (chain - 1) * (SELECT max(iteration) FROM place) + iteration AS draw FROM place)
SELECT m.draw % 10 AS last_digit, item_id, class_id, round(avg(pi), 6) AS pi, round(avg(nu), 6) AS nu, count(*) AS n, (SELECT count(*) FROM drw) AS n_draws
FROM draw_pi p JOIN draw_nu USING (draw, class_id) JOIN merged m ON m.old = p.draw GROUP BY 1, 2, 3"""
)
def stored_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws stored by chain and iteration, read back with chains end to end; their means by
    the last digit of the draw's new number."""
    numbers, path = fx.supplier_draws(spark, sf), scratch(spark)
    io.write_table(fx.jittered_pi(numbers).drop("draw"), f"{path}/pi")
    io.write_table(fx.jittered_nu(numbers).drop("draw"), f"{path}/nu")
    made = draws.load_draws(spark, f"{path}/pi", f"{path}/nu")
    both = made.pi.join(made.nu, ["draw", "class_id"]).withColumn("last_digit", (F.col("draw") % 10).cast("int"))
    means = scoring.draw_mean(both, ["last_digit", "item_id", "class_id"], "pi")
    shares = both.groupBy("last_digit", "item_id", "class_id").agg(F.avg("nu").alias("nu"), F.count(F.lit(1)).alias("n"))
    rounded = [F.round(c, 6).alias(c) for c in ("pi", "nu")]
    return means.join(shares, ["last_digit", "item_id", "class_id"]).select("last_digit", "item_id", "class_id", *rounded, "n", sampling.count_draws(made.nu).scalar().alias("n_draws"))


@query(
    f"""SELECT item_id, class_id, pi, nu, loglik, 'lcdm' AS model, 3 AS n_attr, 3 AS n_iter, false AS converged,
  (SELECT CAST(sum(p) AS BIGINT) FROM (VALUES ({'), ('.join(str(m) for m in fx.Q_MASKS)})) m(p)) AS masks
FROM ({people.QUERIES['em_three_steps_lcdm'][1]})"""
)
def stored_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A fit stored whole, and loaded by a second caller instead of being made again."""
    path = f"{scratch(spark)}/fit"
    make = lambda: em.fit_dcm(fx.responses(spark, sf), fx.qmatrix(spark), fx.N_ATTR, max_iter=3, accelerate=False)
    store.fit_or_load(spark, path, make)

    def again():
        raise AssertionError("a stored fit was made again")

    fit = store.fit_or_load(spark, path, again)
    facts = {
        "loglik": round(fit.loglik, 4),
        "model": fit.model,
        "n_attr": fit.n_attr,
        "n_iter": fit.n_iter,
        "converged": fit.converged,
    }
    rows = fit.pi.join(fit.nu, "class_id").select("item_id", "class_id", F.round("pi", 6).alias("pi"), F.round("nu", 6).alias("nu"))
    return rows.select("*", *[F.lit(v).alias(k) for k, v in facts.items()], F.lit(sum(fit.q_masks.values())).cast("long").alias("masks"))

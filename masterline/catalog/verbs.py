"""Queries of the table verbs: sources, reshaping, filters, joins, aggregates,
ranking, set operations and sampling, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masterline.catalog import fragments as sql
from masterline.functions import hashing, scalar, text
from masterline.operators import aggregates, joins, ranking, sampling, verbs
from masterline.sources import fixtures as fx
from masterline.sources import grid, io

QUERIES: dict[str, tuple] = {}


def query(oracle: str | None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, oracle)
        return fn

    return register


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- projections -----------------------------------------------------------

_X = "(p_size / 60.0)"


@query(
    f"""SELECT p_partkey, round(ln({_X} / (1 - {_X})), 6) AS log_odds,
  round(1 / (1 + exp(-(p_retailprice / 1000.0 - 1.2345))), 6) AS prob,
  round(exp(-0.5 * (({_X} - 1.5) / 0.4) * (({_X} - 1.5) / 0.4)) / (0.4 * sqrt(2 * pi())), 6) AS density,
  round(({_X} * 1.2345) * ({_X} * 1.2345), 6) AS squared, round(abs(ln({_X})), 6) AS gap,
  round(greatest({_X}, 0.512345), 6) AS larger, 'part-' || p_partkey AS label FROM part"""
)
def computed_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = verbs.mutate(
        fx.read(spark, sf, "part"),
        x=F.col("p_size") / 60.0,
        log_odds=scalar.logit(F.col("x")),
        prob=scalar.inv_logit(F.col("p_retailprice") / 1000.0 - 1.2345),
        density=scalar.normal_density(F.col("x"), 1.5, 0.4),
        squared=scalar.square(F.col("x") * 1.2345),
        gap=F.abs(F.ln("x")),
        larger=scalar.pairwise_max(F.col("x"), F.lit(0.512345)),
        label=text.prefixed("part-", F.col("p_partkey")),
    )
    return df.select("p_partkey", *[r6(c) for c in ("log_odds", "prob", "density", "squared", "gap", "larger")], "label")


@query("SELECT p_partkey AS item, p_type, p_brand AS brand, p_size FROM part")
def select_rename_relocate(spark, sf):
    df = verbs.select_cols(fx.read(spark, sf, "part"), between=("p_partkey", "p_size"), drop=("p_name",))
    df = verbs.rename(df, {"p_partkey": "item", "p_brand": "brand"})
    return verbs.relocate(df, "brand", after="p_type")


@query("SELECT c_custkey, c_nationkey FROM customer")
def select_suffix(spark, sf):
    return verbs.select_cols(fx.read(spark, sf, "customer"), suffix="key")


_BITS = {f"att{k + 1}": k for k in range(3)}


def _class_bits(spark, sf):
    bits = [scalar.bit(F.col("class_id"), k).alias(a) for a, k in _BITS.items()]
    return fx.known_classes(spark, sf).select("resp_id", *bits)


@query(
    f"WITH {sql.CLS} SELECT resp_id, "
    + ", ".join(f"CASE WHEN (class_id >> {k}) & 1 = 1 THEN 'check' ELSE 'xmark' END AS {a}" for a, k in _BITS.items())
    + ", CASE WHEN class_id & 1 = 1 THEN '#487398' ELSE '#A91E47' END AS colour FROM cls"
)
def across_marks(spark, sf):
    df = verbs.across(_class_bits(spark, sf), list(_BITS), scalar.to_mark)
    return df.withColumn("colour", scalar.mark_colour(F.col("att1")))


@query(f"WITH {sql.CLS} SELECT resp_id, " + ", ".join(f"CAST((class_id >> {k}) & 1 AS INTEGER) AS {a}" for a, k in _BITS.items()) + " FROM cls")
def marks_to_binary(spark, sf):
    marked = verbs.across(_class_bits(spark, sf), list(_BITS), scalar.to_mark)
    return verbs.across(marked, list(_BITS), scalar.from_mark)


@query(
    "SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 1 WHEN s_acctbal < 5000 THEN 0 END AS s_acctbal FROM supplier"
)
def across_doubles(spark, sf):
    df = fx.read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return verbs.across_type(df, T.DoubleType, lambda x: scalar.mastered(x, 5000.0))


@query(
    """SELECT p_partkey, CASE WHEN p_size = 1 THEN greatest(p_size / 60.0, 0.6) ELSE greatest(p_size / 60.0, 0.2) END AS low,
  CASE WHEN p_size < 10 THEN 'FALSE' WHEN p_size > 40 THEN 'TRUE' ELSE 'Partial' END AS band,
  CASE WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'PROMO' THEN 2 END AS code FROM part"""
)
def conditional_values(spark, sf):
    x = F.col("p_size") / 60.0
    low = scalar.ifelse(F.col("p_size") == 1, scalar.pairwise_max(x, F.lit(0.6)), scalar.pairwise_max(x, F.lit(0.2)))
    band = scalar.case_when((F.col("p_size") < 10, "FALSE"), (F.col("p_size") > 40, "TRUE"), default="Partial")
    code = scalar.case_when((F.col("p_type") == "ECONOMY", 1), (F.col("p_type") == "PROMO", 2))
    return fx.read(spark, sf, "part").select("p_partkey", low.alias("low"), band.alias("band"), code.alias("code"))


@query(
    "SELECT p_partkey AS item_id, CAST(bit_count(CAST(p_partkey % 15 + 1 AS INTEGER)) AS INTEGER) AS n_att FROM part "
    "WHERE (p_partkey % 15 + 1) & 1 = 1 AND bit_count(CAST(p_partkey % 15 + 1 AS INTEGER)) BETWEEN 1 AND 2"
)
def row_sum_filter(spark, sf):
    bank = fx.raw_bank(spark, sf)
    wanted, total = "att1", scalar.row_sum(fx.BANK_ATTRS)
    return bank.filter((F.col(wanted) == 1) & total.between(1, 2)).select("item_id", total.alias("n_att"))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS BIGINT) AS o_totalprice, "
    "CAST(o_orderdate AS DATE) AS o_orderdate FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_orderdate FROM orders)"
)
def cast_columns(spark, sf):
    df = fx.read(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("o_totalprice"), "o_orderdate")
    return verbs.cast(df, {"o_orderkey": "string", "o_totalprice": "bigint", "o_orderdate": "date"})


@query(
    "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS item FROM customer"
)
def rowid_customers(spark, sf):
    df = fx.read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ranking.rowid(df, "item", ["c_mktsegment", ranking.Down("c_acctbal"), "c_custkey"]).drop("c_acctbal")


# --- reshaping ---------------------------------------------------------------


@query(f"WITH {sql.RESP} SELECT resp_id, item_id, score FROM resp")
def responses_long(spark, sf):
    return fx.responses(spark, sf)


_ITEMS = list(range(1, 13))


@query(
    f"WITH {sql.RESP} SELECT resp_id, "
    + ", ".join(f'max(CASE WHEN item_id = {i} THEN score END) AS "{i}"' for i in _ITEMS)
    + " FROM resp GROUP BY resp_id"
)
def responses_wide(spark, sf):
    return verbs.to_wide(fx.responses(spark, sf), ["resp_id"], "item_id", "score", _ITEMS)


@query(f"WITH {sql.RESP} SELECT resp_id, item_id, score FROM resp")
def responses_unpivot(spark, sf):
    return io.responses_to_long(responses_wide(spark, sf), "resp_id")


@query(
    """SELECT item, class, count(*) AS n, round(sum(l_quantity), 6) AS total FROM
  (SELECT CAST(l_linenumber AS INTEGER) AS item, CAST(l_partkey % 8 AS INTEGER) AS class, l_quantity FROM lineitem) GROUP BY 1, 2"""
)
def split_names(spark, sf):
    name = F.concat(F.lit("pi["), F.col("l_linenumber"), F.lit(","), F.col("l_partkey") % 8, F.lit("]"))
    df = fx.read(spark, sf, "lineitem").select(name.alias("name"), "l_quantity")
    parts = verbs.cast(verbs.split_regex(df, "name", r"pi\[([0-9]*),([0-9]*)\]", ["item", "class"]), {"item": "int", "class": "int"})
    return parts.groupBy("item", "class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("total"))


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem"
)
def nest_unnest(spark, sf):
    nested = verbs.nest(fx.read(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity"], "lines")
    return verbs.unnest(nested.withColumn("n_lines", F.size("lines").cast("bigint")), "lines")


@query(
    """SELECT 'album ' || l_partkey AS album, unnest(['artist ' || l_suppkey, 'guest ' || (l_suppkey % 10)]) AS artist
  FROM lineitem WHERE l_linenumber % 2 = 1"""
)
def json_flatten(spark, sf):
    album = (
        "struct(concat('album ', l_partkey) AS name, if(l_linenumber % 2 = 1, 'album', 'single') AS album_type, "
        "array(struct(concat('artist ', l_suppkey) AS name), struct(concat('guest ', l_suppkey % 10) AS name)) AS artists)"
    )
    items = f"collect_list(struct(struct({album} AS album) AS track))"
    lists = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.expr(f"to_json(struct(struct({items} AS items) AS tracks)) AS payload"))
    return io.flatten_playlists(lists)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf):
    props = F.from_json("props", "k bigint").alias("props")
    return fx.read(spark, sf, "events").select("event_id", props).select("event_id", "props.k")


# --- text ----------------------------------------------------------------------

# The fixed titles and names of functions.text, as SQL lists.
_LOWER = ", ".join(f"'{t}'" for t in text.LOWERCASE_TITLES)
_OLD, _NEW = next(iter(text.RENAMED.items()))
_STEMS = f"{_LOWER}, '{_OLD.lower()}'"
_TITLE = (
    f"CASE WHEN p_partkey % 11 = 0 THEN [{_STEMS}][CAST(p_partkey % 4 AS INTEGER) + 1] "
    "ELSE replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '-tv' ELSE '' END END"
)


@query(
    f"""WITH a AS (SELECT p_partkey, 'figure/images/' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || {_TITLE} || '.png' AS img FROM part),
b AS (SELECT *, replace(regexp_replace(regexp_replace(split_part(img, '/', 3), '\\.[^.]+$', ''), '^[0-9]{{2}}-', ''), '-', ' ') AS stem FROM a),
c AS (SELECT *, array_to_string(list_transform(string_split(lower(stem), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titled FROM b),
d AS (SELECT *, CASE WHEN stem IN ({_LOWER}) THEN stem
  WHEN contains(stem, 'tv') THEN regexp_replace(titled, 'Tv', '({text.SHORT_TAG})') ELSE titled END AS era FROM c)
SELECT p_partkey, img, era, CASE WHEN contains(era, '({text.SHORT_TAG})') THEN regexp_replace(era, '{text.SHORT_TAG}', '{text.LONG_TAG.replace("'", "''")}')
  WHEN era = '{_OLD}' THEN '{_NEW}' ELSE era END AS album FROM d"""
)
def clean_title(spark, sf):
    stem = F.expr(
        f"if(p_partkey % 11 = 0, element_at(array({_STEMS}), cast(p_partkey % 4 as int) + 1), "
        "concat(replace(p_name, ' ', '-'), if(p_partkey % 3 = 0, '-tv', '')))"
    )
    path = F.concat(F.lit("/home/figure/user/figure/images/"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-"), stem, F.lit(".png"))
    df = fx.read(spark, sf, "part").select("p_partkey", path.alias("path"))
    cols = text.clean_title(F.col("path"))
    return df.select("p_partkey", *[c.alias(n) for n, c in cols.items()])


@query(
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS file, regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1') AS stem,
  regexp_replace(url, '[0-9]+', '#', 'g') AS masked FROM pages"""
)
def file_names(spark, sf):
    name = text.file_name(F.col("url"))
    return fx.read(spark, sf, "pages").select(
        "page_id", name.alias("file"), text.drop_extension(name).alias("stem"), text.replace_all(F.col("url"), "[0-9]+", "#").alias("masked")
    )


# --- filters ---------------------------------------------------------------------


@query(
    "SELECT p_partkey, p_name FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL') AND contains(p_name, 'bolt') AND NOT contains(p_name, 'red') AND p_size <> 7"
)
def filter_strings(spark, sf):
    df = fx.read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    keep = F.col("p_type").isin("ECONOMY", "PROMO", "SMALL") & F.col("p_name").contains("bolt") & ~F.col("p_name").contains("red")
    return df.filter(keep & (F.col("p_size") != 7)).select("p_partkey", "p_name")


@query("SELECT d.doc_id, CASE WHEN quality IS NULL THEN lang ELSE 'rated' END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_test(spark, sf):
    df = joins.left_join(fx.read(spark, sf, "documents").select("doc_id", "lang"), fx.read(spark, sf, "labels"), ["doc_id"])
    label = scalar.case_when((F.col("quality").isNull(), F.col("lang")), (F.col("quality").isNotNull(), F.lit("rated")))
    return df.select("doc_id", label.alias("label"))


@query(
    "SELECT CASE WHEN c_acctbal <= 5000 THEN 'Not Proficient' ELSE 'Proficient' END AS band, count(*) AS n FROM customer GROUP BY 1"
)
def threshold_band(spark, sf):
    band = scalar.threshold_band(F.col("c_acctbal"), 5000.0, "Not Proficient", "Proficient")
    return aggregates.count_by(fx.read(spark, sf, "customer").withColumn("band", band), "band")


# --- joins -------------------------------------------------------------------------


@query(
    "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"
)
def enrich_supplier(spark, sf):
    dim = io.read_dim(spark, f"{sf}/nation.parquet")
    df = fx.read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return io.enrich(df, dim, [("s_nationkey", "n_nationkey")], ["n_name"]).drop("s_nationkey")


@query(
    """WITH l AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS k, o_orderstatus AS st FROM orders),
r AS (SELECT CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS k, o_orderstatus AS st, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT l.o_orderkey, l.k, l.st, r.n FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k AND l.st = r.st"""
)
def left_join_null_keys(spark, sf):
    rows = fx.read(spark, sf, "orders").selectExpr("o_orderkey", "if(o_custkey % 5 > 0, o_custkey % 5, NULL) AS k", "o_orderstatus AS st")
    counts = aggregates.count_by(rows.filter("st <> 'P'"), "k", "st")
    return joins.left_join(rows, counts, ["k", "st"])


@query(
    """WITH c AS (SELECT CAST(floor(c_acctbal / 50) AS BIGINT) AS band, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT CAST(floor(s_acctbal / 50) AS BIGINT) AS band, count(*) AS m FROM supplier GROUP BY 1)
SELECT band, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM c FULL JOIN s USING (band)"""
)
def full_join_counts(spark, sf):
    customers = fx.read(spark, sf, "customer").select(F.floor(F.col("c_acctbal") / 50).alias("band"))
    suppliers = fx.read(spark, sf, "supplier").select(F.floor(F.col("s_acctbal") / 50).alias("band"))
    both = joins.full_join(aggregates.count_by(customers, "band"), aggregates.count_by(suppliers, "band", name="m"), ["band"])
    return verbs.replace_na(both, {"n": 0, "m": 0})


@query(
    """WITH g AS (SELECT s_nationkey, CAST(floor(s_acctbal / 500) AS BIGINT) AS band, count(*) AS n FROM supplier GROUP BY 1, 2)
SELECT a.s_nationkey, b.band, coalesce(n, 0) AS n FROM (SELECT DISTINCT s_nationkey FROM g) a CROSS JOIN (SELECT DISTINCT band FROM g) b
LEFT JOIN g ON g.s_nationkey = a.s_nationkey AND g.band = b.band"""
)
def complete_counts(spark, sf):
    rows = fx.read(spark, sf, "supplier").select("s_nationkey", F.floor(F.col("s_acctbal") / 500).alias("band"))
    return joins.complete(aggregates.count_by(rows, "s_nationkey", "band"), ["s_nationkey", "band"], {"n": 0})


@query(
    "SELECT o_custkey, "
    + ", ".join(f"nullif(count(CASE WHEN o_orderpriority = '{p}' THEN 1 END), 0) AS n{i}" for i, p in enumerate(fx.PRIORITIES, 1))
    + " FROM orders GROUP BY o_custkey"
)
def full_join_all(spark, sf):
    orders = fx.read(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    tables = [aggregates.count_by(orders.filter(F.col("o_orderpriority") == p), "o_custkey", name=f"n{i}") for i, p in enumerate(fx.PRIORITIES, 1)]
    return joins.full_join_all(tables, ["o_custkey"])


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labelled(spark, sf):
    return joins.semi_join(fx.read(spark, sf, "documents").select("doc_id", "lang", "source"), fx.read(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_labelled(spark, sf):
    labels = fx.read(spark, sf, "labels").select(F.col("doc_id").alias("rated"))
    return joins.anti_join(fx.read(spark, sf, "documents").select("doc_id", "lang", "source"), labels, [("doc_id", "rated")])


@query("SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def expand_grid(spark, sf):
    return joins.expand_grid(fx.read(spark, sf, "supplier").select("s_suppkey"), fx.read(spark, sf, "region").select("r_name"))


@query(
    """WITH cand AS (SELECT c_custkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey) AS rn
  FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT c.c_custkey, s_suppkey, s_acctbal FROM customer c LEFT JOIN (SELECT * FROM cand WHERE rn = 1) b ON c.c_custkey = b.c_custkey"""
)
def nearest_match(spark, sf):
    """Supplier of the same nation with the nearest balance, per customer."""
    cust = fx.read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    supp = fx.read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    near = joins.nearest_join(cust, supp, ["nation"], "c_acctbal", "s_acctbal", "s_suppkey", few=0)
    return near.select("c_custkey", "s_suppkey", "s_acctbal")


@query(
    """WITH cand AS (SELECT n_nationkey, c_custkey, c_acctbal,
  row_number() OVER (PARTITION BY n_nationkey ORDER BY abs(c_acctbal - (n_nationkey * 400.5 - 700)), c_custkey) AS rn
  FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT n.n_nationkey, c_custkey, c_acctbal FROM nation n LEFT JOIN (SELECT * FROM cand WHERE rn = 1) b ON n.n_nationkey = b.n_nationkey"""
)
def nearest_match_few(spark, sf):
    """One target balance per nation against all its customers: few targets."""
    target = (F.col("n_nationkey") * 400.5 - 700).alias("target")
    targets = fx.read(spark, sf, "nation").select("n_nationkey", target)
    cust = fx.read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    near = joins.nearest_join(targets, cust, ["n_nationkey"], "target", "c_acctbal", "c_custkey")
    return near.select("n_nationkey", "c_custkey", "c_acctbal")


# --- aggregation -----------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_type, user_id, CASE WHEN event_id % 997 <> 0 THEN value END AS v FROM events)
SELECT event_type, user_id, CASE WHEN count(*) = count(v) THEN round(sum(v), 4) END AS strict, round(coalesce(sum(v), 0), 4) AS skipped,
  count(*) AS n, round(avg(v), 6) AS mean FROM e GROUP BY 1, 2"""
)
def sums_with_nulls(spark, sf):
    e = fx.read(spark, sf, "events").selectExpr("event_type", "user_id", "if(event_id % 997 <> 0, value, NULL) AS v")
    return e.groupBy("event_type", "user_id").agg(
        F.round(aggregates.sum_strict(F.col("v")), 4).alias("strict"),
        F.round(aggregates.sum_skip(F.col("v")), 4).alias("skipped"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("v"), 6).alias("mean"),
    )


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS total, count(DISTINCT l_orderkey) AS n_orders FROM lineitem")
def global_sum(spark, sf):
    df = fx.read(spark, sf, "lineitem")
    return df.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("total"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
def add_count(spark, sf):
    return aggregates.add_count(fx.read(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type")


@query(
    """WITH f AS (SELECT user_id, event_type, min(struct_pack(t := ts, i := event_id)) AS pos FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS event_type FROM f GROUP BY user_id"""
)
def collapse_unique(spark, sf):
    return aggregates.collapse_unique(fx.read(spark, sf, "events"), "user_id", "event_type", F.struct("ts", "event_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark, sf):
    return fx.read(spark, sf, "events").select("user_id", "event_type").distinct()


@query(
    """SELECT user_id, event_id AS best FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) AS rn FROM events) WHERE rn = 1"""
)
def arg_max_first(spark, sf):
    return fx.read(spark, sf, "events").groupBy("user_id").agg(aggregates.arg_max(F.col("event_id"), F.floor("value")).alias("best"))


@query(
    "SELECT (ceil(c_acctbal / 500.0) - 1) * 500.0 AS lo, ceil(c_acctbal / 500.0) * 500.0 AS hi, count(*) AS n FROM customer GROUP BY ceil(c_acctbal / 500.0)"
)
def histogram_balance(spark, sf):
    return aggregates.histogram(fx.read(spark, sf, "customer"), "c_acctbal", 500.0)


# --- windows and order -------------------------------------------------------------


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
def row_number_within(spark, sf):
    df = fx.read(spark, sf, "events").select("event_id", "user_id", "ts")
    return ranking.rowid(df, "rn", ["ts", "event_id"], ["user_id"]).drop("ts")


@query("SELECT p_partkey, p_brand, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rk FROM part) WHERE rk = 1")
def top_with_ties(spark, sf):
    return ranking.top_with_ties(fx.read(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")


@query("SELECT p_partkey, p_brand, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25), p_partkey) AS rn FROM part) WHERE rn = 1")
def bottom_one(spark, sf):
    df = fx.read(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return ranking.bottom_one(df, ["p_brand"], F.abs(F.col("p_size") - 25), "p_partkey")


@query("SELECT event_id, dense_rank() OVER (ORDER BY user_id) AS idx FROM events")
def dense_index(spark, sf):
    return ranking.dense_index(fx.read(spark, sf, "events").select("event_id", "user_id"), "user_id", "idx").drop("user_id")


@query("SELECT p_name, row_number() OVER (ORDER BY m) AS level, m AS position FROM (SELECT p_name, min(p_partkey) AS m FROM part GROUP BY 1)")
def first_seen(spark, sf):
    return ranking.first_seen(fx.read(spark, sf, "part"), "p_name", F.col("p_partkey"))


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn IN (1, 3, 5, 7)")
def rows_at(spark, sf):
    return ranking.rows_at(fx.read(spark, sf, "customer").select("c_custkey", "c_acctbal"), [1, 3, 5, 7], ["c_acctbal", "c_custkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders")
def sorted_orders(spark, sf):
    return fx.read(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


# --- set operations ------------------------------------------------------------------


@query(
    "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier"
)
def union_missing(spark, sf):
    cust = fx.read(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_mktsegment AS segment")
    supp = fx.read(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation")
    return verbs.union_all([cust, supp])


@query(
    " UNION ALL ".join(
        f"SELECT 'att{k}' AS attribute, count(*) AS n FROM part WHERE ((p_partkey % 15 + 1) >> {k - 1}) & 1 = 1" for k in range(1, 5)
    )
)
def map_union(spark, sf):
    bank = fx.raw_bank(spark, sf)
    one = lambda a: bank.filter(F.col(a) == 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("attribute"), "n")
    return verbs.map_union(one, fx.BANK_ATTRS)


# --- sampling --------------------------------------------------------------------------


@query(f"SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY {sql.u('p_partkey', 1, 7)}, p_partkey) AS rn FROM part) WHERE rn <= 150")
def sample_n(spark, sf):
    return sampling.sample_n(fx.read(spark, sf, "part").select("p_partkey", "p_name"), 150, "p_partkey", 7)


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {sql.u('c_custkey', 1, 9)}, c_custkey) AS position FROM customer")
def shuffle_rows(spark, sf):
    return sampling.shuffle_rows(fx.read(spark, sf, "customer").select("c_custkey"), "c_custkey", 9)


@query(
    f"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS total FROM part)
SELECT d.range AS sample_id, p_partkey FROM range(500) d JOIN p ON p.rn = CAST(floor({sql.u('d.range', 2, 11)} * p.total) AS BIGINT) + 1"""
)
def sample_repl(spark, sf):
    return sampling.sample_repl(spark, fx.read(spark, sf, "part").select("p_partkey"), 500, ["p_partkey"], 11)


@query(
    f"""WITH p AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) AS hi, sum(p_size) OVER () AS total FROM part),
d AS (SELECT range AS sample_id, {sql.u('range', 3, 13)} AS u FROM range(500))
SELECT sample_id, p_partkey, p_size FROM d JOIN p ON u * total >= hi - p_size AND u * total < hi"""
)
def sample_weighted(spark, sf):
    df = fx.read(spark, sf, "part").select("p_partkey", F.col("p_size"))
    return sampling.sample_weighted(spark, df, 500, "p_size", "p_partkey", 13)


@query(
    f"""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY -ln(greatest({sql.u('l_orderkey', 'l_linenumber', 19)}, 1.0 / 2147483647)) / l_quantity, l_linenumber) AS rn FROM lineitem) WHERE rn = 1"""
)
def sample_one(spark, sf):
    return sampling.sample_one(fx.read(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", "l_orderkey", "l_linenumber", 19)


@query(
    f"""SELECT c_custkey, round(0.05 + (0.45 - 0.05) * {sql.u('c_custkey', 1, 23)}, 6) AS low,
  round(0 + 0.6 * (sqrt(-2 * ln(greatest({sql.u('c_custkey', 2, 23)}, 1.0 / 2147483647))) * cos(2 * pi() * {sql.u('c_custkey', 2, 24)})), 6) AS z,
  CASE WHEN {sql.u('c_custkey', 3, 23)} < 0.3 THEN 1 ELSE 0 END AS hit FROM customer"""
)
def random_columns(spark, sf):
    return fx.read(spark, sf, "customer").select(
        "c_custkey",
        F.round(hashing.uniform(0.05, 0.45, "c_custkey", 1, 23), 6).alias("low"),
        F.round(hashing.normal(0.0, 0.6, "c_custkey", 2, 23), 6).alias("z"),
        hashing.bernoulli(F.lit(0.3), "c_custkey", 3, 23).alias("hit"),
    )


@query(
    f"""WITH l AS (SELECT p_name || ' ' || p_partkey AS label, row_number() OVER (ORDER BY {sql.u('p_partkey', 1, 31)}, p_partkey) AS rn FROM part),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier)
SELECT s_suppkey, label FROM s JOIN l USING (rn)"""
)
def assign_labels(spark, sf):
    labels = fx.read(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("label"), "p_partkey")
    return sampling.assign_labels(fx.read(spark, sf, "supplier").select("s_suppkey"), labels, "s_suppkey", "label", "p_partkey", 31)


@query(
    "SELECT (CAST(l_linenumber AS BIGINT) - 1) * (SELECT max(l_orderkey) FROM lineitem) + l_orderkey AS draw, round(l_discount, 6) AS v FROM lineitem"
)
def merge_chains(spark, sf):
    df = fx.read(spark, sf, "lineitem").select("l_linenumber", "l_orderkey", F.round("l_discount", 6).alias("v"))
    return sampling.merge_chains(df, "l_linenumber", "l_orderkey")


@query(
    f"""WITH d AS (SELECT DISTINCT l_orderkey FROM lineitem), k AS (SELECT l_orderkey FROM d ORDER BY {sql.u('l_orderkey', 1, 37)}, l_orderkey LIMIT 500),
i AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS draw FROM k)
SELECT i.draw, l_linenumber, l_quantity FROM lineitem JOIN i USING (l_orderkey)"""
)
def thin_draws(spark, sf):
    df = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("draw"), "l_linenumber", "l_quantity")
    return sampling.thin_draws(df, 500, 37)

"""One query for each operator of the engine, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import scalar as fn
from larkspur.operators import relational as op
from larkspur.session import Session, default_root
from larkspur.sources import synthetic
from larkspur.sources.csv import read_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
col = F.col


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return op.scan(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register a query given as a function of the tables."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def q(name: str, f: Callable[[Tables], DataFrame], sql: str) -> None:
    query(name, sql)(f)


n = lambda: F.count(F.lit(1)).alias("n")
rev = lambda: F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), 2)

# --- flagship ---
q("revenue_by_nation", lambda t: op.top_k(t.customer.join(t.orders, col("c_custkey") == col("o_custkey")).join(t.lineitem, col("o_orderkey") == col("l_orderkey")).join(t.nation, col("c_nationkey") == col("n_nationkey")).where(col("l_quantity") >= 10).groupBy("n_name").agg(rev().alias("revenue"), n()).where(col("n") > 5), [("revenue", False), ("n_name", True)], 10),
  "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 10 GROUP BY n_name HAVING count(*) > 5 ORDER BY revenue DESC, n_name LIMIT 10")

# --- scans, projection, predicates ---
q("scan_full", lambda t: t.nation, "SELECT * FROM nation")
q("scan_eq", lambda t: t.orders.where(col("o_custkey") == 7), "SELECT * FROM orders WHERE o_custkey = 7")
q("scan_between", lambda t: t.part.where(col("p_size").between(10, 20)), "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
q("scan_range", lambda t: t.orders.where(col("o_totalprice") > 300000).select("o_orderkey", "o_custkey", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
q("project_expr", lambda t: t.lineitem.select("l_orderkey", F.round(col("l_extendedprice") * (1 - col("l_discount")), 4).alias("net"), (col("l_linenumber") + 1).cast("long").alias("line")), "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net, CAST(l_linenumber + 1 AS BIGINT) AS line FROM lineitem")
q("project_star", lambda t: t.supplier.select("*"), "SELECT * FROM supplier")
q("project_qualified_star", lambda t: t.nation.alias("n").join(t.region.alias("r"), col("n.n_regionkey") == col("r.r_regionkey")).select("n.*"), "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
q("filter_basic", lambda t: t.customer.where(col("c_mktsegment") == "BUILDING"), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
q("filter_compare", lambda t: t.part.where((col("p_size") != 5) & (col("p_size") < 40) & (col("p_size") >= 2) & (col("p_retailprice") <= 1500) & (col("p_retailprice") > 900)).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size <> 5 AND p_size < 40 AND p_size >= 2 AND p_retailprice <= 1500 AND p_retailprice > 900")
q("filter_logic", lambda t: t.orders.where(((col("o_orderstatus") == "F") | (col("o_totalprice") > 200000)) & ~(col("o_orderpriority") == "1-URGENT")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '1-URGENT')")
q("filter_null", lambda t: t.customer.join(t.orders.where(col("o_totalprice") > 250000), col("c_custkey") == col("o_custkey"), "left").where(col("o_orderkey").isNull() & col("c_name").isNotNull()).select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey WHERE o_orderkey IS NULL AND c_name IS NOT NULL")
q("filter_between", lambda t: t.lineitem.where(col("l_quantity").between(5, 7)).groupBy("l_quantity").agg(n()), "SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 7 GROUP BY l_quantity")
q("filter_like", lambda t: t.part.where(fn.like(col("p_name"), "%w_dget%")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%w_dget%' ESCAPE '\\'")
q("filter_in_list", lambda t: t.nation.where(col("n_regionkey").isin(1, 3) & ~col("n_nationkey").isin(2, 4)), "SELECT * FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4)")
q("case_searched", lambda t: t.orders.select("o_orderkey", F.when(col("o_totalprice") > 300000, "high").when(col("o_totalprice") > 100000, "mid").alias("band")), "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band FROM orders")
q("case_simple", lambda t: t.orders.select("o_orderkey", F.when(col("o_orderstatus") == "F", "final").when(col("o_orderstatus") == "O", "open").otherwise("other").alias("state")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
q("arith", lambda t: t.part.select("p_partkey", (col("p_size") + 3 - 2 * col("p_size")).cast("long").alias("a"), fn.divide(col("p_partkey"), col("p_size") - 10, True).cast("long").alias("d"), fn.modulo(col("p_partkey"), col("p_size") - 10).cast("long").alias("m"), F.round(fn.divide(col("p_retailprice"), (col("p_size") - 10).cast("double"), False), 6).alias("r"), (-col("p_size")).cast("long").alias("neg")),
  "SELECT p_partkey, CAST(p_size + 3 - 2 * p_size AS BIGINT) AS a, CAST(p_partkey // nullif(p_size - 10, 0) AS BIGINT) AS d, CAST(p_partkey % nullif(p_size - 10, 0) AS BIGINT) AS m, round(p_retailprice / nullif(CAST(p_size - 10 AS DOUBLE), 0), 6) AS r, CAST(-p_size AS BIGINT) AS neg FROM part")

# --- joins ---
co = lambda t: (t.customer, t.orders)
q("join_inner", lambda t: t.customer.where(col("c_acctbal") > 5000).join(t.orders, col("c_custkey") == col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice"), "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000")
q("join_multi_key", lambda t: t.lineitem.alias("a").join(t.lineitem.alias("b"), (col("a.l_orderkey") == col("b.l_orderkey")) & (col("a.l_suppkey") == col("b.l_suppkey"))).where(col("a.l_partkey") < col("b.l_partkey")).select(col("a.l_orderkey").alias("o"), col("a.l_partkey").alias("p1"), col("b.l_partkey").alias("p2")), "SELECT a.l_orderkey AS o, a.l_partkey AS p1, b.l_partkey AS p2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_partkey < b.l_partkey")
q("join_theta", lambda t: t.nation.join(t.region, col("n_nationkey") > col("r_regionkey") * 5).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey > r_regionkey * 5")
q("join_cross", lambda t: t.region.crossJoin(t.nation).select("r_name", "n_name"), "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_comma", lambda t: t.supplier.crossJoin(t.nation).where(col("s_nationkey") == col("n_nationkey")).select("s_name", "n_name"), "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
q("join_self", lambda t: t.nation.alias("a").join(t.nation.alias("b"), (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") < col("b.n_nationkey"))).select(col("a.n_name").alias("first"), col("b.n_name").alias("second")), "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
q("join_semi", lambda t: t.customer.join(t.orders.where(col("o_totalprice") > 300000), col("c_custkey") == col("o_custkey"), "left_semi"), "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
q("join_anti", lambda t: t.customer.join(t.orders.where(col("o_totalprice") > 100000), col("c_custkey") == col("o_custkey"), "left_anti"), "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
q("join_range", lambda t: op.range_join(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", t.region.select("r_regionkey", (900 + col("r_regionkey") * 150).cast("double").alias("lo"), (1000 + col("r_regionkey") * 150).cast("double").alias("hi")), "lo", "hi", 100.0).select("p_partkey", "r_regionkey"), "SELECT p_partkey, r_regionkey FROM part JOIN region ON p_retailprice BETWEEN 900 + r_regionkey * 150 AND 1000 + r_regionkey * 150")
q("join_multiway", lambda t: t.region.join(t.nation, col("r_regionkey") == col("n_regionkey")).join(t.customer, col("n_nationkey") == col("c_nationkey")).join(t.orders, col("c_custkey") == col("o_custkey")).groupBy("r_name", "n_name").agg(n(), F.round(F.sum("o_totalprice"), 2).alias("total")), "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name")

# --- aggregation ---
g = ("l_returnflag", "l_linestatus")
by = lambda a: lambda t: t.lineitem.groupBy(*g).agg(*a())
sel = lambda x: f"SELECT l_returnflag, l_linestatus, {x} FROM lineitem GROUP BY l_returnflag, l_linestatus"
q("agg_group_by", by(lambda: (n(), F.round(F.avg("l_extendedprice"), 4).alias("mean"),)), sel("count(*) AS n, round(avg(l_extendedprice), 4) AS mean"))
q("agg_group_expr", lambda t: t.orders.groupBy((col("o_custkey") % 10).alias("k")).agg(n()), "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10")
q("agg_global", lambda t: t.orders.where("o_totalprice < 0").agg(n(), F.sum("o_totalprice").alias("total")), "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0")
q("agg_count_star", lambda t: t.events.groupBy("event_type").agg(n()), "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
q("agg_count_col", by(lambda: (F.count(F.nullif(col("l_linenumber"), F.lit(1))).alias("n"),)), sel("count(nullif(l_linenumber, 1)) AS n"))
q("agg_count_distinct", by(lambda: (F.countDistinct("l_suppkey").alias("n"),)), sel("count(DISTINCT l_suppkey) AS n"))
q("agg_sum", by(lambda: (F.sum("l_linenumber").alias("s"), F.round(F.sum("l_quantity"), 2).alias("q"),)), sel("CAST(sum(l_linenumber) AS BIGINT) AS s, round(sum(l_quantity), 2) AS q"))
q("agg_sum_distinct", by(lambda: (F.sum_distinct("l_linenumber").alias("s"), F.expr("avg(DISTINCT l_quantity)").alias("a"), F.expr("min(DISTINCT l_quantity)").alias("lo"),)), sel("CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_quantity) AS a, min(DISTINCT l_quantity) AS lo"))
q("agg_avg", by(lambda: (F.round(F.avg("l_discount"), 6).alias("a"),)), sel("round(avg(l_discount), 6) AS a"))
q("agg_min_max", lambda t: t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.min("p_name").alias("first"), F.max("p_name").alias("last")), "SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_name) AS first, max(p_name) AS last FROM part GROUP BY p_brand")
q("agg_expr_arg", by(lambda: (rev().alias("revenue"),)), sel("round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue"))
q("agg_of_expr", by(lambda: (F.round(F.sum("l_extendedprice") / F.count(F.lit(1)) + F.max("l_tax"), 4).alias("x"),)), sel("round(sum(l_extendedprice) / count(*) + max(l_tax), 4) AS x"))
q("agg_having", lambda t: t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), n()).where("n > 12").select("o_custkey", "total"), "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
q("distinct_rows", lambda t: t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")

# --- windows ---
w = lambda *keys: Window.partitionBy("o_custkey").orderBy(*keys)
price = lambda: w(col("o_totalprice").desc_nulls_first(), "o_orderkey")
status = lambda: w(col("o_orderpriority").asc_nulls_last())
q("win_row_number", lambda t: t.orders.select("o_orderkey", F.row_number().over(price()).cast("long").alias("rn")), "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
q("win_rank", lambda t: t.orders.select("o_orderkey", F.rank().over(status()).cast("long").alias("rk")), "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders")
q("win_dense_rank", lambda t: t.orders.select("o_orderkey", F.dense_rank().over(status()).cast("long").alias("rk")), "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders")
late = lambda: F.nullif(col("o_orderpriority"), F.lit("1-URGENT"))
q("win_nulls", lambda t: t.orders.select("o_orderkey", F.rank().over(w(late().asc_nulls_last())).cast("long").alias("up"), F.rank().over(w(late().desc_nulls_first())).cast("long").alias("down")), "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderpriority, '1-URGENT') ASC NULLS LAST) AS up, rank() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderpriority, '1-URGENT') DESC NULLS FIRST) AS down FROM orders")
q("win_no_order", lambda t: t.nation.select("n_nationkey", op.rank_without_order("rank").cast("long").alias("rk")), "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) AS rk FROM nation")
q("win_topk_per_group", lambda t: op.top_k_per_group(t.orders, ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)], 3).select("o_custkey", "o_orderkey", col("rn").cast("long").alias("rn")), "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")

# --- order and limit ---
q("sort_multi", lambda t: op.order(t.customer.select("c_mktsegment", "c_acctbal", "c_custkey"), ("c_mktsegment", True), ("c_acctbal", False), ("c_custkey", True)), "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
q("sort_expr", lambda t: op.order(t.part.select("p_partkey", "p_size"), (F.when(col("p_size") > 25, 1).otherwise(0), False), (col("p_size") * -1, True), ("p_partkey", True)), "SELECT p_partkey, p_size FROM part ORDER BY CASE WHEN p_size > 25 THEN 1 ELSE 0 END DESC, p_size * -1, p_partkey")
q("sort_hidden_col", lambda t: op.top_k(t.orders, [("o_totalprice", False), ("o_orderkey", True)], 20).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
q("limit_n", lambda t: t.orders.orderBy("o_orderkey").limit(15), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 15")
q("limit_offset", lambda t: t.orders.orderBy("o_orderkey").offset(30).limit(15), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30")
q("topk", lambda t: op.top_k(t.customer, [("c_acctbal", False), ("c_custkey", True)], 10), "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")

# --- set operations ---
a = lambda t: t.customer.where("c_acctbal > 9000").select(col("c_nationkey").alias("k"))
b = lambda t: t.supplier.where("s_acctbal > 5000").select(col("s_nationkey").alias("k"))
A, B = "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000)", "(SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)"
for kind in ("UNION ALL", "UNION", "INTERSECT", "EXCEPT"):
    q("set_" + kind.lower().replace(" ", "_"), lambda t, kind=kind: op.set_operation(kind, a(t), b(t)), f"{A} {kind} {B}")
q("set_chain", lambda t: op.set_operation("EXCEPT", a(t), op.set_operation("EXCEPT", b(t), t.nation.where("n_regionkey = 1").select("n_nationkey"))), f"{A} EXCEPT ({B} EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
q("set_order_limit", lambda t: op.top_k(op.set_operation("UNION", a(t), b(t)), [("k", False)], 7), f"SELECT * FROM ({A} UNION {B}) ORDER BY k DESC LIMIT 7")

# --- subqueries ---
q("subq_scalar", lambda t: t.orders.join(t.orders.agg(F.avg("o_totalprice").alias("m")), col("o_totalprice") > col("m") * 1.9).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * CAST(1.9 AS DOUBLE)")
q("subq_scalar_corr", lambda t: t.customer.join(t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")), col("c_custkey") == col("o_custkey"), "left").select("c_custkey", "top"), "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
big = lambda t: t.orders.where("o_totalprice > 350000").select("o_custkey")
q("subq_in", lambda t: t.customer.join(big(t), col("c_custkey") == col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
q("subq_not_in", lambda t: op.quantified(t.customer, col("c_custkey"), "!=", t.orders.where("o_totalprice > 150000"), "o_custkey", True).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
q("subq_in_corr", lambda t: t.customer.join(t.orders, (col("c_custkey") == col("o_custkey")) & (col("c_nationkey") == col("o_orderkey") % 25), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 25 = c_nationkey)")
q("subq_exists", lambda t: t.part.join(t.lineitem.where("l_quantity >= 50"), col("p_partkey") == col("l_partkey"), "left_semi").select("p_partkey"), "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)")
q("subq_not_exists", lambda t: t.part.join(t.lineitem.where("l_quantity >= 45"), col("p_partkey") == col("l_partkey"), "left_anti").select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
q("subq_any", lambda t: op.quantified(t.customer, col("c_acctbal"), "<", t.supplier.where("s_acctbal < 0"), "s_acctbal", False).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 0)")
q("subq_all", lambda t: op.quantified(t.customer, col("c_acctbal"), ">=", t.supplier.where("s_nationkey = 3"), "s_acctbal", True).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)")
q("derived_table", lambda t: t.orders.groupBy("o_custkey").agg(n()).groupBy("n").agg(F.count(F.lit(1)).alias("customers")), "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) s GROUP BY n")


@query("cte_basic", "WITH per AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey), top AS (SELECT max(total) AS m FROM per) SELECT o_custkey, total FROM per, top WHERE total > m * CAST(0.7 AS DOUBLE)")
def cte_basic(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return per.join(per.agg(F.max("total").alias("m")), col("total") > col("m") * 0.7).select("o_custkey", "total")


# --- functions ---
q("fn_lower", lambda t: t.part.select("p_partkey", fn.lower(col("p_name")).alias("x")), "SELECT p_partkey, lower(p_name) AS x FROM part")
q("fn_upper", lambda t: t.part.select("p_partkey", fn.upper(col("p_name")).alias("x")), "SELECT p_partkey, upper(p_name) AS x FROM part")
q("fn_length", lambda t: t.documents.select("doc_id", fn.length(col("text")).alias("x")), "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS x FROM documents")
q("fn_trim", lambda t: t.customer.select("c_custkey", fn.trim(F.concat(F.lit(" \t"), "c_name", F.lit(" \n"))).alias("x")), "SELECT c_custkey, trim(' ' || chr(9) || c_name || ' ' || chr(10), ' ' || chr(9) || chr(10)) AS x FROM customer")
q("fn_substr", lambda t: t.documents.select("doc_id", fn.substr(col("text"), 3, 7).alias("a"), fn.substr(col("text"), -5).alias("b")), "SELECT doc_id, substr(text, 3, 7) AS a, CASE WHEN length(text) < 5 THEN text ELSE substr(text, -5) END AS b FROM documents")
q("fn_abs", lambda t: t.customer.select("c_custkey", fn.absolute(col("c_acctbal") - 4000).alias("x")), "SELECT c_custkey, abs(c_acctbal - 4000) AS x FROM customer")
q("fn_round", lambda t: t.customer.select("c_custkey", fn.rounded(col("c_acctbal")).alias("a"), fn.rounded(col("c_acctbal") / 7, 3).alias("b")), "SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS a, round(c_acctbal / 7, 3) AS b FROM customer")
q("fn_ceil", lambda t: t.customer.select("c_custkey", fn.ceiling(col("c_acctbal")).alias("x")), "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS x FROM customer")
q("fn_floor", lambda t: t.customer.select("c_custkey", fn.floor(col("c_acctbal")).alias("x")), "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS x FROM customer")
q("fn_coalesce", lambda t: t.orders.select("o_orderkey", fn.coalesce(fn.nullif(col("o_orderstatus"), F.lit("F")), F.lit("-")).alias("x")), "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '-') AS x FROM orders")
q("fn_nullif", lambda t: t.orders.select("o_orderkey", fn.nullif(col("o_orderstatus"), F.lit("O")).alias("x")), "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS x FROM orders")


# --- statements: a private database is changed, the query returns its end state ---
def script(name: str, tables: str, sql: str, statements: list[str]) -> None:
    """Register a script; its last statement is the SELECT whose rows are returned."""

    def run(t: Tables) -> DataFrame:
        session = Session(t.spark)
        for table in tables.split():
            session.attach(table, f"{t.folder}/{table}.parquet")
        for s in statements[:-1]:
            session.execute(s)
        return session.execute(statements[-1])

    q(name, run, sql)


MADE = ["CREATE TABLE acc (id INT PRIMARY KEY, seg VARCHAR, bal FLOAT DEFAULT 0.5)"]
script("loop_while", "customer", "SELECT CAST(5 AS BIGINT) AS n", ["CREATE TABLE k (id INT)", "again: WHILE (SELECT COUNT(*) FROM k) < 10 DO INSERT INTO k VALUES (1); again2: WHILE (SELECT COUNT(*) FROM k) >= 5 DO LEAVE again; END WHILE; END WHILE", "SELECT COUNT(*) AS n FROM k"])
script("udf_sql_expr", "part", "SELECT p_partkey, (p_size + 1) // 2 AS half FROM part WHERE (p_size + 1) // 2 > 10", ["CREATE FUNCTION half(x INT) RETURNS INT AS '(x + 1) / 2'", "SELECT p_partkey, half(p_size) AS half FROM part WHERE half(p_size) > 10"])


ACC = "SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS bal FROM customer"
WHOLE = [MADE[0], "INSERT INTO acc SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"]
for how, sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    # both sides have rows without a partner: customers with no dear order, and orders of other segments
    q(f"join_{how}", lambda t, how=how: t.customer.withColumn("k", F.when(col("c_mktsegment") != "BUILDING", col("c_custkey"))).select("c_custkey", "c_name", "k").join(t.orders.withColumn("o", F.when(col("o_totalprice") > 250000, col("o_custkey"))).select("o_orderkey", "o_custkey", "o"), col("k") == col("o"), how).select("c_custkey", "c_name", "o_orderkey", "o_custkey"), f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer {sql} JOIN orders ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING' AND o_totalprice > 250000")
script("dml_insert", "customer", f"{ACC} UNION ALL SELECT -1, 'NEW', CAST(0.5 AS DOUBLE)", [*WHOLE, "INSERT INTO acc (seg, id) VALUES ('NEW', -1)", "SELECT * FROM acc"])
script("dml_update", "customer", "SELECT c_custkey AS id, c_mktsegment AS seg, CASE WHEN c_acctbal < 0 THEN c_acctbal * -2 ELSE c_acctbal END AS bal FROM customer", [*WHOLE, "UPDATE acc SET bal = bal * -2 WHERE bal < 0", "SELECT * FROM acc"])
script("dml_delete", "customer", f"{ACC} WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal > 5000)", [*WHOLE, "DELETE FROM acc WHERE seg = 'BUILDING' OR bal > 5000", "SELECT * FROM acc"])
script("dml_delete_cascade", "customer orders", "SELECT o_orderkey AS id, o_custkey AS cust FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", [*WHOLE, "CREATE TABLE ord (id INT, cust INT REFERENCES acc(id) ON DELETE CASCADE)", "INSERT INTO ord SELECT o_orderkey, o_custkey FROM orders", "DELETE FROM acc WHERE seg = 'BUILDING'", "SELECT * FROM ord"])
script("dml_merge", "customer", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 'BOTH' ELSE c_mktsegment END AS seg, c_acctbal AS bal FROM customer", [MADE[0], "INSERT INTO acc SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0", "CREATE TABLE src (id INT, seg VARCHAR, bal FLOAT)", "INSERT INTO src SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal <= 0", "MERGE INTO acc USING src ON acc.id = src.id WHEN MATCHED THEN UPDATE SET seg = 'BOTH' WHEN NOT MATCHED THEN INSERT VALUES (src.id, src.seg, src.bal)", "SELECT * FROM acc"])
script("dml_trigger", "customer", "SELECT CAST(2 AS BIGINT) AS n", [*WHOLE, "CREATE TABLE log (id INT)", "CREATE TRIGGER note AFTER UPDATE ON acc FOR EACH ROW BEGIN 'INSERT INTO log VALUES (1)'; 'INSERT INTO log VALUES (2)'; END", "UPDATE acc SET bal = 1 WHERE bal > 0", "SELECT COUNT(*) AS n FROM log"])
script("txn_rollback", "customer", "SELECT count(*) AS n FROM customer", [*WHOLE, "BEGIN", "DELETE FROM acc", "ROLLBACK", "BEGIN", "UPDATE acc SET bal = 0", "COMMIT", "SELECT COUNT(*) AS n FROM acc WHERE id >= 0"])
script("view_logical", "customer", "SELECT c_mktsegment AS seg, count(*) AS n FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT 'NEW') GROUP BY c_mktsegment", [*WHOLE, "CREATE VIEW segs AS SELECT seg, COUNT(*) AS n FROM acc GROUP BY seg", "INSERT INTO acc (id, seg) VALUES (-1, 'NEW')", "SELECT * FROM segs"])
script("mv_snapshot", "customer", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment", [*WHOLE, "CREATE MATERIALIZED VIEW segs AS SELECT seg, COUNT(*) AS n FROM acc GROUP BY seg", "INSERT INTO acc (id, seg) VALUES (-1, 'NEW')", "SELECT * FROM segs"])
script("alter_table", "customer", "SELECT c_custkey AS key, NULL::VARCHAR AS note FROM customer", [*WHOLE, "ALTER TABLE acc ADD COLUMN note VARCHAR", "ALTER TABLE acc RENAME COLUMN id TO key", "ALTER TABLE acc DROP COLUMN seg", "ALTER TABLE acc DROP COLUMN bal", "RENAME TABLE acc TO account", "SELECT * FROM account"])
script("dialect_select", "orders customer", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds, CAST(sum(o_orderkey) // count(*) AS BIGINT) AS mean FROM orders WHERE o_totalprice > ANY (SELECT c_acctbal * 30 FROM customer WHERE c_acctbal > 5000) GROUP BY o_custkey HAVING count(*) > 3", ["SELECT o_custkey, COUNT(DISTINCT o_orderstatus) AS kinds, SUM(o_orderkey) / COUNT(*) AS mean FROM orders WHERE o_totalprice > ANY (SELECT c_acctbal * 30 FROM customer WHERE c_acctbal > 5000) GROUP BY o_custkey HAVING COUNT(*) > 3"])

@query("load_csv", "SELECT c_custkey AS id, nullif(c_name, '') AS name, c_acctbal AS bal FROM customer")
def load_csv(t: Tables) -> DataFrame:
    """A table written as CSV and loaded back by the dialect's rules."""
    path = f"{default_root(t.spark)}/csv"
    t.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("bal")).write.option("header", True).csv(path)
    return read_csv(t.spark, path, [("id", "bigint"), ("name", "string"), ("bal", "double")])


q("generate_data", lambda t: synthetic.employees(t.spark, 1000).agg(n(), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.when(~col("salary").between(30000, 149999) | ~col("age").between(22, 64), 1).otherwise(0)).cast("long").alias("bad")), "SELECT CAST(1000 AS BIGINT) AS n, CAST(1 AS BIGINT) AS lo, CAST(1000 AS BIGINT) AS hi, CAST(0 AS BIGINT) AS bad")

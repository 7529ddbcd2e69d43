"""The SQL surface over registered views, and the selections of frontends, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import selection as L
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t
from palimpsest.sources.tables import sql


def _sql(name: str, text: str, duck: str | None = None) -> None:
    """A query that is SQL on both sides, as a user would send it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events"):
            if table in text:
                t(spark, sf_dir, table).createOrReplaceTempView(table)
        return sql(spark, text)

    run.__name__ = name
    run.__doc__ = "SQL passthrough."
    query(duck or text)(run)


_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_cube", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
_sql("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("sql_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
_sql("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
_sql("sql_having", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 10")
_sql("sql_window_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM orders")
_sql("sql_scalar_subquery", "SELECT c_custkey, round(c_acctbal, 2) AS bal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_sql("sql_correlated_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 1 AND l_tax > 0.07)")
_sql("sql_five_way_join", "SELECT r_name, n_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name, o_orderstatus")
_sql(
    "sql_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem) PIVOT (count(l_orderkey) FOR l_linestatus IN ('O' AS open, 'F' AS finished))",
    "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_linestatus = 'F') AS finished FROM lineitem GROUP BY 1",
)
_sql("sql_recursive", "WITH RECURSIVE r(n, k) AS (SELECT 0, o_orderkey FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT n + 1, o_orderkey FROM r JOIN orders ON o_orderkey = 2 * k + 1 WHERE n < 12) SELECT n, k, count(*) AS paths FROM r GROUP BY n, k")
_sql("sql_lateral_json", "SELECT event_type, count(*) AS n, max(CAST(get_json_object(props, '$.k') AS INT)) AS top FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, max(json_extract_string(props, '$.k')::INT) AS top FROM events GROUP BY event_type")


@query("""
SELECT o_orderkey AS act, CASE WHEN o_orderkey % 50 = 0 THEN 'undated' WHEN strftime(o_orderdate, '%Y-%m-%d') > '1997-01-01' THEN 'after_cutoff' WHEN o_orderstatus = 'F' AND strftime(o_orderdate::DATE + 90, '%Y-%m-%d') <= '1997-01-01' THEN 'repealed' ELSE 'applied' END AS decision FROM orders""")
def select_applicable_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts that apply at a cutoff, and why the others do not."""
    o = t(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    acts = o.select(F.col("o_orderkey").alias("act"), day.alias("enacted"), day.alias("effective"), F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(F.to_date("o_orderdate"), 90), "yyyy-MM-dd")).alias("repealed"))
    return L.applicable_acts(acts, "1997-01-01").select("act", "decision")


@query("""
SELECT o_custkey, arg_min(o_orderpriority, (r, o_orderkey)) AS o_orderpriority, arg_min(o_orderkey, (r, o_orderkey)) AS o_orderkey, count(*) AS n FROM (SELECT *, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS r FROM orders) GROUP BY 1""")
def select_best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best source per key by a ranking of kinds."""
    return L.best_source(t(spark, sf_dir, "orders"), "o_custkey", {"3-MEDIUM": 0, "1-URGENT": 1}, "o_orderpriority", "o_orderkey")


@query("SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS m, count(DISTINCT l_orderkey) AS n_acts FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1 AND count(DISTINCT l_returnflag) > 1")
def same_moment_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts of one month that write different payloads to one place."""
    line = t(spark, sf_dir, "lineitem").withColumn("m", F.date_format("l_shipdate", "yyyy-MM"))
    return L.same_moment_clashes(line, "l_partkey", "m", "l_orderkey", "l_returnflag")


@query("SELECT CASE WHEN l_quantity > 45 THEN 'too_large' WHEN l_discount = 0 THEN 'no_discount' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'ready' END AS gate, count(*) AS n FROM lineitem GROUP BY 1")
def readiness_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that blocks each row."""
    return L.gate_counts(t(spark, sf_dir, "lineitem"), [(F.col("l_quantity") > 45, "too_large"), (F.col("l_discount") == 0, "no_discount"), (F.col("l_returnflag") == "R", "returned")])


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2")
def repeal_no_double_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates apart from the first."""
    kept, _ = L.exact_duplicates(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"], "l_linenumber")
    return kept.select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, count(*) AS n_ops, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources FROM lineitem GROUP BY 1")
def op_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources made each unit."""
    return L.attribution(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("""
WITH i AS (SELECT DISTINCT 'b' || l_suppkey AS branch, l_partkey FROM lineitem) SELECT l_partkey, count(*) AS n_branches, string_agg(branch, ',' ORDER BY branch) AS branches FROM i GROUP BY 1 HAVING count(*) > 1""")
def branch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that several branches touch."""
    ops = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("branch"), "l_partkey")
    return L.branch_impact(ops, "branch", "l_partkey")[1]


@query("""
WITH c AS (SELECT p_partkey, '3' || (1990 + p_size) || CASE p_partkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'L' WHEN 2 THEN 'D' ELSE 'X' END || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS celex FROM part WHERE p_partkey % 10000 > 0)
SELECT p_partkey, CASE WHEN substr(celex, 6, 1) <> 'X' THEN CASE substr(celex, 6, 1) WHEN 'R' THEN 'reg' WHEN 'L' THEN 'dir' ELSE 'dec' END || '/' || substr(celex, 2, 4) || '/' || (p_partkey % 10000) END AS eli FROM c""")
def id_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one scheme in another."""
    p = t(spark, sf_dir, "part").filter("p_partkey % 10000 > 0")
    kind = F.when(F.col("p_partkey") % 4 == 0, "R").when(F.col("p_partkey") % 4 == 1, "L").when(F.col("p_partkey") % 4 == 2, "D").otherwise("X")
    celex = F.concat(F.lit("3"), (F.col("p_size") + 1990).cast("string"), kind, F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    return p.select("p_partkey", L.celex_to_eli(celex).alias("eli"))


@query("""
WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT DISTINCT k FROM (SELECT k FROM (SELECT o_orderpriority AS family, min(o_orderkey) AS k FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, min(o_orderkey) FROM orders GROUP BY 1) UNION ALL SELECT 77)""")
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that between them have every family, with a pinned one."""
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array("o_orderpriority", "o_orderstatus").alias("families"))
    return L.greedy_cover(rows, "k", "families", [77]).select("k")


@query("""
SELECT 'n' || s_suppkey AS src, 'transposes' AS kind, 'd' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || s_suppkey, 'evidenced_by', 'c' || s_suppkey FROM supplier UNION ALL SELECT 'c' || s_suppkey, 'asserted_by', s_name FROM supplier""")
def transposition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim as three edges."""
    s = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    claims = t(spark, sf_dir, "supplier").select(s("c", "s_suppkey").alias("claim"), s("n", "s_suppkey").alias("national"), s("d", "s_nationkey").alias("directive"), F.col("s_name").alias("authority"))
    return L.transposition_edges(claims)

"""Temporal queries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import temporal as T
from palimpsest.operators.temporal import select_point_in_time
from palimpsest.plans.catalog import query
from palimpsest.session import load_table


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user: errors and sign-ups are temporary and last three days."""
    day = F.date_format("ts", "yyyy-MM-dd")
    temporary = F.col("event_type").isin("error", "signup")
    return load_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("addr"),
        day.alias("effective"),
        day.alias("enacted"),
        F.when(temporary, F.date_format(F.date_add(F.to_date("ts"), 3), "yyyy-MM-dd")).otherwise("").alias("expires"),
        F.when(temporary, "temporary").otherwise("permanent").alias("variant"),
        F.col("event_id").alias("pos"),
        F.col("event_id").alias("content"),
    )


EVENT_VERSIONS_SQL = """
v AS (SELECT user_id AS addr, strftime(ts, '%Y-%m-%d') AS effective, strftime(ts, '%Y-%m-%d') AS enacted,
  CASE WHEN event_type IN ('error', 'signup') THEN strftime(ts::DATE + 3, '%Y-%m-%d') ELSE '' END AS expires,
  CASE WHEN event_type IN ('error', 'signup') THEN 'temporary' ELSE 'permanent' END AS variant, event_id AS pos, event_id AS content FROM events)"""


@query(f"""
WITH {EVENT_VERSIONS_SQL},
e AS (SELECT * FROM v WHERE effective <= '2024-01-15' AND (expires = '' OR expires > '2024-01-15')),
r AS (SELECT *, row_number() OVER (PARTITION BY addr, variant ORDER BY effective DESC, enacted DESC, pos DESC) AS rn FROM e),
o AS (SELECT * FROM r WHERE rn = 1 AND variant = 'temporary'), b AS (SELECT * FROM r WHERE rn = 1 AND variant = 'permanent'),
x AS (SELECT coalesce(o.addr, b.addr) AS addr, o.addr IS NOT NULL AND NOT coalesce(b.effective > o.effective AND o.expires <> '' AND b.effective >= strftime(o.expires::DATE - 1, '%Y-%m-%d'), false) AS use_overlay,
  o.content AS oc, b.content AS bc, o.effective AS oe, b.effective AS be FROM o FULL JOIN b ON o.addr = b.addr)
SELECT addr, CASE WHEN use_overlay THEN 'temporary' ELSE 'permanent' END AS rail, CASE WHEN use_overlay THEN oe ELSE be END AS effective,
  CASE WHEN use_overlay THEN oc ELSE bc END AS content FROM x""")
def pit_two_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-rail point-in-time selection with the hand-off rule."""
    return select_point_in_time(event_versions(spark, sf_dir), "2024-01-15").select("addr", "rail", "effective", "content")


@query(f"""
WITH {EVENT_VERSIONS_SQL},
e AS (SELECT * FROM v WHERE effective <= '2024-01-20' AND (expires = '' OR expires > '2024-01-20') AND (enacted = '' OR enacted <= '2024-01-20'))
SELECT addr, count(*) AS n, max(effective) AS latest FROM e GROUP BY addr""")
def pit_eligibility_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions eligible in 'in_force' mode, counted per address."""
    return event_versions(spark, sf_dir).filter(T.eligible("2024-01-20", "in_force")).groupBy("addr").agg(F.count(F.lit(1)).alias("n"), F.max("effective").alias("latest"))


@query("""
WITH top AS (SELECT l_orderkey AS k, max(strftime(l_shipdate, '%Y-%m-%d')) AS effective FROM lineitem GROUP BY 1),
low AS (SELECT l_orderkey AS k, l_linenumber AS n, max(strftime(l_shipdate, '%Y-%m-%d')) AS effective, max(l_quantity) > 2 AS content FROM lineitem GROUP BY 1, 2)
SELECT k::VARCHAR AS addr FROM top UNION ALL SELECT low.k || '/' || n FROM low JOIN top ON top.k = low.k WHERE content AND top.effective <= low.effective""")
def pit_materialise_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected versions that no ancestor hides."""
    line = load_table(spark, sf_dir, "lineitem").withColumn("d", F.date_format("l_shipdate", "yyyy-MM-dd"))
    top = line.groupBy(F.col("l_orderkey").cast("string").alias("addr")).agg(F.max("d").alias("effective")).withColumns({"rail": F.lit("permanent"), "content": F.lit("x")})
    low = line.groupBy(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("addr")).agg(F.max("d").alias("effective"), F.when(F.max("l_returnflag") == "R", "temporary").otherwise("permanent").alias("rail"), F.when(F.max("l_quantity") > 2, "x").alias("content"))
    return T.visible(top.unionByName(low)).select("addr")


RULES_SQL = """
r AS (SELECT o_custkey AS op, CASE o_orderpriority WHEN '1-URGENT' THEN 'immediate' WHEN '2-HIGH' THEN 'fixed_date' ELSE 'pending_decree' END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS fixed,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate::DATE + 30, '%Y-%m-%d') END AS resolved, o_totalprice > 400000 AS superseded FROM orders),
s AS (SELECT op, CASE WHEN superseded THEN 'inactive' WHEN kind = 'immediate' THEN 'active' WHEN kind = 'fixed_date' THEN CASE WHEN fixed <= '1997-06-01' THEN 'active' ELSE 'scheduled' END
  WHEN resolved IS NULL THEN 'pending' WHEN resolved <= '1997-06-01' THEN 'active' ELSE 'scheduled' END AS status FROM r)"""


def activation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "immediate").when(F.col("o_orderpriority") == "2-HIGH", "fixed_date").otherwise("pending_decree")
    resolved = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd"))
    return o.select(F.col("o_custkey").alias("op"), T.temporal_status(kind, F.date_format("o_orderdate", "yyyy-MM-dd"), resolved, F.col("o_totalprice") > 400000, "1997-06-01").alias("status"))


@query(f"WITH {RULES_SQL} SELECT op, status FROM s")
def temporal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of activation rules at a date."""
    return activation_status(spark, sf_dir).select("op", "status")


@query(f"WITH {RULES_SQL} SELECT op, CASE WHEN bool_or(status = 'pending') THEN 'pending' WHEN bool_or(status = 'active') THEN 'active' WHEN bool_or(status = 'scheduled') THEN 'scheduled' ELSE 'inactive' END AS status FROM s GROUP BY op")
def temporal_status_over_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status per op over its rules, by priority."""
    return activation_status(spark, sf_dir).groupBy("op").agg(T.overall_status(F.col("status")).alias("status"))


@query("""
SELECT user_id AS op, min(strftime(ts, '%Y-%m-%d')) FILTER (WHERE event_type IN ('click', 'view')) AS effective, min(strftime(ts, '%Y-%m-%d')) FILTER (WHERE event_type IN ('error', 'purchase')) AS expires, bool_or(value > 50) AS contingent FROM events GROUP BY 1""")
def event_op_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective and expiry dates that events give to ops."""
    e = load_table(spark, sf_dir, "events")
    kinds = {"click": "commence", "view": "revive", "error": "expire", "purchase": "suspend"}
    named = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")]
    events = e.select(F.col("user_id").alias("group_id"), named.alias("event_kind"), F.date_format("ts", "yyyy-MM-dd").alias("event_day"), (F.col("value") > 50).alias("contingent"))
    ops = e.select(F.col("user_id").alias("group_id")).distinct()
    return T.op_overrides(ops, events).select(F.col("group_id").alias("op"), "effective", "expires", "contingent")


@query(f"""
WITH {EVENT_VERSIONS_SQL}, c AS (SELECT user_id AS addr, min(strftime(ts, '%Y-%m-%d')) AS day FROM events WHERE value > 90 GROUP BY 1),
j AS (SELECT v.*, day, coalesce(effective <= day AND (expires = '' OR expires > day), false) AS hit FROM v LEFT JOIN c USING (addr))
SELECT content, CASE WHEN hit THEN 'temporary' ELSE variant END AS variant, CASE WHEN hit THEN day ELSE expires END AS expires FROM j""")
def standalone_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that end all live versions of their address."""
    ends = load_table(spark, sf_dir, "events").filter("value > 90").select(F.col("user_id").alias("addr"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return T.cap_versions(event_versions(spark, sf_dir), ends).select("content", "variant", "expires")


@query("""
WITH w AS (SELECT o_orderkey AS id, o_custkey AS addr, strftime(o_orderdate, '%Y-%m-%d') AS effective, strftime(o_orderdate::DATE + (o_orderkey % 60)::INT, '%Y-%m-%d') AS expires, o_orderstatus = 'F' AS proven FROM orders),
n AS (SELECT w.id, any_value(w.effective) AS effective, any_value(w.expires) AS expires, any_value(w.proven) AS proven, min(o.effective) FILTER (WHERE o.effective > w.effective) AS nxt FROM w LEFT JOIN w o USING (addr) GROUP BY w.id)
SELECT id, CASE WHEN NOT proven THEN 'unproven' WHEN effective >= expires THEN 'empty_interval' WHEN nxt < expires THEN 'past_next_occupant' ELSE 'spliced' END AS decision FROM n""")
def interval_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary writes spliced into timelines, or the reason why not."""
    o = load_table(spark, sf_dir, "orders")
    w = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("addr"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"), F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 60).cast("int")), "yyyy-MM-dd").alias("expires"), (F.col("o_orderstatus") == "F").alias("proven"))
    return T.splice_windows(w, w.select("addr", "effective")).select("id", "decision")


@query("""
WITH b AS (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m') || '-01' AS effective, o_orderkey AS seq, strftime(o_orderdate::DATE + 400 + 1, '%Y-%m-%d') AS x FROM orders WHERE strftime(o_orderdate, '%Y-%m') || '-01' <= '1997-06-01')
SELECT t.k, arg_max(x, (t.effective, seq)) AS expires_on, any_value(a.ends) > 1 AS ambiguous, '1997-06-01' >= arg_max(x, (t.effective, seq)) AS expired
FROM b t JOIN (SELECT k, effective, count(DISTINCT x) AS ends, row_number() OVER (PARTITION BY k ORDER BY effective DESC) AS rn FROM b GROUP BY 1, 2) a ON a.k = t.k AND a.rn = 1 GROUP BY t.k""")
def validity_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound that governs at a date, whether it is ambiguous, and whether it has passed."""
    b = load_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-01")).alias("effective"), F.col("o_orderkey").alias("seq"), F.date_format(F.date_add(F.to_date("o_orderdate"), 400), "yyyy-MM-dd").alias("valid_until"))
    return T.governing_bound(b, "k", "1997-06-01")


@query("""
SELECT l_returnflag AS op_type, count(*) AS n FROM (SELECT l_returnflag, strftime(l_shipdate, '%Y') || '/' || l_orderkey AS act FROM lineitem) WHERE TRY_CAST(split_part(act, '/', 1) AS INT) BETWEEN 1994 AND 1996 GROUP BY 1""")
def pit_ops_between_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops of acts within a range of years, by type."""
    line = load_table(spark, sf_dir, "lineitem")
    ops = line.select(F.col("l_returnflag").alias("op_type"), F.concat_ws("/", F.date_format("l_shipdate", "yyyy"), "l_orderkey").alias("act"))
    return T.ops_between(ops, "act", 1994, 1996).groupBy("op_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS effective, o_orderkey AS seq, strftime(o_orderdate::DATE + (o_orderkey % 400)::INT + 1, '%Y-%m-%d') AS x FROM orders)
SELECT k, effective, ended FROM (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY effective, seq) AS ended FROM b) WHERE effective > ended""")
def extension_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions that came after the term had run out."""
    bounds = load_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"), F.col("o_orderkey").alias("seq"), F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")), "yyyy-MM-dd").alias("valid_until"))
    return T.extension_gaps(bounds, "k")

"""Routing, grouping, pair planning, sunsets, candidates and proposals on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import audits as U
from palimpsest.operators import routing as R
from palimpsest.plans.catalog import query
from palimpsest.plans.drafting_queries import order_clauses
from palimpsest.session import load_table as t


def text(c: Column) -> Column:
    return c.cast("string")


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_custkey % 50 AS num FROM orders)
SELECT id, CASE k WHEN 0 THEN 'references_parent' WHEN 1 THEN 'references_parent' WHEN 2 THEN CASE WHEN num = 7 THEN 'num_collision_skip' ELSE 'citation_mismatch_skip' END WHEN 3 THEN 'delegated_authority_nojalla_skip' WHEN 4 THEN 'no_guard_needed' WHEN 5 THEN 'pending_amendment_of_parent_skip' ELSE 'citation_mismatch_skip' END AS routing, k IN (0, 1, 4) AS applies FROM o""")
def amendment_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether amendments are meant for a statute, in seven ways in which their texts say so."""
    k = F.col("o_orderkey") % 7
    cites = lambda what: F.concat(F.lit("muutetaan lain ("), what, F.lit(") 3 §"))
    preamble = F.when(k.isin(0, 6), cites(F.lit("7/2009"))).when(k == 1, None).when(k == 3, F.lit("säädetään lain (1/2000) nojalla")).otherwise(cites(F.lit("1/2000")))
    pairs = t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 4, "x").otherwise(F.concat(F.lit("2012/"), text(F.col("o_custkey") % 50))).alias("amendment_id"), F.lit("2009/7").alias("parent_id"), preamble.alias("preamble"), F.lit(None).cast("string").alias("section_one"),
        F.when(k == 5, "laki vesilain muuttamisesta annetun lain muuttamisesta").when(k == 6, "laki toisen lain (3/1999) muuttamisesta").alias("title"), F.lit("vesilain").alias("parent_title"))
    return R.route_amendments(pairs).select("id", "routing", "applies")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS s, CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' END AS c FROM lineitem),
g AS (SELECT doc_id, s, count(DISTINCT c) AS n, min(c) AS one FROM l GROUP BY 1, 2)
SELECT l.doc_id, l.s::VARCHAR AS group_label, CASE WHEN c IS NULL AND n = 1 THEN one || 'luku' ELSE c || 'luku' END AS group_chapter, CASE WHEN c IS NULL AND n = 1 THEN 'inherited' WHEN c IS NULL AND n > 1 THEN 'ambiguous' ELSE 'own' END AS scope FROM l JOIN g ON g.doc_id = l.doc_id AND g.s = l.s""")
def target_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups in which ops are applied; ops without chapter join the one chapter that others name."""
    chapter = F.when(F.col("l_returnflag") == "A", "1 luku").when(F.col("l_returnflag") == "N", "2 luku")
    ops = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("section").alias("unit"), F.concat(text(F.col("l_linenumber")), F.lit(" §")).alias("section"), chapter.alias("chapter"), F.lit(None).cast("string").alias("part")).distinct()
    return R.group_by_target(ops).select("doc_id", "group_label", "group_chapter", "scope")


@query("""
WITH e AS (SELECT user_id AS doc_id, event_id, strftime(ts, '%Y-%m-%d') AS effective, CASE WHEN event_id % 3 = 0 THEN 'c:1/s:' ELSE 'c:' END || (event_id % 5) AS f, 'x:' || (event_id % 4) AS u, event_type AS source FROM events)
SELECT doc_id, event_id, row_number() OVER (PARTITION BY doc_id ORDER BY effective, len(string_split(f, '/')), f, u, source, event_id) - 1 AS position FROM e""")
def lineage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migration events in their one order."""
    k = F.col("event_id")
    events = t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("effective"), F.concat(F.when(k % 3 == 0, "c:1/s:").otherwise("c:"), text(k % 5)).alias("from_addr"), F.concat(F.lit("x:"), text(k % 4)).alias("to_addr"), F.col("event_type").alias("source"))
    return R.lineage_order(events).select("doc_id", "event_id", "position")


def order_redactions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer's orders as consolidated texts of one group, compared as of half a year after them; their parts as references, by shipping year."""
    o = t(spark, sf_dir, "orders")
    name = F.concat(F.lit("o"), text(F.col("o_orderkey")))
    bases = o.select(name.alias("base_id"), F.date_format(F.date_add(F.to_date("o_orderdate"), 180), "yyyy-MM-dd").alias("as_of"), F.col("o_custkey").alias("group_id"), (F.col("o_orderstatus") != "F").alias("consolidated"))
    redactions = o.select(F.col("o_custkey").alias("group_id"), name.alias("oracle_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"))
    refs = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), text(F.col("l_orderkey"))).alias("id"), text(F.col("l_partkey") % 40).alias("act"), F.lit("s").alias("slice"), F.when(F.col("l_linenumber") != 4, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("starts"))
    return bases, redactions, refs


PLANS_SQL = """
o AS (SELECT 'o' || o_orderkey AS id, o_custkey AS g, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate::DATE + 180, '%Y-%m-%d') AS as_of, o_orderstatus <> 'F' AS consolidated FROM orders),
m AS (SELECT b.id, arg_max(r.id, (r.day, r.id)) AS oracle_id FROM o b JOIN o r ON r.g = b.g AND r.day <= b.as_of GROUP BY 1),
p AS (SELECT o.*, m.oracle_id, CASE WHEN m.oracle_id = o.id THEN 'oracle_is_base' WHEN consolidated THEN 'consolidated' ELSE 'source' END AS comparison FROM o JOIN m ON m.id = o.id)"""


@query(f"WITH {PLANS_SQL} SELECT id AS base_id, oracle_id, comparison FROM p")
def oracle_pair_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each base is compared with as of a day."""
    return R.plan_pairs(*order_redactions(spark, sf_dir))[0].select("base_id", "oracle_id", "comparison")


@query(f"""
WITH {PLANS_SQL}, r AS (SELECT 'o' || l_orderkey AS id, (l_partkey % 40)::VARCHAR AS act, min(CASE WHEN l_linenumber <> 4 THEN strftime(l_shipdate, '%Y-%m-%d') END) AS starts FROM lineitem GROUP BY 1, 2),
x AS (SELECT p.id AS base_id, p.as_of, r.act, r.starts FROM p JOIN r ON r.id = p.oracle_id WHERE comparison = 'consolidated' AND NOT EXISTS (SELECT 1 FROM r own WHERE own.id = p.id AND own.act = r.act) UNION ALL SELECT p.id, p.as_of, r.act, r.starts FROM p JOIN r ON r.id = p.id WHERE comparison = 'source')
SELECT base_id, act, CASE WHEN starts IS NULL THEN 'undated' WHEN starts <= as_of THEN 'effective' ELSE 'future' END AS timing FROM x""")
def oracle_pair_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be applied to a base before it is compared."""
    return R.plan_pairs(*order_redactions(spark, sf_dir))[1].select("base_id", "act", "timing")


@query("""
WITH p AS (SELECT p_partkey AS k, p_size % 4 AS how, p_partkey % 3 AS noted FROM part),
c AS (SELECT *, how = 0 AS same, how = 1 AS a, noted = 1 AS b, noted <> 0 AS signal FROM p)
SELECT k::VARCHAR AS section, CASE WHEN same THEN NULL WHEN a OR b THEN 'sunset_reversion' WHEN signal THEN 'insufficient_signal' END AS classification, CASE WHEN NOT same AND (a OR b) THEN CASE WHEN a AND b THEN 'prior_edition+note' WHEN a THEN 'prior_edition' ELSE 'note' END END AS channels,
  CASE WHEN NOT same AND a THEN 2001 END AS reverts_to, CASE WHEN NOT same AND b THEN '2014-12-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') END AS sunset_day FROM c""")
def sunset_reversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that bring back an earlier text, by editions and by notes."""
    k, how, noted = F.col("p_partkey"), F.col("p_size") % 4, F.col("p_partkey") % 3
    part = t(spark, sf_dir, "part")
    earlier, temporary = F.concat(F.lit("Text of "), "p_name"), F.concat(F.lit("Temporary text of "), "p_name")
    day = F.concat(F.lit("December "), text(k % 28 + 1), F.lit(", 2014"))
    notes = F.when(noted == 1, F.array(F.concat(F.lit("The amendment ceases to be effective "), day, F.lit(".")))).when(noted == 2, F.array(F.concat(F.lit("Enacted on "), day, F.lit("."))))
    changes = part.select(text(k).alias("section"), F.lit(2010).alias("before_year"), F.lit(2014).alias("after_year"), temporary.alias("before_text"), F.when(how == 0, F.upper(temporary)).when(how == 1, F.concat(earlier, F.lit("  "))).otherwise(F.lit("a new text")).alias("after_text"), notes.alias("notes"))
    editions = part.select(text(k).alias("section"), F.explode(F.array(F.lit(2001), F.lit(2005))).alias("year"), earlier.alias("text"))
    return R.sunset_reversions(changes, editions).select("section", "classification", "channels", "reverts_to", "sunset_day")


@query("""
WITH d AS (SELECT l_suppkey AS base_id, 's:' || (l_partkey % 200) AS addr, max(l_quantity)::INT AS size, min(CASE l_returnflag WHEN 'A' THEN 'oracle_wrong' WHEN 'R' THEN 'replay_bug' END) FILTER (WHERE l_linenumber > 2) AS bucket, max(CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS act FROM lineitem GROUP BY 1, 2)
SELECT base_id, addr, CASE WHEN bucket IS NULL THEN 'triage' ELSE 'strong' END AS tier, act, row_number() OVER (PARTITION BY base_id ORDER BY bucket IS NULL, size DESC, addr) AS rank FROM d WHERE bucket IS NULL OR bucket = 'oracle_wrong'""")
def consolidation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences that are the consolidation's fault or have not been looked at, ranked."""
    line = t(spark, sf_dir, "lineitem").withColumns({"base_id": F.col("l_suppkey"), "addr": F.concat(F.lit("s:"), text(F.col("l_partkey") % 200))})
    divergences = line.groupBy("base_id", "addr").agg(F.max("l_quantity").cast("int").alias("size"))
    bucket = F.when(F.col("l_returnflag") == "A", "oracle_wrong").when(F.col("l_returnflag") == "R", "replay_bug")
    records = line.filter("l_linenumber > 2").select("base_id", "addr", bucket.alias("bucket")).filter("bucket is not null")
    acts = line.filter("l_linestatus = 'F'").select("base_id", "addr", F.col("l_orderkey").alias("act"))
    return R.consolidation_candidates(divergences, records, acts, ["oracle_wrong"]).select("base_id", "addr", "tier", "act", "rank")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS f, l_partkey % 90 + 1 AS s, l_linenumber AS m, l_linestatus = 'F' AS deep FROM lineitem),
n AS (SELECT id, sum(CASE WHEN f = 'N' AND m = 1 THEN 1 ELSE 2 END)::BIGINT AS ops FROM l GROUP BY 1)
SELECT 'he:2020/' || o_orderkey AS branch_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'partial' ELSE 'full' END AS parse_status, CASE WHEN o_orderstatus = 'F' THEN 'cited' ELSE 'given' END AS target_resolution, CASE WHEN o_orderstatus = 'F' THEN '1999/' || (o_orderkey % 900 + 1) ELSE '2000/1' END AS target_statute_id, ops FROM orders JOIN n ON n.id = o_orderkey""")
def proposal_branch_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What proposals would do to statutes, read from their clauses, counted by branch."""
    proposals = order_clauses(spark, sf_dir).select(F.concat(F.lit("HE "), text(F.col("id")), F.lit("/2020")).alias("he_id"), F.lit(2020).alias("he_year"), F.col("id").alias("he_number"), F.col("text").alias("clause"), F.lit("2000/1").alias("statute"))
    return R.proposal_ops(proposals).groupBy("branch_id", "parse_status", "target_resolution", "target_statute_id").agg(F.count(F.lit(1)).alias("ops"))


# ---------------------------------------------------------------- census and reconciliation


@query("""
WITH n AS (SELECT 'o' || o_orderkey AS node, 'order' AS kind FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'p' || p_partkey, 'part' FROM part WHERE p_size < 40), e AS (SELECT 'o' || l_orderkey AS src, l_returnflag AS relation, 'p' || l_partkey AS dst FROM lineitem),
d AS (SELECT n.node, n.kind, coalesce(c.n, 0) AS degree FROM n LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) c USING (node))
SELECT 'nodes' AS census, kind, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'isolated', kind, count(*) FROM d WHERE degree = 0 GROUP BY 2 UNION ALL SELECT 'edges', relation, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'unknown_source', relation, count(*) FROM e WHERE src NOT IN (SELECT node FROM n) GROUP BY 2
UNION ALL SELECT 'unknown_target', relation, count(*) FROM e WHERE dst NOT IN (SELECT node FROM n) GROUP BY 2 UNION ALL SELECT 'repeated', relation, count(*) FROM (SELECT src, relation, dst FROM e GROUP BY ALL HAVING count(*) > 1) GROUP BY 2
UNION ALL SELECT 'degree', CASE WHEN degree < 3 THEN degree::VARCHAR WHEN degree < 10 THEN '3-9' ELSE '10+' END, count(*) FROM d GROUP BY 2""")
def graph_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, loose ends and degrees of a corpus graph."""
    orders, part = t(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'"), t(spark, sf_dir, "part").filter("p_size < 40")
    nodes = orders.select(F.concat(F.lit("o"), text(F.col("o_orderkey"))).alias("node"), F.lit("order").alias("kind")).unionAll(part.select(F.concat(F.lit("p"), text(F.col("p_partkey"))), F.lit("part")))
    edges = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), text(F.col("l_orderkey"))).alias("src"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("p"), text(F.col("l_partkey"))).alias("dst"))
    return U.graph_census(nodes, edges)


@query("""
WITH n AS (SELECT l_orderkey AS statute, l_linenumber AS s, max(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2),
r AS (SELECT statute, CASE WHEN q % 9 = 0 AND q % 11 = 0 THEN NULL WHEN q % 11 = 0 THEN 'only_replay' WHEN q % 9 = 0 THEN 'only_oracle' WHEN q % 5 = 0 THEN 'differs' ELSE 'agree' END AS status FROM n)
SELECT statute, count(*) FILTER (WHERE status = 'agree') AS agree, count(*) FILTER (WHERE status = 'differs') AS differs, count(*) FILTER (WHERE status = 'only_replay') AS only_replay, count(*) FILTER (WHERE status = 'only_oracle') AS only_oracle, count(*) FILTER (WHERE status = 'agree') / count(*) AS share FROM r WHERE status IS NOT NULL GROUP BY 1""")
def reconcile_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two sides agree, by statute."""
    n = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("statute"), F.col("l_linenumber").alias("s")).agg(F.max("l_quantity").cast("int").alias("q"))
    q, selector = F.col("q"), F.concat(F.lit("s:"), text(F.col("s"))).alias("selector")
    replayed = n.select("statute", selector, F.when(q % 9 != 0, F.concat(F.lit("Text, "), text(q))).alias("text"))
    oracle = n.select("statute", selector, F.when(q % 11 != 0, F.concat(F.lit("TEXT "), text(q), F.when(q % 5 == 0, "x").otherwise("."))).alias("text"))
    return U.reconcile(replayed, oracle)[1]

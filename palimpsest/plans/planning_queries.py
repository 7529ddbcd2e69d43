"""Planning operators on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import planning as N
from palimpsest.plans.catalog import query
from palimpsest.plans.relational_queries import REF_SQL, line_references
from palimpsest.session import load_table as t


def iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


@query("""
WITH v AS (SELECT 'part:' || l_partkey AS addr, strftime(l_shipdate, '%Y-%m-%d') AS effective, CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate::DATE + 700, '%Y-%m-%d') ELSE '' END AS expires, l_linestatus AS territory, CASE WHEN l_quantity > 5 THEN l_orderkey::VARCHAR END AS content FROM lineitem),
q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'xx' ELSE 'fi' END AS jurisdiction, CASE WHEN o_orderkey % 7 = 0 THEN 'part' ELSE 'part:' || (o_orderkey % 2500) END AS provision, CASE WHEN o_orderkey % 5 = 0 THEN '1996' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_of, 'governing' AS query_type FROM orders),
j AS (SELECT *, CASE WHEN jurisdiction <> 'fi' THEN 'unsupported_jurisdiction' WHEN length(as_of) <> 10 THEN 'invalid_query' WHEN provision = 'part' THEN 'invalid_selector' END AS error FROM q),
e AS (SELECT j.id, v.* FROM j JOIN v ON provision = addr AND effective <= as_of AND (expires = '' OR expires > as_of) WHERE error IS NULL),
l AS (SELECT id, max(effective) AS effective FROM e GROUP BY 1), a AS (SELECT id, effective, count(DISTINCT territory) AS places, max(content) AS content, count(content) AS live FROM e JOIN l USING (id, effective) GROUP BY 1, 2),
s AS (SELECT j.id, CASE WHEN error IS NOT NULL THEN error WHEN a.effective IS NULL THEN 'absent' WHEN places > 1 THEN 'ambiguous' WHEN live = 0 THEN 'tombstone' ELSE 'found' END AS status, a.effective, a.content FROM j LEFT JOIN a ON j.id = a.id)
SELECT id, status, CASE WHEN status = 'found' THEN effective END AS effective, CASE WHEN status = 'found' THEN content END AS content FROM s""")
def provision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a provision at a day, or the typed reason why there is none."""
    k = F.col("o_orderkey")
    asked = t(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 11 == 0, "xx").otherwise("fi").alias("jurisdiction"), F.when(k % 7 == 0, "part").otherwise(F.concat(F.lit("part:"), (k % 2500).cast("string"))).alias("provision"),
        F.when(k % 5 == 0, "1996").otherwise(iso("o_orderdate")).alias("as_of"), F.lit("governing").alias("query_type"))
    expires = F.when(F.col("l_returnflag") == "A", F.date_format(F.date_add(F.to_date("l_shipdate"), 700), "yyyy-MM-dd")).otherwise("")
    versions = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("addr"), iso("l_shipdate").alias("effective"), expires.alias("expires"), F.col("l_linestatus").alias("territory"), F.when(F.col("l_quantity") > 5, F.col("l_orderkey").cast("string")).alias("content"))
    return N.provision_states(asked, versions, ["fi"])


ANSWERS_SQL = """
v AS (SELECT 'part:' || l_partkey AS addr, CASE WHEN l_linenumber > 5 THEN 'temporary' ELSE 'permanent' END AS variant, strftime(l_shipdate, '%Y-%m-%d') AS effective, CASE WHEN l_linenumber <> 2 THEN strftime(l_shipdate::DATE + (l_suppkey % 200 - 150)::INT, '%Y-%m-%d') END AS enacted,
  CASE WHEN l_linenumber > 5 OR l_returnflag = 'A' THEN strftime(l_shipdate::DATE + 500, '%Y-%m-%d') END AS expires, CASE WHEN l_suppkey % 6 = 0 THEN l_linestatus END AS place, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity > 8 THEN l_orderkey::VARCHAR END AS content FROM lineitem),
q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'xx' ELSE 'fi' END AS jurisdiction, CASE WHEN o_orderkey % 17 = 0 THEN 'part' ELSE 'part:' || (o_orderkey % 2100) END AS provision, CASE WHEN o_orderkey % 19 = 0 THEN '1999' ELSE strftime(o_orderdate::DATE + 365, '%Y-%m-%d') END AS as_of,
  CASE o_custkey % 4 WHEN 0 THEN 'governing' WHEN 1 THEN 'in_force' WHEN 2 THEN 'enacted' ELSE CASE WHEN o_custkey % 8 = 3 THEN 'other' ELSE 'governing' END END AS kind, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS territory FROM orders),
j AS (SELECT *, CASE WHEN jurisdiction <> 'fi' THEN 'unsupported_jurisdiction' WHEN length(as_of) <> 10 OR kind = 'other' THEN 'invalid_query' WHEN provision = 'part' THEN 'invalid_selector' END AS error FROM q),
m AS (SELECT j.id, j.kind, v.*, CASE WHEN kind = 'enacted' THEN v.enacted ELSE v.effective END AS moment, place IS NULL OR territory IS NOT NULL AS general, variant = 'temporary' AND kind <> 'enacted' AS temp FROM j JOIN v ON addr = provision
  WHERE error IS NULL AND CASE WHEN kind = 'enacted' THEN coalesce(enacted <= as_of, false) ELSE effective <= as_of AND (expires IS NULL OR expires > as_of) AND (kind = 'governing' OR enacted IS NULL OR enacted <= as_of) END AND (territory IS NULL OR place IS NULL OR place = territory)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, temp ORDER BY CASE WHEN kind = 'enacted' THEN enacted ELSE effective END DESC, CASE WHEN kind = 'enacted' THEN effective ELSE coalesce(enacted, '') END DESC, pos DESC) AS rn FROM m WHERE general),
o AS (SELECT * FROM r WHERE temp AND rn = 1), b AS (SELECT * FROM r WHERE NOT temp AND rn = 1),
a AS (SELECT id, max(moment) FILTER (WHERE general) AS g, max(moment) FILTER (WHERE NOT general) AS l, list_sort(list(DISTINCT place) FILTER (WHERE place IS NOT NULL)) AS places FROM m GROUP BY id),
x AS (SELECT j.id, j.error, j.kind, o.id IS NOT NULL AND NOT coalesce(b.effective > o.effective AND b.effective >= strftime(o.expires::DATE - 1, '%Y-%m-%d'), false) AS overlay, o.effective AS oe, o.content AS oc, b.id IS NOT NULL AS has_b, b.effective AS be, b.content AS bc, coalesce(a.l >= coalesce(a.g, ''), false) AS unclear, a.places FROM j LEFT JOIN o ON o.id = j.id LEFT JOIN b ON b.id = j.id LEFT JOIN a ON a.id = j.id),
y AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN unclear THEN 'ambiguous' WHEN NOT overlay AND NOT has_b THEN 'absent' WHEN CASE WHEN overlay THEN oc ELSE bc END IS NULL THEN 'tombstone' ELSE 'found' END AS status FROM x)"""


@query(f"""
WITH {ANSWERS_SQL}
SELECT id, status, CASE WHEN status IN ('found', 'tombstone') THEN CASE WHEN overlay THEN 'temporary' WHEN kind <> 'enacted' THEN 'permanent' END END AS rail, CASE WHEN status IN ('found', 'tombstone') THEN CASE WHEN overlay THEN oe ELSE be END END AS effective,
  CASE WHEN status = 'found' THEN CASE WHEN overlay THEN oc ELSE bc END END AS content, CASE WHEN status = 'ambiguous' THEN places END AS candidates FROM y""")
def provision_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of three types about provisions at a day and in a territory, over two rails."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 8
    asked = t(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 13 == 0, "xx").otherwise("fi").alias("jurisdiction"), F.when(k % 17 == 0, "part").otherwise(F.concat(F.lit("part:"), (k % 2100).cast("string"))).alias("provision"), F.when(k % 19 == 0, "1999").otherwise(F.date_format(F.date_add(F.to_date("o_orderdate"), 365), "yyyy-MM-dd")).alias("as_of"),
        F.when(c.isin(1, 5), "in_force").when(c.isin(2, 6), "enacted").when(c == 3, "other").otherwise("governing").alias("query_type"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("territory"))
    n, shipped = F.col("l_linenumber"), F.to_date("l_shipdate")
    versions = t(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("addr"), F.when(n > 5, "temporary").otherwise("permanent").alias("variant"), iso("l_shipdate").alias("effective"), F.when(n != 2, F.date_format(F.date_add(shipped, (F.col("l_suppkey") % 200 - 150).cast("int")), "yyyy-MM-dd")).alias("enacted"),
        F.when((n > 5) | (F.col("l_returnflag") == "A"), F.date_format(F.date_add(shipped, 500), "yyyy-MM-dd")).alias("expires"), F.when(F.col("l_suppkey") % 6 == 0, F.col("l_linestatus")).alias("territory"), (F.col("l_orderkey") * 10 + n).alias("pos"), F.when(F.col("l_quantity") > 8, F.col("l_orderkey").cast("string")).alias("content"))
    return N.provision_answers(asked, versions, ["fi"])


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'ambiguous' WHEN c_nationkey < 12 THEN 'applies' ELSE 'elsewhere' END AS status FROM customer")
def ambiguous_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a rule applies to a place, with unknown places kept apart."""
    place = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    return t(spark, sf_dir, "customer").select("c_custkey", N.scope_status(place < 12, place).alias("status"))


@query(f"""
WITH {REF_SQL}, s AS (SELECT min(source_statute_id) AS s FROM refs)
SELECT source_provision_ref_str, target_provision_ref_str, CASE WHEN coalesce(valid_at_start BETWEEN '1993-01-01' AND '1998-12-31', false) AND coalesce(valid_at_end BETWEEN '1993-01-01' AND '1998-12-31', false) THEN 'started_and_ended' WHEN coalesce(valid_at_start BETWEEN '1993-01-01' AND '1998-12-31', false) THEN 'started' ELSE 'ended' END AS change
FROM refs, s WHERE source_statute_id = s.s AND (coalesce(valid_at_start BETWEEN '1993-01-01' AND '1998-12-31', false) OR coalesce(valid_at_end BETWEEN '1993-01-01' AND '1998-12-31', false))""")
def pit_diff_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a statute that start or end between two days."""
    refs = line_references(spark, sf_dir)
    statute = refs.agg(F.min("source_statute_id")).first()[0]
    return N.reference_changes(refs, statute, "1993-01-01", "1998-12-31").select("source_provision_ref_str", "target_provision_ref_str", "change")


@query("SELECT event_id, event_type AS rule, value FROM events WHERE event_type = 'purchase' AND value > 50 AND event_id % 2 = 0")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows by rule, phase, status and an entry of their details."""
    e = t(spark, sf_dir, "events")
    rows = e.select("event_id", "value", F.col("event_type").alias("rule"), F.when(F.col("value") > 50, "late").otherwise("early").alias("phase"), F.lit("open").alias("status"), F.to_json(F.struct((F.col("event_id") % 2).cast("string").alias("side"))).alias("detail"))
    return N.filter_evidence(rows, "purchase", "late", "open", {"side": "0"}).select("event_id", "rule", "value")


DUPLICATES_SQL = """
v AS (SELECT l_partkey AS addr, strftime(l_shipdate, '%Y-%m') AS effective, l_returnflag AS content, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY addr, effective, content ORDER BY pos) AS rn FROM v),
g AS (SELECT *, CASE WHEN rn > 1 THEN 'same_day_same_content' WHEN content = lag(content) OVER (PARTITION BY addr, rn = 1 ORDER BY effective, pos) THEN 'no_change' END AS rule FROM r)"""


def monthly_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("addr"), F.date_format("l_shipdate", "yyyy-MM").alias("effective"), F.col("l_returnflag").alias("content"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


@query(f"WITH {DUPLICATES_SQL} SELECT addr, pos, content FROM g WHERE rule IS NULL")
def dedupe_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions without duplicates."""
    return N.drop_duplicate_versions(monthly_versions(spark, sf_dir))[0].select("addr", "pos", "content")


@query(f"WITH {DUPLICATES_SQL} SELECT addr, pos, rule FROM g WHERE rule IS NOT NULL")
def dedupe_versions_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicates, each with the rule that it goes by."""
    return N.drop_duplicate_versions(monthly_versions(spark, sf_dir))[1].select("addr", "pos", "rule")


@query("SELECT l_partkey AS statute, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS acts FROM lineitem GROUP BY 1")
def amending_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acts that amend each statute."""
    return N.affecting_acts(t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("amended"), F.col("l_suppkey").alias("amender")))


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber FROM lineitem WHERE l_orderkey = 7 OR l_partkey = 7")
def branch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a statute at either end."""
    edges = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return N.touching(edges, "7", ["src", "l_linenumber", "dst"])


def graph_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o, line, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "customer")
    return {
        "placed": o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("o"), F.col("o_orderkey"))).alias("dst")),
        "contains": line.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")),
        "lives": c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.when(F.col("c_nationkey") != 3, F.concat(F.lit("n"), F.col("c_nationkey"))).alias("dst")),
    }


@query("""
SELECT DISTINCT 'placed' AS kind, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_orderkey % 10 <> 0 UNION SELECT 'contains', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'lives', 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_nationkey <> 3""")
def corpus_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus graph out of the graphs of its parts."""
    return N.corpus_graph(graph_parts(spark, sf_dir))[0]


@query("SELECT 'placed' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'lives', count(*) FROM customer WHERE c_nationkey = 3")
def corpus_graph_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be built, by kind."""
    return N.corpus_graph(graph_parts(spark, sf_dir))[1]


@query("""
WITH s AS (SELECT l_suppkey, CASE WHEN l_quantity > 45 THEN 'oversize' WHEN l_discount > 0.09 THEN 'discounted' ELSE 'ok' END AS status FROM lineitem)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS n_ok, round(avg((status = 'ok')::INT::DOUBLE), 6) AS share, coalesce(array_to_string(list_sort(list(DISTINCT status) FILTER (WHERE status <> 'ok')), ','), '') AS missing FROM s GROUP BY 1""")
def coverage_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each unit is covered, and what is missing."""
    status = F.when(F.col("l_quantity") > 45, "oversize").when(F.col("l_discount") > 0.09, "discounted").otherwise("ok")
    return N.coverage_report(t(spark, sf_dir, "lineitem").withColumn("status", status), "l_suppkey", "status")


@query("""
WITH o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 20), d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 15)
SELECT l_partkey, l_suppkey, CASE WHEN o.k IS NULL THEN 'unobserved' WHEN d.k IS NULL THEN 'undeclared' ELSE 'as_declared' END AS status FROM (SELECT *, 1 AS k FROM o) o FULL JOIN (SELECT *, 1 AS k FROM d) d USING (l_partkey, l_suppkey)""")
def observed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed writes against declared ones."""
    line = t(spark, sf_dir, "lineitem")
    return N.observed_against_declared(line.filter("l_quantity < 20"), line.filter("l_quantity > 15"), ["l_partkey", "l_suppkey"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def audit_provenance_totality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without a source."""
    return N.without_source(t(spark, sf_dir, "documents").select("doc_id").distinct(), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)")
def audit_materialisation_totality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that no replayed state holds."""
    held = t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return N.without_source(t(spark, sf_dir, "part").select("p_partkey").distinct(), held, "p_partkey")


@query("""
WITH a AS (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT id, CASE WHEN b.v IS NULL THEN 'candidate_only' WHEN a.v IS NULL THEN 'oracle_only' WHEN a.v = b.v THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b USING (id)""")
def oracle_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed units against the oracle's."""
    p = t(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    changed = F.when(F.col("id") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return N.align(p.filter("id % 5 <> 0").select("id", F.col("p_size").alias("v")), p.filter("id % 7 <> 0").select("id", changed.alias("v")), "id", "v")


@query("""
WITH g AS (SELECT o_custkey, min((strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)) AS a, max((strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, a[2] AS base, b[2] AS oracle, CASE WHEN a[2] = b[2] THEN 'single' WHEN a[1] = b[1] THEN 'same_day' ELSE 'planned' END AS status FROM g""")
def pair_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and oracle snapshots of each unit."""
    return N.oracle_pairs(t(spark, sf_dir, "orders").withColumn("day", iso("o_orderdate")), "o_custkey", "day", "o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1996-01-01' END AS pit, CASE WHEN o_orderkey % 3 <> 0 AND strftime(o_orderdate::DATE + 90, '%Y-%m-%d') <= '1996-01-01' THEN strftime(o_orderdate::DATE + 90, '%Y-%m-%d') END AS expired_on FROM orders""")
def replay_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a document is replayed, and whether it has expired by then."""
    asked = F.when(F.col("o_orderkey") % 3 != 0, "1996-01-01")
    ends = F.date_format(F.date_add(F.to_date("o_orderdate"), 90), "yyyy-MM-dd")
    return t(spark, sf_dir, "orders").select("o_orderkey", N.horizons(iso("o_orderdate"), ends, asked).alias("h")).select("o_orderkey", "h.*")


@query("""
WITH p AS (SELECT DISTINCT 'o' || l_orderkey || '/l' || l_linenumber AS id FROM lineitem), x AS (SELECT 'o' || o_orderkey AS prefix FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'o' || l_orderkey || '/l' || l_linenumber FROM lineitem WHERE l_quantity > 40)
SELECT id FROM p WHERE id IN (SELECT prefix FROM x) OR split_part(id, '/', 1) IN (SELECT prefix FROM x)""")
def commenced_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions that are brought into force, themselves or from above."""
    line = t(spark, sf_dir, "lineitem")
    own = F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("/l"), F.col("l_linenumber"))
    orders = t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("prefix")).unionByName(line.filter("l_quantity > 40").select(own.alias("prefix")))
    return N.commenced(line.select(own.alias("id")), orders)


@query("SELECT event_id AS seq, 'u' || user_id AS from_addr, 'u' || (user_id + event_id % 3) AS to_addr, lower(CASE event_type WHEN 'click' THEN 'RENUMBER' WHEN 'view' THEN 'MOVE' ELSE 'SPLIT' END) AS kind FROM events WHERE event_type IN ('click', 'view', 'error') AND event_id % 3 <> 0")
def migration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of addresses out of a stream of mutations."""
    kind = F.col("event_type")
    action = F.when(kind == "click", "RENUMBER").when(kind == "view", "MOVE").when(kind == "error", "SPLIT").otherwise("REPLACE")
    return N.address_moves(t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("u"), F.col("user_id")).alias("target"), F.concat(F.lit("u"), F.col("user_id") + F.col("event_id") % 3).alias("destination")))


@query("""
WITH e AS (SELECT *, CASE WHEN event_type IN ('click', 'error') THEN 0 WHEN event_type = 'view' THEN 1 ELSE 2 END AS r FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY r, event_id) - 1 AS position FROM e""")
def apply_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops of a group with insertions after replacements and repeals."""
    kind = F.col("event_type")
    ops = t(spark, sf_dir, "events").withColumn("action", F.when(kind == "click", "REPLACE").when(kind == "error", "REPEAL").when(kind == "view", "INSERT").otherwise("META"))
    return N.apply_order(ops, "user_id", "action", "event_id").select("event_id", F.col("position").cast("long").alias("position"))


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey::VARCHAR ELSE strftime(o_orderdate, '%Y-%m-%d') END, o_orderkey::VARCHAR, o_orderkey) AS position FROM orders""")
def enactment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts by day of enactment, or by id where that is not known."""
    act = F.col("o_orderkey").cast("string")
    key = N.enactment_key(F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(iso("o_orderdate")), act, F.col("o_orderkey"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(key)).cast("long").alias("position"))


@query("""
WITH r AS (SELECT lower(trim(regexp_replace(p_brand || ' ' || p_type, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS f, count(DISTINCT p_size % 2) AS n, min(p_size % 2) AS act FROM part WHERE p_size > 10 GROUP BY 1),
m AS (SELECT p_partkey, lower(trim(regexp_replace(upper(p_brand) || '  ' || p_type || '!', '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS f FROM part)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN act END AS act_id FROM m LEFT JOIN r USING (f)""")
def act_name_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of acts by their popular names."""
    p = t(spark, sf_dir, "part")
    mentions = p.select("p_partkey", F.concat(F.upper("p_brand"), F.lit("  "), F.col("p_type"), F.lit("!")).alias("mention"))
    registry = p.filter("p_size > 10").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"), (F.col("p_size") % 2).alias("act"))
    return N.by_popular_name(mentions, registry, "mention", "name", "act").select("p_partkey", "status", "act_id")


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY turn, sha256(coalesce(text, '')))) AS root FROM conversations GROUP BY 1")
def overwrite_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content root for the overwrites of each unit."""
    return N.overwrite_roots(t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""
WITH w AS (SELECT o_orderkey, o_orderpriority AS now, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders)
SELECT o_orderkey, CASE WHEN after IS NULL THEN 'lapsed' WHEN prior = after THEN 'reverted' WHEN now = after THEN 'made_permanent' ELSE 'ambiguous' END AS class FROM w""")
def sunset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a temporary text: its predecessor, itself, nothing, or something else."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_orderpriority")
    rows = t(spark, sf_dir, "orders").select("o_orderkey", p.alias("now"), F.lag(p).over(w).alias("prior"), F.lead(p).over(w).alias("after"))
    return rows.select("o_orderkey", N.sunset_class(F.col("prior"), F.col("now"), F.col("after")).alias("class"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'base_source_unavailable' WHEN o_orderkey % 13 = 1 THEN 'base_source_parse_error' WHEN o_orderkey % 13 = 2 THEN 'replay_error_other' WHEN o_orderkey % 5 = 0 THEN 'amendment_source_unavailable' WHEN o_orderpriority = '1-URGENT' THEN 'oracle_source_unavailable'
  WHEN o_orderkey % 17 = 0 THEN 'unclassified' WHEN o_orderstatus = 'O' THEN 'no_amendments_in_window' ELSE 'replayable' END AS state FROM orders""")
def replayability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pair can be replayed, or the one reason why not."""
    k = F.col("o_orderkey")
    error = F.when(k % 13 == 0, "Failed to load base: gone").when(k % 13 == 1, "Failed to parse base: not XML").when(k % 13 == 2, "Failed to apply ops: none")
    state = N.replayability(error, F.when(k % 5 == 0, 2).otherwise(0), F.col("o_orderpriority") != "1-URGENT", k % 17 != 0, F.when(F.col("o_orderstatus") == "O", 0).otherwise(1))
    return t(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS x FROM lineitem WHERE l_linenumber <> 2), o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'R' ELSE l_returnflag END AS x FROM lineitem WHERE l_linenumber <> 3)
SELECT coalesce(r.l_orderkey, o.l_orderkey) AS l_orderkey, coalesce(r.l_linenumber, o.l_linenumber) AS l_linenumber,
  CASE WHEN o.l_orderkey IS NULL THEN 'present_in_replay_absent_in_oracle' WHEN r.l_orderkey IS NULL THEN 'present_in_oracle_absent_in_replay' WHEN r.x = o.x THEN 'agreement' ELSE 'text_divergence' END AS kind, r.x AS replay_text, o.x AS oracle_text
FROM r FULL JOIN o ON r.l_orderkey = o.l_orderkey AND r.l_linenumber = o.l_linenumber""")
def article_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replayed body against a consolidation, article by article."""
    lines = t(spark, sf_dir, "lineitem")
    replayed = lines.filter("l_linenumber <> 2").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("x"))
    consolidated = lines.filter("l_linenumber <> 3").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 40, "R").otherwise(F.col("l_returnflag")).alias("x"))
    return N.article_divergence(replayed, consolidated, ["l_orderkey", "l_linenumber"], "x")


@query("""
SELECT e.event_id AS link, p.event_id AS built_on FROM events e JOIN events p ON e.event_id = p.event_id + 1
WHERE p.event_type = 'error' AND e.value <= 20""")
def audit_retraction_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still stands on a retracted link."""
    e = t(spark, sf_dir, "events")
    links = e.select(F.col("event_id").alias("link"), (F.col("event_id") - 1).alias("built_on"))
    return N.stale_downstream(links, e.filter("event_type = 'error'").select(F.col("event_id").alias("link")), e.filter("value > 20").select(F.col("event_id").alias("link")))


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END, l_suppkey::VARCHAR, l_linenumber) - 1 AS position FROM lineitem""")
def application_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops in order of the day that they apply from; those without a day come first."""
    key = N.application_key(F.when(F.col("l_returnflag") != "N", iso("l_shipdate")), F.col("l_suppkey").cast("string"), F.col("l_linenumber"))
    w = Window.partitionBy("l_orderkey").orderBy(key)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("position"))

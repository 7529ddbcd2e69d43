"""Text, graph, comparison, evidence, audit, replay and extraction queries on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import extraction as X
from palimpsest.functions import text as S
from palimpsest.operators import audits as U
from palimpsest.operators import comparison as C
from palimpsest.operators import evidence as E
from palimpsest.operators import graph as G
from palimpsest.operators import replay as R
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t
from palimpsest.streaming import streams

# ---------------------------------------------------------------- text


@query("""
WITH a AS (SELECT doc_id, text, translate(text, '‐‑‒–—―−', '———————') AS d FROM documents),
b AS (SELECT *, regexp_replace(d, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS s FROM a), c AS (SELECT *, regexp_replace(s, ' +([,.;:])', '\\1', 'g') AS m FROM b)
SELECT doc_id, md5(trim(m, ' ')) AS digest, concat_ws(',', CASE WHEN d <> text THEN 'dashes' END, CASE WHEN s <> d THEN 'space' END, CASE WHEN m <> s THEN 'marks' END, CASE WHEN trim(m, ' ') <> m THEN 'trim' END) AS fired FROM c""")
def normalise_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts with the names of the rules that fired."""
    rules = (S.Rule("dashes", "translate", S.DASHES, "—" * len(S.DASHES)), S.Rule("space", "regex", r"[ \t\n\x0B\f\r]+", " "), S.Rule("marks", "regex", r" +([,.;:])", "$1"), S.Rule("trim", "regex", r"^ +| +$"))
    out = S.normalise(t(spark, sf_dir, "documents"), "text", rules)
    return out.select("doc_id", F.md5("normal").alias("digest"), F.array_join("fired", ",").alias("fired"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents), l AS (SELECT d.doc_id, count(w.doc_id) AS dl FROM documents d LEFT JOIN w USING (doc_id) GROUP BY 1),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('license', 'password', 'token') GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN f USING (term) JOIN l USING (doc_id), n GROUP BY 1""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 scores over an inverted index."""
    return S.bm25(t(spark, sf_dir, "documents"), "doc_id", "text", ["license", "password", "token"]).select("doc_id", F.round("score", 6).alias("score"))


#: The longest common subsequence by dynamic programming: a step of the recursion is a row of the table, of all pairs at once.
RATIO_SQL = """
p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
r AS (SELECT item_id, 0 AS i, u.j, 0 AS v, substr(y, u.j::INT, 1) AS ch, x FROM p, unnest(range(1, length(y) + 1)) AS u(j)
  UNION ALL SELECT item_id, i + 1, j, greatest(v, coalesce(max(CASE WHEN ch = substr(x, i + 1, 1) THEN before + 1 END) OVER (PARTITION BY item_id ORDER BY j), 0)), ch, x FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY item_id ORDER BY j), 0) AS before FROM r WHERE i < length(x))),
l AS (SELECT item_id, max(v) AS lcs FROM r GROUP BY 1),
s AS (SELECT item_id, (2.0 * coalesce(lcs, 0) / (length(x) + length(y)))::DOUBLE AS ratio FROM p LEFT JOIN l USING (item_id))"""


@query(f"WITH RECURSIVE {RATIO_SQL} SELECT item_id, round(ratio, 6) AS ratio FROM s")
def edit_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indel ratios of neighbouring benchmark texts."""
    b = t(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", F.round(S.edit_ratio("text", "other"), 6).alias("ratio"))


@query("""
SELECT item_id, length(p) AS prefix FROM (SELECT a.item_id, a.text AS x, b.text AS y, (SELECT max(left(a.text, i::INT)) FROM range(0, least(length(a.text), length(b.text)) + 1) r(i) WHERE left(a.text, i::INT) = left(b.text, i::INT)) AS p FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)""")
def minimal_changed_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where neighbouring benchmark texts begin to differ."""
    b = t(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", S.changed_span(F.col("text"), F.col("other"))["start"].cast("long").alias("prefix"))


@query("SELECT o_custkey, sha256('orders:list' || chr(0) || '[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']') AS root FROM orders GROUP BY 1")
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root hash per customer over sorted keys."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k")).select("o_custkey", S.root_hash("orders", "list", F.col("k")).alias("root"))


@query("SELECT doc_id, regexp_matches(text, '\\x{FFFD}') OR regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') OR regexp_matches(text, '(?i)[bcdfghjklmnpqrstvwxz]{8,}') AS garbled FROM documents")
def garble_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look misread."""
    return t(spark, sf_dir, "documents").select("doc_id", S.garbled(F.col("text")).alias("garbled"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of a JSON column."""
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---------------------------------------------------------------- graph


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
r AS (SELECT 's1' AS node, 0 AS hops UNION SELECT b.dst, hops + 1 FROM r JOIN b ON r.node = b.src WHERE hops < 2)
SELECT node, min(hops) AS hops FROM r GROUP BY 1""")
def follow_refs_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of a supplier in the graph of suppliers and parts."""
    line = t(spark, sf_dir, "lineitem")
    edges = line.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return G.breadth_first(edges, spark.createDataFrame([("s1",)], "node string"), 2, "both")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * 7) // 3 AS dst FROM part), r AS (SELECT 5::BIGINT AS node UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r""")
def provenance_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes reachable from one; the start counts."""
    edges = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") * 7 / 3).cast("long").alias("dst"))
    return G.reachable(edges, spark.createDataFrame([(5,)], "node long"))


@query("""
WITH RECURSIVE m AS (SELECT p_partkey AS f, p_partkey + 3 AS d FROM part WHERE p_partkey % 4 <> 0), r AS (SELECT f AS addr, d AS cur FROM m UNION ALL SELECT addr, m.d FROM r JOIN m ON r.cur = m.f)
SELECT p_partkey AS addr, coalesce((SELECT max(cur) FROM r WHERE addr = p_partkey), p_partkey) AS final FROM part""")
def lineage_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses after all their renames."""
    p = t(spark, sf_dir, "part")
    moves = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("from_addr"), (F.col("p_partkey") + 3).alias("to_addr"))
    return G.follow_renames(p.select(F.col("p_partkey").alias("addr")), moves)


@query("""
WITH c AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem), v AS (SELECT l_orderkey AS src, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') <= '1996-01-01' GROUP BY 1)
SELECT src, dst, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'active' END AS state FROM c JOIN v USING (src) WHERE dst IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def silent_breakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active citations of changed targets, and those where the citing versions disagree."""
    line = t(spark, sf_dir, "lineitem")
    versions = line.select(F.col("l_orderkey").alias("addr"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("effective"), F.lit(None).cast("string").alias("expires"), F.col("l_returnflag").alias("content"))
    changed = t(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("dst"))
    out = G.silent_breakage(line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), versions, changed, "1996-01-01")
    return out.select("src", "dst", "state")


BUILD_SQL = """
b AS (SELECT o_orderkey AS build, o_orderkey % 11 <> 0 AS known, o_orderkey % 7 <> 0 AS instrumented, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 4 END AS declared FROM orders),
e AS (SELECT l_orderkey AS build, l_partkey AS subject FROM lineitem), n AS (SELECT build, count(*) AS n FROM e GROUP BY 1), x AS (SELECT build, min(p_name) AS r FROM e JOIN part ON subject = p_partkey WHERE p_size = 1 GROUP BY 1)"""


@query(f"""WITH {BUILD_SQL} SELECT build, CASE WHEN NOT known THEN 'BUILD_UNKNOWN' WHEN NOT instrumented THEN 'BUILD_CONSUMPTION_UNINSTRUMENTED' WHEN coalesce(n, 0) <> declared THEN 'INVALID_CONSUMPTION' WHEN declared = 0 THEN 'CLEAN' WHEN r IS NOT NULL THEN 'TAINTED' ELSE 'CLEAN' END AS status
FROM b LEFT JOIN n USING (build) LEFT JOIN x USING (build)""")
def retraction_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of builds by what they consumed and what was retracted."""
    k = F.col("o_orderkey")
    builds = t(spark, sf_dir, "orders").select(k.alias("build"), (k % 11 != 0).alias("known"), (k % 7 != 0).alias("instrumented"), F.when(k % 5 == 0, 2).otherwise(4).alias("declared"))
    edges = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("subject"))
    gone = t(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("subject"), F.col("p_name").alias("retraction"))
    return G.build_status(builds, edges, G.retraction_taint(edges, gone)).select("build", "status")


@query("""
WITH c AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS cited FROM pages), k AS (SELECT DISTINCT lang AS cited FROM documents UNION SELECT 'the')
SELECT page_id, cited, cited IN (SELECT cited FROM k) AS resolved FROM c""")
def work_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved against known addresses."""
    leaves = t(spark, sf_dir, "documents").select(F.col("lang").alias("leaf")).union(spark.createDataFrame([("the",)], "leaf string"))
    return G.work_citations(t(spark, sf_dir, "pages"), "page_id", "html", 'href="/([^"]+)"', leaves, "leaf")


# ---------------------------------------------------------------- comparison


def order_tree(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Orders and their lines as a tree; the sides differ by a rule on the keys."""
    o = t(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 13 != side)
    line = t(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 13 != side).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    top = o.select(F.col("o_orderkey").cast("string").alias("addr"), F.col("o_orderstatus").alias("label"), F.lit("").alias("text"), (F.col("o_orderkey") % 17 == 0).alias("editorial"))
    low = line.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("addr"), F.col("l_linenumber").cast("string").alias("label"), (F.col("q") + F.when((F.lit(side) == 1) & (F.col("l_orderkey") % 5 == 0), 1).otherwise(0)).cast("string").alias("text"), F.lit(False).alias("editorial"))
    return top.unionByName(low)


@query("""
WITH o AS (SELECT o_orderkey AS k FROM orders), l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
e AS (SELECT CASE WHEN k % 13 = 0 THEN 'missing_left' WHEN k % 13 = 1 THEN 'missing_right' WHEN k % 17 = 0 THEN 'editorial' ELSE 'same' END AS event FROM o
  UNION ALL SELECT CASE WHEN k % 5 = 0 THEN 'text' ELSE 'same' END FROM l WHERE k % 13 > 1 AND k % 17 <> 0)
SELECT event, count(*) AS n FROM e GROUP BY 1""")
def tree_diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two trees; nothing is reported below a missing or editorial node."""
    return C.tree_events(order_tree(spark, sf_dir, 0), order_tree(spark, sf_dir, 1)).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, CASE WHEN s = 0 AND l = 0 AND x = 0 AND e = 0 THEN 'identical' WHEN s = 0 AND l = 0 AND x = 0 THEN 'editorial_only' WHEN s > 0 AND x > 0 THEN 'structural_and_text' WHEN s > 0 THEN 'structural' WHEN l > 0 AND x > 0 THEN 'label_and_text' WHEN l > 0 THEN 'label' ELSE 'text' END AS kind
FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 30) AS s, count(*) FILTER (WHERE l_discount > 0.09) AS l, count(*) FILTER (WHERE l_tax > 0.07) AS x, count(*) FILTER (WHERE l_linestatus = 'O') AS e FROM lineitem GROUP BY 1)""")
def diff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each difference by its counters."""
    n = lambda c: F.count(F.when(c, 1))
    per = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 30)).alias("s"), n(F.col("l_discount") > 0.09).alias("l"), n(F.col("l_tax") > 0.07).alias("x"), n(F.col("l_linestatus") == "O").alias("e"))
    return per.select("l_orderkey", C.difference_kind(F.col("s"), F.col("l"), F.col("x"), F.col("e")).alias("kind"))


@query("""
WITH a AS (SELECT p_partkey AS id, p_size % 3 AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS id, p_size % 4 AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN CASE WHEN a.id % 2 = 0 AND a.id % 3 <> 0 THEN 'manual_frontier' ELSE 'deterministic_gap' END WHEN a.id IS NULL THEN 'oracle_suspect' ELSE 'text_diff' END AS kind
FROM a FULL JOIN b ON a.id = b.id WHERE a.v IS DISTINCT FROM b.v""")
def divergence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind for each id on which two sides diverge."""
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    a, b = p.filter("id % 5 <> 0").select("id", (F.col("p_size") % 3).alias("a")), p.filter("id % 7 <> 0").select("id", (F.col("p_size") % 4).alias("b"))
    return C.divergence_kinds(a.join(b, "id", "left_anti"), b.join(a, "id", "left_anti"), a.join(b, "id"), p.filter("id % 2 = 0"), p.filter("id % 3 = 0"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN d < '1996-01-01' THEN CASE WHEN d2 < '1996-01-01' THEN 'FUTURE_EFFECTIVE_EMBEDDED' ELSE 'ORACLE_NEWER_UNIT' END END, CASE WHEN o_orderstatus = 'F' AND d > d2 THEN 'EXPIRY_CUTOFF_MISMATCH' END, CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderkey % 2 = 0 THEN 'EXTENT_BRANCH_MISMATCH' END, CASE WHEN o_totalprice > 300000 THEN 'UNIT_VERSION_AMBIGUOUS' END) AS reasons
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate::DATE + (o_orderkey % 100)::INT - 50, '%Y-%m-%d') AS d2 FROM orders)""")
def commensurability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why two units cannot be compared, tested before their texts."""
    o = t(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("d2", F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 100 - 50).cast("int")), "yyyy-MM-dd"))
    why = C.commensurability(F.col("d"), F.col("d2"), F.lit("1996-01-01"), F.when((F.col("o_orderstatus") == "F") & (F.col("d") > F.col("d2")), "0000"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.lit("1-URGENT"), F.when(F.col("o_totalprice") > 300000, "x"))
    return o.select("o_orderkey", F.array_join(why, ",").alias("reasons"))


@query("""
WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 6 <> 0), b AS (SELECT p_partkey AS k, p_size + (p_partkey % 4 = 0)::INT AS v FROM part WHERE p_partkey % 9 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes added, removed or changed between versions."""
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return C.version_diff(p.filter("k % 6 <> 0").select("k", F.col("p_size").alias("v")), p.filter("k % 9 <> 0").select("k", (F.col("p_size") + (F.col("k") % 4 == 0).cast("int")).alias("v")), "k", "v")


# ---------------------------------------------------------------- evidence and audits


@query("""
SELECT user_id AS subject, bool_or(event_type = 'signup') AS joined, NOT bool_or(event_type = 'error') AS clean, count(DISTINCT event_type) >= 4 AS varied, min(strftime(ts, '%Y-%m-%d')) >= '2024-01-01' AND max(strftime(ts, '%Y-%m-%d')) <= '2024-01-30' AS timely,
  bool_or(event_type = 'signup') AND NOT bool_or(event_type = 'error') AND count(DISTINCT event_type) >= 4 AND min(strftime(ts, '%Y-%m-%d')) >= '2024-01-01' AND max(strftime(ts, '%Y-%m-%d')) <= '2024-01-30' AS authorized FROM events GROUP BY 1""")
def evidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy of four clauses as one aggregation by subject."""
    att = t(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("ts"))
    return E.authorize(att, {"joined": {"op": "exists", "where": {"kind": "signup"}}, "clean": {"op": "none", "where": {"kind": "error"}}, "varied": {"op": "count_distinct_at_least", "path": "kind", "n": 4}, "timely": {"op": "within_time", "start": "2024-01-01", "end": "2024-01-30"}})


@query("SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def audit_source_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators with more than one digest."""
    return U.source_conflicts(t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("digest")), "k", "digest")[0]


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def audit_commencement_totality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops that neither table accounts for."""
    line = t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return U.in_no_table(t(spark, sf_dir, "orders"), "o_orderkey", line.filter("l_returnflag = 'R'"), line.filter("l_quantity > 45"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def audit_duplicate_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that share parent and label."""
    return U.duplicates(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT upper(trim(event_type)) AS normal, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def audit_label_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings whose labels are equal after normalising."""
    return U.duplicates(t(spark, sf_dir, "events"), ["user_id"], F.upper(F.trim("event_type")))


@query("""
SELECT user_id, step, problem FROM (SELECT user_id, event_id AS step, CASE WHEN lag(event_id) OVER w IS NOT NULL AND event_id <> lag(event_id) OVER w + 1 THEN 'missing_link' WHEN value < lag(value) OVER w THEN 'non_monotone' END AS problem FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE problem IS NOT NULL""")
def audit_promotion_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and falling links of chains."""
    return U.promotion_breaks(t(spark, sf_dir, "events").withColumnRenamed("event_id", "step"), "user_id", "step", "value")


@query("""
WITH g AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40), f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_extendedprice > 50000)
SELECT count(g.k) AS gold, count(*) FILTER (WHERE g.k IS NOT NULL AND f.k IS NOT NULL) AS hits, count(*) FILTER (WHERE g.k IS NULL) AS extra, round(count(*) FILTER (WHERE g.k IS NOT NULL AND f.k IS NOT NULL) / count(g.k), 6) AS recall FROM g FULL JOIN f ON g.k = f.k""")
def audit_detection_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a detector against gold keys."""
    line = t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    return U.detection_recall(line.filter("l_quantity > 40"), line.filter("l_extendedprice > 50000"), "k")


@query("SELECT p_partkey AS k, p_type AS v FROM part WHERE p_type NOT IN ('STANDARD', 'SMALL') OR p_type IS NULL")
def audit_closed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label is outside a closed vocabulary."""
    return U.unclassified(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v")), "k", "v", ["STANDARD", "SMALL"])


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS stage FROM lineitem)
SELECT k, stage FROM s WHERE stage = 'A' AND k NOT IN (SELECT k FROM s WHERE stage = 'N') UNION ALL SELECT k, stage FROM s WHERE stage = 'N' AND k NOT IN (SELECT k FROM s WHERE stage = 'R')""")
def audit_residual_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals that a later stage lost."""
    return U.lost_between(t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("stage")).distinct(), "k", "stage", ["A", "N", "R"])


# ---------------------------------------------------------------- replay and extraction


def conversation_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as trees, with three edits on each turn, each of which depends on those before: replace and patch;
    patch, repeal and insert anew; repeal twice and replace in vain; patch all, renumber, patch at the new place."""
    c = t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), "turn").agg(F.min("text").alias("text"))
    addr = F.concat(F.lit("turn:"), F.col("turn").cast("string"))
    moved = F.concat(F.lit("moved:"), F.col("turn").cast("string"))
    nodes = c.select("doc_id", addr.alias("addr"), F.col("turn").cast("double").alias("ord"), F.lit("turn").alias("kind"), "text", F.lit("live").alias("status"))
    null = F.lit(None).cast("string")

    def op(action: str, target: Column = addr, payload: str | None = None, find: str | None = None, occurrence: int = 0, destination: Column = null) -> Column:
        return F.struct(F.lit(action).alias("action"), target.alias("target"), F.lit(payload).cast("string").alias("payload"), F.lit(find).cast("string").alias("find"), F.lit(occurrence).cast("long").alias("occurrence"), destination.alias("destination"))

    kinds = (
        [op("REPLACE", payload="draft one"), op("TEXT_PATCH", payload="two", find="one"), op("TEXT_PATCH", payload="three", find="one")],
        [op("TEXT_PATCH", payload="3", find="e"), op("REPEAL"), op("INSERT", payload="fresh")],
        [op("REPEAL"), op("REPEAL"), op("REPLACE", payload="too late")],
        [op("TEXT_PATCH", payload="A", find="a", occurrence=-1), op("RENUMBER", destination=moved), op("TEXT_PATCH", moved, "aa", "A")],
    )
    four = F.col("turn") % 4
    chosen = F.when(four == 0, F.array(*kinds[0])).when(four == 1, F.array(*kinds[1])).when(four == 2, F.array(*kinds[2])).otherwise(F.array(*kinds[3]))
    each = c.select("doc_id", "turn", F.posexplode(chosen).alias("j", "o"))
    # the rows are dealt out of order on purpose: sequence alone decides
    ops = each.select("doc_id", (F.col("turn") * 10 + F.col("j")).cast("long").alias("seq"), "o.*", null.alias("anchor"), null.alias("group_id"))
    return nodes, ops


EDITED_SQL = """
c AS (SELECT conv_id AS doc_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2),
e AS (SELECT *, replace(text, 'a', 'A') AS cap, contains(coalesce(text, ''), 'a') AS has_a, contains(coalesce(text, ''), 'e') AS has_e FROM c)"""


@query(f"""
WITH {EDITED_SQL}
SELECT doc_id, CASE turn % 4 WHEN 3 THEN 'moved:' ELSE 'turn:' END || turn AS addr,
  CASE turn % 4 WHEN 0 THEN 'draft two' WHEN 1 THEN 'fresh' WHEN 2 THEN NULL ELSE CASE WHEN contains(cap, 'A') THEN left(cap, strpos(cap, 'A')::INT - 1) || 'aa' || substr(cap, strpos(cap, 'A')::INT + 1) ELSE cap END END AS text,
  CASE turn % 4 WHEN 2 THEN 'tombstone' ELSE 'live' END AS status FROM e""")
def replay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after their ordered edits."""
    return R.replay(*conversation_edits(spark, sf_dir))[0].select("doc_id", "addr", "text", "status")


@query(f"""
WITH {EDITED_SQL}
SELECT doc_id, turn * 10 + j AS seq, CASE turn % 4 WHEN 0 THEN CASE j WHEN 2 THEN 'text_not_found' ELSE 'applied' END WHEN 1 THEN CASE WHEN j = 0 AND NOT has_e THEN 'text_not_found' ELSE 'applied' END
  WHEN 2 THEN CASE j WHEN 2 THEN 'target_missing' ELSE 'applied' END ELSE CASE WHEN j = 0 AND NOT has_a THEN 'text_not_found' WHEN j = 2 AND NOT contains(coalesce(cap, ''), 'A') THEN 'text_not_found' ELSE 'applied' END END AS outcome FROM e, unnest([0, 1, 2]) AS u(j)""")
def replay_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt for each edit."""
    return R.replay(*conversation_edits(spark, sf_dir))[1].select("doc_id", "seq", "outcome")


@query("""
WITH c AS (SELECT DISTINCT conv_id AS doc_id, turn FROM conversations)
SELECT doc_id, CASE WHEN turn % 4 = 3 AND turn % 2 = 1 AND k = 1 THEN 'moved:' ELSE 'turn:' END || turn AS addr FROM c, unnest([0, 1]) AS u(k) WHERE turn >= 4 AND (k = 0 OR turn % 4 = 3)""")
def replay_mutation_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that edits changed outside the declared places (the first four turns)."""
    nodes, ops = conversation_edits(spark, sf_dir)
    after = R.replay(nodes, ops)[0]
    declared = ops.filter("seq < 40").select("doc_id", F.explode(F.array("target", "destination")).alias("prefix")).filter("prefix is not null")
    return R.mutation_boundary(nodes, after, declared)


def dated_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as documents of one node; each line item writes its order key on its shipping day."""
    line = t(spark, sf_dir, "lineitem")
    nodes = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.lit("s:1").alias("addr"), F.lit(1.0).alias("ord"), F.lit("s").alias("kind"), F.lit("").alias("text"), F.lit("live").alias("status"))
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    null = F.lit(None).cast("string")
    ops = line.select(F.col("l_partkey").cast("long").alias("doc_id"), seq.alias("seq"), F.lit("REPLACE").alias("action"), F.lit("s:1").alias("target"), seq.cast("string").alias("payload"), null.alias("find"), F.lit(0).cast("long").alias("occurrence"), null.alias("destination"), null.alias("anchor"), null.alias("group_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("effective"))
    return nodes, ops


@query("""
WITH w AS (SELECT l_partkey, arg_max(l_orderkey * 10 + l_linenumber, strftime(l_shipdate, '%Y-%m-%d') || lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 20, '0')) AS last FROM lineitem WHERE l_shipdate <= DATE '1996-06-30' GROUP BY 1)
SELECT p_partkey::BIGINT AS doc_id, coalesce(last::VARCHAR, '') AS text FROM part LEFT JOIN w ON l_partkey = p_partkey""")
def replay_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as of a day: the latest writer by day, then by sequence, of those effective by then."""
    return R.replay(*dated_edits(spark, sf_dir), as_of="1996-06-30")[0].select("doc_id", "text")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), event_type, event_id) - 1 AS position FROM events""")
def op_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops of a user in the order in which they apply: day, act, sequence."""
    ops = t(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return R.order_positions(ops, "user_id", "day", "event_id", "event_type").select("user_id", "event_id", F.col("position").cast("long").alias("position"))


@query("""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1)) AS raw, 'date' AS kind FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(licensed under the [a-z]+ license)', 1)), 'license' FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63})+)', 1)), 'address' FROM documents)
SELECT kind, count(*) AS n, count(DISTINCT raw) AS n_distinct FROM r WHERE kind <> 'date' OR regexp_matches(raw, '^\\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])$') GROUP BY 1""")
def mention_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed mentions out of prose, by kind."""
    chosen = tuple(p for p in X.PRODUCERS if p.kind in ("date", "license", "address"))
    return X.mentions(t(spark, sf_dir, "documents"), "doc_id", "text", chosen)[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw").alias("n_distinct"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM w WHERE term IN ('license', 'apache', 'password') GROUP BY 1, 2""")
def term_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of terms, by a join on words."""
    return X.term_uses(t(spark, sf_dir, "documents"), "doc_id", "text", spark.createDataFrame([("License",), ("Apache",), ("password",)], "term string"))


# ---------------------------------------------------------------- windows over events (beyond parity)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per day and type; the same code runs on streams."""
    return streams.windowed_counts(t(spark, sf_dir, "events"), "ts", ["event_type"], "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps under six hours."""
    return streams.session_counts(t(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

"""Projection, lineage, scoring and label queries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import labels as B
from palimpsest.functions import text as S
from palimpsest.operators import lineage as N
from palimpsest.operators import projections as P
from palimpsest.operators import scoring as C
from palimpsest.plans.analysis_queries import RATIO_SQL
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey::VARCHAR || '/' || l_linenumber LIKE '12%' AND upper(l_returnflag) = 'R' AND regexp_full_match('S' || l_suppkey, 'S1[0-9]*') AND strftime(l_shipdate, '%Y-%m-%d') <= '1998-01-01'""")
def mention_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by provision prefix, an equality in either case, a role pattern and a date."""
    line = t(spark, sf_dir, "lineitem")
    rows = line.select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("source_statute_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("source_provision_ref_str"), "l_returnflag", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("actor"), F.lit(None).cast("string").alias("shown"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("valid_at_start"), F.lit(None).cast("string").alias("valid_at_end"))
    return P.query_mentions(rows, provision="12", equal_ci={"l_returnflag": "r"}, role=("S1[0-9]*", ("actor", "shown")), as_of="1998-01-01").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE (o_orderpriority ILIKE '%urg%') AND year(o_orderdate) BETWEEN 1995 AND 1996 AND o_orderstatus = 'O' ORDER BY year(o_orderdate) DESC, o_orderkey DESC LIMIT 25")
def proposals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest proposals by ministry, years and state (a top-k report)."""
    o = t(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("ministry_canonical_id"), F.lit(None).cast("string").alias("ministry_show_as"), F.year("o_orderdate").alias("he_year"), F.col("o_orderkey").alias("he_number"), F.col("o_orderstatus").alias("finlex_state"))
    return P.query_proposals(rows, "URG", "1995:1996", "O", 25).select("o_orderkey")


@query("SELECT doc_id, left(text, 300) AS excerpt FROM documents WHERE lang = 'de'")
def purpose_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged sections with the beginning of their text."""
    return P.purpose_sections(t(spark, sf_dir, "documents").withColumn("is_purpose_section", F.col("lang") == "de")).select("doc_id", "excerpt")


@query("""
WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'E' || o_orderkey END AS e, CASE WHEN o_orderkey % 3 = 0 THEN 'F' || o_orderkey END AS f FROM orders)
SELECT id, e AS row FROM r WHERE e IS NOT NULL UNION ALL SELECT id, f FROM r WHERE e IS NULL AND f IS NOT NULL UNION ALL SELECT id, unnest(['a', 'b']) FROM r WHERE e IS NULL AND f IS NULL""")
def evidence_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to evidence rows: embedded, own, or listed."""
    k = F.col("o_orderkey")
    tag = lambda x, n: F.when(k % n == 0, F.concat(F.lit(x), k.cast("string")))
    null = F.lit(None).cast("string")
    rec = t(spark, sf_dir, "orders").select(k.alias("id"), tag("E", 5).alias("evidence_row"), tag("F", 3).alias("finding_id"), null.alias("row_id"), null.alias("rule_id"), F.array(F.lit("a")).alias("operation_rows"), F.array(F.lit("b")).alias("finding_rows"))
    return P.evidence_rows(rec)


@query("""
SELECT state, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 3 THEN 'only_replay' WHEN l_quantity > 48 THEN 'only_oracle' WHEN 1 - l_discount >= 0.999 THEN 'equal' WHEN 1 - l_discount >= 0.95 THEN 'near' ELSE 'divergent' END AS state FROM lineitem) GROUP BY 1""")
def section_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnosis of each section, first match first."""
    q = F.col("l_quantity")
    state = P.section_state(F.when(q <= 48, "x"), F.when(q >= 3, "x"), 1 - F.col("l_discount"))
    return t(spark, sf_dir, "lineitem").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus = 'P', false) OR strftime(o_orderdate, '%Y-%m-%d') > '1997-01-01' OR coalesce(CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate::DATE + 100, '%Y-%m-%d') END <= '1997-01-01', false)""")
def inactive_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that do not count at a date."""
    o = t(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    gone = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), 100), "yyyy-MM-dd"))
    return o.filter(P.inactive(F.when(F.col("o_orderstatus") == "P", "Repealed"), day, gone, F.lit("text"), F.lit(True), "1997-01-01")).select("o_orderkey")


@query("SELECT l_orderkey AS src FROM lineitem WHERE l_partkey = 7")
def reverse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who cites a node."""
    edges = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return N.reverse_citations(edges, "7").select("src")


@query("""
WITH r AS (SELECT l_orderkey AS proposal, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS refs FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)
SELECT c_custkey AS provision, o_orderkey AS amendment, p.proposal, refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT o_orderkey AS amendment, o_orderkey AS proposal FROM orders WHERE o_orderkey % 2 = 0) p ON p.amendment = o_orderkey LEFT JOIN r ON r.proposal = p.proposal""")
def provenance_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provision, amendment, proposal and preparatory references in one chain."""
    o = t(spark, sf_dir, "orders")
    prep = t(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("proposal"), F.col("l_returnflag").alias("ref"))
    proposals = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("amendment"), F.col("o_orderkey").alias("proposal"))
    return N.provenance(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("provision")), o.select(F.col("o_custkey").alias("provision"), F.col("o_orderkey").alias("amendment")), proposals, prep).select("provision", "amendment", "proposal", "refs")


@query("SELECT md5(lens || chr(31) || key) AS node, lens, key FROM (SELECT 'nation' AS lens, n_nationkey::VARCHAR AS key FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM region)")
def surface_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of several lenses with stable ids."""
    return N.surface_graph([("nation", t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "key")), ("region", t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "key"))])


@query("""
WITH n AS (SELECT p_partkey AS node, CASE WHEN p_size < 25 THEN 'a' ELSE 'b' END AS kind FROM part WHERE p_size > 5), e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT lint, count(*) AS n FROM (SELECT 'dangling' AS lint FROM e WHERE dst NOT IN (SELECT node FROM n) UNION ALL SELECT 'duplicate' FROM (SELECT src, dst FROM e GROUP BY 1, 2 HAVING count(*) > 1)
  UNION ALL SELECT 'type_mismatch' FROM (SELECT DISTINCT src, dst FROM e) x JOIN n s ON x.src = s.node JOIN n d ON x.dst = d.node WHERE NOT (s.kind = 'a' AND d.kind = 'b')) GROUP BY 1""")
def surface_lints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling, repeated and mistyped edges; the smallest parts are not installed."""
    nodes = t(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") < 25, "a").otherwise("b").alias("kind"))
    edges = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return N.lints(nodes, edges, spark.createDataFrame([("a", "b")], "src_kind string, dst_kind string")).groupBy("lint").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT DISTINCT l_suppkey AS act, l_linenumber AS number FROM lineitem), n AS (SELECT s_suppkey AS act, s_nationkey % 4 AS a, s_nationkey % 4 + 2 AS b FROM supplier)
SELECT c.act, number, CASE WHEN bool_or(coalesce(number BETWEEN a AND b, false)) THEN 'repealed' ELSE 'unknown' END AS cause FROM c LEFT JOIN n USING (act) GROUP BY 1, 2""")
def dangling_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sections that a repeal note covers."""
    cited = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("act"), F.col("l_linenumber").alias("number"), F.lit(None).cast("string").alias("suffix")).distinct()
    k = F.col("s_nationkey") % 4
    notes = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("act"), k.alias("from_number"), F.lit(None).cast("string").alias("from_suffix"), (k + 2).alias("to_number"), F.lit(None).cast("string").alias("to_suffix"))
    return N.dangling_causes(cited, notes).select("act", "number", "cause")


@query("""
WITH b AS (SELECT lower(p_brand) AS name, p_size AS target, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT lower(p_brand) AS name, min(p_size) AS held FROM part WHERE p_brand LIKE '%1' GROUP BY 1)
SELECT b.name, target, n, CASE WHEN held = target THEN 'known' WHEN held IS NOT NULL THEN 'conflict' WHEN n >= 2 THEN 'new' ELSE 'rare' END AS status FROM b LEFT JOIN r ON b.name = r.name""")
def nickname_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and what they are bound to, against a registry."""
    p = t(spark, sf_dir, "part")
    registry = p.filter("p_brand like '%1'").groupBy("p_brand").agg(F.min("p_size").alias("p_size"))
    return N.mine_bindings(p, "p_brand", "p_size", registry)


@query("SELECT o_custkey, arg_max(o_orderkey, (round(o_totalprice, 2), -o_orderkey)) AS o_orderkey, max(round(o_totalprice, 2)) AS score FROM orders GROUP BY 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoint with the best score; ties go to the earliest."""
    return C.best_checkpoint(t(spark, sf_dir, "orders").withColumn("score", F.round("o_totalprice", 2)), "o_custkey", "o_orderkey", "score")


@query("SELECT o_custkey, o_orderkey, before, after FROM (SELECT o_custkey, o_orderkey, lag(o_orderstatus) OVER w AS before, o_orderstatus AS after, row_number() OVER w AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE nth > 1 AND before IS DISTINCT FROM after")
def belief_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where what was held true changed."""
    return C.belief_revisions(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT l_partkey, sum(l_quantity) AS leverage, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY leverage DESC, l_partkey LIMIT 20")
def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys with most leverage (a top-k report)."""
    return C.worklist(t(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_quantity"), 20)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS units FROM events GROUP BY 1")
def finding_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule."""
    return C.harvest(t(spark, sf_dir, "events"), "event_type", "user_id")


@query("""
WITH e AS (SELECT p_partkey AS k FROM part WHERE p_size > 3), p AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 20), x AS (SELECT p_partkey AS k FROM part WHERE p_size % 2 = 0)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN e.k IS NULL THEN 'unexpected' WHEN p.k IS NOT NULL THEN 'present' WHEN x.k IS NOT NULL THEN 'excused' ELSE 'shortfall' END AS state FROM e FULL JOIN p ON e.k = p.k LEFT JOIN x ON x.k = coalesce(e.k, p.k)) GROUP BY 1""")
def corpus_totality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected, present, excused and missing members."""
    p = t(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k")
    present = t(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(F.col("l_partkey").alias("k"))
    return C.corpus_totality(p.filter("p_size > 3"), present, p.filter("p_size % 2 = 0"), "k").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, b.text AS payload FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id AND contains(d.text, b.text))")
def payload_realisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that the text after them lacks."""
    ops = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("payload"))
    return C.unrealised_payloads(ops, t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("after")), "item_id")


@query("SELECT DISTINCT f.l_orderkey AS act, f.l_partkey || '/' || f.l_linenumber AS fine, f.l_partkey::VARCHAR AS broad FROM lineitem f JOIN lineitem b ON f.l_orderkey = b.l_orderkey AND f.l_partkey = b.l_partkey WHERE f.l_quantity <= 25 AND b.l_quantity > 25 AND b.l_linenumber > f.l_linenumber")
def snapshot_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finer ops that a later broad op hides."""
    line = t(spark, sf_dir, "lineitem")
    target = F.when(F.col("l_quantity") <= 25, F.concat_ws("/", "l_partkey", "l_linenumber")).otherwise(F.col("l_partkey").cast("string"))
    return C.snapshot_shadows(line.select(F.col("l_orderkey").alias("act"), target.alias("target"), F.col("l_linenumber").alias("seq")))


@query(f"WITH RECURSIVE {RATIO_SQL} SELECT item_id % 2 = 0 AS touched, (item_id // 10)::BIGINT AS decade, count(*) AS n, round(avg(ratio), 6) AS mean FROM s GROUP BY 1, 2")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of neighbouring benchmark texts, by a flag."""
    b = t(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id").withColumn("touched", F.col("item_id") % 2 == 0)
    return C.drift(pairs, S.edit_ratio("text", "other"), "touched", F.floor(F.col("item_id") / 10)).withColumn("mean", F.round("mean", 6))


@query("""
SELECT p_partkey, CASE WHEN s = '' THEN (p_size + 1)::VARCHAR WHEN s = 'z' THEN p_size || 'aa' ELSE p_size || chr(ascii(s) + 1) END AS nxt, p_size < 10 OR (p_size = 10 AND s = '') AS early
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'k' ELSE 'z' END AS s FROM part)""")
def label_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors and order of labels."""
    k = F.col("p_partkey") % 4
    label = F.concat(F.col("p_size").cast("string"), F.when(k == 0, "").when(k == 1, "a").when(k == 2, "k").otherwise("z"))
    return t(spark, sf_dir, "part").select("p_partkey", B.successor(label).alias("nxt"), B.before(label, F.lit("10a")).alias("early"))


@query("""
WITH f AS (SELECT lower(p_type) AS form, min(p_brand) AS lemma FROM part WHERE p_size < 20 GROUP BY 1) SELECT p_partkey, coalesce(lemma, lower(p_type)) AS lemma FROM part LEFT JOIN f ON lower(p_type) = form""")
def lemma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the lemma of their form."""
    p = t(spark, sf_dir, "part")
    forms = p.filter("p_size < 20").select(F.col("p_type").alias("form"), F.col("p_brand").alias("lemma"))
    return B.lemmas(p.select("p_partkey", F.col("p_type").alias("word")), forms).select("p_partkey", "lemma")

"""Order of ops, chunked runs, closures, drift and timelines on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import closure as C
from palimpsest.operators import replay as R
from palimpsest.operators import temporal as T
from palimpsest.operators.graph import shared_folder
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t
from palimpsest.streaming import chunked


def nulls(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


# ---------------------------------------------------------------- order of ops


def chained_renumberings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's k-th order renumbers section k to k + 1; by its status it also renumbers section 1 again, repeals, or replaces."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), k.alias("k"), "o_orderstatus")
    section = lambda n: F.concat(F.lit("s:"), n.cast("string"))
    op = lambda base, action, target, to: F.struct((F.lit(base) + F.col("k")).cast("long").alias("seq"), F.lit(action).alias("action"), target.alias("target"), to.alias("destination"))
    none = F.lit(None).cast("string")
    again = op(10_000, "RENUMBER", section(F.lit(1)), section(F.col("k") + 900))
    more = F.when(F.col("o_orderstatus") == "P", again).when(F.col("o_orderstatus") == "F", op(20_000, "REPEAL", section(F.col("k")), none)).otherwise(op(30_000, "REPLACE", section(F.col("k")), none))
    return o.select("doc_id", F.explode(F.array(op(0, "RENUMBER", section(F.col("k")), section(F.col("k") + 1)), more)).alias("o")).select("doc_id", "o.*", *nulls("group_id"))


@query("""
WITH o AS (SELECT o_custkey AS doc_id, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
ops AS (SELECT doc_id, k AS seq, 1 AS class, -k AS place FROM o UNION ALL SELECT doc_id, CASE s WHEN 'P' THEN 10000 WHEN 'F' THEN 20000 ELSE 30000 END + k, CASE s WHEN 'P' THEN 2 WHEN 'F' THEN 0 ELSE 3 END, k FROM o)
SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY class, place) - 1 AS position FROM ops""")
def applied_order_vacated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which chained and repeated renumberings apply if places are to be left before they are taken."""
    return R.applied_positions(chained_renumberings(spark, sf_dir), R.Ordering(vacate=True))


@query("""
WITH o AS (SELECT o_custkey AS doc_id, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
ops AS (SELECT doc_id, k AS seq FROM o UNION ALL SELECT doc_id, CASE s WHEN 'P' THEN 10000 WHEN 'F' THEN 20000 ELSE 30000 END + k FROM o)
SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS position FROM ops""")
def applied_order_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the same ops where nothing more is asked for."""
    return R.applied_positions(chained_renumberings(spark, sf_dir))


@query("""
WITH o AS (SELECT o_custkey AS doc_id, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT doc_id, k AS seq, 'applied' AS outcome FROM o UNION ALL SELECT doc_id, CASE s WHEN 'P' THEN 10000 ELSE 30000 END + k, CASE WHEN s = 'P' OR k = 1 THEN 'target_missing' ELSE 'payload_missing' END FROM o WHERE s <> 'F'""")
def replay_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each of those ops but the repeals, over documents that have all sections: each renumbering finds its place left, so all
    apply, and nothing is left at section 1."""
    ops = chained_renumberings(spark, sf_dir).filter("action <> 'REPEAL'")
    last = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    sections = last.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    nodes = sections.select("doc_id", F.concat(F.lit("s:"), F.col("k")).alias("addr"), F.col("k").cast("double").alias("ord"), F.lit("s").alias("kind"), F.lit("text").alias("text"), F.lit("live").alias("status"))
    full = ops.select("*", F.lit(0).cast("long").alias("occurrence"), *nulls("payload", "find", "anchor"))
    return R.replay(nodes, full, ordering=R.Ordering(vacate=True))[1].select("doc_id", "seq", "outcome")


@query("""
WITH r AS (SELECT l_partkey AS doc_id, strftime(l_shipdate, '%Y') AS day, l_suppkey AS act, l_linenumber AS target, CASE WHEN l_linenumber > 5 THEN l_linenumber - 1 - l_suppkey % 2 END AS dest, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_returnflag END AS payload, l_discount FROM lineitem),
f AS (SELECT doc_id, day, target, 'same_moment_conflict' AS finding, count(*) AS ops, count(DISTINCT act) AS acts FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT act) > 1 AND count(DISTINCT coalesce(payload, '') || '>' || coalesce(dest::VARCHAR, '')) > 1
  UNION ALL SELECT doc_id, day, dest, 'destination_contested', count(*), count(DISTINCT act) FROM r WHERE dest IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1
  UNION ALL SELECT doc_id, day, target, 'target_renumbered_again', count(*), count(DISTINCT act) FROM r WHERE dest IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, day, target FROM r WHERE l_discount > 0.08)
SELECT f.doc_id, f.day, 's:' || f.target AS target, finding, ops, acts, CASE WHEN finding = 'same_moment_conflict' AND p.doc_id IS NOT NULL THEN 'precedence_claim' ELSE 'sequence_order_unproven' END AS resolution, finding = 'same_moment_conflict' AND p.doc_id IS NULL AS blocking
FROM f LEFT JOIN p ON f.doc_id = p.doc_id AND f.day = p.day AND f.target = p.target""")
def order_conflict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops of one year that sequence alone orders, though their acts disagree."""
    n = F.col("l_linenumber")
    section = lambda c: F.concat(F.lit("s:"), c.cast("string"))
    moves = n > 5
    ops = t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("doc_id"), (F.col("l_orderkey") * 10 + n).alias("seq"), F.date_format("l_shipdate", "yyyy").alias("effective"), F.col("l_suppkey").cast("string").alias("act"), F.when(moves, "RENUMBER").otherwise("REPLACE").alias("action"),
        section(n).alias("target"), F.when(moves, section(n - 1 - F.col("l_suppkey") % 2)).alias("destination"), F.when(~moves, F.col("l_returnflag")).alias("payload"), "l_discount")
    claims = ops.filter("l_discount > 0.08").select("doc_id", F.col("effective").alias("day"), "target")
    return R.order_conflicts(ops, claims)


# ---------------------------------------------------------------- chunked runs


def part_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("last"))


def part_run(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a finished run over the line items by part, in six chunks."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    lines = t(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_shipdate")
    chunked.run_chunked(lines, "l_partkey", part_totals, path, 6)
    return path


@query("SELECT l_partkey, count(*) AS n, sum(l_quantity) AS quantity, max(l_shipdate) AS last FROM lineitem GROUP BY 1")
def chunked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by part, computed chunk by chunk under a journal."""
    return chunked.chunk_rows(spark, part_run(spark, sf_dir))


@query("WITH c AS (SELECT DISTINCT l_partkey, (CAST('0x' || substr(md5(l_partkey::VARCHAR), 1, 8) AS BIGINT) % 6)::INT AS chunk FROM lineitem) SELECT chunk, 'done' AS status, count(*) AS n FROM c GROUP BY 1")
def chunked_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal of that run."""
    return chunked.journal(spark, part_run(spark, sf_dir)).select("chunk", "status", "n")


# ---------------------------------------------------------------- closures


NEEDS_SQL = "e AS (SELECT DISTINCT l_orderkey AS src, 2 * l_orderkey + 1 + l_partkey % 3 AS dst FROM lineitem)"


def order_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order needs one to three orders of about twice its number."""
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (2 * F.col("l_orderkey") + 1 + F.col("l_partkey") % 3).alias("dst"))


@query(f"""
WITH RECURSIVE {NEEDS_SQL}, k AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT o_orderkey AS node, 0 AS layer FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 UNION SELECT e.dst, r.layer + 1 FROM r JOIN k USING (node) JOIN e ON e.src = r.node)
SELECT r.node, min(layer)::INT AS layer, CASE WHEN max(k.node) IS NULL THEN 'frontier' ELSE 'expanded' END AS state FROM r LEFT JOIN k ON k.node = r.node GROUP BY 1""")
def acquisition_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What urgent large orders need, step by step, with a frontier of orders that are not known."""
    o = t(spark, sf_dir, "orders")
    roots = o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_orderkey").alias("node"))
    return C.acquisition_closure(order_needs(spark, sf_dir), roots, o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("node")))


@query(f"""
WITH RECURSIVE {NEEDS_SQL}, r AS (SELECT src AS node, 0 AS layer FROM e UNION SELECT e.dst, r.layer + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, max(layer)::INT AS layer, 'layered' AS state FROM r GROUP BY 1""")
def dependency_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the longest chain of needs that leads to it."""
    return C.dependency_layers(order_needs(spark, sf_dir))


AMENDMENTS_SQL = """
f AS (SELECT 'a' || (l_orderkey % 500) AS amending, CASE WHEN l_discount < 0.01 THEN NULL ELSE 'a' || (l_partkey % 500) END AS base, CASE l_returnflag WHEN 'A' THEN 'amends' WHEN 'N' THEN 'corrects' ELSE 'cites' END AS relation,
  strftime(l_shipdate, '%Y-%m-%d') AS in_force, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate::DATE + 30, '%Y-%m-%d') END AS applies FROM lineitem),
j AS (SELECT *, CASE WHEN base IS NULL THEN 'missing_id' WHEN amending = base THEN 'self_loop' WHEN relation = 'cites' THEN 'unknown_relation' END AS reason FROM f)"""


def found_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = lambda c: F.concat(F.lit("a"), (F.col(c) % 500).cast("string"))
    relation = F.when(F.col("l_returnflag") == "A", "amends").when(F.col("l_returnflag") == "N", "corrects").otherwise("cites")
    return t(spark, sf_dir, "lineitem").select(
        act("l_orderkey").alias("amending"), F.when(F.col("l_discount") >= 0.01, act("l_partkey")).alias("base"), relation.alias("relation"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("in_force"),
        F.when(F.col("l_linestatus") == "F", F.date_format(F.date_add(F.to_date("l_shipdate"), 30), "yyyy-MM-dd")).alias("applies"))


@query(f"WITH {AMENDMENTS_SQL} SELECT DISTINCT amending, base, relation, coalesce(applies, in_force) AS ordering_date FROM j WHERE reason IS NULL")
def amendment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed and dated amendment edges."""
    return C.amendment_edges(found_amendments(spark, sf_dir))[0]


@query(f"WITH {AMENDMENTS_SQL} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1")
def amendment_edges_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no amendment edge, by reason."""
    return C.amendment_edges(found_amendments(spark, sf_dir))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- drift


DRIFT_SQL = """
o AS (SELECT l_partkey AS doc_id, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey * 10 + l_linenumber AS act, 's:' || (l_linenumber % 3) AS addr, max(l_returnflag || (l_quantity::INT % 3)) AS text FROM lineitem GROUP BY 1, 2, 3, 4),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY day, act) - 1 AS step FROM o),
x AS (SELECT s.doc_id, s.step, s.act::VARCHAR AS act, a.addr, coalesce(last_value(CASE WHEN s.addr = a.addr THEN s.text END IGNORE NULLS) OVER (PARTITION BY s.doc_id, a.addr ORDER BY s.step), 'old') AS text FROM s, (VALUES ('s:0'), ('s:1'), ('s:2')) a(addr)),
w AS (SELECT doc_id, addr, coalesce(arg_max(text, (day, act)) FILTER (WHERE day <= '1999-12-31' OR doc_id % 7 = 0), 'old') AS text FROM s GROUP BY 1, 2),
p AS (SELECT DISTINCT d.doc_id, a.addr, CASE WHEN d.doc_id % 5 = 1 THEN 'nowhere' ELSE coalesce(w.text, 'old') END AS text FROM s d CROSS JOIN (VALUES ('s:0'), ('s:1'), ('s:2')) a(addr) LEFT JOIN w ON w.doc_id = d.doc_id AND w.addr = a.addr),
c AS (SELECT x.doc_id, x.step, any_value(x.act) AS act, sum(CASE WHEN lower(x.text) = lower(p.text) THEN 1 ELSE 0 END)::BIGINT AS matched FROM x JOIN p ON p.doc_id = x.doc_id AND p.addr = x.addr GROUP BY 1, 2)"""


def part_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of three sections that line items replace, against what they said at the end of 1999 (every seventh: now; every
    fifth: nothing that they ever said)."""
    line = t(spark, sf_dir, "lineitem")
    act = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    addr = F.concat(F.lit("s:"), (F.col("l_linenumber") % 3).cast("string"))
    text = F.concat("l_returnflag", (F.col("l_quantity").cast("int") % 3).cast("string"))
    writes = line.groupBy(F.col("l_partkey").alias("doc_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("effective"), act.alias("seq"), addr.alias("target")).agg(F.max(text).alias("payload"))
    ops = writes.select("doc_id", "seq", F.lit("REPLACE").alias("action"), "target", "payload", F.lit(0).cast("long").alias("occurrence"), "effective", F.col("seq").cast("string").alias("act"), *nulls("find", "destination", "anchor", "group_id"))
    docs = ops.select("doc_id").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("doc_id", F.concat(F.lit("s:"), F.col("k")).alias("addr"), F.col("k").cast("double").alias("ord"))
    nodes = docs.select("doc_id", "addr", "ord", F.lit("s").alias("kind"), F.lit("old").alias("text"), F.lit("live").alias("status"))
    then = ops.filter("effective <= '1999-12-31' or doc_id % 7 = 0").groupBy("doc_id", F.col("target").alias("addr")).agg(F.max_by("payload", F.struct("effective", "seq")).alias("said"))
    oracle = docs.join(then, ["doc_id", "addr"], "left").select("doc_id", "addr", F.when(F.col("doc_id") % 5 == 1, "nowhere").otherwise(F.coalesce("said", F.lit("old"))).alias("text"))
    return R.checkpoint_scores(nodes, ops, oracle)


@query(f"WITH {DRIFT_SQL} SELECT doc_id, step, act, 2 * matched / 6.0::DOUBLE AS score FROM c")
def checkpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state between amendments, scored against the text of another source."""
    return part_drift(spark, sf_dir).select("doc_id", "step", "act", "score")


@query(f"""
WITH {DRIFT_SQL}, g AS (SELECT doc_id, count(*) AS steps, arg_max(matched, step) AS fin, max(matched) AS best, arg_max(step, (matched, -step)) AS best_step, arg_max(act, (matched, -step)) AS last_act FROM c GROUP BY 1),
h AS (SELECT *, CASE WHEN steps < 2 THEN 'too_few_steps' WHEN fin = 3 THEN 'current' WHEN best = 3 THEN 'drift' ELSE 'unmatched' END AS status FROM g)
SELECT doc_id, steps, best_step, status, CASE WHEN status = 'drift' THEN last_act END AS matched_at, CASE WHEN status = 'drift' THEN steps - 1 - best_step END AS behind_by FROM h""")
def version_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that lag behind by some amendments, with the amendment that they match."""
    return R.version_drift(part_drift(spark, sf_dir)).select("doc_id", "steps", "best_step", "status", "matched_at", "behind_by")


# ---------------------------------------------------------------- spliced timelines


SPLICE_SQL = """
w AS (SELECT 'c' || o_custkey AS addr, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS effective, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE strftime(o_orderdate::DATE + (o_orderkey % 900 - 20)::INT, '%Y-%m-%d') END AS expires, o_orderpriority AS content FROM orders),
g AS (SELECT * FROM w WHERE expires IS NULL OR expires > effective), p AS (SELECT DISTINCT addr, unnest([effective, expires]) AS day FROM g),
s AS (SELECT addr, day AS start, lead(day) OVER (PARTITION BY addr ORDER BY day) AS stop FROM p WHERE day IS NOT NULL),
a AS (SELECT s.addr, start, stop, arg_max(content, seq) AS content, max(seq) AS seq FROM s JOIN g ON g.addr = s.addr AND effective <= start AND (expires IS NULL OR expires > start) GROUP BY 1, 2, 3)"""


def order_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as writes to their customer's timeline, open or of up to 880 days."""
    ends = F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 900 - 20).cast("int")), "yyyy-MM-dd")
    return t(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("addr"), F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"), F.when(F.col("o_orderstatus") != "O", ends).alias("expires"), F.col("o_orderpriority").alias("content"))


@query(f"""
WITH {SPLICE_SQL}, i AS (SELECT *, CASE WHEN lag(stop) OVER o = start AND lag(content) OVER o = content THEN 0 ELSE 1 END AS new FROM a WINDOW o AS (PARTITION BY addr ORDER BY start)),
n AS (SELECT *, sum(new) OVER (PARTITION BY addr ORDER BY start ROWS UNBOUNDED PRECEDING) AS k FROM i),
m AS (SELECT addr, min(start) AS effective, coalesce(arg_max(coalesce(stop, ''), start), '') AS expires, min(content) AS content FROM n GROUP BY addr, k),
b AS (SELECT addr, lag(expires) OVER (PARTITION BY addr ORDER BY effective) AS effective, effective AS expires FROM m)
SELECT addr, effective, expires, content, false AS gap FROM m UNION ALL SELECT addr, effective, expires, NULL, true FROM b WHERE effective < expires""")
def spliced_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines without overlaps or holes after writes that came in any order of days."""
    return T.spliced_timeline(order_writes(spark, sf_dir), 5)[0]


@query(f"""
WITH {SPLICE_SQL}, i AS (SELECT *, CASE WHEN lag(stop) OVER o = start AND lag(seq) OVER o = seq THEN 0 ELSE 1 END AS new FROM a WINDOW o AS (PARTITION BY addr ORDER BY start)),
n AS (SELECT *, sum(new) OVER (PARTITION BY addr ORDER BY start ROWS UNBOUNDED PRECEDING) AS k FROM i),
m AS (SELECT addr, seq, min(start) AS effective, arg_max(coalesce(stop, ''), start) AS expires FROM n GROUP BY addr, k, seq),
q AS (SELECT addr, seq, count(*) AS pieces, min(effective) AS f, arg_max(expires, effective) AS u FROM m GROUP BY 1, 2)
SELECT w.addr, w.seq, CASE WHEN w.expires <= w.effective THEN 'empty_interval' WHEN pieces IS NULL THEN 'buried' WHEN pieces > 1 THEN 'cut' WHEN f = w.effective AND u = coalesce(w.expires, '') THEN 'whole' ELSE 'trimmed' END AS fate, coalesce(pieces, 0) AS pieces
FROM w LEFT JOIN q ON q.addr = w.addr AND q.seq = w.seq""")
def splice_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each write."""
    return T.spliced_timeline(order_writes(spark, sf_dir), 5)[1]

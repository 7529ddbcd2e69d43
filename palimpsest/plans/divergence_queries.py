"""Divergence, canonical form and timeline dedupe on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import divergence as D
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'identical' WHEN 1 THEN 'editorial_convention' WHEN 5 THEN 'editorial_convention' WHEN 6 THEN 'source_pathology' WHEN 7 THEN CASE WHEN o_orderstatus = 'F' THEN 'oracle_stale' ELSE 'replay_extra' END ELSE 'oracle_stale' END AS code,
  CASE o_orderkey % 8 WHEN 0 THEN 'same_text' WHEN 1 THEN 'same_letters' WHEN 2 THEN 'duplicate_sentence' WHEN 3 THEN 'residual_sentences' WHEN 4 THEN 'repeal_notice' WHEN 5 THEN 'bare_stub' WHEN 6 THEN 'tiny_edit' ELSE CASE WHEN o_orderstatus = 'F' THEN 'amendment_not_in_oracle' ELSE 'much_more_text' END END AS reason FROM orders""")
def divergence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a section differs from its oracle: each order as a section, and eight ways in which an oracle may tell it."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    placed = F.concat(F.lit("Order "), text(k), F.lit(" of customer "), text(F.col("o_custkey")), F.lit(" was placed on "), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("."))
    price = F.concat(F.lit(" The price is "), text(F.floor("o_totalprice")), F.lit(" euros."))
    said = F.concat(placed, price, F.lit(" It is handled by the clerk of the central office in the order of arrival."))
    oracle = (
        F.when(k % 8 == 0, said).when(k % 8 == 1, F.upper(F.replace(said, F.lit(" "), F.lit("  ")))).when(k % 8 == 2, F.concat(said, price)).when(k % 8 == 3, F.concat(placed, F.lit(" An older sentence that was repealed."), F.substring(said, F.char_length(placed) + 1, F.lit(10_000))))
        .when(k % 8 == 4, F.concat(text(k), F.lit(" § on kumottu L:lla 30.12.1994/"), text(k % 900 + 1), F.lit("."))).when(k % 8 == 5, F.concat(text(k), F.lit(" § "), text(k), F.lit(" §"))).when(k % 8 == 6, F.replace(said, F.lit("handled"), F.lit("handed"))).otherwise(placed))
    blamed = F.when(F.col("o_orderstatus") == "F", "REPLACE").when(F.col("o_orderstatus") == "O", "REPEAL")
    pairs = t(spark, sf_dir, "orders").select(k.alias("id"), said.alias("replay"), oracle.alias("oracle"), blamed.alias("blamed"))
    return pairs.select("id", D.divergence_reason(F.col("replay"), F.col("oracle"), F.col("blamed")).alias("d")).select("id", "d.code", "d.reason")


@query("""
WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_quantity)::INT AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, q % 10 <> 0 AS in_l, q % 7 <> 0 AS in_r FROM n)
SELECT doc_id, 's:' || n AS addr, CASE WHEN NOT in_l THEN 'missing_left' WHEN NOT in_r THEN 'missing_right' WHEN q % 11 = 0 THEN 'kind' ELSE 'text' END AS residual FROM r WHERE (in_l OR in_r) AND NOT (in_l AND in_r AND q % 11 <> 0 AND q % 3 <> 0)""")
def canonical_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the differences between two sides once labels and typography are set aside."""
    # grouped by the keys of the comparison: it needs no shuffle and no sort of its own
    n = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s:"), F.col("l_linenumber").cast("string")).alias("addr")).agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_returnflag").alias("f"))
    q = F.col("q")
    base = n.select("doc_id", "q", "f", "addr", F.substring("addr", 3, 20).alias("label"), F.lit("section").alias("kind"))
    left = base.select("doc_id", "addr", "kind", "label", F.concat("label", F.lit(" §.  Flag “"), "f", F.lit("” – of  line , it says")).alias("text"), F.when(q % 10 == 0, "tombstone").otherwise("live").alias("status"))
    right = base.select("doc_id", "addr", F.when(q % 11 == 0, "part").otherwise("section").alias("kind"), "label", F.concat(F.lit('Flag "'), "f", F.lit('" - of line, it '), F.when(q % 3 == 0, "tells").otherwise("says")).alias("text"), F.when(q % 7 == 0, "tombstone").otherwise("live").alias("status"))
    return D.canonical_residuals(D.canonical_nodes(left), D.canonical_nodes(right)).select("doc_id", "addr", "residual")


DEDUPE_SQL = """
v AS (SELECT l_partkey AS addr, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'act' || (l_suppkey % 3) END AS source, strftime(l_shipdate, '%Y') AS effective, l_linestatus AS variant, CASE WHEN l_linenumber = 5 THEN '2030' END AS expires,
  CASE WHEN l_linenumber = 1 THEN 'relabel' WHEN l_linenumber = 2 THEN 'shell' WHEN l_linenumber = 3 THEN 'renumber' END AS shape, CASE WHEN l_linenumber <> 4 THEN l_returnflag END AS content,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS pos FROM lineitem),
g AS (SELECT *, source <> '' AS s, bool_or(content IS NOT NULL) OVER w AS filled, coalesce(bool_or(content IS NOT NULL AND shape = 'relabel') OVER w, false) AS rel, bool_or(content IS NOT NULL AND shape IS NULL) OVER w AS body FROM v WINDOW w AS (PARTITION BY addr, source, effective, variant)),
a AS (SELECT *, CASE WHEN NOT s THEN NULL WHEN content IS NULL AND filled THEN 'absent_content_shadow' WHEN content IS NOT NULL AND shape = 'relabel' AND body THEN 'relabel_snapshot_shadow' WHEN content IS NOT NULL AND shape = 'shell' AND rel AND NOT body THEN 'relabel_shell_shadow' END AS r1 FROM g),
b AS (SELECT *, r1 IS NULL AND s AND content IS NOT NULL AS here FROM a),
c AS (SELECT *, max(pos) OVER k AS last, min(pos) OVER k AS first FROM b WINDOW k AS (PARTITION BY addr, source, effective, variant, here, expires, content)),
d AS (SELECT *, coalesce(r1, CASE WHEN here AND pos < last THEN 'same_source_semantic' END) AS rule FROM c)"""


def part_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions of their part: of three acts or none, some restructured, some without content."""
    n = F.col("l_linenumber")
    pos = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    return t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("addr"), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("act"), (F.col("l_suppkey") % 3).cast("string"))).alias("source"), F.date_format("l_shipdate", "yyyy").alias("effective"), F.lit("").alias("enacted"), F.when(n == 5, "2030").alias("expires"), F.col("l_linestatus").alias("variant"),
        F.lit(None).cast("string").alias("applicability"), F.when(n == 1, "relabel").when(n == 2, "shell").when(n == 3, "renumber").alias("shape"), F.when(n != 4, F.col("l_returnflag")).alias("content"), pos.cast("long").alias("pos"))


@query(f"WITH {DEDUPE_SQL} SELECT addr, pos, CASE WHEN here THEN first ELSE pos END AS place FROM d WHERE rule IS NULL")
def timeline_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that are left once shadows and repetitions of one source and moment are gone, with their place."""
    return D.dedupe_timeline(part_versions(spark, sf_dir))[0].select("addr", "pos", "place")


@query(f"WITH {DEDUPE_SQL} SELECT addr, source, effective, variant, rule, count(*) AS removed FROM d WHERE rule IS NOT NULL GROUP BY ALL")
def timeline_dedupe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went, by group and rule."""
    return D.dedupe_timeline(part_versions(spark, sf_dir))[1].select("addr", "source", "effective", "variant", "rule", "removed")

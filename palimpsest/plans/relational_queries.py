"""Filters, joins, aggregations and windows on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as A
from palimpsest.operators import filters as P
from palimpsest.operators import joins as J
from palimpsest.operators import windows as W
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t

DAY = "1997-06-01"


def iso(c: str):
    return F.date_format(c, "yyyy-MM-dd")


# ---------------------------------------------------------------- filters


@query("""
SELECT o_orderkey, o_custkey FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS s,
  lead(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM orders)
WHERE s <= '1997-06-01' AND (e IS NULL OR e >= '1997-06-01')""")
def filter_as_of_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders valid on a day, both ends inclusive; an order ends where the customer's next begins."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = t(spark, sf_dir, "orders").withColumn("s", iso("o_orderdate")).withColumn("e", F.lead("s").over(w))
    return orders.filter(P.valid_on("s", "e", DAY)).select("o_orderkey", "o_custkey")


@query("""
SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2)[0-9]') AND p_size BETWEEN 10 AND 20 AND p_name ILIKE '%a%'""")
def filter_patterns_and_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole-string pattern, a range and a case-insensitive substring, all pushed to the scan's filter."""
    part = t(spark, sf_dir, "part")
    return part.filter(P.all_of([P.whole_match("p_brand", "Brand#(1|2)[0-9]"), P.year_range("p_size", "10:20"), P.contains_ci("p_name", "a")])).select("p_partkey", "p_brand")


REF_SQL = """
refs AS (SELECT 'O/' || l_orderkey AS source_statute_id, 'O/' || l_orderkey || '/' || l_linenumber AS source_provision_ref_str, 'P/' || l_partkey AS target_statute_id,
  'P/' || l_partkey || '/' || l_suppkey AS target_provision_ref_str, lower(replace(l_returnflag || '-' || l_linestatus, '-', '_')) AS cite_kind,
  CASE WHEN l_quantity < 5 THEN 'broken' WHEN l_quantity < 25 THEN NULL ELSE 'exact' END AS cite_confidence,
  strftime(l_shipdate, '%Y-%m-%d') AS valid_at_start, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate::DATE + 365, '%Y-%m-%d') END AS valid_at_end FROM lineitem)"""


def line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references from orders to parts."""
    line = t(spark, sf_dir, "lineitem")
    s = lambda *c: F.concat_ws("/", *c)
    return line.select(
        s(F.lit("O"), "l_orderkey").alias("source_statute_id"), s(F.lit("O"), "l_orderkey", "l_linenumber").alias("source_provision_ref_str"),
        s(F.lit("P"), "l_partkey").alias("target_statute_id"), s(F.lit("P"), "l_partkey", "l_suppkey").alias("target_provision_ref_str"),
        F.lower(F.concat_ws("_", "l_returnflag", "l_linestatus")).alias("cite_kind"),
        F.when(F.col("l_quantity") < 5, "broken").when(F.col("l_quantity") >= 25, "exact").alias("cite_confidence"),
        iso("l_shipdate").alias("valid_at_start"), F.when(F.col("l_linestatus") == "F", F.date_format(F.date_add(F.to_date("l_shipdate"), 365), "yyyy-MM-dd")).alias("valid_at_end"),
    )


@query(f"WITH {REF_SQL} SELECT source_provision_ref_str, target_provision_ref_str, cite_confidence FROM refs WHERE target_statute_id = 'P/7' AND cite_kind = 'r_f' AND valid_at_start <= '1998-01-01' AND (valid_at_end IS NULL OR valid_at_end >= '1998-01-01')")
def refs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by target, kind (with a hyphen) and date."""
    found = P.query_references(line_references(spark, sf_dir), target="P/7", kind="r-f", as_of="1998-01-01")
    return found.select("source_provision_ref_str", "target_provision_ref_str", "cite_confidence")


@query(f"WITH {REF_SQL} SELECT source_provision_ref_str, target_provision_ref_str FROM refs WHERE (target_statute_id = 'P/1045/8' OR target_provision_ref_str LIKE 'P/1045/8%') AND cite_confidence = 'broken' AND valid_at_start > '1994-01-01'")
def refs_query_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provision target, by bare prefix, among broken references after a date."""
    found = P.query_references(line_references(spark, sf_dir), target="P/1045/8", broken_after="1994-01-01")
    return found.select("source_provision_ref_str", "target_provision_ref_str")


@query(f"WITH {REF_SQL} SELECT count(*) AS n FROM refs WHERE target_provision_ref_str = 'P/1/1' OR target_provision_ref_str LIKE 'P/1/1/%'")
def refs_prefix_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict prefix: a provision or one under it."""
    return line_references(spark, sf_dir).filter(P.provision_prefix("target_provision_ref_str", "P/1/1", "strict")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'document' AS kind, doc_id::VARCHAR AS id, left(text, 200) AS excerpt FROM documents WHERE text ILIKE '%license%'
UNION ALL SELECT 'page', page_id::VARCHAR, left(html, 200) FROM pages WHERE html ILIKE '%license%'
UNION ALL SELECT 'turn', conv_id::VARCHAR, left(text, 200) FROM conversations WHERE text ILIKE '%license%'""")
def keyword_search_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over three sources as one UNION ALL."""
    return P.keyword_search([(t(spark, sf_dir, "documents"), "document", "doc_id", "text"), (t(spark, sf_dir, "pages"), "page", "page_id", "html"), (t(spark, sf_dir, "conversations"), "turn", "conv_id", "text")], "license")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license') AND NOT regexp_matches(text, '(?i)password') AND lang = 'en'")
def structural_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns to hold and not to hold, with an equality."""
    return P.structural_grep(t(spark, sf_dir, "documents"), ["license"], ["password"], equal={"lang": "en"}).select("doc_id")


@query("""
WITH d AS (SELECT event_id, CASE WHEN value >= 0 AND event_id % 7 = 0 THEN NULL ELSE user_id END AS group_id,
  CASE WHEN event_type = 'error' THEN 'rejected' WHEN value > 100 THEN 'pending' ELSE 'kept' END AS disposition FROM events)
SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN group_id IS NOT NULL AND max(CASE WHEN disposition <> 'kept' THEN 1 ELSE 0 END) OVER (PARTITION BY group_id) = 1 THEN 'rejected' ELSE disposition END AS disposition FROM d) GROUP BY 1""")
def lossless_group_atomicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-way split without loss, with groups that stand or fall together."""
    e = t(spark, sf_dir, "events").withColumn("group_id", F.when(~((F.col("value") >= 0) & (F.col("event_id") % 7 == 0)), F.col("user_id")))
    split = P.disposition(e, F.col("event_type") == "error", F.col("value") > 100)
    return P.group_atomicity(split).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, 'chapter:' || p_size || '/section:' || (p_partkey % 9) AS locator,
  len(string_split('chapter:' || p_size || '/section:' || (p_partkey % 9), '/')) AS steps FROM part""")
def selector_to_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selector grammar and the locator grammar."""
    sel = F.concat(F.lit("§"), F.col("p_size").cast("string"), F.lit(":"), (F.col("p_partkey") % 9).cast("string"))
    loc = P.selector_locator(sel)
    return t(spark, sf_dir, "part").select("p_partkey", loc.alias("locator"), F.size(P.parse_locator(loc)).cast("long").alias("steps"))


# ---------------------------------------------------------------- joins


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderdate <= TIMESTAMP '1997-06-01') AS before_key,
  arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-06-01') AS after_key FROM orders GROUP BY o_custkey""")
def as_of_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order at or before a day and earliest at or after it."""
    orders = t(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    out = J.as_of_window(orders, "o_custkey", "o_orderdate", ["o_orderkey"], DAY)
    return out.select("o_custkey", F.col("before.o_orderkey").alias("before_key"), F.col("after.o_orderkey").alias("after_key"))


@query("""
SELECT o_custkey, arg_max(o_orderkey, (d, o_orderkey)) FILTER (WHERE d < '1997-06-01') AS before_key, arg_min(o_orderkey, (d, o_orderkey)) FILTER (WHERE d >= '1997-06-01') AS after_key
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) GROUP BY o_custkey""")
def as_of_strict_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the latest strictly before the day."""
    out = J.as_of_window(t(spark, sf_dir, "orders").withColumn("d", iso("o_orderdate")), "o_custkey", "d", ["o_orderkey"], DAY, strict=True)
    return out.select("o_custkey", F.col("before.o_orderkey").alias("before_key"), F.col("after.o_orderkey").alias("after_key"))


@query("""
WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), c AS (SELECT l_partkey FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT s_suppkey, s_name, count(l_partkey) AS n_contested FROM supplier LEFT JOIN (SELECT * FROM l WHERE l_partkey IN (SELECT l_partkey FROM c)) ON s_suppkey = l_suppkey GROUP BY ALL""")
def competing_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the number of parts that another supplier offers too."""
    both = J.contested(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    counted = both.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_contested"))
    sup = t(spark, sf_dir, "supplier")
    return sup.join(counted, sup.s_suppkey == counted.l_suppkey, "left").select("s_suppkey", "s_name", F.coalesce("n_contested", F.lit(0)).alias("n_contested"))


@query("""
SELECT c_custkey, p.priorities FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1) p ON c_custkey = o_custkey""")
def left_join_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their sorted distinct order priorities, aggregated before the join."""
    lists = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(A.sorted_distinct("o_orderpriority").alias("priorities"))
    return t(spark, sf_dir, "customer").join(lists, "c_custkey", "left").select("c_custkey", "priorities")


@query("""
WITH m AS (SELECT l_partkey, max(l_shipdate) AS latest FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, date_diff('day', l_shipdate::DATE, latest::DATE) AS staleness FROM lineitem JOIN m USING (l_partkey) WHERE l_shipdate < latest AND l_returnflag = 'R'""")
def census_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped before the latest of their part, by staleness: aggregate, join, filter."""
    line = t(spark, sf_dir, "lineitem")
    latest = line.groupBy("l_partkey").agg(F.max("l_shipdate").alias("latest"))
    return line.filter("l_returnflag = 'R'").join(latest, "l_partkey").filter("l_shipdate < latest").select("l_orderkey", "l_linenumber", F.datediff(F.to_date("latest"), F.to_date("l_shipdate")).cast("long").alias("staleness"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def census_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    o = t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT DISTINCT o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def census_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a returned line."""
    returned = t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query("""
WITH a AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT CASE WHEN a.k IS NULL THEN 'LEFT_MISSING' WHEN b.k IS NULL THEN 'RIGHT_MISSING' WHEN a.v = b.v THEN 'MATCH' ELSE 'MISMATCH' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def full_outer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their lines, both sides kept."""
    a = t(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("v"))
    b = t(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return J.full_compare(a, b, ["k"], "v").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH acts AS (SELECT o_orderkey AS act, strftime(o_orderdate, '%Y-%m-%d') AS in_force, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate::DATE + 60, '%Y-%m-%d') END AS repealed FROM orders WHERE o_orderkey % 4 <> 0)
SELECT CASE WHEN act IS NULL THEN 'unverifiable' WHEN in_force <= d AND (repealed IS NULL OR repealed > d) THEN 'in_force' ELSE 'broken' END AS lifecycle, count(*) AS n
FROM (SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem) LEFT JOIN acts ON l_orderkey = act GROUP BY 1""")
def lifecycle_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Was the order open when the line shipped? Unknown orders are unverifiable, never broken."""
    acts = t(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("act"), iso("o_orderdate").alias("in_force"), F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(F.to_date("o_orderdate"), 60), "yyyy-MM-dd")).alias("repealed"))
    cites = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("act"), iso("l_shipdate").alias("d"))
    return J.lifecycle(cites, acts, "act", "d").groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH i AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'classified' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN s END AS supplier FROM part LEFT JOIN i ON p_partkey = k""")
def lookup_with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts looked up in an index: one answer, several, or none."""
    index = t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("supplier"))
    return J.lookup_status(t(spark, sf_dir, "part").select("p_partkey"), index, "p_partkey", "supplier").select("p_partkey", "status", "supplier")


@query("""
WITH a AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE turn % 2 = 0),
b AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE turn % 3 <> 0)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.role, b.role) AS role, coalesce(a.nth, b.nth) AS nth, CASE WHEN a.conv_id IS NULL THEN 'right_only' WHEN b.conv_id IS NULL THEN 'left_only' ELSE 'matched' END AS side
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.role = b.role AND a.nth = b.nth""")
def align_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of two trees, aligned first with first within equal keys."""
    c = t(spark, sf_dir, "conversations")
    out = J.align_children(c.filter("turn % 2 = 0"), c.filter("turn % 3 <> 0"), ["conv_id", "role"], "turn")
    return out.select("conv_id", "role", F.col("nth").cast("long").alias("nth"), "side")


@query("""
WITH places AS (SELECT DISTINCT l_orderkey AS act, l_linenumber AS place FROM lineitem WHERE l_orderkey % 10 <> 0), r AS (SELECT l_orderkey AS act, (l_linenumber + l_partkey % 2)::INT AS place FROM lineitem)
SELECT CASE WHEN a.act IS NULL THEN 'UNAVAILABLE' WHEN p.act IS NULL THEN 'BROKEN' ELSE 'OK' END AS state, count(*) AS n FROM r LEFT JOIN (SELECT DISTINCT act FROM places) a ON r.act = a.act LEFT JOIN places p ON r.act = p.act AND r.place = p.place GROUP BY 1""")
def broken_refs_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to places that the target lacks; a target without text is unavailable, not broken."""
    line = t(spark, sf_dir, "lineitem")
    places = line.filter("l_orderkey % 10 <> 0").select(F.col("l_orderkey").alias("act"), F.col("l_linenumber").alias("place"))
    refs = line.select(F.col("l_orderkey").alias("act"), (F.col("l_linenumber") + F.col("l_partkey") % 2).cast("int").alias("place"))
    return J.broken_references(refs, places, "act", "place").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT o_custkey, left(o_orderpriority, 1)::INT AS rank, o_orderstatus AS v, o_orderkey FROM orders), t AS (SELECT * FROM c QUALIFY rank = min(rank) OVER (PARTITION BY o_custkey))
SELECT o_custkey, CASE WHEN count(DISTINCT v) = 1 THEN arg_min(v, o_orderkey) END AS v, CASE WHEN count(DISTINCT v) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM t GROUP BY 1""")
def precedence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank wins if its values agree; else the answer is ambiguous."""
    claims = t(spark, sf_dir, "orders").select("o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("rank"), F.col("o_orderstatus").alias("v"), "o_orderkey")
    return J.resolve_precedence(claims, "o_custkey", "rank", "v", "o_orderkey")


# ---------------------------------------------------------------- aggregations


@query("SELECT md5(text) AS content, count(*) AS n_rows, count(DISTINCT source) AS n_works FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def harmonisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several sources share."""
    return A.harmonisation(t(spark, sf_dir, "documents"), "text", "source")


@query("""
WITH l AS (SELECT md5(text) AS leaf, count(*) AS n, any_value(strlen(text)) AS size FROM documents GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS distinct_leaves, count(*) FILTER (WHERE n > 1) AS shared_leaves, sum(n * size)::BIGINT AS bytes_total, sum((n - 1) * size)::BIGINT AS bytes_saved FROM l""")
def leaf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and shared leaves and the bytes that sharing saves."""
    return A.leaf_dedup(t(spark, sf_dir, "documents"), "text")


@query("""
WITH o AS (SELECT year(o_orderdate)::INT AS yr, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT year(l_shipdate)::INT AS yr, count(*) AS lines FROM lineitem GROUP BY 1),
r AS (SELECT year(l_shipdate)::INT AS yr, count(*) AS returns FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), j AS (SELECT yr, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, coalesce(returns, 0) AS returns FROM o FULL JOIN l USING (yr) FULL JOIN r USING (yr))
SELECT *, round(lines / greatest(orders, 1), 3) AS lines_density, round(returns / greatest(orders, 1), 3) AS returns_density FROM j""")
def census_year_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three kinds per year, full-joined, with densities."""
    o, line = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    return A.rollup_counts({"orders": (o, F.year("o_orderdate")), "lines": (line, F.year("l_shipdate")), "returns": (line.filter("l_returnflag = 'R'"), F.year("l_shipdate"))}, "yr", "orders")


@query("SELECT p_brand, count(*) AS n_lines, count(DISTINCT o_custkey) AS n_customers FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY n_lines DESC, p_brand LIMIT 10")
def census_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten brands most ordered, with their distinct customers (a top-k report)."""
    line = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("o_orderkey"))
    joined = line.join(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").join(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("o_custkey").alias("n_customers")).orderBy(F.desc("n_lines"), "p_brand").limit(10)


SCORES = "s AS (SELECT l_orderkey AS unit, 1 - avg(l_discount) AS score, bool_or(l_returnflag = 'R') AS crashed FROM lineitem GROUP BY 1)"


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg((1 - F.avg("l_discount")).alias("score"), F.max(F.col("l_returnflag") == "R").alias("crashed"))


@query(f"""WITH {SCORES} SELECT round(avg(score) FILTER (WHERE NOT crashed), 9) AS mean, count(*) FILTER (WHERE NOT crashed) AS n, count(*) FILTER (WHERE NOT crashed AND score >= 0.9999) AS perfect, count(*) FILTER (WHERE NOT crashed AND score >= 0.99) AS ge_99,
  count(*) FILTER (WHERE NOT crashed AND score >= 0.95) AS ge_95, count(*) FILTER (WHERE NOT crashed AND score < 0.90) AS lt_90, count(*) FILTER (WHERE crashed) AS errors FROM s""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and buckets of scores; rows that are not scored count as errors."""
    return A.distribution(order_scores(spark, sf_dir), "score", ~F.col("crashed")).withColumn("mean", F.round("mean", 9))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def status_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by status."""
    return t(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS bucket, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events WHERE value > 5 GROUP BY 1")
def residue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of MAP values by key over scored rows; the values come out of JSON."""
    e = t(spark, sf_dir, "events").withColumn("residue", F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")))
    return A.residue_totals(e, "residue", F.col("value") > 5)


@query("""
WITH a AS (SELECT l_partkey AS unit, round(avg(l_discount), 6) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS unit, round(avg(l_discount), 6) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT unit, a.s AS "before", b.s AS "after", round(b.s - a.s, 6) AS delta FROM a JOIN b USING (unit) WHERE b.s - a.s < -0.001""")
def regression_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of two runs that got worse by more than the tolerance."""
    run = lambda x: t(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == x).groupBy(F.col("l_partkey").alias("unit")).agg(F.round(F.avg("l_discount"), 6).alias("s"))
    return A.regressions(run("F"), run("O"), "unit", "s").withColumn("delta", F.round("delta", 6))


@query("SELECT l_orderkey, l_linenumber, greatest(CASE WHEN l_discount > 0 THEN l_discount END, CASE WHEN l_tax > 0 THEN l_tax END) AS err FROM lineitem")
def headline_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of the errors that were attempted; null if none was."""
    line = t(spark, sf_dir, "lineitem").withColumn("a", F.when(F.col("l_discount") > 0, F.col("l_discount"))).withColumn("b", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return line.select("l_orderkey", "l_linenumber", A.headline_error("a", "b").alias("err"))


@query("""
WITH c AS (SELECT event_type AS bucket, count(*) AS n FROM events GROUP BY 1), d AS (SELECT * FROM (VALUES ('click', false), ('view', false), ('refund', false), ('error', true)) AS v(bucket, zero))
SELECT bucket, coalesce(n, 0) AS n, CASE WHEN zero IS NULL THEN 'undeclared' WHEN zero AND coalesce(n, 0) > 0 THEN 'must_be_zero' WHEN NOT zero AND n IS NULL THEN 'missing' END AS problem FROM c FULL JOIN d USING (bucket)
WHERE CASE WHEN zero IS NULL THEN 'undeclared' WHEN zero AND coalesce(n, 0) > 0 THEN 'must_be_zero' WHEN NOT zero AND n IS NULL THEN 'missing' END IS NOT NULL""")
def partition_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that are undeclared, missing, or should be empty."""
    return A.partition_violations(t(spark, sf_dir, "events"), "event_type", ["click", "view", "refund", "error"], ["error"])


@query("""
WITH e AS (SELECT o_orderkey AS k, count(*) AS n_effects FROM orders GROUP BY 1), r AS (SELECT l_orderkey AS k, count(*) AS n_receipts FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 10 GROUP BY 1)
SELECT k, coalesce(n_effects, 0) AS n_effects, coalesce(n_receipts, 0) AS n_receipts FROM e FULL JOIN r USING (k) WHERE coalesce(n_effects, 0) <> coalesce(n_receipts, 0) OR coalesce(n_effects, 0) <> 1""")
def conservation_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects without exactly one receipt, and receipts without effect."""
    e = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    r = t(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_quantity > 10").select(F.col("l_orderkey").alias("k"))
    return A.bijection_violations(e, r, "k")


@query("""
WITH u AS (SELECT p_partkey::VARCHAR AS unit_id, p_brand AS kind_label, CASE WHEN p_size < 5 THEN 'small' END AS class FROM part), c AS (SELECT DISTINCT l_partkey::VARCHAR AS claim FROM lineitem WHERE l_quantity > 48 UNION SELECT 'Brand#11')
SELECT CASE WHEN unit_id IN (SELECT claim FROM c) OR kind_label IN (SELECT claim FROM c) THEN 'covered' ELSE coalesce(class, 'UNIT_UNCLASSIFIED') END AS state, count(*) AS n FROM u GROUP BY 1""")
def coverage_totality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units covered by id or label; the rest classified, so that nothing is missing."""
    units = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("unit_id"), F.col("p_brand").alias("kind_label"), F.when(F.col("p_size") < 5, "small").alias("class"))
    claims = t(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").cast("string").alias("claim")).union(spark.createDataFrame([("Brand#11",)], "claim string"))
    return A.coverage(units, claims).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORES}, d AS (SELECT s.*, strftime(o_orderdate, '%Y-%m-%d') AS as_of FROM s JOIN orders ON unit = o_orderkey)
SELECT count(*) FILTER (WHERE as_of <= '1996-01-01') AS n_train, round(avg(score) FILTER (WHERE as_of <= '1996-01-01'), 9) AS mean_train, count(*) FILTER (WHERE as_of > '1996-01-01') AS n_held, round(avg(score) FILTER (WHERE as_of > '1996-01-01'), 9) AS mean_held FROM d WHERE as_of IS NOT NULL AND score >= 0""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores before and after a cutoff."""
    dated = order_scores(spark, sf_dir).join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), iso("o_orderdate").alias("as_of")), "unit")
    return A.holdout(dated, "as_of", "score", "1996-01-01").withColumns({"mean_train": F.round("mean_train", 9), "mean_held": F.round("mean_held", 9)})


@query("""
WITH b AS (SELECT l_orderkey AS statute, CASE WHEN l_quantity = 50 THEN NULL ELSE l_linenumber END AS section, l_returnflag AS blocker FROM lineitem WHERE l_quantity >= 49),
x AS (SELECT statute, section, blocker FROM b WHERE section IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, blocker FROM b JOIN lineitem ON statute = l_orderkey WHERE section IS NULL),
g AS (SELECT statute, section, string_agg(DISTINCT blocker, ',' ORDER BY blocker) AS blockers FROM x GROUP BY 1, 2)
SELECT l_orderkey AS statute, l_linenumber AS section, CASE WHEN g.statute IS NULL THEN 'complete' ELSE 'blocked' END AS status, g.blockers FROM lineitem LEFT JOIN g ON l_orderkey = g.statute AND l_linenumber = g.section""")
def chain_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with what blocks them; statute-wide blockers hit them all."""
    line = t(spark, sf_dir, "lineitem")
    b = line.filter("l_quantity >= 49").select(F.col("l_orderkey").alias("statute"), F.when(F.col("l_quantity") != 50, F.col("l_linenumber")).alias("section"), F.col("l_returnflag").alias("blocker"))
    out = A.chain_completeness(line.select(F.col("l_orderkey").alias("statute"), F.col("l_linenumber").alias("section")), b)
    return out.select("statute", "section", "status", F.array_join("blockers", ",").alias("blockers"))


# ---------------------------------------------------------------- windows


@query("SELECT l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey, arg_max(l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS l_linenumber FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def blame_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that touched each part last, skipped lines apart."""
    return W.last_writer(t(spark, sf_dir, "lineitem"), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R")


@query("""
WITH s AS (SELECT user_id AS addr, strftime(ts, '%Y-%m-%d') AS day, max(event_type) AS content FROM events GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT addr FROM s), (SELECT DISTINCT day FROM s)),
f AS (SELECT addr, day, content, lag(content) OVER (PARTITION BY addr ORDER BY day) AS p FROM g LEFT JOIN s USING (addr, day))
SELECT addr, day, content FROM f WHERE content IS DISTINCT FROM p""")
def timeline_from_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions out of daily snapshots: a new one wherever the content changes or goes."""
    s = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("addr"), iso("ts").alias("day")).agg(F.max("event_type").alias("content"))
    return W.change_versions(s, "addr", "day", "content", s.select("day"))


@query("SELECT unit, step, drop_ AS \"drop\" FROM (SELECT o_custkey AS unit, o_orderkey AS step, round(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_totalprice, 2) AS drop_ FROM orders) WHERE drop_ > 100000")
def bisect_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps at which a unit's score fell by much."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("score"))
    return W.score_drops(o, "unit", "step", "score").withColumn("drop", F.round("drop", 2)).filter("drop > 100000").select("unit", "step", "drop")


@query("SELECT o_custkey, after, missing FROM (SELECT o_custkey, o_orderkey AS after, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey - 1 AS missing FROM orders) WHERE missing > 0")
def ordinal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes in the ascending order numbers of each customer."""
    return W.ordinal_gaps(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderdate::DATE AS d, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def dedupe_first_per_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order per customer and day."""
    o = t(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return W.first_per(o, ["o_custkey", "d"], ["o_orderkey"]).select("o_custkey", "d", "o_orderkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r % 7 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh customer (a sampling operator)."""
    return W.stride_sample(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)


@query("""
WITH l AS (SELECT DISTINCT p_size::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END AS label FROM part)
SELECT label, row_number() OVER (ORDER BY regexp_extract(label, '^\\d+')::INT, regexp_extract(label, '[a-z]?$')) AS place FROM l""")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in their own order: 2, 2a, 10."""
    labels = t(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("")).alias("label")).distinct()
    return labels.select("label", F.row_number().over(Window.orderBy(W.label_sort_key("label"))).cast("long").alias("place"))

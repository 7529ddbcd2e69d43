"""Amendment clauses, references and definitions on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import clauses as G
from palimpsest.operators import closure as C
from palimpsest.operators import references as X
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t

# ---------------------------------------------------------------- clauses

CLAUSE_SQL = """
l AS (SELECT DISTINCT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'REPEAL' WHEN 'N' THEN 'REPLACE' ELSE 'INSERT' END AS action, l_partkey % 90 + 1 AS s, l_linenumber AS m, l_linestatus = 'F' AS deep FROM lineitem),
x AS (SELECT *, 'section:' || s AS sec, CASE WHEN action = 'REPLACE' AND m = 1 THEN 'heading' END AS facet FROM l)"""


def order_clauses(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """(id, text), and columns ``more`` of orders: each order as an amendment clause. Its line items are the targets: returned ones are repealed, others replaced or, with the
    renumbering that follows from it, inserted; shipped ones name items. Urgent orders have a word that is no part of the grammar."""
    line = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", (F.col("l_partkey") % 90 + 1).alias("s"), F.col("l_linenumber").alias("m"), (F.col("l_linestatus") == "F").alias("deep"))
    line = line.repartition("id").distinct()  # dealt once: all that follows goes by id
    m = F.col("m").cast("string")
    inside = F.when(F.col("deep"), F.concat(F.lit(" §:n "), m, F.lit(" momentin 2 ja 4 kohta"))).otherwise(F.concat(F.lit(" §:n "), m, F.lit("–"), (F.col("m") + 1).cast("string"), F.lit(" momentti")))
    heading = (F.col("l_returnflag") == "N") & (F.col("m") == 1)
    new = F.concat(F.lit(" §:ään uusi "), m, F.lit(" momentti, jolloin nykyinen "), m, F.lit(" momentti siirtyy "), (F.col("m") + 1).cast("string"), F.lit(" momentiksi"))
    target = F.concat(F.col("s").cast("string"), F.when(heading, F.lit(" §:n otsikko")).when(F.col("l_returnflag") == "R", new).otherwise(inside))
    verb = F.when(F.col("l_returnflag") == "A", "kumotaan").when(F.col("l_returnflag") == "N", "muutetaan").otherwise("lisätään")
    group = lambda v: F.when(F.count_if(verb == v) > 0, F.concat_ws(" ", F.lit(v), F.array_join(F.sort_array(F.collect_list(F.when(verb == v, target))), ", ")))
    texts = line.groupBy("id").agg(F.concat_ws(" sekä ", *(group(v) for v in ("kumotaan", "lisätään", "muutetaan"))).alias("text"))
    orders = t(spark, sf_dir, "orders")
    lead = F.when(F.col("o_orderpriority") == "1-URGENT", "kiireellisesti ").otherwise("")
    cite = F.concat(F.lit("annetun lain ("), (F.col("id") % 900 + 1).cast("string"), F.lit("/1999) "))
    return texts.join(orders, F.col("id") == F.col("o_orderkey")).select("id", F.concat(lead, F.when(F.col("o_orderstatus") == "F", cite).otherwise(""), "text", F.lit(" seuraavasti:")).alias("text"), *(c.alias(name) for name, c in more.items()))


@query(f"""
WITH {CLAUSE_SQL}, o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 900 + 1) || '/1999' END AS statute FROM orders),
r AS (SELECT id, CASE WHEN facet IS NOT NULL THEN 'HEADING_REPLACE' ELSE action END AS action, CASE WHEN facet IS NOT NULL THEN sec WHEN action = 'INSERT' THEN sec || '/subsection:' || m WHEN deep THEN sec || '/subsection:' || m || '/item:' || k ELSE sec || '/subsection:' || (m + k // 2 - 1) END AS target,
    NULL AS destination, facet, action = 'INSERT' AS new FROM x, (VALUES (2), (4)) v(k) WHERE k = 2 OR (facet IS NULL AND action <> 'INSERT')
  UNION ALL SELECT id, 'RENUMBER', sec || '/subsection:' || m, sec || '/subsection:' || (m + 1), NULL, false FROM x WHERE action = 'INSERT')
SELECT id, action, target, destination, facet, new, statute, count(*) AS n FROM r JOIN o USING (id) GROUP BY ALL""")
def clause_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ops that clauses order: several verbs, scopes, lists, ranges and consequences in each."""
    parsed = G.parse_clauses(order_clauses(spark, sf_dir), "id", "text", ("ops",))
    return G.clause_ops(parsed, "id").groupBy("id", "action", "target", "destination", "facet", "new", "statute").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_orderkey AS id, 'kiireellisesti' AS leftover, 'unknown_word' AS reason, 0 AS at FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def clause_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the clauses no rule of the grammar takes."""
    return G.clause_leftovers(G.parse_clauses(order_clauses(spark, sf_dir), "id", "text", ("leftovers",)), "id").select("id", "leftover", "reason", "at")


def act_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, acts): orders as acts with a clause that amends another and a block of preparatory works; two thirds of the acts amended are known."""
    from palimpsest.plans.policy_queries import works_text

    texts = order_clauses(spark, sf_dir, works=works_text()).withColumnRenamed("text", "clause")
    n = F.col("o_orderkey") % 900 + 1
    acts = t(spark, sf_dir, "orders").filter(n % 3 != 0).select(F.concat(n.cast("string"), F.lit("/1999")).alias("act")).distinct()
    return texts, acts


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 900 + 1 AS k, o_orderstatus AS s, o_orderkey % 300 + 1 AS n, 2000 + o_custkey % 20 AS y, o_orderkey % 12 + 1 AS m, bool_and(l_returnflag = 'A') AS gone FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, CASE WHEN gone THEN 'repeals' ELSE 'amends' END AS relation, k || '/1999' AS target, k % 3 <> 0 AS resolved FROM o WHERE s = 'F'
UNION ALL SELECT id, 'prepared_by', 'HE ' || n || '/' || y, NULL FROM o UNION ALL SELECT id, 'prepared_by', CASE s WHEN 'F' THEN 'HaVM ' WHEN 'O' THEN 'PeVL ' ELSE 'EV ' END || m || '/' || y, NULL FROM o
UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'implements' ELSE 'cites' END, CASE WHEN id % 2 = 0 THEN '3' || y || 'L' || lpad(n::VARCHAR, 4, '0') ELSE 'EU ' || y || '/' || n END, NULL FROM o UNION ALL SELECT id, 'cites', 'EUVL L ' || n, NULL FROM o""")
def text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of acts as their own texts tell it."""
    texts, acts = act_texts(spark, sf_dir)
    return C.text_edges(texts, "id", "clause", "works", acts)[0].select("id", "relation", "target", "resolved")


@query("""
WITH o AS (SELECT DISTINCT o_orderkey AS id, o_orderkey % 12 + 1 AS m, o_orderpriority AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT id, 'preparatory' AS stage, 'muistio ' || m AS detail FROM o UNION ALL SELECT id, 'clause', 'unknown_word: kiireellisesti' FROM o WHERE p = '1-URGENT'""")
def text_graph_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the texts became no edge."""
    texts, acts = act_texts(spark, sf_dir)
    return C.text_edges(texts, "id", "clause", "works", acts)[1]


# ---------------------------------------------------------------- elliptical references


ELLIPSIS_SQL = """
k AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
s AS (SELECT user_id AS doc, (k % 7)::VARCHAR AS section, list_sort(list(DISTINCT k % 4 + 1)) AS subsections, list_sort(list(DISTINCT k % 4 + 1) FILTER (WHERE k % 5 = 0)) AS carriers FROM k GROUP BY 1, 2),
m AS (SELECT user_id AS doc, event_id // 2 AS pos, event_id AS mention, CASE WHEN k % 11 <> 0 THEN ((value::INT) % 7)::VARCHAR END AS section, CASE WHEN event_type = 'click' THEN (k % 9)::VARCHAR END AS ref_section,
  CASE WHEN event_type = 'view' OR (event_type = 'click' AND k % 2 = 0) THEN k % 6 + 1 END AS ref_subsection, CASE WHEN event_type = 'error' THEN (k % 3)::VARCHAR END AS ref_item, CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'section' ELSE 'subsection' END END AS anaphor FROM k),
j AS (SELECT m.*, s.subsections, coalesce(s.carriers, []) AS carriers FROM m LEFT JOIN s ON s.doc = m.doc AND s.section = m.section),
o AS (SELECT *, CASE WHEN ref_section IS NOT NULL OR (ref_subsection IS NULL AND ref_item IS NULL) THEN 'not_elliptical' WHEN section IS NULL THEN 'open' WHEN ref_subsection IS NULL AND len(carriers) <> 1 THEN 'ambiguous' ELSE 'resolved' END AS st FROM j WHERE anaphor IS NULL),
f AS (SELECT *, CASE st WHEN 'not_elliptical' THEN ref_section WHEN 'resolved' THEN section END AS ts, CASE WHEN st IN ('not_elliptical', 'resolved') THEN coalesce(ref_subsection, CASE WHEN st = 'resolved' THEN carriers[1] END) END AS tb FROM o),
a AS (SELECT doc, pos, count(DISTINCT CASE WHEN ts IS NOT NULL THEN ts || '/' || coalesce(tb, -1) END) AS n, min(ts) AS ts, min(tb) AS tb, bool_or(st = 'ambiguous') AS unclear, bool_or(st = 'open') AS nowhere FROM f WHERE ref_section IS NOT NULL OR ref_subsection IS NOT NULL OR ref_item IS NOT NULL GROUP BY 1, 2),
b AS (SELECT j.*, a.n, a.ts, a.tb, a.unclear, a.nowhere FROM j ASOF LEFT JOIN a ON a.doc = j.doc AND a.pos < j.pos WHERE j.anaphor IS NOT NULL),
c AS (SELECT *, CASE WHEN unclear OR n > 1 THEN 'ambiguous' WHEN n IS NULL OR nowhere OR n = 0 OR (anaphor = 'subsection' AND tb IS NULL) THEN 'open' ELSE 'resolved' END AS st FROM b)"""


@query(f"""
WITH {ELLIPSIS_SQL}
SELECT mention, st AS status, ts AS to_section, tb AS to_subsection, CASE WHEN st IN ('resolved', 'not_elliptical') THEN ref_item END AS to_item,
  CASE WHEN st = 'resolved' THEN CASE WHEN ref_subsection IS NULL OR ref_item IS NOT NULL OR coalesce(list_contains(subsections, ref_subsection), false) THEN 'exact' ELSE 'approximate' END WHEN st = 'not_elliptical' AND ref_section IS NOT NULL THEN 'exact' END AS confidence, CASE WHEN st = 'ambiguous' THEN carriers END AS candidates FROM f
UNION ALL SELECT mention, st, CASE WHEN st = 'resolved' THEN ts END, CASE WHEN st = 'resolved' THEN CASE WHEN anaphor = 'subsection' THEN tb ELSE ref_subsection END END, CASE WHEN st = 'resolved' THEN ref_item END, CASE WHEN st = 'resolved' THEN 'anaphoric' END, NULL FROM c""")
def elliptical_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that leave out their section or subsection, and chains of "the said …" across sections."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = t(spark, sf_dir, "events").withColumn("k", k)
    kind = lambda name: F.col("event_type") == name
    text = lambda c: c.cast("string")
    number = F.col("k")
    nodes = e.select(F.col("user_id").alias("doc"), text(number % 7).alias("section"), (number % 4 + 1).alias("subsection"), F.when(number % 5 == 0, "1").alias("item"))
    mentions = e.select(
        F.col("user_id").alias("doc"), F.floor(F.col("event_id") / 2).alias("pos"), F.col("event_id").alias("mention"), F.when(number % 11 != 0, text(F.rint("value").cast("int") % 7)).alias("section"), F.when(kind("click"), text(number % 9)).alias("ref_section"),
        F.when(kind("view") | (kind("click") & (number % 2 == 0)), number % 6 + 1).alias("ref_subsection"), F.when(kind("error"), text(number % 3)).alias("ref_item"), F.when(kind("purchase"), F.when(number % 2 == 0, "section").otherwise("subsection")).alias("anaphor"))
    return X.resolve_elliptical(mentions, X.section_structure(nodes)).select("mention", "status", "to_section", "to_subsection", "to_item", "confidence", "candidates")


# ---------------------------------------------------------------- reference sets


@query("""
WITH w AS (SELECT o_orderkey AS id, o_orderkey % 40 + 1 AS a, o_custkey % 7 AS b, o_custkey % 60 + 1 AS c FROM orders)
SELECT id, true AS known, list_sort(list_distinct(list_concat(list_transform(range(a, a + b + 1), lambda x: x::VARCHAR), [c::VARCHAR || 'a', (c + 2)::VARCHAR]))) AS labels, CASE WHEN b = 0 THEN 'coordination' ELSE 'mixed' END AS kind FROM w""")
def reference_set_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels that written lists and ranges denote."""
    o = t(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    a, b, c = F.col("o_orderkey") % 40 + 1, F.col("o_custkey") % 7, F.col("o_custkey") % 60 + 1
    written = F.concat(text(a), F.when(b > 0, F.concat(F.lit("–"), text(a + b))).otherwise(""), F.lit(", "), text(c), F.lit(" a and "), text(c + 2))
    s = o.select(F.col("o_orderkey").alias("id"), X.label_set(written).alias("s"))
    return s.select("id", (F.size("s.rejected") == 0).alias("known"), F.array_sort("s.labels").alias("labels"), "s.kind")


@query("""
WITH d AS (SELECT DISTINCT o_custkey AS id, o_orderkey % 30 AS n FROM orders), i AS (SELECT *, n - row_number() OVER (PARTITION BY id ORDER BY n) AS g FROM d),
r AS (SELECT id, min(n) AS a, max(n) AS b, count(*) AS len FROM i GROUP BY id, g), p AS (SELECT id, a AS n, a || '-' || b AS t FROM r WHERE len >= 3 UNION ALL SELECT id, i.n, i.n::VARCHAR FROM i JOIN r USING (id) WHERE i.n BETWEEN r.a AND r.b AND len < 3),
l AS (SELECT id, list(t ORDER BY n) AS ts FROM p GROUP BY 1)
SELECT id, CASE WHEN len(ts) = 1 THEN ts[1] ELSE array_to_string(ts[1:-2], ', ') || ' and ' || ts[-1] END AS written FROM l""")
def reference_set_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of labels in the shortest way of writing them."""
    sets = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set((F.col("o_orderkey") % 30).cast("string")).alias("labels"))
    return sets.select("id", X.written_labels("labels").alias("written"))


@query("""
WITH m AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber <> 3 THEN 's:' || l_linenumber END AS target, CASE WHEN l_linenumber = 3 THEN 'open' WHEN l_discount > 0.09 THEN 'ambiguous' ELSE 'exact' END AS confidence FROM lineitem),
g AS (SELECT id, list_sort(list(DISTINCT target) FILTER (WHERE target IS NOT NULL)) AS targets, count(*) AS n, bool_or(confidence = 'ambiguous') AS unclear, bool_and(confidence = 'open') AS vague, bool_or(target IS NULL) AS partly FROM m GROUP BY 1)
SELECT id, coalesce(targets, []) AS targets, CASE WHEN unclear THEN 'candidate_ambiguity' WHEN len(targets) = 1 AND n = 1 THEN 'single' WHEN len(targets) > 0 THEN 'all_valid' WHEN vague THEN 'open' ELSE 'no_enumerable_extension' END AS semantics,
  CASE WHEN unclear OR coalesce(len(targets), 0) = 0 THEN 'unresolved' WHEN partly OR len(targets) < n THEN 'partial' ELSE 'resolved' END AS reference_status FROM g""")
def reference_set_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat mentions folded back into sets, with what the set means."""
    n = F.col("l_linenumber")
    mentions = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(n != 3, F.concat(F.lit("s:"), n)).alias("target"), F.when(n == 3, "open").when(F.col("l_discount") > 0.09, "ambiguous").otherwise("exact").alias("confidence"), F.lit("1, 2").alias("surface"))
    return X.reference_sets(mentions, ["id"]).select("id", "targets", "semantics", "reference_status")


# ---------------------------------------------------------------- definitions


TERM_SQL = """
k AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
d AS (SELECT user_id AS doc, event_id AS definition, 't' || (k % 4) AS term, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'c:' || (k % 5) ELSE 'c:' || (k % 5) || '/s:' || (k % 7) END AS scope, 'c:' || (k % 5) || '/s:' || (k % 7) AS addr, event_id AS pos FROM k WHERE event_type IN ('click', 'view')),
u AS (SELECT user_id AS doc, event_id AS use, 't' || (value::INT % 4) AS term, 'c:' || (k % 5) || '/s:' || (k % 7) AS addr, event_id AS pos FROM k WHERE event_type IN ('purchase', 'error')),
q AS (SELECT u.doc, u.use, d.scope, d.definition, CASE WHEN d.scope = '' THEN 0 ELSE len(string_split(d.scope, '/')) END AS depth FROM u JOIN d ON d.doc = u.doc AND d.term = u.term AND d.pos <= u.pos AND (d.scope = '' OR d.scope = u.addr OR starts_with(u.addr, d.scope || '/'))),
b AS (SELECT doc, use, max(depth) AS depth, count(*) AS n FROM q GROUP BY 1, 2),
i AS (SELECT b.doc, b.use, any_value(q.scope) AS scope, count(*) AS here, min(q.definition) AS definition, any_value(b.n) AS n FROM b JOIN q ON q.doc = b.doc AND q.use = b.use AND q.depth = b.depth GROUP BY 1, 2),
r AS (SELECT u.*, i.scope, CASE WHEN here = 1 THEN definition END AS definition, CASE WHEN here IS NULL THEN 'open' WHEN here > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, coalesce(n - here, 0) AS shadowed FROM u LEFT JOIN i ON i.doc = u.doc AND i.use = u.use)"""


def event_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(uses, definitions): events of users as uses and definitions of four terms in nested scopes."""
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k: Column = F.col("k")
    chapter, section = F.concat(F.lit("c:"), (k % 5).cast("string")), F.concat(F.lit("s:"), (k % 7).cast("string"))
    inner = F.concat_ws("/", chapter, section)
    scope = F.when(k % 3 == 0, "").when(k % 3 == 1, chapter).otherwise(inner)
    definitions = e.filter(F.col("event_type").isin("click", "view")).select(F.col("user_id").alias("doc"), F.col("event_id").alias("definition"), F.concat(F.lit("T"), (k % 4).cast("string")).alias("term"), scope.alias("scope"), inner.alias("addr"), F.col("event_id").alias("pos"))
    uses = e.filter(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("doc"), F.col("event_id").alias("use"), F.concat(F.lit("t"), (F.rint("value").cast("int") % 4).cast("string")).alias("term"), inner.alias("addr"), F.col("event_id").alias("pos"))
    return uses, definitions


@query(f"WITH {TERM_SQL} SELECT doc, use, definition, scope, status, shadowed FROM r")
def term_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition that binds each use: that of the innermost scope around it."""
    return X.resolve_terms(*event_terms(spark, sf_dir)).select("doc", "use", "definition", "scope", "status", "shadowed")


@query(f"WITH {TERM_SQL} SELECT DISTINCT r.doc, d.definition AS src, r.definition AS dst FROM r JOIN d ON d.doc = r.doc AND d.addr = r.addr WHERE status = 'resolved' AND d.definition <> r.definition")
def definition_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that rest on other definitions."""
    uses, definitions = event_terms(spark, sf_dir)
    return X.definition_edges(X.resolve_terms(uses, definitions), definitions)


@query(f"""
WITH {TERM_SQL}
SELECT r.doc, CASE WHEN bool_or(d.doc IS NOT NULL) THEN 'used_before_definition' ELSE 'unbound_term' END AS lint, r.use::VARCHAR AS subject, any_value(r.term) AS term FROM r LEFT JOIN d ON d.doc = r.doc AND d.term = r.term AND (d.scope = '' OR d.scope = r.addr OR starts_with(r.addr, d.scope || '/')) WHERE status = 'open' GROUP BY r.doc, r.use
UNION ALL SELECT doc, 'ambiguous_term_use', use::VARCHAR, term FROM r WHERE status = 'ambiguous'
UNION ALL SELECT doc, 'definition_never_used', definition::VARCHAR, term FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = d.doc AND r.definition = d.definition)
UNION ALL SELECT doc, 'duplicate_definition', scope, term FROM d GROUP BY doc, scope, term HAVING count(*) > 1""")
def definition_lints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses without definition, definitions without use, and terms defined twice."""
    uses, definitions = event_terms(spark, sf_dir)
    return X.definition_lints(X.resolve_terms(uses, definitions), definitions)

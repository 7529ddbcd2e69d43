"""Text selectors, range renumbering, effects, preparatory references and the clauses of the evidence policy on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import frames as X
from palimpsest.functions import preparatory as P
from palimpsest.operators import evidence as E
from palimpsest.operators import selectors as S
from palimpsest.operators.graph import reachable
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t

# ---------------------------------------------------------------- text selectors

SELECT_SQL = """
o AS (SELECT o_orderkey AS id, o_custkey % 3 AS a, o_orderkey % 3 AS b, o_orderkey % 5 AS how, 'Pay ' || (o_custkey % 3) || ' euros. Pay ' || (o_orderkey % 3) || ' euros today.' AS text FROM orders),
r AS (SELECT *, CASE how WHEN 0 THEN CASE WHEN a = b THEN 'ambiguous' ELSE 'unique' END WHEN 1 THEN CASE WHEN a = b THEN 'unique' ELSE 'context_not_found' END WHEN 2 THEN 'nth' WHEN 3 THEN CASE WHEN a = b THEN 'nth' ELSE 'no_such_place' END ELSE 'all' END AS reason FROM o),
s AS (SELECT *, CASE WHEN reason = 'unique' AND how = 1 OR how = 3 THEN 17 ELSE 4 END AS start FROM r)"""


def payments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, edits): each order names two amounts, and an edit of the first by its words alone, by what follows, by its number, or everywhere."""
    a, b, how = (c.cast("string") for c in (F.col("o_custkey") % 3, F.col("o_orderkey") % 3, F.col("o_orderkey") % 5))
    o = t(spark, sf_dir, "orders")
    texts = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Pay "), a, F.lit(" euros. Pay "), b, F.lit(" euros today.")).alias("text"))
    nth = F.when(how == "2", 1).when(how == "3", 2).when(how == "4", 0)
    edits = o.select(F.col("o_orderkey").alias("id"), F.lit("substitute").alias("action"), F.concat(a, F.lit(" euros")).alias("quote"), F.lit("Pay").alias("before"), F.when(how == "1", "today").alias("after"), nth.alias("nth"), F.lit("nothing").alias("payload"))
    return texts, edits


@query(f"WITH {SELECT_SQL} SELECT id, CASE WHEN reason IN ('unique', 'nth', 'all') THEN 'applied' ELSE 'refused' END AS outcome, reason, CASE WHEN reason IN ('unique', 'nth') THEN start END AS start FROM s")
def text_selector_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where edits of a quoted span land, or why their place is not proven."""
    return S.select_and_patch(*payments(spark, sf_dir), ["id"])[1].select("id", "outcome", "reason", "start")


@query(f"""
WITH {SELECT_SQL}
SELECT id, CASE WHEN reason = 'all' THEN replace(text, a || ' euros', 'nothing') WHEN reason IN ('unique', 'nth') THEN substr(text, 1, start) || 'nothing' || substr(text, start + 8) ELSE text END AS text FROM s""")
def text_selector_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts after those edits."""
    return S.select_and_patch(*payments(spark, sf_dir), ["id"])[0]


def range_renumberings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order renumbers a range of sections by up to four; those of one status name one destination too few."""
    low, n, by = F.col("o_custkey") % 30 + 5, F.col("o_orderkey") % 6, F.col("o_custkey") % 9 - 4
    text = lambda c: c.cast("string")
    written = lambda a, b: F.when(a == b, text(a)).otherwise(F.concat(text(a), F.lit("–"), text(b)))
    end = low + n + by - F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return t(spark, sf_dir, "orders").select(F.lit(1).cast("long").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.lit("").alias("parent"), F.lit("section").alias("level"), written(low, low + n).alias("labels"), F.when(end < low + by, "none").otherwise(written(low + by, end)).alias("new_labels"))


@query("""
WITH r AS (SELECT o_orderkey AS id, o_custkey % 30 + 5 AS low, o_orderkey % 6 AS n, o_custkey % 9 - 4 AS shift, o_orderstatus = 'P' AS short FROM orders)
SELECT id * 10000 + CASE WHEN shift > 0 THEN n - i ELSE i END AS seq, 'section:' || (low + i) AS target, 'section:' || (low + i + shift) AS destination FROM r, unnest(range(0, n + 1)) AS u(i) WHERE NOT short AND shift <> 0""")
def range_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renumberings of ranges, label by label, in an order that leaves each place before it is taken."""
    return S.expand_renumbering(range_renumberings(spark, sf_dir))[0].select("seq", "target", "destination")


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 6 = 0 THEN 'labels_unreadable' ELSE 'lengths_differ' END AS refusal FROM orders WHERE o_orderstatus = 'P'")
def range_renumbering_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renumberings that are no one-to-one mapping."""
    return S.expand_renumbering(range_renumberings(spark, sf_dir))[1].select("seq", "refusal")


# ---------------------------------------------------------------- effects and preparatory works


@query("""
SELECT user_id || ':' || (event_id + 1) AS event_id, CASE event_type WHEN 'click' THEN 'commence' WHEN 'view' THEN 'expire' WHEN 'error' THEN 'suspend' WHEN 'purchase' THEN 'revive' ELSE 'unsupported' END AS kind,
  CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 2 = 0 THEN '' ELSE '2023-12-24' END WHEN event_type = 'purchase' AND value > 50 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS effective,
  CASE WHEN value <= 50 THEN '' WHEN event_type = 'view' THEN strftime(ts::DATE + 1, '%Y-%m-%d') WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS expires, CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'fixed_date' WHEN event_id % 2 = 0 THEN 'pending_decree' ELSE 'immediate' END END AS activation FROM events""")
def effect_lowering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect intents as temporal events, one for each."""
    kind = F.when(F.col("event_type") == "click", "commencement").when(F.col("event_type") == "view", "expiry").when(F.col("event_type") == "error", "suspension").when(F.col("event_type") == "purchase", "revival").otherwise("other")
    intents = t(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("group_id"), F.col("event_id").alias("nth"), kind.alias("kind"), F.when(F.col("value") > 50, F.date_format("ts", "yyyy-MM-dd")).alias("day"), (F.col("event_id") % 2 == 0).alias("contingent"), F.lit("").alias("raw_text"), F.lit("2023-12-24").alias("source_issued"), F.lit("").alias("source_effective"), F.lit("1/2000").alias("statute"))
    return S.lower_effects(intents).select("event_id", "kind", "effective", "expires", "activation")


PREPARATORY_SQL = "o AS (SELECT o_orderkey AS id, o_orderkey % 300 + 1 AS n, 2000 + o_custkey % 20 AS y, o_orderkey % 12 + 1 AS m, o_orderstatus AS s, o_orderkey % 2 = 0 AS even FROM orders)"


def works_text() -> Column:
    """An order as a block of preparatory works."""
    text = lambda c: c.cast("string")
    n, y, m = text(F.col("o_orderkey") % 300 + 1), text(2000 + F.col("o_custkey") % 20), text(F.col("o_orderkey") % 12 + 1)
    committee = F.when(F.col("o_orderstatus") == "F", "HaVM").when(F.col("o_orderstatus") == "O", "PeVL").otherwise("EV")
    act = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("direktiivi (EY) N:o "), n, F.lit("/"), y)).otherwise(F.concat(F.lit("("), F.lit("EY) "), n, F.lit("/"), y))
    return F.concat(F.lit("HE "), n, F.lit("/"), y, F.lit(" vp, "), committee, F.lit(" "), m, F.lit("/"), y, F.lit(" vp, "), act, F.lit("; EUVL L "), n, F.lit(", "), m, F.lit("."), m, F.lit("."), y, F.lit(", s. "), m, F.lit(", muistio "), m)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): each order as a block of preparatory works."""
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), works_text().alias("text"))


@query(f"""
WITH {PREPARATORY_SQL}
SELECT id, 0 AS nth, 'he' AS kind, 'HE ' || n || '/' || y AS canonical_id, NULL AS oj_date, 'exact' AS confidence FROM o
UNION ALL SELECT id, 1, CASE s WHEN 'F' THEN 'committee_report' WHEN 'O' THEN 'committee_opinion' ELSE 'parliament_response' END, CASE s WHEN 'F' THEN 'HaVM ' WHEN 'O' THEN 'PeVL ' ELSE 'EV ' END || m || '/' || y, NULL, 'exact' FROM o
UNION ALL SELECT id, 2, CASE WHEN even THEN 'eu_directive' ELSE 'eu_regulation' END, CASE WHEN even THEN '3' || y || 'L' || lpad(n::VARCHAR, 4, '0') ELSE 'EU ' || y || '/' || n END, NULL, CASE WHEN even THEN 'exact' ELSE 'approximate' END FROM o
UNION ALL SELECT id, 3, 'oj_reference', 'EUVL L ' || n, y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(m::VARCHAR, 2, '0'), 'exact' FROM o""")
def preparatory_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed references to preparatory works."""
    return P.preparatory_references(works(spark, sf_dir), "id", "text")[0].select("id", "nth", "kind", "canonical_id", "oj_date", "confidence")


@query(f"WITH {PREPARATORY_SQL} SELECT id, 'muistio ' || m AS candidate FROM o")
def preparatory_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands among them and is none."""
    return P.preparatory_references(works(spark, sf_dir), "id", "text")[1]


# ---------------------------------------------------------------- evidence clauses


def attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k: Column = F.get_json_object("props", "$.k").cast("int")
    return t(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.when((F.col("event_type") == "error") & (k % 4 == 0), "retracted").otherwise(F.col("event_type")).alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.concat(F.lit("key"), (k % 9).cast("string")).alias("signer"), F.when(k % 2 == 0, "lab").otherwise("field").alias("place"),
        F.when(k % 3 == 0, F.concat(F.lit("m"), (k % 6).cast("string"))).alias("material"), F.when(k % 3 != 0, F.concat(F.lit("m"), (k % 6 - k % 3).cast("string"))).alias("dependency"), k.alias("k"))


@query("""
WITH RECURSIVE a AS (SELECT user_id AS subject, CASE WHEN event_type = 'error' AND CAST(json_extract(props, '$.k') AS INT) % 4 = 0 THEN 'retracted' ELSE event_type END AS kind, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
r AS (SELECT 1::BIGINT AS subject UNION SELECT a.k::BIGINT FROM r JOIN a ON a.subject = r.subject WHERE a.kind = 'click')
SELECT subject, NOT bool_or(kind <> 'view') AS only_views, coalesce(bool_or(kind = 'click' AND k % 9 = 3), false) AS signed, NOT bool_or(kind = 'retracted') AS standing, NOT coalesce(bool_or(kind = 'retracted' AND k % 2 <> 0), false) AS standing_in_field,
  count(DISTINCT CASE WHEN kind = 'click' THEN (k % 9)::VARCHAR || (k % 2)::VARCHAR END) >= 2 AS independent, len(list_filter(list_distinct(list('m' || (k % 6)) FILTER (WHERE k % 3 = 0)), lambda m: NOT coalesce(list_contains(list('m' || (k % 6 - k % 3)) FILTER (WHERE k % 3 <> 0), m), false))) IS NOT DISTINCT FROM 0 OR count(*) FILTER (WHERE k % 3 = 0) = 0 AS materials,
  subject IN (SELECT subject FROM r) AS reached FROM a GROUP BY subject""")
def evidence_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses that the policy of four leaves out: all, signed_by, not_retracted with and without condition, independent, materials, reachable."""
    att = attestations(spark, sf_dir)
    edges = att.filter("kind = 'click'").select(F.col("subject").alias("src"), F.col("k").cast("long").alias("dst"))
    reached = reachable(edges, spark.range(1, 2).select(F.col("id").alias("node"))).select(F.col("node").alias("subject"))
    clauses = {
        "only_views": {"op": "all", "where": {"kind": "view"}}, "signed": {"op": "signed_by", "key": "key3", "where": {"kind": "click"}}, "standing": {"op": "not_retracted"}, "standing_in_field": {"op": "not_retracted", "where": {"place": "field"}},
        "independent": {"op": "independent", "where": {"kind": "click"}, "dimensions": ["signer", "place"], "n": 2}, "materials": {"op": "materials_match_dependencies"}, "reached": {"op": "reachable"},
    }
    return E.authorize(att, clauses, {"reached": reached}).drop("authorized")


# ---------------------------------------------------------------- frames


FRAMES_SQL = "o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS a, o_custkey % 3 AS b, o_orderkey % 28 + 1 AS d, strftime(o_orderdate, '%Y') AS y, o_orderpriority = '1-URGENT' AS u FROM orders)"


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): each order as a provision of four sentences, one for each kind of frame."""
    a, b = F.col("o_orderkey") % 3, F.col("o_custkey") % 3
    day = F.concat((F.col("o_orderkey") % 28 + 1).cast("string"), F.lit(" päivänä maaliskuuta "), F.date_format("o_orderdate", "yyyy"))
    grant = F.when(a == 0, "Valtioneuvoston asetuksella voidaan säätää maksuista.").when(a == 1, "Virasto antaa määräyksiä lomakkeista.").otherwise("Ohjeita annetaan tarvittaessa.")
    breach = F.when(b == 0, "Joka rikkoo lakia, tuomitaan sakkoon.").when(b == 1, "Sille määrätään seuraamusmaksu enintään 500 euroa.").otherwise("Hallitus peruuttaa kokouksen.")
    but = F.when(F.col("o_orderpriority") == "1-URGENT", "Maksu on kiinteä, jollei toisin sovita.").otherwise("Maksu on kiinteä.")
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", grant, breach, but, F.concat(F.lit("Tämä laki tulee voimaan "), day, F.lit("."))).alias("text"))


@query(f"""
WITH {FRAMES_SQL}
SELECT id, 0 AS sentence, 'delegation' AS frame, CASE a WHEN 0 THEN 'asetus' ELSE 'määräys' END AS kind, CASE a WHEN 0 THEN 'valtioneuvosto' ELSE 'virasto' END AS value, CASE a WHEN 0 THEN 'may' ELSE 'must' END AS detail FROM o WHERE a < 2
UNION ALL SELECT id, 1, 'sanction', CASE b WHEN 0 THEN 'rangaistus' ELSE 'seuraamusmaksu' END, CASE b WHEN 1 THEN '500 euroa' END, CASE b WHEN 0 THEN 'joka' END FROM o WHERE b < 2
UNION ALL SELECT id, 2, 'exception', 'jollei', NULL, 'toisin sovita' FROM o WHERE u UNION ALL SELECT id, 3, 'temporal', 'fixed_date', y || '-03-' || lpad(d::VARCHAR, 2, '0'), NULL FROM o""")
def statutory_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delegations, sanctions, exceptions and times that provisions state."""
    return X.frames(provisions(spark, sf_dir), "id", "text")[0]


@query(f"WITH {FRAMES_SQL} SELECT id, 'delegation' AS frame, 'no_issuer' AS reason FROM o WHERE a = 2 UNION ALL SELECT id, 'sanction', 'revocation_without_permit' FROM o WHERE b = 2")
def statutory_frames_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with the trigger of a frame and not what it needs."""
    return X.frames(provisions(spark, sf_dir), "id", "text")[1].select("id", "frame", "reason")

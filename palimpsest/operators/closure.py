"""Dependency graphs of acts: typed and dated edges, closures to a frontier of unknown acts, layers, and cycles.

Edges are dealt once; each round of a loop is one join with them and one table in the shared folder. Counts come to the driver, and frontiers that are
small enough to be sent to the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.clauses import clause_ops, ordered_statutes, parse_clauses
from palimpsest.functions.preparatory import named_works, preparatory_references
from palimpsest.operators.graph import FRONTIER_ROWS, DealtEdges, Layers, cut_lineage, of_one_type

# The relations that amend.
RELATIONS = ("amends", "corrects")


def amendment_edges(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected) of rows (amending, base, relation, in_force, applies).

    Edges are typed, directed (amending to base) and dated: ``ordering_date`` is the day of application, else that of entry into
    force, else '' (no date is made up); equal ones are one. Rejected rows keep their columns and say why: missing_id, self_loop,
    unknown_relation. Whatever comes in goes out on one side."""
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    reason = F.when(~has("amending") | ~has("base"), "missing_id").when(F.trim("amending") == F.trim("base"), "self_loop").when(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)), "unknown_relation")
    judged = found.withColumn("reason", reason)
    date = F.when(has("applies"), F.trim("applies")).when(has("in_force"), F.trim("in_force")).otherwise("")
    edges = judged.filter("reason is null").select(F.trim("amending").alias("amending"), F.trim("base").alias("base"), "relation", date.alias("ordering_date")).distinct()
    return edges, judged.filter("reason is not null")


def acquisition_closure(edges: DataFrame, roots: DataFrame, known: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, layer, state): what ``roots`` (node) need over ``edges`` (src needs dst), each at its least number of steps.

    Only known nodes are expanded, as the needs of the others cannot be read: they are the frontier, what is to be acquired
    next. With ``depth`` known nodes at the last layer are 'unexpanded'. Cycles do no harm."""
    have = known.filter("node is not null").select("node").distinct()
    # only known nodes are expanded, so that the needs of others are not kept
    steps = edges.filter("src is not null and dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("next"))
    first, steps = of_one_type(roots.filter("node is not null").select("node"), steps)
    dealt = DealtEdges(steps.join(have.hint("merge"), "node", "left_semi"), "node", edges.count())
    layers, layer = Layers(edges.sparkSession), 0
    now = layers.add(first.distinct(), 0)
    while (depth is None or layer < depth) and (n := now.count()):
        layer += 1
        reached = dealt.of(now, n).select(F.col("next").alias("node")).distinct()
        now = layers.add(reached.join(layers.all().select("node").hint("merge"), "node", "left_anti"), layer)
    dealt.drop()
    expanded = F.when((F.col("layer") < depth) if depth is not None else F.lit(True), "expanded").otherwise("unexpanded")
    return layers.all().join(have.withColumn("__known", F.lit(True)).hint("merge"), "node", "left").select("node", "layer", F.when(F.col("__known").isNotNull(), expanded).otherwise("frontier").alias("state"))


def dependency_layers(edges: DataFrame) -> DataFrame:
    """(node, layer, state): every node of ``edges`` (src before dst) with the length of the longest path to it.

    Nodes leave once all before them have. Those that never do have no layer: 'cycle' if they lie on a cycle or between two, and
    'behind_cycle' if they only come after one. There are as many rounds as layers; an edge knows how many its target waits for, so that a round
    touches the nodes at hand and those that some but not all before them have left."""
    spark = edges.sparkSession
    known = edges.filter("src is not null and dst is not null")
    _, typed = of_one_type(known.select(F.col("src").alias("node")), known.select(F.col("src").alias("node"), F.col("dst").alias("next")))
    pairs = typed.select(F.col("node").alias("src"), F.col("next").alias("dst")).repartition("dst").distinct()
    dealt = DealtEdges(pairs.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("dst"))), "src", edges.count())
    sources = dealt.rows.select(F.col("src").alias("node")).distinct()
    targets = dealt.rows.select(F.col("dst").alias("node")).distinct()
    layers, layer = Layers(spark), 0
    pending = Layers(spark)
    leaving = layers.add(sources.join(targets.hint("merge"), "node", "left_anti"), 0)
    waiting = None
    while n := leaving.count():
        layer += 1
        arrived = dealt.of(leaving.select(F.col("node").alias("src")), n).select(F.col("dst").alias("node"), "need", F.lit(1).cast("long").alias("come"))
        arrived = arrived if waiting is None else arrived.unionByName(waiting)
        waiting = pending.add(arrived.groupBy("node").agg(F.max("need").alias("need"), F.sum("come").alias("come")), layer)
        leaving = layers.add(waiting.filter("come = need").select("node"), layer)
        waiting = waiting.filter("come < need")
    placed = layers.all().select("node", "layer", F.lit("layered").alias("state"))
    nodes = sources.union(targets).distinct()
    left = cut_lineage(nodes.join(placed.select("node").hint("merge"), "node", "left_anti"))
    rest, n = left, left.count()
    while n:  # what leads to none of the rest is not on a cycle
        inner = dealt.rows.join(rest.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        kept = cut_lineage(rest.join(inner.hint("merge"), "node", "left_semi"))
        rest, n, before = kept, kept.count(), n
        if n == before:
            break
    dealt.drop()
    pending.drop()
    stuck = left.join(rest.withColumn("on", F.lit(True)).hint("merge"), "node", "left").select("node", F.lit(None).cast("int").alias("layer"), F.when(F.col("on").isNotNull(), "cycle").otherwise("behind_cycle").alias("state"))
    return placed.unionByName(stuck)


def text_edges(texts: DataFrame, key: str, clause: str, preparatory: str, acts: DataFrame, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, failures) of acts as their own texts tell them: the statutes that a clause amends (amends, repeals for clauses that only repeal), the works that
    prepared the act (prepared_by, and implements for EU directives), and other acts that the clause cites as number/year (cites).

    Edges (key, relation, target, n, resolved): ``resolved`` says whether ``acts`` (column act) has the target; EU acts and proposals are outside of it and
    stay null. Failures (key, stage, detail): words that no rule of the clause grammar takes, and what stands among preparatory works and is none.
    Edges come out of one pass over the texts, and are counted by key: nothing is dealt where the texts lie by key. With ``both`` the parsed clauses are
    checkpointed, for callers that read edges and failures; otherwise each side reads for itself what it needs, edges only the clauses that may cite."""
    parsed = cut_lineage(parse_clauses(texts, key, clause, ("ops", "leftovers"))) if both else None
    none = lambda kind: F.lit(None).cast(kind)
    edge = lambda relation, target, ops, only: F.struct(relation.alias("relation"), target.alias("target"), ops.alias("ops"), only.alias("only"))
    order, block = F.coalesce(clause, F.lit("")), F.coalesce(preparatory, F.lit(""))
    # of the domestic ones the relation is open until a statute's ops and citations have met
    numbers = F.when(F.contains(order, F.lit("/")), F.regexp_extract_all(order, F.lit(r"\b(\d{1,4}/\d{4})\b"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    cited = F.transform(numbers, lambda t: edge(none("string"), t, none("long"), none("boolean")))
    relation = lambda kind: F.when(kind == "eu_directive", "implements").when(kind.isin("eu_regulation", "eu_decision", "oj_reference"), "cites").otherwise("prepared_by")
    prepared = F.transform(named_works(block), lambda w: edge(relation(w["kind"]), w["canonical_id"], none("long"), none("boolean")))
    ordered = [] if both else [F.transform(ordered_statutes(texts.sparkSession, order), lambda s: edge(none("string"), s["statute"], s["ops"], s["only_repeals"]))]
    told = texts.select(key, F.explode(F.concat(*ordered, cited, prepared)).alias("e")).select(key, "e.*")
    if parsed is not None:
        told = told.unionByName(clause_ops(parsed, key).filter("statute is not null").select(key, edge(none("string"), F.col("statute"), F.lit(1).cast("long"), F.col("action") == "REPEAL").alias("e")).select(key, "e.*"))
    counted = told.groupBy(key, "relation", "target").agg(F.coalesce(F.sum("ops"), F.count(F.lit(1))).alias("n"), F.min("only").alias("only"))
    known = acts.filter("act is not null").select(F.col("act").alias("target")).distinct().withColumn("known", F.lit(True))
    near = F.broadcast(known) if known.count() <= FRONTIER_ROWS else known
    domestic = F.col("relation").isNull()
    edges = counted.join(near, "target", "left").select(
        key, F.when(~domestic, F.col("relation")).when(F.col("only"), "repeals").when(~F.col("only"), "amends").otherwise("cites").alias("relation"), "target", "n", F.when(domestic, F.coalesce("known", F.lit(False))).alias("resolved"))
    left = parsed if parsed is not None else parse_clauses(texts, key, clause, ("leftovers",))
    words = left.filter("leftover is not null").select(key, F.lit("clause").alias("stage"), F.concat_ws(": ", "reason", "leftover").alias("detail"))
    rejected = preparatory_references(texts, key, preparatory)[1]
    return edges, words.unionByName(rejected.select(key, F.lit("preparatory").alias("stage"), F.col("candidate").alias("detail")))

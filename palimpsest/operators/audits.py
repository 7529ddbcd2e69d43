"""Audit sweeps: each is a count, an anti join or a grouping that returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unclassified(rows: DataFrame, key: str, label: str, closed: Sequence[str]) -> DataFrame:
    """Rows whose label is missing or outside the closed set."""
    return rows.filter(F.col(label).isNull() | ~F.col(label).isin(*closed)).select(key, label)


def in_no_table(rows: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Keys of rows that none of the tables has."""
    out = rows.select(key).distinct()
    for table in tables:
        out = out.join(table.select(key), key, "left_anti")
    return out


def in_several_buckets(rows: DataFrame, key: str, bucket: str) -> DataFrame:
    """(key, n) of keys in more than one bucket."""
    return rows.groupBy(key).agg(F.count_distinct(bucket).alias("n")).filter("n > 1")


def leaks(rows: DataFrame, key: str, value: str, pattern: str) -> DataFrame:
    """Rows whose stored value matches a pattern that it must not."""
    return rows.filter(F.col(value).rlike(pattern)).select(key, value)


def source_conflicts(observations: DataFrame, locator: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(conflicts, uncheckable): locators with more than one digest; observations without a digest, set aside."""
    checkable = observations.filter(F.col(digest).isNotNull())
    return in_several_buckets(checkable, locator, digest), observations.filter(F.col(digest).isNull())


def lost_between(stages: DataFrame, key: str, stage: str, order: Sequence[str]) -> DataFrame:
    """(key, stage): residuals of a stage that the next stage no longer has."""
    out = None
    for a, b in zip(order, order[1:], strict=False):
        gone = stages.filter(F.col(stage) == a).join(stages.filter(F.col(stage) == b).select(key), key, "left_anti").select(key, stage)
        out = gone if out is None else out.unionByName(gone)
    return out


def not_rederivable(rows: DataFrame, key: str, columns: Sequence[str], committed: str) -> DataFrame:
    """Rows whose committed hash is not the hash of their values."""
    derived = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    return rows.filter(~derived.eqNullSafe(F.col(committed))).select(key)


def duplicates(rows: DataFrame, keys: Sequence[str], normal: Column | None = None) -> DataFrame:
    """(keys, n) of groups with more than one row; with ``normal``, of labels that become equal by it."""
    named = rows if normal is None else rows.withColumn("normal", normal)
    by = [*keys, *(["normal"] if normal is not None else [])]
    return named.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def promotion_breaks(links: DataFrame, chain: str, step: str, rank: str) -> DataFrame:
    """Links of a chain that are missing (a hole in the steps) or whose rank falls."""
    from pyspark.sql import Window

    w = Window.partitionBy(chain).orderBy(step)
    seen = links.withColumn("p_step", F.lag(step).over(w)).withColumn("p_rank", F.lag(rank).over(w))
    problem = F.when(F.col("p_step").isNotNull() & (F.col(step) != F.col("p_step") + 1), "missing_link").when(F.col(rank) < F.col("p_rank"), "non_monotone")
    return seen.withColumn("problem", problem).filter("problem is not null").select(chain, step, "problem")


def detection_recall(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: gold, hits, extra, recall."""
    g, f = gold.select(key).distinct().withColumn("g", F.lit(1)), found.select(key).distinct().withColumn("f", F.lit(1))
    both = g.join(f, key, "full")
    counted = both.agg(F.count("g").alias("gold"), F.count(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1)).alias("hits"), F.count(F.when(F.col("g").isNull(), 1)).alias("extra"))
    return counted.withColumn("recall", F.when(F.col("gold") > 0, F.round(F.col("hits") / F.col("gold"), 6)))


def timeline_breaks(findings: DataFrame, unsafe: Sequence[str], day: str) -> DataFrame:
    """(addr, n) of findings that make an answer at a date unsafe."""
    return findings.filter(F.col("rule").isin(*unsafe) & (F.col("since") <= day)).groupBy("addr").agg(F.count(F.lit(1)).alias("n"))


def graph_census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(census, kind, n) of nodes (node, kind) and edges (src, relation, dst): nodes and isolated nodes by kind, edges by relation, edges that lead from or to no
    known node, repeated edges, and nodes by how many edges they have (0, 1, 2, 3 to 9, 10 and more)."""
    known = nodes.select("node", "kind").dropDuplicates(["node"])
    count = F.count(F.lit(1)).alias("n")
    row = lambda df, census, kind: df.groupBy(kind.alias("kind")).agg(count).select(F.lit(census).alias("census"), "kind", "n")
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    degrees = known.join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    bucket = F.when(F.col("degree") < 3, F.col("degree").cast("string")).when(F.col("degree") < 10, "3-9").otherwise("10+")
    missing = lambda end: edges.join(known.select(F.col("node").alias(end)), end, "left_anti")
    repeated = edges.groupBy("src", "relation", "dst").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return (
        row(known, "nodes", F.col("kind")).unionByName(row(degrees.filter("degree = 0"), "isolated", F.col("kind"))).unionByName(row(edges, "edges", F.col("relation"))).unionByName(row(missing("src"), "unknown_source", F.col("relation")))
        .unionByName(row(missing("dst"), "unknown_target", F.col("relation"))).unionByName(row(repeated, "repeated", F.col("relation"))).unionByName(row(degrees, "degree", bucket))
    )


def reconcile(replayed: DataFrame, oracle: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, statutes): what two sides (statute, selector, text) say of each selector, agree, differs, only_replay or only_oracle (null text counts as not there), and by statute
    how many of each and the share that agrees. Texts compare in letters and digits."""
    plain = F.nullif(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", ""), F.lit(""))
    side = lambda df, x: df.filter("text is not null").groupBy("statute", "selector").agg(F.min(plain).alias(x), F.lit(True).alias(f"has_{x}"))
    both = side(replayed, "r").join(side(oracle, "o"), ["statute", "selector"], "full")
    status = F.when(F.col("has_o").isNull(), "only_replay").when(F.col("has_r").isNull(), "only_oracle").when(F.col("r").eqNullSafe(F.col("o")), "agree").otherwise("differs")
    rows = both.select("statute", "selector", status.alias("status"))
    of = lambda name: F.count(F.when(F.col("status") == name, 1)).alias(name)
    totals = rows.groupBy("statute").agg(*map(of, ("agree", "differs", "only_replay", "only_oracle")), (F.count(F.when(F.col("status") == "agree", 1)) / F.count(F.lit(1))).alias("share"))
    return rows, totals

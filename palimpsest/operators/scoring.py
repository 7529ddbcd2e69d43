"""Scores over runs and states: drift, best checkpoints, belief revision, worklists, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drift(pairs: DataFrame, ratio: Column, touched: str, decade: Column) -> DataFrame:
    """(touched, decade, n, mean): similarity of sections that both sides have, by whether they were touched."""
    return pairs.withColumn("ratio", ratio).groupBy(touched, decade.alias("decade")).agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean"))


def best_checkpoint(scores: DataFrame, unit: str, step: str, score: str) -> DataFrame:
    """(unit, step, score) of the best score; ties go to the earliest step."""
    return scores.groupBy(unit).agg(F.max_by(F.struct(step, score), F.struct(F.col(score), -F.col(step))).alias("b")).select(unit, "b.*")


def belief_revisions(states: DataFrame, slice_key: str, learned: str, content: str) -> DataFrame:
    """(slice, learned, before, after): where what was held true of one slice of time changed."""
    w = Window.partitionBy(slice_key).orderBy(learned)
    seen = states.withColumn("before", F.lag(content).over(w)).withColumn("nth", F.row_number().over(w))
    return seen.filter((F.col("nth") > 1) & ~F.col("before").eqNullSafe(F.col(content))).select(slice_key, learned, "before", F.col(content).alias("after"))


def worklist(rows: DataFrame, key: str, weight: Column, top: int) -> DataFrame:
    """The keys with most leverage (a top-k report): (key, leverage, n)."""
    return rows.groupBy(key).agg(F.sum(weight).alias("leverage"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("leverage"), key).limit(top)


def harvest(findings: DataFrame, rule: str, unit: str) -> DataFrame:
    """(rule, n, units) of findings."""
    return findings.groupBy(rule).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(unit).alias("units"))


def append_history(summary: DataFrame, path: str) -> None:
    """Adds a run's summary row to a history table."""
    summary.write.mode("append").parquet(path)


def corpus_totality(expected: DataFrame, present: DataFrame, excused: DataFrame, key: str) -> DataFrame:
    """(key, state) for every expected or present key: present, excused, shortfall or unexpected."""
    e, p, x = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((expected, "e"), (present, "p"), (excused, "x")))
    both = e.join(p, key, "full").join(x, key, "left")
    return both.select(key, F.when(F.col("e").isNull(), "unexpected").when(F.col("p"), "present").when(F.col("x"), "excused").otherwise("shortfall").alias("state"))


def unrealised_payloads(ops: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ops whose payload is not in the text after them."""
    return ops.join(after.select(key, "after"), key, "left").filter(F.col("payload").isNotNull() & ~F.coalesce(F.contains("after", "payload"), F.lit(False))).select(key, "payload")


def closure_gaps(counts: DataFrame, key: str) -> DataFrame:
    """Rows (key, source, candidate, result, rejected) whose counts do not close."""
    return counts.filter((F.col("candidate") > F.col("source")) | (F.col("result") + F.col("rejected") != F.col("candidate"))).select(key)


def snapshot_shadows(ops: DataFrame) -> DataFrame:
    """(act, fine, broad): finer ops of an act that a later broad op on an ancestor hides."""
    parts = F.split("target", "/")
    fine = ops.filter(F.size(parts) > 1).withColumn("broad", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    wide = ops.select("act", F.col("target").alias("broad"), F.col("seq").alias("broad_seq"))
    return fine.join(wide, ["act", "broad"]).filter("broad_seq > seq").select("act", F.col("target").alias("fine"), "broad").distinct()

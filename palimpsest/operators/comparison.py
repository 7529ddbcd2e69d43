"""Comparison of document states: tree differences, divergence kinds, commensurability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import cut_lineage


def tree_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """(addr, event) between trees of (addr, label, text, editorial): missing_left, missing_right, editorial, label, text or same.
    Below a missing or editorial node nothing more is reported."""
    side = lambda df, x: df.select("addr", *(F.col(c).alias(f"{x}_{c}") for c in ("label", "text", "editorial")), F.lit(True).alias(f"{x}_in"))
    both = side(left, "l").join(side(right, "r"), "addr", "full")
    event = (
        F.when(F.col("l_in").isNull(), "missing_left").when(F.col("r_in").isNull(), "missing_right")
        .when(F.col("l_editorial") | F.col("r_editorial"), "editorial").when(~F.col("l_label").eqNullSafe(F.col("r_label")), "label").when(~F.col("l_text").eqNullSafe(F.col("r_text")), "text").otherwise("same")
    )
    events = cut_lineage(both.select("addr", event.alias("event")))  # read three times below
    stops = events.filter(F.col("event").isin("missing_left", "missing_right", "editorial")).select(F.col("addr").alias("ancestor"))
    parts = F.split("addr", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    below = events.select("addr", F.explode(above).alias("ancestor")).join(stops, "ancestor", "left_semi").select("addr").distinct()
    return events.join(below, "addr", "left_anti")


def difference_kind(structural: Column, label: Column, text: Column, editorial: Column) -> Column:
    """The kind of a difference by its counters."""
    return (
        F.when((structural == 0) & (label == 0) & (text == 0) & (editorial == 0), "identical").when((structural == 0) & (label == 0) & (text == 0), "editorial_only")
        .when((structural > 0) & (text > 0), "structural_and_text").when(structural > 0, "structural").when((label > 0) & (text > 0), "label_and_text").when(label > 0, "label").otherwise("text")
    )


def divergence_kinds(only_oracle: DataFrame, only_replay: DataFrame, both: DataFrame, manual: DataFrame, deterministic: DataFrame) -> DataFrame:
    """Exactly one kind per id: manual_frontier (manual evidence and no deterministic), deterministic_gap, oracle_suspect, text_diff."""
    m, d = manual.select("id").distinct().withColumn("m", F.lit(True)), deterministic.select("id").distinct().withColumn("d", F.lit(True))
    first = only_oracle.select("id").distinct().join(m, "id", "left").join(d, "id", "left")
    a = first.select("id", F.when(F.col("m") & F.col("d").isNull(), "manual_frontier").otherwise("deterministic_gap").alias("kind"))
    b = only_replay.select("id").distinct().withColumn("kind", F.lit("oracle_suspect"))
    c = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("id").distinct().withColumn("kind", F.lit("text_diff"))
    return a.unionByName(b).unionByName(c)


def commensurability(replay_as_of: Column, oracle_as_of: Column, oracle_effective: Column, oracle_expiry: Column, replay_extent: Column, oracle_extent: Column, version_selection: Column) -> Column:
    """Why two units cannot be compared, before any text is: an array of reasons, empty if they can."""
    reasons: Sequence[Column] = (
        F.when(replay_as_of < oracle_effective, F.when(oracle_as_of < oracle_effective, "FUTURE_EFFECTIVE_EMBEDDED").otherwise("ORACLE_NEWER_UNIT")),
        F.when(oracle_expiry < oracle_as_of, "EXPIRY_CUTOFF_MISMATCH"),
        F.when(replay_extent.isNotNull() & oracle_extent.isNotNull() & (replay_extent != oracle_extent), "EXTENT_BRANCH_MISMATCH"),
        F.when(version_selection.isNotNull(), "UNIT_VERSION_AMBIGUOUS"),
    )
    return F.array_compact(F.array(*reasons))


def version_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    a = before.select(key, F.col(content).alias("a"), F.lit(True).alias("in_a"))
    b = after.select(key, F.col(content).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")

"""Joins with the engine's own semantics. Sides are joined by equality wherever that is possible; which side is
broadcast is left to the optimiser's sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_of_window(facts: DataFrame, key: str, date: str, row: Sequence[str], day: str, strict: bool = False) -> DataFrame:
    """Per key the latest row at or before ``day`` (before it, if ``strict``) and the earliest at or after it.

    One aggregation with conditional extremes: no range join, no sort. ``row`` columns break ties.
    """
    d = F.col(date)
    before = d < F.lit(day) if strict else d <= F.lit(day)
    value = F.struct(date, *row)
    return facts.groupBy(key).agg(F.max(F.when(before, value)).alias("before"), F.min(F.when(d >= F.lit(day), value)).alias("after"))


def full_compare(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, missing_equals_empty: bool = False) -> DataFrame:
    """(keys, status): MATCH, MISMATCH, LEFT_MISSING or RIGHT_MISSING for every key of either side."""
    a = left.select(*keys, F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, list(keys), "full")
    if missing_equals_empty:
        blank = F.coalesce("a", F.lit("")) == F.coalesce("b", F.lit(""))
        case = F.when(blank, "MATCH").when(F.col("in_a").isNull(), "LEFT_MISSING").when(F.col("in_b").isNull(), "RIGHT_MISSING")
    else:
        case = F.when(F.col("in_a").isNull(), "LEFT_MISSING").when(F.col("in_b").isNull(), "RIGHT_MISSING").when(F.col("a").eqNullSafe(F.col("b")), "MATCH")
    return both.select(*keys, case.otherwise("MISMATCH").alias("status"))


def contested(links: DataFrame, member: str, target: str) -> DataFrame:
    """(target, member) where a target has more than one member. The counts are partial, so no self-join."""
    distinct = links.select(target, member).distinct()
    several = distinct.groupBy(target).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(target)
    return distinct.join(several, target, "left_semi")


def lifecycle(citations: DataFrame, acts: DataFrame, act: str, day: str, start: str = "in_force", end: str = "repealed") -> DataFrame:
    """Was the cited act in force? Three answers: 'in_force', 'broken', and 'unverifiable' for an act that is not known."""
    known = acts.select(F.col(act), F.col(start), F.col(end), F.lit(True).alias("known"))
    joined = citations.join(known, act, "left")
    alive = (F.col(start).isNull() | (F.col(start) <= F.col(day))) & (F.col(end).isNull() | (F.col(end) > F.col(day)))
    return joined.withColumn("lifecycle", F.when(F.col("known").isNull(), "unverifiable").when(alive, "in_force").otherwise("broken")).drop("known")


def lookup_status(keys: DataFrame, index: DataFrame, key: str, target: str) -> DataFrame:
    """(…, status, target): 'classified' for one target, 'ambiguous' for several, 'unmapped' for none. A null target in
    the index means that the key is 'uncodified'."""
    found = index.groupBy(key).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target))
    status = F.when(F.col("n").isNull(), "unmapped").when(F.col("n") == 0, "uncodified").when(F.col("n") == 1, "classified").otherwise("ambiguous")
    joined = keys.join(found, key, "left")
    return joined.withColumn("status", status).withColumn(target, F.when(F.col("n") == 1, F.col(target))).drop("n")


def align_children(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Pairs children by key, the first with the first, the second with the second; leftovers keep a null side."""
    from pyspark.sql import Window

    ranked = lambda df, name: df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).select(*keys, "nth", F.struct("*").alias(name))
    both = ranked(left, "l").join(ranked(right, "r"), [*keys, "nth"], "full")
    return both.withColumn("side", F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("matched"))


def broken_references(refs: DataFrame, targets: DataFrame, act: str, provision: str) -> DataFrame:
    """References by state of the target: 'UNAVAILABLE' if the act has no text here, 'BROKEN' if it lacks the provision, else 'OK'."""
    acts = targets.select(act).distinct().withColumn("has_act", F.lit(True))
    places = targets.select(act, provision).distinct().withColumn("has_place", F.lit(True))
    joined = refs.join(acts, act, "left").join(places, [act, provision], "left")
    return joined.withColumn("state", F.when(F.col("has_act").isNull(), "UNAVAILABLE").when(F.col("has_place").isNull(), "BROKEN").otherwise("OK")).drop("has_act", "has_place")


def resolve_precedence(claims: DataFrame, key: str, rank: str, value: str, order: str, never: str | None = None) -> DataFrame:
    """Per key the claim of the best (smallest) rank: 'resolved' if those of that rank agree, else 'ambiguous'. Ranks whose
    ``never`` flag is set do not resolve on their own."""
    best = claims.groupBy(key).agg(F.min(rank).alias("best"))
    top = claims.join(best, key).filter(F.col(rank) == F.col("best"))
    agg = top.groupBy(key).agg(F.count_distinct(value).alias("values"), F.min_by(value, order).alias(value), (F.max(F.col(never).cast("int")) if never else F.lit(0)).alias("held"))
    return agg.select(key, F.when((F.col("values") <= 1) & (F.col("held") == 0), F.col(value)).alias(value), F.when(F.col("held") > 0, "held").when(F.col("values") <= 1, "resolved").otherwise("ambiguous").alias("status"))

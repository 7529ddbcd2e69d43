"""Selections that frontends make: which acts apply, which source, which pair, in what order, and why not the others.

Each is an ordered CASE or a ranked aggregation; what is not selected stays, with its reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_case(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds; null conditions do not."""
    out = None
    for condition, name in cases:
        c = F.coalesce(condition, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def applicable_acts(acts: DataFrame, cutoff: str, mode: str = "in_force") -> DataFrame:
    """Acts (act, enacted, effective, repealed) with a decision: 'applied', or the reason for leaving one out."""
    day = F.col("effective") if mode == "in_force" else F.col("enacted")
    return acts.withColumn("decision", first_case([(F.col("act").isNull(), "no_id"), (day.isNull(), "undated"), (day > cutoff, "after_cutoff"), (F.col("repealed") <= cutoff, "repealed")], "applied"))


def best_source(candidates: DataFrame, key: str, rank: Mapping[str, int], kind: str, order: str) -> DataFrame:
    """(key, kind, order, n): the candidate of the best kind, then the smallest ``order``; kinds without a rank come last."""
    table = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    r = F.coalesce(table[F.col(kind)], F.lit(len(rank)))
    return candidates.groupBy(key).agg(F.min_by(F.struct(kind, order), F.struct(r, F.col(order))).alias("c"), F.count(F.lit(1)).alias("n")).select(key, f"c.{kind}", f"c.{order}", "n")


def same_moment_clashes(ops: DataFrame, target: str, day: str, act: str, payload: str) -> DataFrame:
    """(target, day, n_acts): places where acts of one day write different payloads."""
    return ops.groupBy(target, day).agg(F.count_distinct(act).alias("n_acts"), F.count_distinct(payload).alias("n_payloads")).filter("n_acts > 1 and n_payloads > 1").select(target, day, "n_acts")


def in_force(started: Column, ended: Column, known: Column, day: str) -> Column:
    """true, false, or null where it is not known."""
    return F.when(known, F.coalesce(started <= day, F.lit(False)) & ~F.coalesce(ended <= day, F.lit(False)))


def gate_counts(rows: DataFrame, gates: Sequence[tuple[Column, str]]) -> DataFrame:
    """(gate, n): the first gate that blocks each row; 'ready' if none does."""
    return rows.groupBy(first_case(gates, "ready").alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def exact_duplicates(ops: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first op of each set of equal ones, and the others."""
    from pyspark.sql import Window

    ranked = ops.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter("rn = 1").drop("rn"), ranked.filter("rn > 1").drop("rn")


def attribution(ops: DataFrame, unit: str, source: str) -> DataFrame:
    """(unit, n_ops, sources): how many ops of which sources made a unit."""
    return ops.groupBy(unit).agg(F.count(F.lit(1)).alias("n_ops"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def celex_to_eli(c: Column) -> Column:
    """'32016R0679' → 'reg/2016/679'; null for other forms."""
    pattern = r"^3(\d{4})([RLD])0*(\d+)$"
    kind = F.regexp_extract(c, pattern, 2)
    name = F.when(kind == "R", "reg").when(kind == "L", "dir").when(kind == "D", "dec")
    return F.when(c.rlike(pattern), F.concat_ws("/", name, F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 3)))


def credit_acts(c: Column) -> Column:
    """The acts of a source credit: its parts between semicolons, each with its number and date if it has them."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(x.alias("credit"), F.regexp_extract(x, r"Pub\. L\. (\d+[-–]\d+)", 1).alias("law"), F.regexp_extract(x, r"([A-Z][a-z]{2,4}\.? \d{1,2}, \d{4})", 1).alias("dated")))


def branch_impact(ops: DataFrame, branch: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(impact, conflicts): targets per branch, kept apart from what is enacted, and targets that several branches touch."""
    impact = ops.groupBy(branch, target).agg(F.count(F.lit(1)).alias("n"))
    conflicts = impact.groupBy(target).agg(F.count(F.lit(1)).alias("n_branches"), F.array_join(F.array_sort(F.collect_set(branch)), ",").alias("branches")).filter("n_branches > 1")
    return impact, conflicts


def greedy_cover(rows: DataFrame, key: str, families: str, pinned: Sequence[str] = ()) -> DataFrame:
    """Pinned rows, and for each family the first row by key that has it: each adds something that no earlier row has."""
    first = rows.select(key, F.explode(families).alias("family")).groupBy("family").agg(F.min(key).alias(key)).select(key).distinct()
    pins = rows.filter(F.col(key).isin(*pinned)).select(key) if pinned else rows.select(key).limit(0)
    return rows.join(first.union(pins).distinct(), key, "left_semi")


def transposition_edges(claims: DataFrame) -> DataFrame:
    """Each claim (claim, national, directive, authority) as three edges: transposes, is evidenced by, is asserted by."""
    edge = lambda s, k, d: F.struct(F.col(s).alias("src"), F.lit(k).alias("kind"), F.col(d).alias("dst"))
    edges = F.array(edge("national", "transposes", "directive"), edge("national", "evidenced_by", "claim"), edge("claim", "asserted_by", "authority"))
    return claims.select(F.explode(edges).alias("e")).select("e.*")

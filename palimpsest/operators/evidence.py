"""The evidence policy: clauses over the attestations of a subject. Each clause is one aggregate, so a policy of any
number of clauses is one aggregation by subject; only ``reachable`` walks a graph and comes in as a set of subjects."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.filters import all_of

Clause = Mapping[str, Any]


def _where(clause: Clause) -> Column:
    return all_of([F.col(k) == v for k, v in (clause.get("where") or {}).items()])


def clause_column(clause: Clause) -> Column:
    """The aggregate expression of a clause; an unknown op raises."""
    op, hit = clause["op"], _where(clause)
    some = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))
    if op == "exists":
        return some(hit)
    if op == "none":
        return ~some(hit)
    if op == "count_distinct_at_least":
        return F.count_distinct(F.when(hit, F.col(clause["path"]))) >= clause["n"]
    if op == "all":
        return ~some(~hit)
    if op == "within_time":
        ts = F.when(hit, F.col("ts"))
        return F.coalesce((F.count(ts) > 0) & (F.min(ts) >= clause["start"]) & (F.max(ts) <= clause["end"]), F.lit(False))
    if op == "signed_by":
        return some(hit & (F.col("signer") == clause["key"]))
    if op == "not_retracted":
        return ~some(hit & (F.col("kind") == "retracted"))
    if op == "independent":
        dims = clause.get("dimensions") or []
        return F.count_distinct(F.when(hit, F.struct(*dims))) >= clause.get("n", 2) if dims else F.lit(True)
    if op == "materials_match_dependencies":
        return F.coalesce(F.size(F.filter(F.array_except(F.collect_set("material"), F.collect_set("dependency")), lambda m: m != F.any_value("subject"))) == 0, F.lit(True))
    raise ValueError(f"unknown op {op!r}")


def authorize(attestations: DataFrame, clauses: Mapping[str, Clause], reachable: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(subject, a boolean per clause, authorized). ``reachable`` gives the subjects (column subject) of clauses of that op."""
    plain = {name: c for name, c in clauses.items() if c["op"] != "reachable"}
    out = attestations.groupBy("subject").agg(*(clause_column(c).alias(name) for name, c in plain.items()))
    for name, subjects in (reachable or {}).items():
        out = out.join(subjects.select("subject").distinct().withColumn(name, F.lit(True)), "subject", "left").fillna(False, [name])
    return out.withColumn("authorized", all_of([F.col(name) for name in clauses]))


def effective_state(events: DataFrame, subject: str, order: str, state: str, legal: Mapping[str, list[str]]) -> DataFrame:
    """Folds an event log into the state of each subject; the first illegal transition is reported beside it."""
    ordered = F.array_sort(F.collect_list(F.struct(order, state)))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, bs in legal.items() for b in bs))
    folded = events.groupBy(subject).agg(ordered.alias("log"))
    steps = F.filter(F.transform("log", lambda e, i: F.when(i > 0, F.concat(F.get("log", i - 1)[state], F.lit(">"), e[state]))), lambda s: s.isNotNull())
    bad = F.filter(steps, lambda s: ~F.array_contains(allowed, s))
    return folded.select(subject, F.element_at("log", -1)[state].alias("state"), F.get(bad, F.lit(0)).alias("illegal"))

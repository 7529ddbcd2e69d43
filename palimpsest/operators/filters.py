"""Predicates and projections. All filters are optional and AND together; they stay plain column expressions, so they
reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conditions: Sequence[Column | None]) -> Column:
    """The AND of those conditions that are given; true if none is."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def valid_on(start: str | Column, end: str | Column, day: str | Column) -> Column:
    """Both ends inclusive; a null end is open. Not the rule for version expiry, which is exclusive."""
    s, e, d = col(start), col(end), F.lit(day) if isinstance(day, str) else day
    return (s.isNull() | (s <= d)) & (e.isNull() | (e >= d))


def escaped(text: str) -> str:
    """``text`` as a LIKE pattern that matches itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def provision_prefix(c: str | Column, value: str, mode: str = "compat") -> Column:
    """Provisions at or under ``value``. 'compat' is a bare prefix (…/7 also finds …/70); 'strict' ends at a slash."""
    if mode == "compat":
        return col(c).startswith(value)
    if mode != "strict":
        raise ValueError(f"unknown prefix mode {mode!r}")
    return (col(c) == value) | col(c).startswith(f"{value}/")


def reference_end(id_col: str, provision_col: str, value: str, mode: str = "compat") -> Column:
    """An end of a reference: with two or more slashes a provision, else a document id."""
    if value.count("/") >= 2:
        return (F.col(id_col) == value) | provision_prefix(provision_col, value, mode)
    return F.col(id_col) == value


def whole_match(c: str | Column, pattern: str) -> Column:
    """SQL's SIMILAR TO: the pattern must match all of the value."""
    return col(c).rlike(f"^(?:{pattern})$")


def contains_ci(c: str | Column, term: str) -> Column:
    return col(c).ilike(f"%{term}%")


def year_range(c: str | Column, spec: str) -> Column:
    """'2024' or '2020:2024', both ends inclusive."""
    low, _, high = spec.partition(":")
    return col(c).between(int(low), int(high or low))


def query_references(refs: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None, confidence: str | None = None, as_of: str | None = None, broken_after: str | None = None, broken_before: str | None = None, limit: int | None = None, prefix_mode: str = "compat") -> DataFrame:
    """References by any of their ends, kind, confidence and date, in order of source."""
    broken = broken_after is not None or broken_before is not None
    found = refs.filter(all_of([
        reference_end("source_statute_id", "source_provision_ref_str", source, prefix_mode) if source else None,
        reference_end("target_statute_id", "target_provision_ref_str", target, prefix_mode) if target else None,
        F.col("cite_kind") == kind.replace("-", "_") if kind else None,
        F.col("cite_confidence") == ("broken" if broken else confidence) if broken or confidence else None,
        F.col("valid_at_start") > broken_after if broken_after else None,
        F.col("valid_at_start") < broken_before if broken_before else None,
        valid_on("valid_at_start", "valid_at_end", as_of) if as_of else None,
    ]))
    ordered = found.orderBy(F.asc_nulls_last("source_statute_id"), F.asc_nulls_last("source_provision_ref_str"))
    return ordered if limit is None else ordered.limit(limit)


def keyword_search(sources: Sequence[tuple[DataFrame, str, str, str]], term: str, id_glob: str | None = None, width: int = 200) -> DataFrame:
    """(kind, id, excerpt) over several (table, kind, id column, text column), as one UNION ALL."""
    parts = []
    for df, kind, key, text in sources:
        hit = df.filter(all_of([F.col(text).ilike(f"%{term}%"), F.col(key).cast("string").like(id_glob.replace("*", "%")) if id_glob else None]))
        parts.append(hit.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.left(F.col(text), F.lit(width)).alias("excerpt")))
    return reduce(DataFrame.unionByName, parts)


def disposition(df: DataFrame, rejected: Column, pending: Column) -> DataFrame:
    """Splits without loss: each row is 'rejected', 'pending' or 'kept'. Null conditions count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumn("disposition", F.when(yes(rejected), "rejected").when(yes(pending), "pending").otherwise("kept"))


def group_atomicity(df: DataFrame, group: str = "group_id") -> DataFrame:
    """A group with a rejected or pending member is rejected whole; rows without a group stay as they are."""
    failed = F.max(F.col("disposition") != "kept").over(Window.partitionBy(group))
    return df.withColumn("disposition", F.when(F.col(group).isNotNull() & failed, "rejected").otherwise(F.col("disposition")))


def structural_grep(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), text: str = "text", equal: dict[str, str] | None = None, has_op: bool | None = None) -> DataFrame:
    """Rows that match every ``include`` pattern and no ``exclude`` pattern in either case, and all equalities."""
    hit = [F.col(text).rlike(f"(?i){p}") for p in include] + [~F.col(text).rlike(f"(?i){p}") for p in exclude]
    hit += [F.col(k) == v for k, v in (equal or {}).items()]
    if has_op is not None:
        hit.append((F.size("ops") > 0) == has_op)
    return df.filter(all_of(hit))


def selector_locator(c: str | Column) -> Column:
    """'§a:b.c.d' → chapter:a/section:b/subsection:c/paragraph:d; a bare 'N §' → section:N; anything else unchanged."""
    s = F.trim(col(c))
    pattern = r"^§\s*(?:([^:.\s]+):)?([^:.\s]+)(?:\.([^.\s]+))?(?:\.([^.\s]+))?$"
    part = lambda i, name: F.when(F.regexp_extract(s, pattern, i) != "", F.concat(F.lit(f"{name}:"), F.regexp_extract(s, pattern, i)))
    bare = r"^(\S+)\s*§$"
    return F.when(s.rlike(pattern), F.concat_ws("/", part(1, "chapter"), part(2, "section"), part(3, "subsection"), part(4, "paragraph"))).when(s.rlike(bare), F.concat(F.lit("section:"), F.regexp_extract(s, bare, 1))).otherwise(col(c))


def parse_locator(c: str | Column) -> Column:
    """'kind:label/…' → array of (kind, label); null if malformed."""
    ok = col(c).rlike(r"^[a-z_]+:[^/:]+(/[a-z_]+:[^/:]+)*$")
    return F.when(ok, F.transform(F.split(col(c), "/"), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(x, F.lit(":"), F.lit(2)).alias("label"))))


def within_scope(address: str | Column, scope: str | Column) -> Column:
    """The address itself or one under it."""
    a, s = col(address), col(scope)
    return (a == s) | F.startswith(a, F.concat(s, F.lit("/")))


def expand_evidence(records: DataFrame, evidence: str = "evidence") -> DataFrame:
    """One row per evidence row embedded in a record: an array of structs, absent meaning none."""
    return records.withColumn("row", F.explode(evidence)).drop(evidence)

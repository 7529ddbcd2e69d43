"""Parameterised queries over projections: mentions, proposals, purpose sections, evidence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.filters import all_of, provision_prefix, valid_on, whole_match, year_range


def query_mentions(
    rows: DataFrame, document: str | None = None, provision: str | None = None, equal: dict[str, object] | None = None, equal_ci: dict[str, str] | None = None,
    role: tuple[str, tuple[str, ...]] | None = None, as_of: str | None = None, order: tuple[str, ...] = (), limit: int | None = None,
) -> DataFrame:
    """Mentions (actors, quantities, citations, preparatory references) by document, provision prefix, equalities (case
    ignored in ``equal_ci``), a role pattern that must match one of several columns whole, and date."""
    found = rows.filter(all_of([
        F.col("source_statute_id") == document if document else None,
        provision_prefix("source_provision_ref_str", provision) if provision else None,
        *(F.col(k) == v for k, v in (equal or {}).items()),
        *(F.upper(F.col(k)) == v.upper() for k, v in (equal_ci or {}).items()),
        _any(*(whole_match(c, role[0]) for c in role[1])) if role else None,
        valid_on("valid_at_start", "valid_at_end", as_of) if as_of else None,
    ]))
    if order:
        found = found.orderBy(*(F.asc_nulls_last(c) for c in order))
    return found if limit is None else found.limit(limit)


def _any(first: Column, *rest: Column) -> Column:
    for c in rest:
        first = first | c
    return first


def query_proposals(corpus: DataFrame, ministry: str | None = None, years: str | None = None, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Proposals by ministry (part of its id or name, in either case), years 'a' or 'a:b', and state; the newest first."""
    found = corpus.filter(all_of([
        F.col("ministry_canonical_id").ilike(f"%{ministry}%") | F.col("ministry_show_as").ilike(f"%{ministry}%") if ministry else None,
        year_range("he_year", years) if years else None, F.col("finlex_state") == state if state else None,
    ])).orderBy(F.desc_nulls_last("he_year"), F.desc_nulls_last("he_number"))
    return found if limit is None else found.limit(limit)


def show_proposal(key: str, corpus: DataFrame, atoms: DataFrame, refs: DataFrame, signatures: DataFrame) -> dict[str, DataFrame]:
    """The four lookups of one proposal; the id matches in either case."""
    mine = F.lower(F.col("he_id")) == key.lower()
    return {"corpus": corpus.filter(mine).limit(10), "atoms": atoms.filter(mine).orderBy("seq"), "law_refs": refs.filter(mine).orderBy("target_provision_ref_str"), "signatures": signatures.filter(mine)}


def purpose_sections(sections: DataFrame, width: int = 300) -> DataFrame:
    """Sections flagged as purpose clauses, with the beginning of their text."""
    return sections.filter("is_purpose_section").withColumn("excerpt", F.left("text", F.lit(width)))


def evidence_rows(records: DataFrame) -> DataFrame:
    """Records (id, evidence_row, finding_id, row_id, rule_id, operation_rows, finding_rows) to rows (id, row): the embedded
    row if there is one, else the record itself if it names anything, else its lists of rows, else nothing."""
    own = F.coalesce("finding_id", "row_id", "rule_id")
    rows = F.when(F.col("evidence_row").isNotNull(), F.array("evidence_row")).when(own.isNotNull(), F.array(own)).otherwise(F.concat(F.coalesce("operation_rows", F.array()), F.coalesce("finding_rows", F.array())))
    return records.select("id", F.explode(rows).alias("row"))


def section_state(replay: Column, oracle: Column, ratio: Column) -> Column:
    """A section's diagnosis, first match first."""
    return F.when(oracle.isNull() & replay.isNull(), "absent").when(oracle.isNull(), "only_replay").when(replay.isNull(), "only_oracle").when(ratio >= 0.999, "equal").when(ratio >= 0.95, "near").otherwise("divergent")


def inactive(status: Column, start: Column, end: Column, text: Column, live_child: Column, day: str) -> Column:
    """Repealed or prospective, not begun, over, or nothing but dots without a live child."""
    dots = text.rlike(r"^[\s.]*\.[\s.]*$") & ~F.coalesce(live_child, F.lit(False))
    return F.coalesce(status.isin("Repealed", "Prospective"), F.lit(False)) | F.coalesce(start > day, F.lit(False)) | F.coalesce(end <= day, F.lit(False)) | F.coalesce(dots, F.lit(False))

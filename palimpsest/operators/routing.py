"""What frontends decide before and after a replay: whether an amendment is meant for a statute, which ops belong together, what an oracle is compared on, whether
a change is a sunset, which divergences are the consolidation's fault, and what proposals would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.clauses import VERBS, parse_clauses
from palimpsest.operators.graph import cut_lineage
from palimpsest.operators.windows import roman_value

_CITED = r"\(\s*(\d{1,4}\s*/\s*\d{4})\s*\)"
_ID = r"^\d{4}/\d+$"


def cited_statutes(text: Column) -> Column:
    """The statutes that a text cites as (number/year), as year/number."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CITED), F.lit(1))
    return F.array_distinct(F.transform(found, lambda c: F.concat_ws("/", F.trim(F.split_part(c, F.lit("/"), F.lit(2))), F.trim(F.split_part(c, F.lit("/"), F.lit(1))))))


def route_amendments(pairs: DataFrame) -> DataFrame:
    """Pairs (amendment_id, parent_id, preamble, section_one, title, parent_title) with ``applies`` and ``routing``.

    no_guard_needed (ids that are no year/number); references_parent (the preamble cites the parent, or nothing; or it orders nothing itself and section one
    cites the parent). Else it goes elsewhere: pending_amendment_of_parent_skip (its title amends an act that amends the parent), delegated_authority_nojalla_skip
    (the citation names an authority), num_collision_skip (same number, another year), citation_mismatch_skip; the last one too where the title cites another statute."""
    cited, titled = cited_statutes(F.col("preamble")), cited_statutes(F.col("title"))
    parent, low = F.col("parent_id"), F.lower(F.coalesce("preamble", F.lit("")))
    guarded = F.coalesce(F.col("amendment_id").rlike(_ID) & parent.rlike(_ID), F.lit(False))
    orders = low.rlike(r"\b(?:" + "|".join(VERBS) + r")\b")
    direct = (F.size(cited) == 0) | F.array_contains(cited, parent)
    by_section = ~orders & F.array_contains(cited_statutes(F.col("section_one")), parent)
    pending = F.coalesce(F.lower("title").rlike(r"muuttamisesta annetun") & F.contains(F.lower("title"), F.lower("parent_title")), F.lit(False))
    number = lambda c: F.split_part(c, F.lit("/"), F.lit(2))
    routing = (
        F.when(~guarded, "no_guard_needed").when((direct | by_section) & (F.size(titled) > 0) & ~F.array_contains(titled, parent), "citation_mismatch_skip").when(direct | by_section, "references_parent").when(pending, "pending_amendment_of_parent_skip")
        .when(low.rlike(r"\bnojalla\b"), "delegated_authority_nojalla_skip").when(number(F.col("amendment_id")) == number(parent), "num_collision_skip").otherwise("citation_mismatch_skip")
    )
    return pairs.withColumn("routing", routing).withColumn("applies", F.col("routing").isin("no_guard_needed", "references_parent"))


def group_by_target(ops: DataFrame) -> DataFrame:
    """Ops (doc_id, seq, unit, section, chapter, part) with the group that they are applied in: group_unit, group_label, group_chapter, group_part, scope.

    Labels compare without marks and in lower case, parts and their Roman numbers as numbers. Ops on a section without chapter join those with one if there is only
    one such chapter and part in the document (scope 'inherited'); where there are several they stay apart (scope 'ambiguous'), else scope is 'own'."""
    word = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))
    numbered = lambda c: F.when(word(c).rlike("^[ivxlcdm]+$"), roman_value(F.upper(word(c))).cast("string")).otherwise(word(c))
    unit = F.col("unit")
    label = F.when(unit == "part", numbered(F.col("section"))).otherwise(word(F.col("section")))
    chapter = F.when(unit == "section", F.nullif(word(F.col("chapter")), F.lit("")))
    part = F.when(unit.isin("section", "chapter"), F.nullif(numbered(F.col("part")), F.lit("")))
    keyed = ops.withColumns({"group_unit": unit, "group_label": label, "group_chapter": chapter, "group_part": part})
    bare = (F.col("group_unit") == "section") & F.col("group_chapter").isNull() & F.col("group_part").isNull()
    scopes = keyed.filter((F.col("group_unit") == "section") & ~bare).groupBy("doc_id", "group_label").agg(F.count_distinct(F.struct("group_chapter", "group_part")).alias("__n"), F.first("group_chapter", ignorenulls=True).alias("__chapter"), F.first("group_part", ignorenulls=True).alias("__part"))
    joined = keyed.join(scopes, ["doc_id", "group_label"], "left")
    scope = F.when(bare & (F.col("__n") == 1), "inherited").when(bare & (F.col("__n") > 1), "ambiguous").otherwise("own")
    takes = scope == "inherited"
    return joined.select(*ops.columns, "group_unit", "group_label", F.when(takes, F.col("__chapter")).otherwise(F.col("group_chapter")).alias("group_chapter"), F.when(takes, F.col("__part")).otherwise(F.col("group_part")).alias("group_part"), scope.alias("scope"))


def lineage_order(events: DataFrame) -> DataFrame:
    """Migration events (doc_id, event_id, effective, from_addr, to_addr, source) with ``position``: by day, depth, addresses, source and id, a total order."""
    depth = F.size(F.split("from_addr", "/"))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("effective", F.lit("")), depth, "from_addr", "to_addr", "source", "event_id")
    return events.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def plan_pairs(bases: DataFrame, redactions: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, amendments) of bases (base_id, as_of, group_id, consolidated), redactions (group_id, oracle_id, effective) and references (id, act, slice, starts).

    The oracle of a base is the latest redaction of its group that is effective by then (of equal days the largest id). comparison: no_oracle, oracle_is_base,
    consolidated (what the oracle has beyond the base is to be applied) or source (all that the base lists is). Amendments (base_id, act, slice, timing) are each
    slice once, effective or future as of the day; a reference without day is undated and not applied."""
    dated = redactions.select(F.col("group_id").alias("__g"), "oracle_id", "effective")
    found = bases.join(dated, (F.col("group_id") == F.col("__g")) & (F.col("effective") <= F.col("as_of"))).groupBy("base_id").agg(F.max_by("oracle_id", F.struct("effective", "oracle_id")).alias("oracle_id"), F.max("effective").alias("oracle_effective"))
    joined = cut_lineage(bases.join(found, "base_id", "left"))
    comparison = F.when(F.col("oracle_id").isNull(), "no_oracle").when(F.col("oracle_id") == F.col("base_id"), "oracle_is_base").when(F.col("consolidated"), "consolidated").otherwise("source")
    plans = joined.withColumn("comparison", comparison)
    once = refs.groupBy("id", "act", "slice").agg(F.min("starts").alias("starts"))
    own = once.select(F.col("id").alias("base_id"), "act", "slice", "starts")
    beyond = plans.filter("comparison = 'consolidated'").select("base_id", "oracle_id", "as_of").join(once.withColumnRenamed("id", "oracle_id"), "oracle_id").join(own.select("base_id", "act", "slice"), ["base_id", "act", "slice"], "left_anti").select("base_id", "as_of", "act", "slice", "starts")
    listed = plans.filter("comparison = 'source'").select("base_id", "as_of").join(own, "base_id").select("base_id", "as_of", "act", "slice", "starts")
    timing = F.when(F.coalesce("starts", F.lit("")) == "", "undated").when(F.col("starts") <= F.col("as_of"), "effective").otherwise("future")
    return plans, beyond.unionByName(listed).select("base_id", "act", "slice", timing.alias("timing"))


# What notes say where a text comes back.
REVERSION = r"(?i)\b(?:revert|reverts|as in effect (?:on the day )?before|shall cease to (?:have effect|be effective)|ceases? to be effective|sunset|is repealed effective|shall not apply after)\b"
_DAY = r"(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),\s+(\d{4})"


def sunset_reversions(changes: DataFrame, editions: DataFrame) -> DataFrame:
    """Changes (section, before_year, after_year, before_text, after_text, notes) with classification, channels, reverts_to and sunset_day.

    Channel a: the new text is that of an edition (section, year, text) before ``before_year``; the earliest counts. Channel b: a note names a day between the two
    editions and speaks of reversion. Either makes a sunset_reversion; notes with a day or such words and neither channel are insufficient_signal; texts that do not
    differ, and changes without any signal, have none."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    earlier = editions.select(F.col("section").alias("__s"), F.sha2(norm(F.col("text")), 256).alias("__text"), F.col("year").alias("__year")).groupBy("__s", "__text").agg(F.min("__year").alias("__year"))
    joined = changes.join(earlier, (F.col("section") == F.col("__s")) & (F.sha2(norm(F.col("after_text")), 256) == F.col("__text")) & (F.col("__year") < F.col("before_year")), "left")
    months = F.create_map(*(F.lit(x) for k, m in enumerate("January February March April May June July August September October November December".split(), 1) for x in (m, f"{k:02d}")))
    notes = F.coalesce("notes", F.array().cast("array<string>"))
    iso = lambda d: F.concat_ws("-", F.regexp_extract(d, _DAY, 3), months[F.regexp_extract(d, _DAY, 1)], F.lpad(F.regexp_extract(d, _DAY, 2), 2, "0"))
    days = lambda n: F.transform(F.regexp_extract_all(n, F.lit(_DAY), F.lit(0)), iso)
    all_days = F.flatten(F.transform(notes, days))
    within = F.filter(all_days, lambda d: (F.left(d, F.lit(4)).cast("int") >= F.col("before_year")) & (F.left(d, F.lit(4)).cast("int") <= F.col("after_year")))
    speaks = F.exists(notes, lambda n: n.rlike(REVERSION))
    same = norm(F.col("before_text")) == norm(F.col("after_text"))
    a, b = F.col("__year").isNotNull() & (norm(F.col("after_text")) != ""), (F.size(within) > 0) & speaks
    classification = F.when(same, None).when(a | b, "sunset_reversion").when((F.size(all_days) > 0) | speaks, "insufficient_signal")
    judged = joined.withColumn("classification", classification)
    is_sunset = F.col("classification") == "sunset_reversion"
    channels = F.array_join(F.array_compact(F.array(F.when(a, "prior_edition"), F.when(b, "note"))), "+")
    return judged.select(*changes.columns, "classification", F.when(is_sunset, channels).alias("channels"), F.when(is_sunset & a, F.col("__year")).alias("reverts_to"), F.when(is_sunset & b, F.get(within, F.lit(0))).alias("sunset_day"))


def consolidation_candidates(divergences: DataFrame, records: DataFrame, attribution: DataFrame, buckets: list[str]) -> DataFrame:
    """Divergences (base_id, addr, size) that are the consolidation's fault, ranked: (base_id, addr, tier, bucket, act, rank).

    strong: adjudicated (records: base_id, addr, bucket) into one of ``buckets``. triage: not adjudicated at all, for review and not asserted. What is adjudicated
    into another bucket is left out. ``attribution`` (base_id, addr, act) names the last act that wrote there; strong ones come first, then larger ones."""
    one = records.groupBy("base_id", "addr").agg(F.min("bucket").alias("bucket"))
    acts = attribution.groupBy("base_id", "addr").agg(F.max("act").alias("act"))
    joined = divergences.join(one, ["base_id", "addr"], "left").join(acts, ["base_id", "addr"], "left")
    tier = F.when(F.col("bucket").isin(*buckets), "strong").when(F.col("bucket").isNull(), "triage")
    order = Window.partitionBy("base_id").orderBy(F.col("tier") != "strong", F.col("size").desc(), "addr")
    return joined.withColumn("tier", tier).filter("tier is not null").withColumn("rank", F.row_number().over(order).cast("long")).select("base_id", "addr", "tier", F.coalesce("bucket", F.lit("unadjudicated_needs_review")).alias("bucket"), "act", "rank")


def proposal_ops(proposals: DataFrame) -> DataFrame:
    """Proposals (he_id, he_year, he_number, clause, statute) as rows of the branch table: one for each op that the clause orders, and one without op for a
    proposal of which nothing is read.

    parse_status: full (no leftovers), partial, failed (a clause that orders nothing) or not_applicable (no clause); parse_confidence is the share of tokens that the
    grammar took. target_resolution: cited (the clause names the statute), given (the proposal's own statute) or unresolved."""
    parsed = cut_lineage(parse_clauses(proposals, "he_id", "clause", ("ops", "counts")))
    size = parsed.filter("tokens is not null").select("he_id", "tokens", "used")
    ops = parsed.filter("action is not null").select("he_id", F.col("nth").alias("op_index"), F.col("action").alias("operation_kind"), F.col("target").alias("target_provision_ref"), F.col("destination").alias("payload_summary"), F.col("statute").alias("__cited"))
    joined = proposals.join(size, "he_id", "left").join(ops, "he_id", "left")
    status = F.when(F.coalesce(F.trim("clause"), F.lit("")) == "", "not_applicable").when(F.col("operation_kind").isNull(), "failed").when(F.col("used") < F.col("tokens"), "partial").otherwise("full")
    cited = F.concat_ws("/", F.split_part("__cited", F.lit("/"), F.lit(2)), F.split_part("__cited", F.lit("/"), F.lit(1)))
    resolution = F.when(F.col("operation_kind").isNull(), None).when(F.col("__cited").isNotNull(), "cited").when(F.col("statute").isNotNull(), "given").otherwise("unresolved")
    return joined.select(
        F.concat(F.lit("he:"), F.col("he_year").cast("string"), F.lit("/"), F.col("he_number").cast("string")).alias("branch_id"), "he_id", "he_year", "he_number", "op_index", "operation_kind", "target_provision_ref", F.when(F.col("__cited").isNotNull(), cited).otherwise(F.col("statute")).alias("target_statute_id"), "payload_summary",
        F.col("clause").alias("source_span_text"), F.when(F.col("tokens") > 0, F.round(F.col("used") / F.col("tokens"), 4)).alias("parse_confidence"), resolution.alias("target_resolution"), F.lit(True).alias("is_proposal_relative"), status.alias("parse_status"))

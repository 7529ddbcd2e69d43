"""What frontends and lookups plan over: provision states, reference changes, corpus graphs, oracle pairs, registries.

Each is a filter, a ranked aggregation or a full join with a typed status; nothing that fails a rule is dropped in
silence. Days are ISO strings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISO_DAY = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
# What a lookup may ask for.
QUERY_TYPES = ("governing", "enacted", "in_force")


def provision_states(asked: DataFrame, versions: DataFrame, jurisdictions: Sequence[str]) -> DataFrame:
    """Each question (id, jurisdiction, provision, as_of, query_type) with a status and, if there is one, the version in
    force: unsupported_jurisdiction, invalid_query, invalid_selector, then ambiguous (versions that differ only in
    territory), absent, tombstone or found. ``versions``: (addr, effective, expires, territory, content)."""
    status = (
        F.when(~F.col("jurisdiction").isin(*jurisdictions), "unsupported_jurisdiction").when(~F.col("as_of").rlike(ISO_DAY) | ~F.col("query_type").isin(*QUERY_TYPES), "invalid_query")
        .when(~F.col("provision").rlike(r"^[a-z]+:[0-9A-Za-z]+(/[a-z]+:[0-9A-Za-z]+)*$"), "invalid_selector")
    )
    judged = asked.withColumn("error", status)
    valid = judged.filter("error is null")
    held = versions.select("addr", "effective", "expires", "territory", "content")
    eligible = valid.join(held, (F.col("provision") == F.col("addr")) & (F.col("effective") <= F.col("as_of")) & (F.coalesce("expires", F.lit("")).isin("") | (F.col("expires") > F.col("as_of"))))
    latest = eligible.groupBy("id").agg(F.max("effective").alias("effective"))
    at_latest = eligible.join(latest, ["id", "effective"]).groupBy("id", "effective").agg(F.count_distinct(F.coalesce("territory", F.lit(""))).alias("n_places"), F.max("content").alias("content"), F.count("content").alias("n_live"))
    found = judged.join(at_latest, "id", "left")
    case = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("effective").isNull(), "absent").when(F.col("n_places") > 1, "ambiguous").when(F.col("n_live") == 0, "tombstone").otherwise("found")
    return found.select("id", case.alias("status"), F.when(case == "found", F.col("effective")).alias("effective"), F.when(case == "found", F.col("content")).alias("content"))


def provision_answers(asked: DataFrame, versions: DataFrame, jurisdictions: Sequence[str]) -> DataFrame:
    """Questions (id, jurisdiction, provision, as_of, query_type, territory) over versions (addr, variant, effective, enacted, expires, territory, pos, content),
    with status, rail, effective, content and candidates.

    The three types differ: governing takes versions in effect at the day; in_force asks besides that they were enacted by then; enacted takes what had been
    enacted by then, in effect or not (the latest act counts, and there is no rail). For the first two the latest of each rail stands, and a temporary one hides the permanent
    one unless that began later and not before the last day of the temporary's term.

    A version without territory holds everywhere. A question with a territory sees those and its own; one without is ambiguous, with the territories as candidates,
    where a version of some territory is as late as the latest that holds everywhere. Status: the errors of a question first (unsupported_jurisdiction, invalid_query, invalid_selector),
    then ambiguous, absent, tombstone (the version has no content) or found. Versions of an address meet its questions by equality and are aggregated at once."""
    error = (
        F.when(~F.col("jurisdiction").isin(*jurisdictions), "unsupported_jurisdiction").when(~F.coalesce(F.col("as_of").rlike(ISO_DAY), F.lit(False)) | ~F.coalesce(F.col("query_type").isin(*QUERY_TYPES), F.lit(False)), "invalid_query")
        .when(~F.coalesce(F.col("provision").rlike(r"^[a-z]+:[0-9A-Za-z]+(/[a-z]+:[0-9A-Za-z]+)*$"), F.lit(False)), "invalid_selector")
    )
    judged = asked.withColumn("error", error)
    held = versions.select("addr", "variant", "effective", "enacted", "expires", F.col("territory").alias("place"), "pos", "content")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    day, kind = F.col("as_of"), F.col("query_type")
    current = (F.col("effective") <= day) & (blank("expires") | (F.col("expires") > day))
    counts = F.when(kind == "governing", current).when(kind == "in_force", current & (blank("enacted") | (F.col("enacted") <= day))).otherwise(~blank("enacted") & (F.col("enacted") <= day))
    near = F.col("territory").isNull() | F.col("place").isNull() | (F.col("place") == F.col("territory"))
    met = judged.filter("error is null").select("id", "provision", "as_of", "query_type", "territory").join(held, F.col("provision") == F.col("addr")).filter(counts & near)
    key = F.when(kind == "enacted", F.struct(F.col("enacted").alias("a"), F.col("effective").alias("b"), F.col("pos").alias("c"))).otherwise(F.struct(F.col("effective").alias("a"), F.col("enacted").alias("b"), F.col("pos").alias("c")))
    moment = F.when(kind == "enacted", F.col("enacted")).otherwise(F.col("effective"))
    everywhere = F.col("place").isNull() | F.col("territory").isNotNull()
    temporary = (F.col("variant") == "temporary") & (kind != "enacted")
    row = F.struct("effective", "expires", "content")
    best = lambda on: F.max_by(row, F.when(on & everywhere, key))
    g = met.groupBy("id").agg(
        best(temporary).alias("o"), best(~temporary).alias("b"), F.max(F.when(everywhere, moment)).alias("general"), F.max(F.when(~everywhere, moment)).alias("local"), F.array_sort(F.collect_set("place")).alias("places"), F.first("query_type").alias("__kind"),
    )
    ended = F.date_format(F.date_sub(F.try_to_date("o.expires", "yyyy-MM-dd"), 1), "yyyy-MM-dd")
    handed_off = (F.col("b.effective") > F.col("o.effective")) & (F.coalesce(F.col("o.expires"), F.lit("")) != "") & (F.col("b.effective") >= ended)
    overlay = F.col("o").isNotNull() & ~F.coalesce(handed_off, F.lit(False))
    chosen = g.select("id", F.when(overlay, F.col("o")).otherwise(F.col("b")).alias("c"), F.when(overlay, "temporary").when(F.col("b").isNotNull() & (F.col("__kind") != "enacted"), "permanent").alias("rail"), F.coalesce(F.col("local") >= F.coalesce("general", F.lit("")), F.lit(False)).alias("unclear"), "places")
    found = judged.join(chosen, "id", "left")
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("unclear"), "ambiguous").when(F.col("c").isNull(), "absent").when(F.col("c.content").isNull(), "tombstone").otherwise("found")
    answered = status.isin("found", "tombstone")
    return found.select("id", status.alias("status"), F.when(answered, F.col("rail")).alias("rail"), F.when(answered, F.col("c.effective")).alias("effective"), F.when(answered, F.col("c.content")).alias("content"), F.when(status == "ambiguous", F.col("places")).alias("candidates"))


def scope_status(matches: Column, scoped: Column) -> Column:
    """'applies', 'elsewhere', or 'ambiguous' where the territory is not known: that is not absence."""
    return F.when(scoped.isNull(), "ambiguous").when(matches, "applies").otherwise("elsewhere")


def reference_changes(refs: DataFrame, statute: str, first: str, last: str) -> DataFrame:
    """References of a statute that start or end from ``first`` to ``last``, both days included, with what changes."""
    within = lambda c: F.coalesce(F.col(c).between(first, last), F.lit(False))
    starts, ends = within("valid_at_start"), within("valid_at_end")
    kind = F.when(starts & ends, "started_and_ended").when(starts, "started").otherwise("ended")
    return refs.filter((F.col("source_statute_id") == statute) & (starts | ends)).withColumn("change", kind)


def filter_evidence(rows: DataFrame, rule: str | None = None, phase: str | None = None, status: str | None = None, details: Mapping[str, str] | None = None) -> DataFrame:
    """Evidence rows by the fields that all kinds share: rule, phase, status, and entries of the JSON column ``detail``."""
    for name, value in (("rule", rule), ("phase", phase), ("status", status)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    for key, value in (details or {}).items():
        rows = rows.filter(F.get_json_object("detail", f"$.{key}") == value)
    return rows


def drop_duplicate_versions(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with a rule): of versions (addr, effective, content, pos) of an address the first of equal day and
    content stays (same_day_same_content); of those left, one that repeats what the day before had goes (no_change)."""
    first = Window.partitionBy("addr", "effective", "content").orderBy("pos")
    ranked = versions.withColumn("rn", F.row_number().over(first))
    before = Window.partitionBy("addr", F.col("rn") == 1).orderBy("effective", "pos")
    judged = ranked.withColumn("rule", F.when(F.col("rn") > 1, "same_day_same_content").when(F.col("content").eqNullSafe(F.lag("content").over(before)) & (F.lag("pos").over(before).isNotNull()), "no_change"))
    return judged.filter("rule is null").drop("rn", "rule"), judged.filter("rule is not null").drop("rn")


def affecting_acts(edges: DataFrame) -> DataFrame:
    """(statute, acts): for each amended statute (amended, amender) the ids of the acts that amend it, in order."""
    return edges.groupBy(F.col("amended").alias("statute")).agg(F.array_join(F.array_sort(F.collect_set("amender")), ",").alias("acts"))


def touching(edges: DataFrame, statute: str, order: Sequence[str]) -> DataFrame:
    """Edges with the statute at either end, in order."""
    return edges.filter((F.col("src") == statute) | (F.col("dst") == statute)).orderBy(*order)


def corpus_graph(parts: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(edges, failures): the union of edge tables (src, dst) by kind, each edge once; edges without an end are failures,
    counted by kind."""
    every = None
    for kind, df in sorted(parts.items()):
        own = df.select(F.lit(kind).alias("kind"), "src", "dst")
        every = own if every is None else every.unionByName(own)
    broken = F.col("src").isNull() | F.col("dst").isNull()
    return every.filter(~broken).distinct(), every.filter(broken).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def coverage_report(rows: DataFrame, unit: str, status: str) -> DataFrame:
    """(unit, n, n_ok, share, missing): how much of each unit is covered, and the statuses of what is not."""
    ok = F.col(status) == "ok"
    return rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg(ok.cast("double")), 6).alias("share"), F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col(status)))), ",").alias("missing"))


def observed_against_declared(observed: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status) of writes: as_declared, undeclared (observed only) or unobserved (declared only)."""
    o, d = observed.select(*keys).distinct().withColumn("o", F.lit(True)), declared.select(*keys).distinct().withColumn("d", F.lit(True))
    return o.join(d, list(keys), "full").select(*keys, F.when(F.col("o").isNull(), "unobserved").when(F.col("d").isNull(), "undeclared").otherwise("as_declared").alias("status"))


def without_source(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Claims without any source row: provenance, materialisation and candidate sets are total if there is none."""
    return claims.join(sources.select(key).distinct(), key, "left_anti")


def align(replayed: DataFrame, oracle: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of a candidate against its oracle: equal, different, candidate_only, oracle_only."""
    a, b = replayed.select(key, F.col(value).alias("va"), F.lit(1).alias("a")), oracle.select(key, F.col(value).alias("vb"), F.lit(1).alias("b"))
    return a.join(b, key, "full").select(key, F.when(F.col("b").isNull(), "candidate_only").when(F.col("a").isNull(), "oracle_only").when(F.col("va").eqNullSafe(F.col("vb")), "equal").otherwise("different").alias("status"))


def oracle_pairs(snapshots: DataFrame, unit: str, day: str, key: str) -> DataFrame:
    """(unit, base, oracle, status): the earliest snapshot as base and the latest as oracle; single if they are one,
    same_day if no day lies between them."""
    firsts = snapshots.groupBy(unit).agg(F.min(F.struct(day, key)).alias("a"), F.max(F.struct(day, key)).alias("b"))
    status = F.when(F.col(f"a.{key}") == F.col(f"b.{key}"), "single").when(F.col(f"a.{day}") == F.col(f"b.{day}"), "same_day").otherwise("planned")
    return firsts.select(unit, F.col(f"a.{key}").alias("base"), F.col(f"b.{key}").alias("oracle"), status.alias("status"))


def horizons(day: Column, expiry: Column, asked: Column) -> Column:
    """(pit, expiry_horizon): what is replayed up to and what expires are two questions. The horizon is the asked day, or
    the day of the text itself where none is asked; expiries count to the asked day only."""
    return F.struct(F.coalesce(asked, day).alias("pit"), F.when(asked.isNotNull() & (expiry <= asked), expiry).alias("expired_on"))


def commenced(provisions: DataFrame, orders: DataFrame) -> DataFrame:
    """Provisions (id) at or under one that an order (prefix) brings into force. Prefixes are looked up, not compared."""
    parts = F.split("id", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return provisions.select("id", F.explode(up).alias("prefix")).join(orders.select("prefix").distinct(), "prefix", "left_semi").select("id").distinct()


def address_moves(mutations: DataFrame) -> DataFrame:
    """(seq, from_addr, to_addr, kind) of the mutations that move an address: renumber, move, and split (which also keeps
    the old one)."""
    moved = mutations.filter(F.col("action").isin("RENUMBER", "MOVE", "SPLIT") & F.col("destination").isNotNull() & (F.col("destination") != F.col("target")))
    return moved.select("seq", F.col("target").alias("from_addr"), F.col("destination").alias("to_addr"), F.lower("action").alias("kind"))


def apply_order(ops: DataFrame, group: str, action: str, seq: str) -> DataFrame:
    """``ops`` with ``position`` in their group: replacements and repeals, then insertions, then the rest, each by sequence."""
    rank = F.when(F.col(action).isin("REPLACE", "REPEAL"), 0).when(F.col(action) == "INSERT", 1).otherwise(2)
    return ops.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(rank, seq)) - 1)


def enactment_key(enacted: Column, act: Column, seq: Column) -> Column:
    """Sort key (enacted or id, id, sequence); what is not known is empty."""
    return F.struct(F.coalesce(F.nullif(enacted, F.lit("")), act, F.lit("")).alias("first"), F.coalesce(act, F.lit("")).alias("act"), seq.alias("seq"))


def by_popular_name(mentions: DataFrame, registry: DataFrame, mention: str, name: str, act: str) -> DataFrame:
    """Mentions with the act of their name, case and spaces aside: resolved, ambiguous (several acts) or unknown."""
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))
    known = registry.groupBy(folded(F.col(name)).alias("folded")).agg(F.count_distinct(act).alias("n_acts"), F.min(act).alias("only"))
    joined = mentions.withColumn("folded", folded(F.col(mention))).join(known, "folded", "left")
    status = F.when(F.col("n_acts").isNull(), "unknown").when(F.col("n_acts") > 1, "ambiguous").otherwise("resolved")
    return joined.withColumn("status", status).withColumn("act_id", F.when(status == "resolved", F.col("only"))).drop("folded", "n_acts", "only")


def overwrite_roots(events: DataFrame, unit: str, seq: str, content: str) -> DataFrame:
    """(unit, n, root): SHA-256 over the hashes of a unit's overwrite events in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("h"))))
    return events.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), ""), 256).alias("root"))


def sunset_class(prior: Column, temporary: Column, after: Column) -> Column:
    """What the end of a temporary text shows: reverted (the prior text is back), lapsed (nothing follows), made_permanent
    (the temporary text stays), else ambiguous."""
    return F.when(after.isNull(), "lapsed").when(prior.eqNullSafe(after), "reverted").when(temporary.eqNullSafe(after), "made_permanent").otherwise("ambiguous")


# How error banners begin, and the state that each stands for.
REPLAY_ERRORS = (("Failed to load base", "base_source_unavailable"), ("Failed to parse base", "base_source_parse_error"))


def replayability(error: Column, n_failed: Column, has_oracle: Column, has_replayed: Column, n_ops: Column) -> Column:
    """The one state of a replayed pair; the first that holds, from the error banner to a clean replay."""
    banner = F.regexp_replace(F.coalesce(error, F.lit("")), r"^\s+|\s+$", "")
    state = F.when(F.lit(False), "")
    for prefix, name in REPLAY_ERRORS:
        state = state.when(banner.startswith(prefix), name)
    state = state.when(banner != "", "replay_error_other").when(n_failed > 0, "amendment_source_unavailable")
    return state.when(~has_oracle, "oracle_source_unavailable").when(~has_replayed, "unclassified").when(n_ops == 0, "no_amendments_in_window").otherwise("replayable")


def article_divergence(replayed: DataFrame, consolidated: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, kind, replay_text, oracle_text): one row per article of either side, agreements included."""
    a = replayed.select(*keys, F.col(text).alias("replay_text"), F.lit(True).alias("in_replay"))
    b = consolidated.select(*keys, F.col(text).alias("oracle_text"), F.lit(True).alias("in_oracle"))
    kind = (
        F.when(F.col("in_oracle").isNull(), "present_in_replay_absent_in_oracle").when(F.col("in_replay").isNull(), "present_in_oracle_absent_in_replay")
        .when(F.col("replay_text").eqNullSafe(F.col("oracle_text")), "agreement").otherwise("text_divergence")
    )
    return a.join(b, list(keys), "full").select(*keys, kind.alias("kind"), "replay_text", "oracle_text")


def stale_downstream(links: DataFrame, retracted: DataFrame, reopened: DataFrame) -> DataFrame:
    """Links (link, built_on) that stand right on a retracted one and are not reopened. Those further down are judged once
    what they stand on is retracted itself."""
    standing = links.join(retracted.select(F.col("link").alias("built_on")).distinct(), "built_on", "left_semi")
    return standing.join(reopened.select("link").distinct(), "link", "left_anti").select("link", "built_on")


def application_key(applies: Column, act: Column, seq: Column) -> Column:
    """Sort key (day of application, act, sequence); ops without a day come first."""
    return F.struct(F.coalesce(applies, F.lit("")).alias("applies"), F.coalesce(act, F.lit("")).alias("act"), seq.alias("seq"))

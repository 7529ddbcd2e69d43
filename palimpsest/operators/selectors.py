"""Text selectors and range renumbering: a span is changed only where its place is proven, and each edit leaves a receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import references as X


def occurrences(text: Column, quote: Column) -> Column:
    """How often ``quote`` is in ``text``, side by side; 0 for an empty quote."""
    return F.when(F.coalesce(quote, F.lit("")) == "", 0).otherwise((F.char_length(text) - F.char_length(F.replace(text, quote, F.lit("")))) / F.char_length(quote)).cast("long")


def located(text: Column, quote: Column, before: Column, after: Column, nth: Column) -> Column:
    """struct(start, length, outcome) of the place that a selector names: ``quote`` between the words ``before`` and ``after`` (null: whatever
    stands there; white space between does not count), or its ``nth`` place from 1, or all of its places for 0.

    unique, or nth, or all: proven. Else start is null and the outcome says why: empty_quote, not_found, context_not_found (the quote is there, but not
    between those words), ambiguous (several places and nothing to tell them apart), no_such_place (nth is beyond the last)."""
    # the pieces between the quotes are all that has to be looked at: piece k ends where place k begins
    pieces = F.when(F.coalesce(quote, F.lit("")) != "", F.split(text, F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1))
    n = F.size(pieces) - 1
    fits = lambda k: (
        F.coalesce(F.rtrim(F.get(pieces, k)).endswith(F.trim(before)), before.isNull()) & F.coalesce(F.ltrim(F.get(pieces, k + 1)).startswith(F.trim(after)), after.isNull())
    )
    places = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), fits))
    start = lambda k: F.char_length(F.array_join(F.slice(pieces, F.lit(1), k + 1), "")) + k * F.char_length(quote)
    outcome = (
        F.when(pieces.isNull(), "empty_quote").when(n == 0, "not_found").when(F.size(places) == 0, "context_not_found").when(nth == 0, "all").when(nth.isNotNull() & (nth > F.size(places)), "no_such_place").when(nth.isNotNull(), "nth").when(F.size(places) > 1, "ambiguous").otherwise("unique")
    )
    chosen = F.when(outcome == "unique", F.get(places, F.lit(0))).when(outcome == "nth", F.get(places, nth - 1))
    return F.struct(start(chosen).cast("long").alias("start"), F.when(chosen.isNotNull(), F.char_length(quote)).cast("long").alias("length"), outcome.alias("outcome"))


def select_and_patch(texts: DataFrame, edits: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(texts, receipts): one edit (key…, action, quote, before, after, nth, payload) at most for each text (key…, text).

    Actions: substitute, omit, insert_after, insert_before. An edit whose place is not proven changes nothing. Receipts (key…, action, outcome,
    start) say where it landed or why it was refused; an edit of no text is text_missing, and several edits of one text are refused as conflicting_edits
    (their order would decide)."""
    counted = edits.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(c) for c in ("action", "quote", "before", "after", "nth", "payload")))
    joined = texts.withColumn("__here", F.lit(True)).join(counted, key, "full")
    at = located(F.col("text"), F.col("quote"), F.col("before"), F.col("after"), F.col("nth"))
    known = F.col("action").isin("substitute", "omit", "insert_after", "insert_before")
    outcome = F.when(F.col("__n").isNull(), None).when(F.col("__here").isNull(), "text_missing").when(F.col("__n") > 1, "conflicting_edits").when(~F.coalesce(known, F.lit(False)), "unknown_action").otherwise(F.col("__at.outcome"))
    judged = joined.withColumn("__at", at).withColumn("__outcome", outcome)
    proven = F.col("__outcome").isin("unique", "nth", "all")
    payload = F.coalesce("payload", F.lit(""))
    new = F.when(F.col("action") == "substitute", payload).when(F.col("action") == "omit", "").when(F.col("action") == "insert_after", F.concat("quote", payload)).otherwise(F.concat(payload, F.col("quote")))
    start, length = F.col("__at.start"), F.col("__at.length")
    one = F.concat(F.substring(F.col("text"), F.lit(1), start.cast("int")), new, F.substring(F.col("text"), (start + length + 1).cast("int"), F.char_length("text")))
    patched = F.when(~F.coalesce(proven, F.lit(False)), F.col("text")).when(F.col("__outcome") == "all", F.replace(F.col("text"), F.col("quote"), new)).otherwise(one)
    after = judged.filter("__here").select(*key, patched.alias("text"))
    receipts = judged.filter("__n is not null").select(*key, "action", F.when(proven, "applied").otherwise("refused").alias("outcome"), F.col("__outcome").alias("reason"), F.when(proven, start).alias("start"))
    return after, receipts


def expand_renumbering(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ops, refused) of renumberings (doc_id, seq, parent, level, labels, new_labels) written as lists or ranges, such as sections "5-9" to "6-10".

    One RENUMBER op for each label, with sequences ``seq`` * 10000 + place, in an order that leaves each place before it is taken: upwards moves from the
    last on, others from the first. Refused, whole: labels_unreadable, lengths_differ, overlapping_cycle (some go up and some down)."""
    read = ranges.select("doc_id", "seq", "parent", "level", "labels", "new_labels", X.label_set(F.col("labels")).alias("a"), X.label_set(F.col("new_labels")).alias("b"))
    pairs = F.arrays_zip(F.col("a.labels").alias("l"), F.col("b.labels").alias("m"))
    value = lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long"), F.regexp_extract(x, r"([a-z]*)$", 1))
    up, down = F.exists(pairs, lambda p: value(p["m"]) > value(p["l"])), F.exists(pairs, lambda p: value(p["m"]) < value(p["l"]))
    refusal = F.when((F.size("a.rejected") > 0) | (F.size("b.rejected") > 0) | (F.size("a.labels") == 0), "labels_unreadable").when(F.size("a.labels") != F.size("b.labels"), "lengths_differ").when(up & down, "overlapping_cycle")
    judged = read.withColumn("refusal", refusal).withColumn("__up", up)
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(value(p["l"]).alias("v"), p["l"].alias("l"), p["m"].alias("m"))))
    each = judged.filter("refusal is null").select("doc_id", "seq", "parent", "level", F.posexplode(F.when(F.col("__up"), F.reverse(ordered)).otherwise(ordered)).alias("k", "p"))
    address = lambda label: F.concat_ws("/", F.nullif(F.col("parent"), F.lit("")), F.concat("level", F.lit(":"), label))
    ops = each.filter("p.l <> p.m").select("doc_id", (F.col("seq") * 10_000 + F.col("k")).cast("long").alias("seq"), F.lit("RENUMBER").alias("action"), address(F.col("p.l")).alias("target"), address(F.col("p.m")).alias("destination"))
    return ops, judged.filter("refusal is not null").select("doc_id", "seq", "labels", "new_labels", "refusal")


# ---------------------------------------------------------------- effect intents


def lower_effects(intents: DataFrame) -> DataFrame:
    """Effect intents (group_id, nth, kind, day, contingent, raw_text, source_issued, source_effective, statute) as temporal events, one each.

    commencement: commence, on its day (fixed_date), on a decree still to come (pending_decree, no day), or with its source (immediate). expiry: expire, the
    day after the last day in force. suspension: suspend until its day. revival: revive on its day. applicability: set_applicability with its text as
    predicate, with its source. Anything else is an event of kind unsupported, so that nothing is lost. Dates are ISO strings; missing ones are ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind, day = F.col("kind"), blank("day")
    source = F.when(blank("source_effective") != "", blank("source_effective")).otherwise(blank("source_issued"))
    names = {"commencement": "commence", "expiry": "expire", "suspension": "suspend", "revival": "revive", "applicability": "set_applicability"}
    event = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[kind], F.lit("unsupported"))
    rule = F.when(kind == "commencement", F.when(day != "", "fixed_date").when(F.coalesce("contingent", F.lit(False)), "pending_decree").otherwise("immediate"))
    effective = F.when(kind == "commencement", F.when(rule == "fixed_date", day).when(rule == "pending_decree", "").otherwise(source)).when(kind == "revival", day).when(kind == "applicability", source).otherwise("")
    after = F.coalesce(F.date_format(F.date_add(F.try_to_date(day, "yyyy-MM-dd"), 1), "yyyy-MM-dd"), F.lit(""))
    expires = F.when(kind == "expiry", after).when(kind == "suspension", day).otherwise("")
    predicate = F.when(kind == "applicability", F.coalesce(F.nullif(F.trim("raw_text"), F.lit("")), F.lit("applicability")))
    return intents.select(F.concat_ws(":", "group_id", (F.col("nth") + 1).cast("string")).alias("event_id"), "group_id", event.alias("kind"), effective.alias("effective"), expires.alias("expires"), rule.alias("activation"), predicate.alias("predicate"), "statute", kind.alias("derived_from"))

"""Why two texts of one section differ: canonical form, sentence alignment and typed reasons, as expressions over pairs of texts.

Everything runs inside the scan of the pairs: no shuffle and no Python. Edit distances are those of ``levenshtein`` with a bound, so that they cost
length times bound and not length squared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of markup left in text, editorial notices, and words of temporary acts.
CORRUPTION = r"[<>]|&lt;|&gt;|&amp;|&quot;|&apos;"
REPEAL_STUB = r"(?i)^(?:\d+\s*[a-zäöå]?\s*§\s*)?\d+\s*[a-zäöå]?\s*§\s+on\s+kumottu\s+[LAP](?::ll[äa])?\s+(?:\d{1,2}\.\d{1,2}\.)?(\d{4})/(\d+)\s*\.?\s*$"
PRIOR_WORDING = r"(?is)\bon\s+kumottu\b.{0,500}?\baiempi\s+sanamuoto\s+kuuluu\s*:"
FUTURE_REPEAL = r"(?is)on\s+kumottu\b.{0,500}?\bjoka\s+tulee\s+voimaan\b.{0,500}?\baiempi\s+sanamuoto\s+kuuluu\s*:"
SECTION_PREFIX = r"(?i)^\d+\s*[a-zäöå]?\s*§\s*"
#: Edits that are tiny whatever the length; the most that a bounded phrase may differ by; a difference in length that is more than wording.
TINY, PHRASE, MUCH = 3, 200, 40


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squashed(text: Column) -> Column:
    # a single space stays as it is, so that most texts are not written again
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s{2,}|[^\S ]", " "))


def plain(text: Column) -> Column:
    """Letters and digits in lower case: what is compared."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9äöå]+", "")


def sentences(text: Column) -> Column:
    """The sentences of a text in letters and digits; those without any are left out."""
    return F.filter(F.transform(F.split(squashed(text), r"(?<=[.!?])\s+"), plain), lambda s: s != "")


def is_stub(text: Column) -> Column:
    """Whether nothing but a section number (once or twice) and a dozen letters is there."""
    bare = F.regexp_replace(F.regexp_replace(squashed(text), SECTION_PREFIX, ""), SECTION_PREFIX, "")
    return F.char_length(F.regexp_replace(F.lower(bare), "[^a-zäöå]", "")) <= 12


def repealed_by(text: Column) -> Column:
    """The act that a repeal notice in place of a section names, as year/number; null if the text is no such notice."""
    t = squashed(text)
    return F.when(t.rlike(REPEAL_STUB), F.concat_ws("/", F.regexp_extract(t, REPEAL_STUB, 1), F.regexp_extract(t, REPEAL_STUB, 2).cast("int").cast("string")))


def without_first_extra(longer: Column, shorter: Column) -> Column:
    """``longer`` less its first item that is not the one of ``shorter`` at its place: if they differ by that one item, ``shorter``."""
    size = F.size(shorter)
    at = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), F.size(longer)), lambda i: ~F.coalesce((i <= size) & (F.get(longer, i - 1) == F.get(shorter, i - 1)), F.lit(False))), True), F.lit(0)).cast("int")
    return let(at, lambda k: F.concat(F.slice(longer, F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(longer, k + 1, F.greatest(F.size(longer) - k, F.lit(0)))))


def extra_sentences(oracle: Column, replay: Column, most: int = 2) -> Column:
    """How many sentences of ``oracle`` have to go so that the rest are those of ``replay``, in order: 1 to ``most``, or null. Both are arrays."""

    def after(k: int, rest: Column) -> Column:
        same = F.when(rest == replay, F.lit(k))
        return same if k == most else F.when(rest == replay, F.lit(k)).when(F.size(rest) > F.size(replay), let(without_first_extra(rest, replay), lambda less: after(k + 1, less)))

    some = F.size(oracle) - F.size(replay)
    return F.when((some >= 1) & (some <= most) & (F.size(replay) > 0), let(without_first_extra(oracle, replay), lambda less: after(1, less)))


def repeated_extra(oracle: Column, replay: Column) -> Column:
    """Whether the one sentence that ``oracle`` has more is one that ``replay`` has once and ``oracle`` twice."""
    counted = lambda a, s: F.size(F.filter(a, lambda x: x == s))
    doubled = F.exists(oracle, lambda s: (counted(oracle, s) >= 2) & (counted(replay, s) == 1))
    return F.when(F.size(oracle) == F.size(replay) + 1, (F.coalesce(extra_sentences(oracle, replay, 1) == 1, F.lit(False))) & doubled).otherwise(F.lit(False))


def close(a: Column, b: Column, bound: Column | int) -> Column:
    """Whether two strings are at most ``bound`` edits apart, and ``bound`` at most that of a phrase. The distance is computed once, and only of strings
    whose lengths allow it."""
    most = bound if isinstance(bound, int) else PHRASE
    top = F.lit(bound) if isinstance(bound, int) else bound
    far = F.pmod(F.levenshtein(a, b, most), F.lit(most + 2))  # beyond ``most`` it is -1, here most + 1
    return F.coalesce(F.when(F.abs(F.char_length(a) - F.char_length(b)) <= top, far <= F.least(top, F.lit(most))), F.lit(False))


def divergence_reason(replay: Column, oracle: Column, blamed: Column) -> Column:
    """struct(code, reason) for a section's text by replay and in an oracle; ``blamed`` is the action of the op that last wrote it, or null.

    In this order: identical; editorial_convention (a bare stub, or the same letters and digits); oracle_stale (a repeal notice with the prior
    wording, a sentence twice, or one or two sentences that replay no longer has); source_pathology (within three edits; or one bounded phrase
    with marks of markup or no op to blame); oracle_stale or replay_extra (replay is longer by more than 40, with or without a replacement or
    insertion to blame), replay_missing (shorter by more than 40), and unknown."""
    of = lambda code, reason: F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
    put = F.coalesce(blamed.isin("REPLACE", "INSERT"), F.lit(False))

    # each step is evaluated only where those before it say nothing, and what it reads more than once is evaluated once
    def of_lengths(r: Column, o: Column, marked: Column) -> Column:
        shorter, longer = F.least(F.char_length(r), F.char_length(o)), F.greatest(F.char_length(r), F.char_length(o))
        more = F.char_length(r) - F.char_length(o)
        phrase = (shorter > 0) & (shorter >= 0.6 * longer) & (blamed.isNull() | marked) & close(r, o, F.least(F.floor(0.1 * longer).cast("int"), F.lit(PHRASE)))
        return (
            F.when((shorter > 0) & close(r, o, TINY), of("source_pathology", "tiny_edit")).when(phrase, of("source_pathology", "bounded_phrase"))
            .when((more > MUCH) & put, of("oracle_stale", "amendment_not_in_oracle")).when(more > MUCH, of("replay_extra", "much_more_text"))
            .when(more < -MUCH, of("replay_missing", "much_less_text")).otherwise(of("unknown", "similar_length"))
        )

    def of_sentences(p: Column) -> Column:
        marked = F.coalesce(replay, F.lit("")).rlike(CORRUPTION) | F.coalesce(oracle, F.lit("")).rlike(CORRUPTION)
        return let(
            F.struct(sentences(oracle).alias("o"), sentences(replay).alias("r")),
            lambda s: F.when(repeated_extra(s["o"], s["r"]), of("oracle_stale", "duplicate_sentence")).when(extra_sentences(s["o"], s["r"]).isNotNull(), of("oracle_stale", "residual_sentences")).otherwise(of_lengths(p["r"], p["o"], marked)),
        )

    def of_letters(p: Column) -> Column:
        return F.when(p["r"] == p["o"], of("editorial_convention", "same_letters")).otherwise(of_sentences(p))

    def of_notice(t: Column) -> Column:
        return (
            F.when(t.rlike(REPEAL_STUB), of("oracle_stale", "repeal_notice")).when(t.rlike(FUTURE_REPEAL), of("oracle_stale", "future_repeal_overlay"))
            .when(t.rlike(PRIOR_WORDING), of("oracle_stale", "repeal_with_prior_wording")).when(is_stub(t), of("editorial_convention", "bare_stub"))
            .otherwise(let(F.struct(plain(replay).alias("r"), plain(oracle).alias("o")), of_letters))
        )

    return F.when(F.coalesce(replay, F.lit("")) == F.coalesce(oracle, F.lit("")), of("identical", "same_text")).otherwise(let(squashed(oracle), of_notice))


# ---------------------------------------------------------------- canonical form


def each(text: Column, finds: str | list[str], put: str) -> Column:
    """``text`` with each of the strings replaced: plain search costs a fraction of a pattern, most of all where nothing is found."""
    return reduce(lambda t, find: F.replace(t, F.lit(find), F.lit(put)), finds, text)


def single_spaces(text: Column) -> Column:
    spaced = each(text, "\t\n\x0b\f\r\u00a0\u2007\u202f", " ")
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)


def closed_marks(text: Column) -> Column:
    """No space before a mark; there is one at most."""
    return reduce(lambda t, mark: each(t, [f" {mark}"], mark), ",.;:!?)", text)


def section_sign(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("§")), F.regexp_replace(text, r"(\d[a-zåäö]?)\s*§", "$1 §")).otherwise(text)


#: What the canonical form rewrites, in order; each has a name that says so where it fires.
CANONICAL = (
    ("soft_hyphen", lambda t: each(t, "\u00ad", "")), ("spaces", single_spaces), ("dashes", lambda t: each(t, "‐‑‒–—―", "-")), ("double_quotes", lambda t: each(t, "“”„«»", '"')), ("single_quotes", lambda t: each(t, "‘’‚`´", "'")), ("space_before_mark", closed_marks), ("section_sign", section_sign),
)

#: A label, NUL and a text: the label, NUL and what the text says of the label at its beginning. One pattern serves all labels; one made of the row's label
#: would be compiled for each row.
SECTION_LABEL = r"(?i)^([^\x00]+)\x00(?:\s*\1\s*§[.:]?\s*)?"
ITEM_LABEL = r"(?i)^([^\x00]+)\x00(?:\s*\1\s*\)\s*)?"


def without_label(text: Column, label: Column, kind: Column) -> Column:
    """``text`` without the label, and its "§" or ")", that it begins with. Neither text nor label is null."""
    labelled = F.concat(label, F.lit("\0"), text)
    # a label with NUL cannot be told from the text behind it by the patterns
    quoted = F.regexp_replace(label, r"([^A-Za-z0-9åäöÅÄÖ ])", r"\\$1")
    behind = F.when(kind == "section", r"\s*§[.:]?\s*").otherwise(r"\s*\)\s*")
    return (
        F.when((label == "") | ~F.contains(text, F.when(kind == "section", "§").otherwise(")")), text)
        .when(F.contains(label, F.lit("\0")), F.regexp_replace(text, F.concat(F.lit(r"(?i)^\s*"), quoted, behind), F.lit("")))
        .when(kind == "section", F.regexp_replace(labelled, SECTION_LABEL, "")).otherwise(F.regexp_replace(labelled, ITEM_LABEL, ""))
    )


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, addr, kind, label, text, status) with ``canonical``, ``fired`` and ``occupancy``.

    The text loses what its label says already (a leading "3 §" of section 3, "2)" of item 2), and differences of typography; ``fired`` names each
    rule that changed it. The form is idempotent. occupancy: tombstone, empty (no letter or digit) or substantive."""
    text = F.coalesce("text", F.lit(""))
    elided = without_label(text, F.coalesce("label", F.lit("")), F.col("kind"))
    steps = nodes.withColumn("__t0", text).withColumn("__t1", elided)
    names = ["label_prefix"]
    for k, (name, rule) in enumerate(CANONICAL):
        steps = steps.withColumn(f"__t{k + 2}", rule(F.col(f"__t{k + 1}")))
        names.append(name)
    last = f"__t{len(CANONICAL) + 1}"
    fired = F.array_compact(F.array(*(F.when(F.col(f"__t{k}") != F.col(f"__t{k + 1}"), name) for k, name in enumerate(names))))
    done = steps.withColumn("canonical", F.trim(last)).withColumn("fired", fired)
    # no rule of typography adds or takes a letter or digit, so a filter on occupancy does not evaluate them
    occupancy = F.when(F.col("status") == "tombstone", "tombstone").when(~F.col("__t1").rlike(r"[\p{L}\p{N}]"), "empty").otherwise("substantive")
    return done.withColumn("occupancy", occupancy).drop(*(f"__t{k}" for k in range(len(CANONICAL) + 2)))


def canonical_residuals(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, addr, residual, elisions) of two sides in canonical form: missing_left, missing_right, occupancy, kind or text, one for each address at
    which they are not equal; tombstones and empty nodes are equal to nothing at all. ``elisions`` lists the rules that fired on either side."""
    side = lambda df, x: df.filter("occupancy = 'substantive'").select("doc_id", "addr", F.col("kind").alias(f"{x}_kind"), F.col("canonical").alias(f"{x}_text"), F.col("fired").alias(f"{x}_fired"))
    both = side(left, "l").join(side(right, "r"), ["doc_id", "addr"], "full")
    residual = F.when(F.col("l_text").isNull(), "missing_left").when(F.col("r_text").isNull(), "missing_right").when(~F.col("l_kind").eqNullSafe(F.col("r_kind")), "kind").when(F.col("l_text") != F.col("r_text"), "text")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "addr", residual.alias("residual"), F.array_sort(F.array_union(F.coalesce("l_fired", none), F.coalesce("r_fired", none))).alias("elisions")).filter("residual is not null")


# ---------------------------------------------------------------- timeline dedupe


def dedupe_timeline(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, records) of versions (addr, source, effective, enacted, expires, variant, applicability, shape, content, pos).

    Three rules among versions of one address, source, moment and rail; versions without source are left alone:

    * absent_content_shadow: those without content go where one has some;
    * relabel_snapshot_shadow: snapshots of a restructuring (shape 'relabel') go where a version with a body of its own stands beside them;
      where there are only shells (shape 'shell': a number and no body), relabel_shell_shadow: the shells go. Versions of shape 'renumber' count as
      neither;
    * same_source_semantic: of versions that also share expiry, applicability and text (white space and the space before § aside) the last
      stays, at the place of the first.

    ``records`` has a row for each group and rule, with how many versions went. One shuffle: all three go by the same keys."""
    moment = ["addr", "source", "effective", "enacted", "variant"]
    sourced = F.coalesce(F.col("source"), F.lit("")) != ""
    has = F.col("content").isNotNull()
    shape = F.coalesce(F.col("shape"), F.lit(""))
    relabel, shell = has & (shape == "relabel"), has & (shape == "shell")
    body = has & ~shape.isin("relabel", "renumber", "shell")
    any_ = lambda c: F.max(c.cast("int")).over(Window.partitionBy(*moment)) == 1
    flagged = versions.withColumns({"__some": any_(has), "__relabel": any_(relabel), "__body": any_(body), "__shell": any_(shell)})
    rule = (
        F.when(~sourced, None).when(~has & F.col("__some"), "absent_content_shadow").when(relabel & F.col("__body"), "relabel_snapshot_shadow").when(shell & F.col("__relabel") & ~F.col("__body"), "relabel_shell_shadow")
    )
    text = F.regexp_replace(F.trim(F.regexp_replace("content", r"\s+", " ")), r"(\d[A-Za-zåäö]?)\s*§", "$1 §")
    judged = flagged.withColumn("__rule", rule).withColumn("__text", text).withColumn("__left", F.col("__rule").isNull() & sourced & has)
    same = Window.partitionBy(*moment, "__left", "expires", "applicability", "__text")
    ranked = judged.withColumns({"__last": F.max("pos").over(same), "__first": F.min("pos").over(same)})
    final = ranked.withColumn("rule", F.when(F.col("__rule").isNotNull(), F.col("__rule")).when(F.col("__left") & (F.col("pos") < F.col("__last")), "same_source_semantic"))
    place = F.when(F.col("__left"), F.col("__first")).otherwise(F.col("pos"))
    kept = final.filter("rule is null").select(*versions.columns, place.alias("place"))
    records = final.filter("rule is not null").groupBy(*moment, "rule").agg(F.count(F.lit(1)).alias("removed"))
    return kept, records

"""References that leave something out: elliptical and anaphoric ones, sets written as ranges, terms and where they are defined.

All of it is joins, aggregations and windows by document; a window runs over the mentions of one document in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- elliptical references


def section_structure(nodes: DataFrame) -> DataFrame:
    """(doc, section, subsections, carriers) out of nodes (doc, section, subsection, item): the subsections that a section has, and
    those of them that have items, in order."""
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return nodes.filter("section is not null").groupBy("doc", "section").agg(distinct("subsection").alias("subsections"), distinct(F.when(F.col("item").isNotNull(), F.col("subsection"))).alias("carriers"))


def resolve_elliptical(mentions: DataFrame, structure: DataFrame) -> DataFrame:
    """Mentions (doc, pos, section, ref_section, ref_subsection, ref_item, anaphor) with what they leave out filled in.

    ``section`` is where a mention stands; ``anaphor`` is null, 'section' ("the said section") or 'subsection'. Adds the columns
    to_section, to_subsection, to_item, status, confidence, candidates:

    * not_elliptical: it names its section, or names nothing;
    * resolved: a bare subsection is one of the section that it stands in (exact where that section has it, approximate where it is
      only drafting convention); a bare item is of the one subsection there that has items; an anaphor takes the section (and
      subsection) of the mention before it that is no anaphor, however far back and in whichever section;
    * ambiguous: no or several subsections have items (candidates lists them), or an anaphor goes back to a place where several
      targets are named, or to a mention that is ambiguous itself. None is picked;
    * open: it stands in no section, or an anaphor has nothing before it, or goes back to something that names no such part.

    Mentions of one ``pos`` are one expression. Nulls in ``doc`` are a document of their own. Rows are kept as they are.
    """
    at = mentions.withColumn("__anaphor", F.col("anaphor").isNotNull())
    known = structure.select(F.col("doc").alias("__doc"), F.col("section").alias("__section"), "subsections", "carriers")
    joined = at.join(known, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("section") == F.col("__section")), "left")
    names = F.col("ref_section").isNotNull() | (F.col("ref_subsection").isNull() & F.col("ref_item").isNull())
    one = F.size("carriers") == 1
    bare_item = F.col("ref_subsection").isNull()
    status = F.when(names, "not_elliptical").when(F.col("section").isNull(), "open").when(bare_item & ~F.coalesce(one, F.lit(False)), "ambiguous").otherwise("resolved")
    listed = F.coalesce(F.array_contains("subsections", F.col("ref_subsection")), F.lit(False))
    own = joined.withColumn("status", F.when(~F.col("__anaphor"), status))
    filled = own.withColumns({
        "to_section": F.when(F.col("status") == "not_elliptical", F.col("ref_section")).when(F.col("status") == "resolved", F.col("section")),
        "to_subsection": F.when(F.col("status").isin("not_elliptical", "resolved"), F.coalesce("ref_subsection", F.when(~names & one, F.element_at("carriers", 1)))),
        "candidates": F.when(F.col("status") == "ambiguous", F.coalesce("carriers", F.array().cast("array<int>"))),
        "confidence": F.when(F.col("status") == "resolved", F.when(bare_item | F.col("ref_item").isNotNull() | listed, "exact").otherwise("approximate")).when((F.col("status") == "not_elliptical") & F.col("ref_section").isNotNull(), "exact"),
    })
    # what an expression hands on: its one target, or that it has none to give
    there = F.struct("to_section", "to_subsection")
    given = filled.filter(~F.col("__anaphor") & (F.col("ref_section").isNotNull() | F.col("ref_subsection").isNotNull() | F.col("ref_item").isNotNull()))
    antecedents = given.groupBy("doc", "pos").agg(F.count_distinct(F.when(F.col("to_section").isNotNull(), there)).alias("n"), F.min(there).alias("target"), F.max(F.col("status") == "ambiguous").alias("unclear"), F.max(F.col("status") == "open").alias("nowhere"))
    carried = antecedents.select("doc", "pos", F.struct("n", "target", "unclear", "nowhere").alias("from"))
    places = filled.select("doc", "pos").distinct().join(carried.select(F.col("doc").alias("__d"), F.col("pos").alias("__p"), "from"), F.col("doc").eqNullSafe(F.col("__d")) & (F.col("pos") == F.col("__p")), "left").select("doc", "pos", "from")
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = places.select(F.col("doc").alias("__ad"), F.col("pos").alias("__ap"), F.last("from", ignorenulls=True).over(before).alias("from"))
    back = filled.join(last, F.col("doc").eqNullSafe(F.col("__ad")) & (F.col("pos") == F.col("__ap")), "left")
    missing = F.col("from").isNull() | F.col("from.nowhere") | (F.col("from.n") == 0) | ((F.col("anaphor") == "subsection") & F.col("from.target.to_subsection").isNull())
    unclear = F.coalesce(F.col("from.unclear") | (F.col("from.n") > 1), F.lit(False))
    anaphoric = F.when(unclear, "ambiguous").when(missing, "open").otherwise("resolved")
    takes = F.col("__anaphor") & (anaphoric == "resolved")
    done = back.withColumns({
        "status": F.when(F.col("__anaphor"), anaphoric).otherwise(F.col("status")),
        "to_section": F.when(takes, F.col("from.target.to_section")).otherwise(F.col("to_section")),
        "to_subsection": F.when(takes, F.when(F.col("anaphor") == "subsection", F.col("from.target.to_subsection")).otherwise(F.col("ref_subsection"))).otherwise(F.col("to_subsection")),
        "confidence": F.when(takes, "anaphoric").otherwise(F.col("confidence")),
    })
    to_item = F.when(F.col("status").isin("resolved", "not_elliptical"), F.col("ref_item"))
    return done.select(*mentions.columns, "to_section", "to_subsection", to_item.alias("to_item"), "status", "confidence", "candidates")


# ---------------------------------------------------------------- reference sets

_LIST = r"\s*(?:,|;|\b(?:and|or|ja|sekä|tai)\b)\s*"
_RANGE = r"^(\d+)\s?([a-z]?)\s*[-‐‑‒–—]\s*(\d+)\s?([a-z]?)$"
_SINGLE = r"^(\d+)\s?([a-z]*)$"


def label_set(written: Column, longest: int = 2000) -> Column:
    """struct(labels, rejected, kind) of a written list such as "1-3, 3a and 5": every label that it denotes, in its order and once,
    what is no label or range (backwards, or over ``longest`` long), and its shape: none, single, range, coordination, mixed."""
    parts = F.filter(F.split(F.lower(F.trim(F.coalesce(written, F.lit("")))), _LIST), lambda p: p != "")

    def members(p: Column) -> Column:
        number = lambda k: F.regexp_extract(p, _RANGE, k)
        low, high, a, b = number(1).try_cast("long"), number(3).try_cast("long"), number(2), number(4)
        numbers = F.when((a == "") & (b == "") & (low < high) & (high - low < longest), F.transform(F.sequence(low, high), lambda n: n.cast("string")))
        letters = F.when((low == high) & (a != "") & (a < b), F.transform(F.sequence(F.ascii(a), F.ascii(b)), lambda c: F.concat(low.cast("string"), F.char(c))))
        single = F.when(p.rlike(_SINGLE), F.array(F.concat(F.regexp_extract(p, _SINGLE, 1), F.regexp_extract(p, _SINGLE, 2))))
        return F.struct(p.alias("part"), F.coalesce(F.when(p.rlike(_RANGE), F.coalesce(numbers, letters)), single).alias("labels"), p.rlike(_RANGE).alias("ranged"))

    read = F.transform(parts, members)
    labels = F.array_distinct(F.flatten(F.transform(F.filter(read, lambda r: r["labels"].isNotNull()), lambda r: r["labels"])))
    rejected = F.transform(F.filter(read, lambda r: r["labels"].isNull()), lambda r: r["part"])
    ranged = F.exists(read, lambda r: r["ranged"])
    kind = F.when(F.size(parts) == 0, "none").when(F.size(parts) == 1, F.when(ranged, "range").otherwise("single")).when(ranged, "mixed").otherwise("coordination")
    return F.struct(labels.alias("labels"), rejected.alias("rejected"), kind.alias("kind"))


def written_labels(labels: Column, conjunction: str = "and", dash: str = "-", least: int = 3) -> Column:
    """The shortest way to write a set of labels: sorted by number and letters, runs of ``least`` or more as a range."""
    key = lambda x: F.struct(F.regexp_extract(x, _SINGLE, 1).try_cast("long").alias("n"), F.regexp_extract(x, _SINGLE, 2).alias("s"), x.alias("x"))
    ordered = F.array_sort(F.transform(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())), key))
    run = "array<struct<n:bigint,s:string,x:string>>"

    def follows(a: Column, b: Column) -> Column:
        """Within a run: the next number, or the next letter of the same number."""
        numbers = (a["s"] == "") & (b["s"] == "") & (b["n"] == a["n"] + 1)
        letters = (a["n"] == b["n"]) & (F.char_length(a["s"]) == 1) & (F.char_length(b["s"]) == 1) & (F.ascii(b["s"]) == F.ascii(a["s"]) + 1)
        return F.coalesce(numbers | letters, F.lit(False))

    def step(runs: Column, x: Column) -> Column:
        last, begun = F.element_at(runs, -1), F.array(x).cast(run)
        joined = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.concat(last, begun)))
        return F.when((F.size(runs) > 0) & follows(F.element_at(last, -1), x), joined).otherwise(F.concat(runs, F.array(begun)))

    runs = F.aggregate(ordered, F.array().cast(f"array<{run}>"), step)
    whole = lambda r: F.array(F.concat(F.element_at(r, 1)["x"], F.lit(dash), F.element_at(r, -1)["x"]))
    shown = F.flatten(F.transform(runs, lambda r: F.when(F.size(r) >= least, whole(r)).otherwise(F.transform(r, lambda x: x["x"]))))
    head = F.array_join(F.slice(shown, F.lit(1), F.greatest(F.size(shown) - 1, F.lit(0))), ", ")
    return F.when(F.size(shown) > 1, F.concat(head, F.lit(f" {conjunction} "), F.element_at(shown, -1))).otherwise(F.array_join(shown, ""))


def reference_sets(mentions: DataFrame, key: list[str]) -> DataFrame:
    """Flat mentions (key…, target, confidence, surface) folded back into one row an expression: (key…, targets, kind, semantics,
    reference_status).

    candidate_ambiguity if any mention is ambiguous (one of several, none picked); single or all_valid if targets are named, resolved
    if all are; open if all mentions are; no_enumerable_extension otherwise. Targets come sorted, each once."""
    bad = F.col("confidence").isin("unresolved", "broken", "open")
    g = mentions.groupBy(*key).agg(
        F.array_sort(F.collect_set("target")).alias("targets"), F.count(F.lit(1)).alias("n"), F.max(F.col("confidence") == "ambiguous").alias("unclear"), F.min(F.col("confidence") == "open").alias("vague"),
        F.max(F.coalesce(bad, F.lit(True)) | F.col("target").isNull()).alias("partly"), F.min("surface").alias("surface"),
    )
    size = F.size("targets")
    semantics = F.when(F.col("unclear"), "candidate_ambiguity").when((size == 1) & (F.col("n") == 1), "single").when(size > 0, "all_valid").when(F.col("vague"), "open").otherwise("no_enumerable_extension")
    status = F.when(F.col("unclear") | (size == 0), "unresolved").when(F.col("partly") | (size < F.col("n")), "partial").otherwise("resolved")
    dash, listed = F.col("surface").rlike(r"[\dA-Za-zÅÄÖåäö]\s*[-‐‑‒–—]\s*\d"), F.col("surface").rlike(r"(?i)\b(ja|sekä|tai|and|or)\b|,")
    kind = F.when(size <= 1, "single").when(dash & listed, "mixed").when(dash, "range").otherwise("coordination")
    return g.select(*key, "targets", kind.alias("kind"), semantics.alias("semantics"), status.alias("reference_status"))


# ---------------------------------------------------------------- terms and their definitions


def scope_chain(addr: Column) -> Column:
    """The address, what is above it, and '' for the whole document."""
    parts = F.split(addr, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.coalesce(addr, F.lit("")) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), own))


def _depth(scope: Column) -> Column:
    return F.when(scope == "", 0).otherwise(F.size(F.split(scope, "/")))


def resolve_terms(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """Uses (doc, use, term, addr, pos) with the definition (doc, definition, term, scope, pos) that binds them: the columns
    definition, scope, status and shadowed are added.

    A use is bound by the definitions of the innermost scope that holds its address and has one at or before its place: resolved if that is
    one, ambiguous if several, open if there is none; ``shadowed`` counts definitions in outer scopes that it hides. Terms compare in
    lower case, trimmed. Each use meets the scopes above it by equality, so work grows with their depth only."""
    norm = lambda c: F.lower(F.trim(c))
    known = definitions.select(F.col("doc").alias("d_doc"), norm(F.col("term")).alias("d_term"), F.coalesce("scope", F.lit("")).alias("d_scope"), "definition", F.col("pos").alias("d_pos"))
    asked = uses.select("doc", "use", norm(F.col("term")).alias("t"), "pos", F.explode(scope_chain(F.col("addr"))).alias("at"))
    met = asked.join(known, (F.col("doc") == F.col("d_doc")) & (F.col("t") == F.col("d_term")) & (F.col("at") == F.col("d_scope"))).filter("d_pos <= pos")
    by_scope = met.groupBy("doc", "use", "at").agg(F.count(F.lit(1)).alias("n"), F.min("definition").alias("definition"))
    inner = by_scope.groupBy("doc", "use").agg(F.max_by(F.struct("at", "n", "definition"), _depth(F.col("at"))).alias("in"), F.sum("n").alias("all"))
    joined = uses.join(inner.withColumnRenamed("doc", "__doc").withColumnRenamed("use", "__use"), (F.col("doc") == F.col("__doc")) & (F.col("use") == F.col("__use")), "left")
    status = F.when(F.col("in").isNull(), "open").when(F.col("in.n") > 1, "ambiguous").otherwise("resolved")
    return joined.select(*uses.columns, F.when(status == "resolved", F.col("in.definition")).alias("definition"), F.col("in.at").alias("scope"), status.alias("status"), F.coalesce(F.col("all") - F.col("in.n"), F.lit(0)).alias("shadowed"))


def definition_edges(resolved: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc, src, dst): definitions that use terms of other definitions. A use is inside a definition if it stands at the definition's own
    place ``addr``."""
    inside = definitions.select(F.col("doc").alias("__doc"), F.col("definition").alias("src"), F.col("addr").alias("__addr"))
    bound = resolved.filter("status = 'resolved'").select("doc", "addr", F.col("definition").alias("dst"))
    return bound.join(inside, (F.col("doc") == F.col("__doc")) & (F.col("addr") == F.col("__addr"))).select("doc", "src", "dst").filter("src <> dst").distinct()


def definition_lints(resolved: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc, lint, subject, term): used_before_definition and unbound_term (open uses, by whether the term is defined later in a scope that holds
    them), ambiguous_term_use, definition_never_used, duplicate_definition (one term and scope defined more than once)."""
    norm = lambda c: F.lower(F.trim(c))
    row = lambda df, lint, subject: df.select("doc", lint.alias("lint"), F.col(subject).cast("string").alias("subject"), norm(F.col("term")).alias("term"))
    open_ = resolved.filter("status = 'open'").withColumn("at", F.explode(scope_chain(F.col("addr"))))
    scopes = definitions.select(F.col("doc").alias("d_doc"), norm(F.col("term")).alias("d_term"), F.coalesce("scope", F.lit("")).alias("d_scope")).distinct()
    later = open_.join(scopes, (F.col("doc") == F.col("d_doc")) & (norm(F.col("term")) == F.col("d_term")) & (F.col("at") == F.col("d_scope")), "left").groupBy("doc", "use").agg(F.min("term").alias("term"), F.max(F.col("d_scope").isNotNull()).alias("defined"))
    used = resolved.filter("status = 'resolved'").select(F.col("doc").alias("u_doc"), F.col("definition").alias("u_definition")).distinct()
    unused = definitions.join(used, (F.col("doc") == F.col("u_doc")) & (F.col("definition") == F.col("u_definition")), "left_anti")
    twice = definitions.groupBy("doc", norm(F.col("term")).alias("term"), F.coalesce("scope", F.lit("")).alias("subject")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        row(later, F.when(F.col("defined"), "used_before_definition").otherwise("unbound_term"), "use")
        .unionByName(row(resolved.filter("status = 'ambiguous'"), F.lit("ambiguous_term_use"), "use"))
        .unionByName(row(unused, F.lit("definition_never_used"), "definition"))
        .unionByName(row(twice, F.lit("duplicate_definition"), "subject"))
    )

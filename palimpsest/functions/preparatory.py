"""References to preparatory works: government proposals, committee reports and opinions, responses of parliament, initiatives, EU acts and the
Official Journal, typed out of one block of text, with whatever is none of them as rejected candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import _let

# How preparatory works are cited. Of each kind the pattern, with its parts in groups.
HE = r"HE\s+(\d{1,4})/(\d{4})(?:\s+vp)?"
COMMITTEE = r"([A-ZÅÄÖ][a-zåäö]{0,3}V[ML])\s+(\d{1,4})/(\d{4})(?:\s+vp)?"
RESPONSE = r"(EVK?)\s+(\d{1,4})/(\d{4})(?:\s+vp)?"
INITIATIVE = r"LA\s+(\d{1,4})/(\d{4})(?:\s+vp)?"
CELEX = r"3(\d{4})([LRD])(\d{4})"
EU_ACT = r"(?:(direktiivi|asetus|päätös)[a-zäö]*\s+)?\((?:EU|EY|EEY|ETY)\)\s*(?:N:o\s*)?(\d{1,4})/(\d{1,4})"
JOURNAL = r"EUVL\s+([LCS])\s*(\d{1,4})(?:,\s*(\d{1,2}\.\d{1,2}\.\d{4}))?(?:,\s*s\.\s*(\d{1,5}))?"

_NAMED = (("he", HE), ("committee", COMMITTEE), ("response", RESPONSE), ("initiative", INITIATIVE), ("celex", CELEX), ("eu", EU_ACT), ("journal", JOURNAL))
_ANY = "|".join(rf"\b(?:{p})\b" if name in ("he", "committee", "response", "initiative", "celex") else f"(?:{p})" for name, p in _NAMED)


def _whole(raw: Column, pattern: str) -> Column:
    return raw.rlike(f"^(?:{pattern})$")


def _part(raw: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(raw, f"^(?:{pattern})$", group), F.lit(""))


def _number(raw: Column, pattern: str, group: int) -> Column:
    return _part(raw, pattern, group).cast("int")


def _eu(raw: Column) -> Column:
    """form, year, number and celex of an EU act; null fields for anything else."""
    number = lambda p, k: F.regexp_extract(raw, f"^(?:{p})$", k).cast("int")
    of = lambda form, year, n: F.struct(form.alias("form"), year.alias("year"), n.alias("number"))
    form = F.when(raw.startswith("direktiivi"), "L").when(raw.startswith("asetus"), "R").when(raw.startswith("päätös"), "D")

    def act(p: Column) -> Column:
        # since 2015 the year comes first, before that it was the other way round
        first, second = p["first"], p["second"]
        return of(form, F.when(first >= 2015, first).when(second < 100, 1900 + second).otherwise(second), F.when(first >= 2015, second).otherwise(first))

    parts = F.when(_whole(raw, EU_ACT), _let(F.struct(number(EU_ACT, 2).alias("first"), number(EU_ACT, 3).alias("second")), act)).when(_whole(raw, CELEX), of(_part(raw, CELEX, 2), number(CELEX, 1), number(CELEX, 3)))
    celex = lambda e: F.when(e["form"].isNotNull() & e["year"].isNotNull(), F.concat(F.lit("3"), e["year"].cast("string"), e["form"], F.lpad(e["number"].cast("string"), 4, "0")))
    return _let(parts, lambda e: F.struct(e["form"].alias("form"), e["year"].alias("year"), e["number"].alias("number"), celex(e).alias("celex")))


def _named(raw: Column) -> Column:
    """kind and canonical_id of one citation. A citation is read for its own kind only, and its name is what its pattern leaves, without leading zeros."""
    of = lambda kind, name: F.struct(kind.alias("kind"), name.alias("canonical_id"))
    name = lambda p, put: F.regexp_replace(raw, "^(?:" + p.replace(r"(\d{1,4})", r"0*(\d{1,4})", 1) + ")$", put)

    def act(e: Column) -> Column:
        unnamed = F.concat(F.lit("EU "), e["year"].cast("string"), F.lit("/"), e["number"].cast("string"))
        return of(F.when(e["form"] == "L", "eu_directive").when(e["form"] == "D", "eu_decision").otherwise("eu_regulation"), F.coalesce(e["celex"], unnamed))

    return (
        F.when(_whole(raw, HE), of(F.lit("he"), name(HE, "HE $1/$2")))
        .when(_whole(raw, COMMITTEE), of(F.when(F.contains(raw, F.lit("VM")), "committee_report").otherwise("committee_opinion"), name(COMMITTEE, "$1 $2/$3")))
        .when(_whole(raw, RESPONSE), of(F.when(raw.startswith("EVK"), "parliament_response_comm").otherwise("parliament_response"), name(RESPONSE, "$1 $2/$3")))
        .when(_whole(raw, INITIATIVE), of(F.lit("law_initiative"), name(INITIATIVE, "LA $1/$2")))
        .when(_whole(raw, JOURNAL), of(F.lit("oj_reference"), name(JOURNAL, "EUVL $1 $2")))
        .otherwise(_let(_eu(raw), act))
    )


def _found(text: Column) -> Column:
    """The citations of a text, as they are written."""
    return F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))


def _squashed(text: Column) -> Column:
    spaced = reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r")))
    return F.trim(F.when(spaced, F.regexp_replace(text, r"\s+", " ")).otherwise(text))


def named_works(text: Column) -> Column:
    """kind and canonical_id of the references of a text in their order, as those of :func:`preparatory_references`; null text has null.

    They are read expression by expression: one generated method for all fields of a reference is longer than the JVM compiles, and would be interpreted."""
    return F.transform(_found(_squashed(text)), lambda raw: _let(F.trim(raw), _named))


def _typed(found: DataFrame, key: str) -> DataFrame:
    """The fields of citations (nth, raw). Their names and what they have of EU acts are evaluated once, by a step of their own."""
    raw, e = F.col("raw"), lambda name: F.col("__e")[name]
    vague = (_whole(raw, EU_ACT) & e("form").isNull()) | (_whole(raw, JOURNAL) & _part(raw, JOURNAL, 3).isNull())
    return found.select(key, "nth", "raw", _named(raw).alias("__n"), _eu(raw).alias("__e")).select(
        key, "nth", F.coalesce(F.col("__n")["kind"], F.lit("eu_regulation")).alias("kind"), F.col("__n")["canonical_id"].alias("canonical_id"), raw.alias("raw_text"), _part(raw, COMMITTEE, 1).alias("committee_abbrev"), _number(raw, HE, 2).alias("he_year"), _number(raw, HE, 1).alias("he_number"),
        e("form").alias("eu_form"), e("celex").alias("celex"), e("number").alias("eu_number"), e("year").alias("eu_year"), _part(raw, JOURNAL, 1).alias("oj_series"), F.date_format(F.try_to_date(_part(raw, JOURNAL, 3), "d.M.yyyy"), "yyyy-MM-dd").alias("oj_date"),
        _number(raw, JOURNAL, 2).alias("oj_number"), _number(raw, JOURNAL, 4).alias("oj_page"), F.when(vague, "approximate").otherwise("exact").alias("confidence"),
    )


def preparatory_references(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(references, rejected) of texts: references in their order (nth from 0) with their typed fields, and what stands between them and holds a letter
    or a digit. An EU act whose kind is not named counts as a regulation, and like a journal without date, as approximate. Null text has neither."""
    base = docs.select(key, _squashed(F.col(text)).alias("__t"))
    rows = base.select(key, F.posexplode(_found(F.col("__t"))).alias("nth", "raw")).select(key, F.col("nth").cast("long").alias("nth"), F.trim("raw").alias("raw"))
    references = _typed(rows, key)
    between = base.select(key, F.explode(F.split("__t", _ANY)).alias("candidate")).withColumn("candidate", F.regexp_replace("candidate", r"^[\s,;.()]+|[\s,;.()]+$", ""))
    return references, between.filter(F.col("candidate").rlike(r"[\p{L}\p{N}]"))

"""Mention producers: prose into typed rows. Patterns run as built-in expressions; every producer returns its rows and the
candidates that it recognised and rejected, so nothing goes unaccounted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Producer:
    """``pattern`` finds candidates (group 1 is the id); ``accept`` decides; ``kind`` names the rows."""

    kind: str
    pattern: str
    accept: str = ".*"


#: Citations, emails, amounts, dates, section and act references, modal duties.
PRODUCERS = (
    Producer("act", r"\b(\d{1,4}/\d{4})\b", r"^\d{1,4}/(1[89]|20)\d\d$"),
    Producer("section", r"(§\s?\d+[a-z]?)"),
    Producer("date", r"\b(\d{4}-\d{2}-\d{2})\b", r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"),
    Producer("quantity", r"\b(\d+(?:[.,]\d+)?\s?(?:%|euros?|EUR|dollars?|days?|months?|years?))", r"^[1-9].*"),
    Producer("license", r"(?i)(licensed under the [a-z]+ license)"),
    Producer("address", r"([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"),
    Producer("modal", r"(?i)\b(shall not|shall|must not|must|may not|may)\b"),
)


def mentions(docs: DataFrame, key: str, text: str, producers: tuple[Producer, ...] = PRODUCERS) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): (key, kind, raw, nth), the nth mention of its kind in the text from 0."""

    def found(p: Producer) -> Column:
        raw = F.regexp_extract_all(F.col(text), F.lit(p.pattern), F.lit(1))
        return F.transform(raw, lambda r, i: F.struct(F.lit(p.kind).alias("kind"), r.alias("raw"), i.cast("long").alias("nth"), r.rlike(p.accept).alias("ok")))

    rows = docs.select(key, F.explode(F.concat(*map(found, producers))).alias("m")).select(key, "m.kind", "m.raw", "m.nth", "m.ok")
    return rows.filter("ok").drop("ok"), rows.filter("not ok").drop("ok")


def actor_duties(docs: DataFrame, key: str, text: str, actors: tuple[str, ...]) -> DataFrame:
    """(key, actor, modal, n): an actor followed by a modal verb within its sentence."""
    who = "|".join(actors)
    hits = F.regexp_extract_all(F.col(text), F.lit(rf"(?i)\b((?:{who})\b[^.!?]*?\b(?:shall|must|may))\b"), F.lit(1))
    rows = docs.select(key, F.explode(hits).alias("h"))
    return rows.select(key, F.lower(F.regexp_extract("h", rf"(?i)^({who})", 1)).alias("actor"), F.lower(F.regexp_extract("h", r"(\w+)$", 1)).alias("modal")).groupBy(key, "actor", "modal").agg(F.count(F.lit(1)).alias("n"))


def amendment_ops(clauses: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, action, target): an amendment clause, split into ops by its verbs."""
    parts = F.split(F.col(text), r"\s*;\s*")
    rows = clauses.select(key, F.posexplode(parts).alias("nth", "clause"))
    verb = F.lower(F.regexp_extract("clause", r"(?i)\b(repealed|replaced|amended|inserted|added|renumbered)\b", 1))
    action = F.when(verb == "repealed", "REPEAL").when(verb.isin("replaced", "amended"), "REPLACE").when(verb.isin("inserted", "added"), "INSERT").when(verb == "renumbered", "RENUMBER")
    target = F.regexp_extract("clause", r"(?i)section\s+(\d+[a-z]?)", 1)
    return rows.select(key, F.col("nth").cast("long").alias("nth"), action.alias("action"), F.when(target != "", F.concat(F.lit("section:"), target)).alias("target"))


def definitions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): terms that a text defines, written '"term" means'."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit('"([^"]{1,80})" means'), F.lit(1))).alias("term")).distinct()


def term_uses(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term, n): uses of one-word terms, by a join on words rather than a search per term."""
    words = docs.select(key, F.explode(F.split(F.lower(F.col(text)), r"(?U)[^\w]+")).alias("term"))
    return words.join(terms.select(F.lower("term").alias("term")).distinct(), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles and comments out, tags to spaces, common entities back."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    plain = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))

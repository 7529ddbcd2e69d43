"""Frames of statutory prose: who may issue what, what a breach costs, what is excepted and on what condition, and from when to when.

Frames are facts of the surface, read sentence by sentence from closed vocabularies by built-in expressions. A sentence that has a frame's trigger but not
what the frame needs is a rejected candidate with a reason: nothing is guessed and nothing is lost in silence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import _let

# The closed vocabularies of the frames. Behind a pattern stands what every match holds: plain search for that comes first.
INSTRUMENTS = (("asetus", r"\basetu(?:s|ks)[a-zäö]*", ["asetu"]), ("määräys", r"\bmääräy[a-zäö]*", ["määräy"]), ("ohje", r"\bohjei?[a-zäö]*", ["ohje"]), ("päätös", r"\bpäätö[a-zäö]*", ["päätö"]))
GRANTS = r"\b(?:säädetään|annetaan|antaa|määrätään|päättää|säätää|vahvistetaan|voidaan|voi)\b"
MAY = r"\b(?:voidaan|voi)\b"
ISSUERS = r"(?:valtioneuvosto|tasavallan presidentti|[a-zäö]*ministeriö|[a-zäö]*viranomainen|[a-zäö]*viranomaisen|[a-zäö]*virasto|[a-zäö]*laitos|[a-zäö]*laitoksen)"
SANCTIONS = (("uhkasakko", r"\buhkasak?ko?[a-zäö]*", ["uhkasa"]), ("seuraamusmaksu", r"\b[a-zäö]*seuraamusmaksu[a-zäö]*", ["seuraamusmaksu"]), ("vahingonkorvaus", r"\bvahingonkorvau[a-zäö]*", ["vahingonkorvau"]), ("rangaistus", r"\b(?:rangais[a-zäö]*|tuomita[a-zäö]*)", ["rangais", "tuomita"]), ("sakko", r"\bsak?ko[a-zäö]*", ["sakko", "sako"]))
REVOKES, PERMITS = r"\bperuu(?:tta|te)[a-zäö]*", r"\b(?:toimi)?(?:lupa|luvan|luvas|luvol|lup)[a-zäö]*"
EXCEPTIONS = ("poiketen siitä mitä", "ei kuitenkaan", "lukuun ottamatta", "sen estämättä", "jollei", "paitsi", "ellei")
CONDITIONS = ("sillä edellytyksellä että", "edellyttäen että", "siltä osin kuin", "mikäli", "jos", "kun")
MONTHS = ("tammi", "helmi", "maalis", "huhti", "touko", "kesä", "heinä", "elo", "syys", "loka", "marras", "joulu")

_LONG = r"(\d{1,2})\s+päivä(?:nä|än|stä)\s+(" + "|".join(MONTHS) + r")kuuta\s+(\d{4})"
_NUMERIC = r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"


def prose_date(text: Column) -> Column:
    """The first day that a sentence names, "1 päivänä tammikuuta 2020" or "1.1.2020", as ISO; null if there is none or it is not a day."""
    return _date_in(F.lower(text))


def _date_in(low: Column) -> Column:
    month = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, f"{k:02d}")))
    spelled = F.concat_ws("-", F.regexp_extract(low, _LONG, 3), month[F.regexp_extract(low, _LONG, 2)], F.lpad(F.regexp_extract(low, _LONG, 1), 2, "0"))
    written = F.concat_ws("-", F.regexp_extract(low, _NUMERIC, 3), F.lpad(F.regexp_extract(low, _NUMERIC, 2), 2, "0"), F.lpad(F.regexp_extract(low, _NUMERIC, 1), 2, "0"))
    found = F.when(low.rlike(_LONG), spelled).when(low.rlike(_NUMERIC), written)
    return F.date_format(F.try_to_date(found, "yyyy-MM-dd"), "yyyy-MM-dd")


def _has(low: Column, pattern: str, stems: list[str]) -> Column:
    """Whether a pattern, each match of which holds one of the stems, is found."""
    return reduce(Column.__or__, (F.contains(low, F.lit(stem)) for stem in stems)) & low.rlike(pattern)


def _first_of(low: Column, kinds: tuple[tuple[str, str, list[str]], ...]) -> Column:
    """The first kind, in the order of the table, that a sentence has."""
    return F.coalesce(*(F.when(_has(low, pattern, stems), name) for name, pattern, stems in kinds))


def _cue(words: tuple[str, ...]) -> tuple[str, str, list[str]]:
    """What finds one of the words behind a pause or space, what finds it where a clause begins, and the longest part of each."""
    spelled = "|".join(w.replace(" ", r",?\s+") for w in words)
    return rf"(?:^|[,;:]\s*|\s)({spelled})(?=[\s,])", rf"(?:^|[,;:]\s*)(?:{spelled})(?=[\s,])", [max(w.split(), key=len) for w in words]


def _word(low: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_extract(low, pattern, 1), r",?\s+", " ")


def _scope(low: Column, pattern: str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_extract(low, pattern + r"[,\s]*([^,;:]{1,200})", 2)), r"\.$", "")


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _issuer(low: Column) -> Column:
    return _some(F.regexp_extract(low, rf"\b({ISSUERS})n?\b", 1))


_ENDS, _EXCEPTION, _CONDITION = r"\bon\s+voimassa\b.{0,80}\b(?:saakka|asti)\b", _cue(EXCEPTIONS), _cue(CONDITIONS)


def _candidates(low: Column, rejected: bool) -> Column:
    """The frames that a sentence in lower case has the trigger of, as array of struct(frame, reason) in the order of the frames: those rejected, or those
    accepted, whose reason is null. Nothing is read that these two do not need.

    The filter is evaluated expression by expression. One generated method of all of them is longer than the JVM compiles, and would be interpreted."""
    frame = lambda condition, name, reason: F.when(condition, F.struct(F.lit(name).alias("frame"), reason.cast("string").alias("reason")))

    # a section or number behind the instrument cites one that exists
    cites = _has(low, r"\basetu(?:s|ks)[a-zäö]*\s*\(?\d|\basetuksen\s+\d", ["asetu"])
    grants = low.rlike(GRANTS)
    delegation = frame(
        _first_of(low, INSTRUMENTS).isNotNull() & (grants | low.rlike(r"\bannettu[a-zäö]*\b") | cites), "delegation",
        F.when(cites, "cross_reference_instrument").when(~grants, "no_grant").when(_issuer(low).isNull() & ~low.rlike(r"\basetuksella\b"), "no_issuer"))

    unnamed = _first_of(low, SANCTIONS).isNull()
    sanction = frame(~unnamed | _has(low, REVOKES, ["peruu"]), "sanction", F.when(unnamed & ~low.rlike(PERMITS), "revocation_without_permit"))

    def cue(name: str, pattern: str, at_start: str, stems: list[str]) -> Column:
        return frame(_has(low, pattern, stems), name, F.when(_word(low, pattern).isin("jos", "kun") & ~low.rlike(at_start), "not_clause_initial").when(_scope(low, pattern) == "", "no_scope"))

    ends = _has(low, _ENDS, ["voimassa"])
    stated = _has(low, r"\btulee\s+voimaan\b", ["voimaan"]) | _has(low, r"\bon\s+voimassa\b", ["voimassa"]) | _has(low, r"\bkunnes\b", ["kunnes"]) | _has(low, r"\bvoimaantulosta\b", ["voimaantulosta"])
    temporal = frame(stated, "temporal", F.when(ends & _date_in(low).isNull(), "no_end_day"))
    every = F.array(delegation, sanction, cue("exception", *_EXCEPTION), cue("condition", *_CONDITION), temporal)
    return F.filter(every, lambda f: f["reason"].isNotNull() if rejected else f["frame"].isNotNull() & f["reason"].isNull())


def _typed(found: DataFrame) -> DataFrame:
    """kind, value and detail of the frames that were found (frame, __low): each is read only for its frame, and where it is asked for.
    Evaluated expression by expression as well."""
    frame, day = F.col("frame"), F.col("__day")

    def temporal(low: Column) -> Column:
        return (
            F.when(low.rlike(_ENDS), "fixed_term_expiry").when(low.rlike(r"\btulee\s+voimaan\b"), F.when(day.isNotNull(), "fixed_date").otherwise("commencement"))
            .when(low.rlike(r"\bkunnes\b"), "event_bound").when(low.rlike(r"\bvoimaantulosta\b"), "duration_from_commencement").otherwise("validity_open"))

    def kind(low: Column) -> Column:
        return (
            F.when(frame == "delegation", _first_of(low, INSTRUMENTS)).when(frame == "sanction", F.coalesce(_first_of(low, SANCTIONS), F.when(low.rlike(REVOKES) & low.rlike(PERMITS), "luvan_peruuttaminen")))
            .when(frame == "exception", _word(low, _EXCEPTION[0])).when(frame == "condition", _word(low, _CONDITION[0])).otherwise(temporal(low)))

    def value(low: Column) -> Column:
        top = F.regexp_extract(low, r"enintään\s+([a-zäö0-9 ]+?(?:vuode(?:ksi|n)|kuukaude(?:ksi|n)|euron|euroa))\b", 1)
        return F.when(frame == "delegation", _issuer(low)).when(frame == "sanction", _some(top)).when((frame == "temporal") & F.col("kind").isin("fixed_date", "fixed_term_expiry"), day)

    def detail(low: Column) -> Column:
        return (
            F.when(frame == "delegation", F.when(low.rlike(MAY), "may").otherwise("must")).when(frame == "sanction", _some(F.regexp_extract(low, r"\b((?:se, )?joka|jos|mikäli|milloin)\b", 1)))
            .when(frame == "exception", _scope(low, _EXCEPTION[0])).when(frame == "condition", _scope(low, _CONDITION[0])).when(low.rlike(r"\bkunnes\b"), F.trim(F.regexp_extract(low, r"\bkunnes\b([^.;]*)", 1))))

    low = F.col("__low")
    return found.withColumn("__day", F.when(frame == "temporal", _let(low, _date_in))).withColumn("kind", _let(low, kind)).withColumn("value", _let(low, value)).withColumn("detail", _let(low, detail))


def frames(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(frames, rejected) of texts: (key, sentence, frame, kind, value, detail), ``sentence`` from 0, and rejected ones with ``reason``.

    delegation: kind of instrument, value the issuer (null if the text leaves it open), detail must or may. sanction: its kind, value the most that it may
    come to, detail what introduces the case. exception and condition: the cue, detail its scope up to the clause's end. temporal: kind, value a day,
    detail an event. Null text has none. Triggers and reasons are read before the explode, the rest behind it."""
    raw = F.col(text)
    spaced = reduce(Column.__or__, (F.contains(raw, F.lit(x)) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r")))
    squashed = F.when(spaced, F.regexp_replace(raw, r"\s+", " ")).otherwise(raw)
    # the space comes first in the pattern, so that the look behind is tried at spaces only
    sentences = docs.select(key, F.posexplode(F.split(squashed, r" (?<=[a-zäöå)][.;] )")).alias("sentence", "__s"))
    lowered = sentences.select(key, F.col("sentence").cast("long").alias("sentence"), F.lower(F.trim("__s")).alias("__low"))
    columns = [key, "sentence", "frame", "kind", "value", "detail"]
    found = lambda rejected: _typed(lowered.select("*", F.explode(_candidates(F.col("__low"), rejected)).alias("f")).select(key, "sentence", "__low", "f.*"))
    return found(False).select(*columns), found(True).select(*columns, "reason")

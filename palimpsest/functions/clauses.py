"""The grammar of amendment clauses: a sentence that orders changes becomes typed ops, and nothing of it goes unaccounted.

    kumotaan lain 3 §, muutetaan 5 §:n 2 momentti ja 7 §:n otsikko sekä lisätään 8 §:ään uusi 3 momentti,
    jolloin nykyinen 3 momentti siirtyy 4 momentiksi

Three steps, as in the sentence itself:

1. The lexer cuts the text into tokens: verbs, units with their case, numbers, facets, connectives, citations, words.
2. The surface: each verb opens a group of references. Numbers wait for the unit that they belong to; a unit in the genitive or
   illative opens a scope for what follows, one in the nominative names targets under the scope, one in the translative a
   destination. A reference on a level closes the scopes at and below it.
3. Lowering: every target of every group becomes one op, ranges member by member, renumberings pair by pair.

Tokens that no rule takes are leftovers with a reason. Every token of a text is either used by the grammar or a leftover:
their counts add up, which the tests hold.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import ship

# The closed vocabulary of Finnish amendment clauses.
VERBS = {"kumotaan": "REPEAL", "muutetaan": "REPLACE", "lisätään": "INSERT", "siirretään": "MOVE", "siirtyy": "RENUMBER", "siirtyvät": "RENUMBER"}
LEVELS = ("part", "chapter", "section", "subsection", "item")
UNITS = {
    "osa": ("part", "nom"), "osan": ("part", "gen"), "osaan": ("part", "ill"), "osat": ("part", "nom"), "osien": ("part", "gen"), "osaksi": ("part", "tra"), "osiksi": ("part", "tra"),
    "luku": ("chapter", "nom"), "luvun": ("chapter", "gen"), "lukuun": ("chapter", "ill"), "luvut": ("chapter", "nom"), "lukujen": ("chapter", "gen"), "luvuksi": ("chapter", "tra"), "luvuiksi": ("chapter", "tra"),
    "§": ("section", "nom"), "§:n": ("section", "gen"), "§:ään": ("section", "ill"), "§:t": ("section", "nom"), "§:ien": ("section", "gen"), "§:ksi": ("section", "tra"), "§:iksi": ("section", "tra"),
    "pykälä": ("section", "nom"), "pykälän": ("section", "gen"), "pykälään": ("section", "ill"), "pykäläksi": ("section", "tra"), "pykäliksi": ("section", "tra"),
    "momentti": ("subsection", "nom"), "momentin": ("subsection", "gen"), "momenttiin": ("subsection", "ill"), "momentit": ("subsection", "nom"), "momenttien": ("subsection", "gen"), "momentiksi": ("subsection", "tra"), "momenteiksi": ("subsection", "tra"),
    "kohta": ("item", "nom"), "kohdan": ("item", "gen"), "kohtaan": ("item", "ill"), "kohdat": ("item", "nom"), "kohtien": ("item", "gen"), "kohdaksi": ("item", "tra"), "kohdiksi": ("item", "tra"),
}
FACETS = {"otsikko": "heading", "otsikon": "heading", "johdantokappale": "intro", "johdantokappaleen": "intro", "nimike": "title", "väliotsikko": "subheading"}
WHOLES = {"liite": "appendix", "liitteen": "appendix", "liitettä": "appendix"}
SEPARATORS = {",": "list", "ja": "list", "sekä": "list"}
FILLERS = {"uusi", "uudet", "nykyinen", "nykyiset", "jolloin", "samalla", "seuraavasti", "lain", "lakiin", "laista", "asetuksen", "asetukseen", "annetun", "annettuun", ":", ".", "sellaisena", "kuin", "on", "ovat", "se", "ne"}

NEW, PRESENT = ("uusi", "uudet"), ("nykyinen", "nykyiset")  # fillers that say whether what follows is there

_TOKEN = re.compile(r"""
    (?P<cite>\(\s*\d{1,4}\s*/\s*\d{4}\s*\))
  | (?P<section>§(?::[a-zåäö]+)?)
  | (?P<number>\d+(?:\s?[a-zåäö](?![\wåäö§]))?)
  | (?P<dash>[-‐‑–—])
  | (?P<word>[^\W\d_]+(?:-[^\W\d_]+)*)
  | (?P<mark>\S)
""", re.VERBOSE)


# what lies between white space is cut once and kept: texts repeat their words; a lone letter may belong to the number before it
_LONE_LETTER = re.compile(r"[a-zåäö](?![\wåäö§])")
_KEPT = 100_000
_RANK = {level: k for k, level in enumerate(LEVELS)}
_LABEL = re.compile(r"(\d+)([a-zåäö]?)")


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    value: tuple = ()


def _cut(low: str) -> list[Token]:
    """The tokens of a text in lower case."""
    out = []
    for m in _TOKEN.finditer(low):
        kind, raw = str(m.lastgroup), m.group()
        value: tuple = ()
        if kind == "number":
            value = (re.sub(r"\s", "", raw),)
        elif kind == "cite":
            value = (re.sub(r"[\s()]", "", raw),)
        elif raw in VERBS:
            kind, value = "verb", (VERBS[raw],)
        elif raw in UNITS:
            kind, value = "unit", UNITS[raw]
        elif raw in FACETS:
            kind, value = "facet", (FACETS[raw],)
        elif raw in WHOLES:
            kind, value = "whole", (WHOLES[raw],)
        elif raw in SEPARATORS:
            kind = "separator"
        elif raw in FILLERS:
            kind = "filler"
        elif kind == "section":
            kind = "word"  # a section sign in a case that the grammar does not know
        out.append(Token(kind, raw, m.start(), m.end(), value))
    return out


#: Of what lies between white space: its tokens by their places in it, and those of them that do something when they are read.
_chunks: dict[str, tuple[list[Token], list[Token]] | None] = {}


def _chunk(raw: str) -> tuple[list[Token], list[Token]] | None:
    """The entry of a chunk; None where its tokens depend on what is beside it: a lone letter, or a parenthesis that may open or go on a citation."""
    tokens = None if _LONE_LETTER.match(raw) else _cut(raw)
    found = None
    if tokens is not None and all(t.text != "(" for t in tokens):
        found = tokens, [t for t in tokens if t.kind != "separator" and (t.kind != "filler" or t.text in NEW or t.text in PRESENT)]
    if len(_chunks) >= _KEPT:
        _chunks.clear()
    _chunks[raw] = found
    return found


def lex(text: str) -> list[Token]:
    """The tokens of a clause, with their places in it."""
    low, out, at = text.lower(), [], 0
    for raw in low.split():
        at = low.find(raw, at)
        found = _chunks[raw] if raw in _chunks else _chunk(raw)
        if found is None:
            return _cut(low)
        out += [Token(kind, piece, start + at, end + at, value) for kind, piece, start, end, value in found[0]]
        at += len(raw)
    return out


def _unplaced(text: str) -> tuple[int, list[Token]]:
    """How many tokens a clause has, and those that do something when they are read, their places unknown."""
    low = text.lower()
    n, out = 0, []
    for raw in low.split():
        found = _chunks[raw] if raw in _chunks else _chunk(raw)
        if found is None:
            tokens = _cut(low)
            return len(tokens), tokens
        n += len(found[0])
        out += found[1]
    return n, out


@dataclass(slots=True)
class Target:
    """One reference: its path of (level, label), its facet if any, and whether it is new."""

    path: tuple[tuple[str, str], ...]
    facet: str | None = None
    new: bool = False
    destination: tuple[tuple[str, str], ...] | None = None


@dataclass(slots=True)
class VerbGroup:
    """A verb and what it orders; ``statute`` is the act cited before or within the group."""

    action: str
    start: int
    targets: list[Target] = field(default_factory=list)
    statute: str | None = None


@dataclass
class Surface:
    """The groups of a clause, and its leftovers as (token, reason). ``used`` counts the tokens that the grammar took."""

    groups: list[VerbGroup]
    leftovers: list[tuple[Token, str]]
    used: int


def label_range(first: str, last: str) -> list[str] | None:
    """The labels from ``first`` to ``last``: numbers, or letters of one number; None if they are no range."""
    a, b = _LABEL.fullmatch(first), _LABEL.fullmatch(last)
    if not a or not b:
        return None
    if not a[2] and not b[2]:
        low, high = int(a[1]), int(b[1])
        return [str(k) for k in range(low, high + 1)] if low < high <= low + 2000 else None
    if a[1] == b[1] and a[2] and b[2]:
        return [a[1] + chr(k) for k in range(ord(a[2]), ord(b[2]) + 1)] if a[2] < b[2] else None
    return None


class Reader:
    """Reads tokens from left to right; what is open is the group, the scope by level, the numbers that wait, the flags."""

    def __init__(self) -> None:
        self.groups: list[VerbGroup] = []
        self.leftovers: list[tuple[Token, str]] = []
        self.scope: dict[str, str] = {}
        self.waiting: list[tuple[Token, list[str]]] = []
        self.dash: Token | None = None
        self.new = False
        self.statute: str | None = None
        self.pending: list[Target] = []  # what a renumbering or a move has named so far
        self.consequence_of = ""  # the verb that a renumbering follows from

    def drop_waiting(self, reason: str) -> None:
        self.leftovers += [(token, reason) for token, _ in self.waiting]
        if self.dash:
            self.leftovers.append((self.dash, reason))
        self.waiting, self.dash = [], None

    def number(self, token: Token) -> None:
        label = token.value[0]
        if self.dash:
            before = self.waiting[-1][1]
            members = label_range(before[-1], label)
            if members is None:
                self.leftovers += [(self.dash, "no_range")]
                self.waiting.append((token, [label]))
            else:
                self.waiting.append((token, members[1:]))
            self.dash = None
        else:
            self.waiting.append((token, [label]))

    def unit(self, token: Token) -> None:
        level, case = token[4]
        waiting = self.waiting
        if not waiting or not self.groups:
            self.drop_waiting("no_verb" if not self.groups else "unit_without_number")
            self.leftovers.append((token, "no_verb" if not self.groups else "unit_without_number"))
            return
        labels = waiting[0][1] if len(waiting) == 1 else [label for _, members in waiting for label in members]
        self.waiting, self.dash = [], None
        scope = self.scope
        if scope:
            rank = _RANK[level]
            self.scope = scope = {k: v for k, v in scope.items() if _RANK[k] < rank}
        above = tuple(scope.items())
        group = self.groups[-1]
        if case == "nom":
            new = self.new and group.action == "INSERT"
            made = [Target((*above, (level, label)), None, new) for label in labels]
            self.pending = made if group.action != "MOVE" else self.pending + made
            group.targets += made
        elif case == "tra":
            self.arrive([(*above, (level, label)) for label in labels], token)
        elif case == "ill" and group.action == "MOVE" and self.pending:
            self.arrive([(*above, (level, labels[0]))], token, inside=True)
        else:
            if len(labels) > 1:  # several places at once cannot be a scope
                self.leftovers.append((token, "several_scopes"))
            scope[level] = labels[-1]

    def arrive(self, places: list[tuple[tuple[str, str], ...]], token: Token, inside: bool = False) -> None:
        """Destinations for what was named last: one for one, or one place for all to go into."""
        if inside:
            for target in self.pending:
                target.destination = (*places[0], target.path[-1])
        elif len(places) == len(self.pending):
            for target, place in zip(self.pending, places, strict=True):
                target.destination = (*target.path[:-1], place[-1])
        else:
            self.leftovers.append((token, "destinations_do_not_match"))
        self.pending = []
        if self.groups[-1].action == "RENUMBER":  # a consequence is over: its verb goes on
            self.groups.append(VerbGroup(self.consequence_of, token.end, [], self.statute))

    def facet(self, token: Token) -> None:
        if not self.groups:
            self.leftovers.append((token, "no_verb"))
            return
        path = tuple(self.scope.items())
        if token.value[0] == "title" or path:
            self.groups[-1].targets.append(Target(path, token.value[0], self.new))
        else:
            self.leftovers.append((token, "facet_without_scope"))

    def verb(self, token: Token) -> None:
        self.drop_waiting("number_without_unit")
        action = token.value[0]
        if action == "RENUMBER":  # takes what was named before it; the destination follows
            named, group = self.pending, self.groups[-1] if self.groups else None
            if not named or not group:
                self.leftovers.append((token, "nothing_to_renumber"))
                return
            gone = {id(n) for n in named}
            group.targets = [t for t in group.targets if id(t) not in gone]
            self.consequence_of = group.action
            self.groups.append(VerbGroup("RENUMBER", token.start, named, self.statute))
            return
        self.scope, self.new, self.pending = {}, False, []
        self.groups.append(VerbGroup(action, token.start, [], self.statute))

    def whole(self, token: Token) -> None:
        labels = [label for _, members in self.waiting for label in members] or [""]
        self.waiting, self.dash = [], None
        if self.groups:
            self.groups[-1].targets += [Target(((token.value[0], label),), None, self.new) for label in labels]
        else:
            self.leftovers.append((token, "no_verb"))

    def take(self, token: Token) -> None:
        kind = token[0]
        if kind == "separator":
            return
        if kind == "number":
            self.number(token)
        elif kind == "unit":
            self.unit(token)
        elif kind == "filler":
            word = token[1]
            if word in NEW:
                self.new = True
            elif word in PRESENT:
                self.new = False
        elif kind == "verb":
            self.verb(token)
        elif kind == "dash":
            if self.waiting and not self.dash:
                self.dash = token
            else:
                self.leftovers.append((token, "dash_without_number"))
        elif kind == "facet":
            self.facet(token)
        elif kind == "whole":
            self.whole(token)
        elif kind == "cite":
            self.statute = token.value[0]
            if self.groups and not self.groups[-1].targets:
                self.groups[-1].statute = self.statute
        else:
            self.leftovers.append((token, "unknown_word"))


def _surface(n: int, tokens: list[Token]) -> Surface:
    """What tokens say, ``n`` with those that do nothing."""
    reader = Reader()
    take = reader.take
    for token in tokens:
        take(token)
    reader.drop_waiting("number_without_unit")
    for group in reader.groups:
        for target in list(group.targets) if group.action in ("RENUMBER", "MOVE") else ():
            if target.destination is None:
                group.targets.remove(target)
                reader.leftovers.append((Token("target", address(target.path), group.start, group.start), "no_destination"))
    counted = sum([t.kind != "target" for t, _ in reader.leftovers])
    return Surface(reader.groups, reader.leftovers, n - counted)


def read_clause(text: str) -> Surface:
    """The surface of a clause."""
    tokens = lex(text)
    return _surface(len(tokens), tokens)


def _read(text: str, placed: bool) -> Surface:
    """The surface of a clause for those who do not ask where its verbs are; where its leftovers are only if ``placed``."""
    surface = _surface(*_unplaced(text))
    return read_clause(text) if placed and surface.leftovers else surface


def address(path: tuple[tuple[str, str], ...]) -> str:
    return "/".join([f"{level}:{label}" if label else level for level, label in path])


def lowered(surface: Surface) -> Iterator[tuple[str, str, str | None, str | None, bool, str | None]]:
    """(action, target, destination, facet, new, statute) of each target of each group, in order."""
    for group in surface.groups:
        for t in group.targets:
            action = "HEADING_REPLACE" if t.facet in ("heading", "subheading") and group.action == "REPLACE" else group.action
            yield action, address(t.path), address(t.destination) if t.destination else None, t.facet, t.new, group.statute


OPS = "action string, target string, destination string, facet string, new boolean, statute string"
FOUND = f"nth long, {OPS}, leftover string, reason string, at long, tokens long, used long"


KINDS = ("ops", "leftovers", "counts")


def parse_clauses(clauses: DataFrame, key: str, text: str, kinds: Collection[str] = KINDS) -> DataFrame:
    """One row an op (leftover null), one a leftover (action null), and one a clause with its number of tokens and how many the
    grammar used (both others null), all with the key; of these, the ``kinds`` that the caller reads. Null text has no tokens."""
    kind = dict(clauses.dtypes)[key]
    wanted = [k in kinds for k in KINDS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([pa.field("key", batch.schema.field(0).type), *(pa.field(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (c.split() for c in FOUND.split(", ")))])
            ops: list[tuple] = []
            left: list[tuple] = []
            counts: list[tuple] = []
            for at, value in enumerate(batch.column(1).to_pylist()):
                surface = _read(value or "", wanted[1])
                if wanted[0]:
                    ops += [(at, n, *op) for n, op in enumerate(lowered(surface))]
                if wanted[1]:
                    left += [(at, n, token.text, reason, token.start) for n, (token, reason) in enumerate(surface.leftovers)]
                if wanted[2]:
                    counts.append((at, surface.used + sum(token.kind != "target" for token, _ in surface.leftovers), surface.used))
            # the columns that each kind of row fills
            for rows, filled in ((ops, range(1, 8)), (left, (1, 8, 9, 10)), (counts, (11, 12))):
                if rows:
                    columns = list(zip(*rows, strict=True))
                    by = dict(zip(filled, columns[1:], strict=True))
                    arrays = [pa.array(by[k], f.type) if k in by else pa.nulls(len(rows), f.type) for k, f in enumerate(schema) if k]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *arrays], schema=schema)

    ship(clauses.sparkSession)
    return clauses.select(key, text).mapInArrow(run, f"key {kind}, {FOUND}").withColumnRenamed("key", key)


def _by_statute(text: str) -> dict[str, tuple[int, bool]]:
    """Of each statute that a clause cites: how many ops it orders there, and whether all of them repeal. Nothing is lowered for that."""
    found: dict[str, tuple[int, bool]] = {}
    for group in _read(text, placed=False).groups:
        if group.statute is not None and group.targets:
            n, only = found.get(group.statute, (0, True))
            found[group.statute] = n + len(group.targets), only and group.action == "REPEAL"
    return found


STATUTES = pa.list_(pa.struct([("statute", pa.string()), ("ops", pa.int64()), ("only_repeals", pa.bool_())]))


def ordered_statutes(spark: SparkSession, text: Column) -> Column:
    """What the ops of :func:`parse_clauses` say of statutes, as array of struct(statute, ops, only_repeals) beside the clause: rows stay where they are. Only
    clauses that may hold a citation, a slash in parentheses, are read; the array of others is empty."""
    ship(spark)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[(statute, n, only) for statute, (n, only) in _by_statute(value).items()] if value else [] for value in texts.to_pylist()], STATUTES)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<statute string, ops long, only_repeals boolean>>")(F.when(F.contains(text, F.lit("(")) & F.contains(text, F.lit("/")), text))


def clause_ops(parsed: DataFrame, key: str) -> DataFrame:
    """The ops of :func:`parse_clauses`."""
    return parsed.filter("action is not null").select(key, "nth", "action", "target", "destination", "facet", "new", "statute")


def clause_leftovers(parsed: DataFrame, key: str) -> DataFrame:
    """The leftovers, each with its reason and place."""
    return parsed.filter("leftover is not null").select(key, "nth", "leftover", "reason", "at")

"""Text functions: normalisation with the names of the rules that fired, distances, search, hashes, dates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import ship


@dataclass(frozen=True)
class Rule:
    """One step of a normalisation: 'regex', 'literal' or 'translate'."""

    name: str
    kind: str
    find: str
    put: str = ""

    def apply(self, c: Column) -> Column:
        if self.kind == "regex":
            return F.regexp_replace(c, self.find, self.put)
        if self.kind == "literal":
            return F.replace(c, F.lit(self.find), F.lit(self.put))
        if self.kind == "translate":
            return F.translate(c, self.find, self.put)
        raise ValueError(f"unknown rule kind {self.kind!r}")


# Code points that fold to a space, a dash, an apostrophe, a double quote.
SPACES = "     "
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"

#: White space, punctuation spacing and folds, in order. (?U) makes \s and \w Unicode classes.
INLINE_RULES = (
    Rule("fold_spaces", "translate", SPACES, " " * len(SPACES)),
    Rule("fold_dashes", "translate", DASHES, "—" * len(DASHES)),
    Rule("fold_single_quotes", "translate", SINGLE_QUOTES, "'" * len(SINGLE_QUOTES)),
    Rule("fold_double_quotes", "translate", DOUBLE_QUOTES, '"' * len(DOUBLE_QUOTES)),
    Rule("hyphen_wrap", "regex", r"(?U)(?<=\w-)\s+(?=\w)"),
    Rule("collapse_space", "regex", r"(?U)\s+", " "),
    Rule("space_before_mark", "regex", r" +([,.;:])", "$1"),
    Rule("space_after_open", "regex", r"\( +", "("),
    Rule("space_before_close", "regex", r" +([)\]])", "$1"),
    Rule("trim", "regex", r"^ +| +$"),
)


def normalise(df: DataFrame, text: str, rules: Sequence[Rule] = INLINE_RULES, out: str = "normal", fired: str = "fired") -> DataFrame:
    """``out`` is the text after all rules, ``fired`` the names of those that changed it, in order."""
    steps = "__steps"
    chain = F.array(F.struct(F.col(text).alias("t"), F.lit(None).cast("string").alias("rule")))
    for rule in rules:
        last = F.element_at(F.col(steps), -1)["t"]
        df = df.withColumn(steps, chain if rule is rules[0] else F.col(steps))
        after = rule.apply(last)
        df = df.withColumn(steps, F.concat(F.slice(steps, F.lit(1), F.size(steps) - 1), F.array(F.struct(last.alias("t"), F.when(after != last, F.lit(rule.name)).alias("rule")), F.struct(after.alias("t"), F.lit(None).cast("string").alias("rule")))))
    return df.withColumn(out, F.element_at(steps, -1)["t"]).withColumn(fired, F.filter(F.transform(steps, lambda s: s["rule"]), lambda r: r.isNotNull())).drop(steps)


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long") if needle else F.lit(0).cast("long")


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / (length a + length b), by the longest common subsequence in bit-parallel rows."""
    if not a and not b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def _pairwise(function: Callable[[str, str], float], a: str | Column, b: str | Column) -> Column:
    """A vectorised UDF of two text columns; null if either is null."""
    ship(SparkSession.active())

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else function(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def edit_ratio(a: str | Column, b: str | Column) -> Column:
    """The indel ratio of two columns, in a batch of rows at a time; a pair costs the product of its lengths, so it is for sections, not for whole corpora of text in a row."""
    return _pairwise(indel_ratio, a, b)


def matching_ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def sequence_ratio(a: str | Column, b: str | Column) -> Column:
    """The matching-blocks ratio of two columns."""
    return _pairwise(matching_ratio, a, b)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common_start(a: Column, b: Column) -> Column:
    """How many characters two strings begin with in common, in one pass."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    shorter = F.least(F.char_length(a), F.char_length(b))
    return F.when(shorter == 0, 0).when(differs == 0, shorter).otherwise(differs - 1).cast("int")


def changed_span(a: Column, b: Column) -> Column:
    """(start, end_a, end_b) of the smallest change: common prefix and then common suffix cut off. Equal strings: empty. Linear in the text."""
    least = F.least(F.char_length(a), F.char_length(b))
    both = F.struct(_common_start(a, b).alias("prefix"), _common_start(F.reverse(a), F.reverse(b)).alias("suffix"))

    def span(s: Column) -> Column:
        suffix = F.least(s["suffix"], least - s["prefix"])
        return F.struct(s["prefix"].alias("start"), (F.char_length(a) - suffix).alias("end_a"), (F.char_length(b) - suffix).alias("end_b"))

    return F.when(a.isNotNull() & b.isNotNull(), _let(both, span))


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def token_tape(c: Column, pattern: str = r"\s+|[0-9]+|[^\s0-9]+") -> Column:
    """A lossless array of (text, start, end): the texts joined are the input. Linear in the text: a flag for each character says where a part ends."""
    parts = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    last = lambda p: F.concat(F.array_repeat(F.lit(False), F.char_length(p) - 1), F.array(F.lit(True)))

    def placed(s: Column) -> Column:
        ends = F.when(F.size(s["flags"]) > 0, F.filter(F.sequence(F.lit(1), F.size(s["flags"])), lambda n: F.get(s["flags"], n - 1))).otherwise(F.array().cast("array<int>"))
        return F.zip_with(s["parts"], ends, lambda p, e: F.struct(p.alias("text"), (e - F.char_length(p)).alias("start"), e.alias("end")))

    return F.when(c.isNotNull(), _let(F.struct(parts.alias("parts"), F.flatten(F.transform(parts, last)).alias("flags")), placed))


def bm25(docs: DataFrame, key: str, text: str, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold a query term. Postings of other terms are filtered before the shuffle."""
    words = sorted(set(query))
    sized = docs.select(F.col(key), tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(words)).alias("hits"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = sized.filter(F.size("hits") > 0).select(key, "dl", F.explode("hits").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # no more rows than query terms
    joined = postings.join(F.broadcast(df), "term").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.groupBy(key).agg(F.sum(part).alias("score"))


def root_hash(tag: str, kind: str, leaves: Column) -> Column:
    """SHA-256 of a domain tag, NUL and the canonical JSON of an array; 'set' sorts it first."""
    ordered = F.array_sort(leaves) if kind == "set" else leaves
    return F.sha2(F.concat(F.lit(f"{tag}:{kind}"), F.lit("\0"), F.to_json(ordered)), 256)


def iso_prefix(c: Column) -> Column:
    """The ISO date that a string begins with; null if none."""
    found = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def garbled(c: Column) -> Column:
    """Whether a text looks misread: replacement characters, control codes, or long runs without a vowel."""
    return c.rlike("�") | c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") | c.rlike(r"(?i)[bcdfghjklmnpqrstvwxz]{8,}")


#: A reader's confusions of digits for letters, valid inside words only.
GLYPHS = (("0", "o"), ("1", "l"), ("5", "s"))


def repair_glyphs(c: Column) -> Column:
    """Digits between letters become the letters that they are mistaken for."""
    for digit, letter in GLYPHS:
        c = F.regexp_replace(c, rf"(?<=[a-z]){digit}(?=[a-z])", letter)
    return c


def arabic_to_roman(c: Column) -> Column:
    """Roman numeral of 1 to 3999; null outside."""
    digits = {1000: ("", "M", "MM", "MMM"), 100: ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), 10: ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), 1: ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")}
    parts = [F.element_at(F.array(*(F.lit(x) for x in v)), (F.floor(c / k) % 10 + 1).cast("int")) for k, v in digits.items()]
    return F.when(c.between(1, 3999), F.concat(*parts))

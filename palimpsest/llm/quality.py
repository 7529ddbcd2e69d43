"""Quality rules: surface counts and the distance of a text's histograms to language references.

A reference holds the shares of six character classes and the relative frequencies of common
words of a language. A document is compared with every reference by the Jensen-Shannon distance
(square root of the divergence to base 2) and keeps the smallest, so its ``lang`` label is not
needed. Texts under the minimum lengths are not judged by distance. All of it is row-local SQL:
no shuffle, no Python.

Null text counts as empty: all counts 0, ``base_failed`` true. Repeated rows give repeated rows, ties of references do not
matter, and a very long text is one row in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import DOCUMENT, let, own_columns, total

SYMBOLS = "#*$%&|<>"
#: Character classes of a histogram, by code points; the last is what is left: punctuation, symbols, control characters.
CLASSES = ("A-Z", "a-z", "0-9", "white space", "beyond ASCII", "other")


@dataclass(frozen=True)
class LanguageReference:
    """Shares of the six classes in running text, and common words with their shares of all words."""

    lang: str
    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]

    def word_shares(self) -> list[float]:
        return [*self.shares, 1 - sum(self.shares)]


def by_counts(counts: str, total_words: int) -> tuple[tuple[str, ...], tuple[float, ...]]:
    pairs = [x.split() for x in counts.split(",")]
    return tuple(w for w, _ in pairs), tuple(int(n) / total_words for _, n in pairs)


def by_rank(words: str, top: float = 0.06) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """By Zipf's law: the r-th word has the share ``top`` / r."""
    return tuple(words.split()), tuple(top / (r + 1) for r in range(len(words.split())))


#: Fixed values. Words: English by the counts of the Brown corpus (Kucera and Francis 1967, 1,014,312 words), Spanish by
#: those of the CREA list of the Real Academia (per hundred million words), French and German by the ranks of common
#: published lists, as no counts were at hand. Classes: estimates for edited prose from word lengths (4.7 letters and a
#: space for English), a capital for each sentence and name (German nouns besides) and the frequencies of accented
#: letters (French 3 %, German 1.8 %, Spanish 2 %). None of it was taken from the tables that it is tested on.
REFERENCES = (
    LanguageReference("en", (0.030, 0.765, 0.005, 0.170, 0.001, 0.029), *by_counts(
        "the 69971, of 36411, and 28852, to 26149, a 23237, in 21341, that 10595, is 10099, was 9816, he 9543, for 9489, it 8756, with 7289, as 7250, his 6997, on 6742, be 6377, at 5378, by 5305, i 5173", 1014312)),
    LanguageReference("fr", (0.028, 0.745, 0.005, 0.165, 0.030, 0.027), *by_rank("de la le et les des en un du une que est pour qui dans a par plus pas au")),
    LanguageReference("de", (0.055, 0.740, 0.005, 0.150, 0.018, 0.032), *by_rank("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als")),
    LanguageReference("es", (0.028, 0.752, 0.005, 0.168, 0.020, 0.027), *by_counts(
        "de 6554555, la 4114859, que 3068885, el 2995348, en 2775516, y 2740119, a 2137503, los 1716495, se 1325731, del 1217387, las 1105637, un 1087995, por 1023807, con 971174, no 960618, una 883336, su 723406, para 696226, es 668379, al 623403", 100_000_000)),
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Distances count from ``min_chars`` characters and ``min_judged_words`` words on. A text of which an
    eighth of the characters are of classes that prose hardly has is about ``max_class_distance`` away; one without any
    common word is 0.34 (French, German) to 0.42 (English) away, and the chance of a hundred words alone makes 0.2."""

    references: tuple[LanguageReference, ...] = REFERENCES
    max_class_distance: float = 0.25
    max_word_distance: float = 0.33
    min_chars: int = 200
    min_judged_words: int = 100
    min_words: int = 10
    max_repeat_percent: int = 20


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the array. Windows are compared by 64-bit hash."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: total(F.transform(s, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(s, i + 1) - x, F.lit(5))).cast("long"))))

    def hashed(h: Column) -> Column:
        five = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
        return F.slice(five, F.lit(1), F.size(h) - 4)

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    repeated = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(repeated)


def _distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts and reference shares; null without counts."""
    q = F.array(*(F.lit(float(x)) for x in shares))
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    divergence = let(total(counts), lambda n: 0.5 * F.aggregate(F.zip_with(counts, q, lambda c, y: term(c / n, y) + term(y, c / n)), F.lit(0.0), lambda a, x: a + x))
    return F.when(total(counts) > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _class_counts(text: Column, word_chars: Column) -> Column:
    """Lower-case letters go first: the others are counted in what they leave."""
    n = F.char_length(text).cast("long")

    def rest(r: Column) -> Column:
        count = lambda kind: (F.char_length(r) - F.char_length(F.regexp_replace(r, kind, ""))).cast("long")
        counts = F.array(count("[A-Z]+"), n - F.char_length(r), count("[0-9]+"), n - word_chars, count(r"[^\x00-\x7F]+"))
        return let(counts, lambda c: F.concat(c, F.array(F.greatest(n - total(c), F.lit(0).cast("long")))))

    return let(F.regexp_replace(text, "[a-z]+", ""), rest)


def _word_counts(words: Column, vocabulary: list[str]) -> Column:
    """How often each entry of ``vocabulary`` is a whole word, in either case."""
    found = F.lower(F.concat(F.lit("|"), F.array_join(F.filter(words, lambda w: F.lower(w).isin(vocabulary)), "||"), F.lit("|")))
    return let(found, lambda s: F.array(*(((F.char_length(s) - F.char_length(F.replace(s, F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("long") for w in vocabulary)))


def with_quality(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:  # noqa: B008
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance and kept. Columns of those names in ``docs`` are replaced."""
    vocabulary = sorted({w for r in rules.references for w in r.words})
    t, at = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "__q_"
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = sum((F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))

    def nearest(distances: list[Column]) -> Column:
        return F.least(*distances) if len(distances) > 1 else distances[0]

    def word_distance(r: LanguageReference) -> Column:
        own = F.array(*(F.get(f"{at}common", F.lit(vocabulary.index(w))) for w in r.words))
        return _distance(F.concat(own, F.array(F.col("n_words") - total(own))), r.word_shares())

    split = docs.withColumns({f"{at}words": words, f"{at}lines": lines, "n_symbols": symbols.cast("long")})
    counted = split.withColumns({
        "n_words": F.size(f"{at}words").cast("long"),
        "word_chars": F.char_length(F.array_join(f"{at}words", "")).cast("long"),
        "n_dup_lines": (F.size(f"{at}lines") - F.size(F.array_distinct(f"{at}lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(f"{at}words")),
        f"{at}common": _word_counts(F.col(f"{at}words"), vocabulary),
    })
    classed = counted.withColumn(f"{at}classes", _class_counts(t, F.col("word_chars")))
    judged = classed.withColumns({
        "class_distance": nearest([_distance(F.col(f"{at}classes"), list(r.classes)) for r in rules.references]),
        "word_distance": nearest([word_distance(r) for r in rules.references]),
    })
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    far = (
        (total(F.col(f"{at}classes")) >= rules.min_chars) & (F.col("class_distance") > rules.max_class_distance)
        | (F.col("n_words") >= rules.min_judged_words) & (F.col("word_distance") > rules.max_word_distance)
    )
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False))).drop(*(f"{at}{x}" for x in ("words", "lines", "classes", "common")))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:  # noqa: B008
    """The documents that pass, with the columns of the documents table."""
    judged = with_quality(own_columns(docs, *DOCUMENT), rules)
    # a filter would be pushed below the columns that it needs, and each would be computed again wherever it is named
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(1))))
    return judged.select(*DOCUMENT, once.alias("__kept")).select(*DOCUMENT)


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:  # noqa: B008
    """One row per document: the counts and the verdict."""
    out = with_quality(own_columns(docs, "doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def quality_sql(rules: QualityRules = QualityRules()) -> str:  # noqa: B008
    """The same rows by DuckDB over ``documents``."""
    vocabulary = sorted({w for r in rules.references for w in r.words})
    numbers = lambda xs: "[" + ", ".join(f"{float(x)!r}" for x in xs) + "]"

    def distance(counts: str, shares: list[float]) -> str:
        q = numbers(shares)
        n = f"list_sum({counts})"
        both = f"list_zip({counts}, {q})"
        term = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0.0 END)"
        p, r = f"(z[1]::DOUBLE / {n})", "z[2]"
        return f"CASE WHEN {n} > 0 THEN sqrt(greatest(0.5 * list_sum(list_transform({both}, lambda z: {term(p, r)} + {term(r, p)})), 0.0)) END"

    classes = ", ".join(distance("classes", list(r.classes)) for r in rules.references)
    own = lambda r: "[" + ", ".join(f"common[{vocabulary.index(w) + 1}]" for w in r.words) + "]"
    words = ", ".join(distance(f"list_append({own(r)}, n_words - list_sum({own(r)}))", r.word_shares()) for r in rules.references)
    listed = "[" + ", ".join(f"'{w}'" for w in vocabulary) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
s AS (SELECT rid, i, hash(words[i:i + 4]) AS h FROM w, unnest(range(1, len(words) - 3)) AS u(i) WHERE len(words) >= 5),
r AS (SELECT rid, i FROM s QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
p AS (SELECT rid, sum(least(5, nxt - i))::BIGINT AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM r) GROUP BY rid),
c AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
k AS (SELECT rid, map_from_entries(list((x, n))) AS m FROM (SELECT rid, lower(x) AS x, count(*) AS n FROM (SELECT rid, unnest(words) AS x FROM w) WHERE list_contains({listed}, lower(x)) GROUP BY 1, 2) GROUP BY rid),
f AS (SELECT d.doc_id, d.t, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(c.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  list_transform({listed}, lambda x: coalesce(k.m[x], 0)) AS common
  FROM d JOIN w USING (rid) LEFT JOIN p USING (rid) LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)),
g AS (SELECT *, list_append(list_transform(['[A-Z]', '[a-z]', '[0-9]'], lambda x: length(t) - length(regexp_replace(t, x, '', 'g'))), length(t) - word_chars) AS head, length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS beyond FROM f),
h AS (SELECT *, head || [beyond, greatest(length(t) - list_sum(head) - beyond, 0)] AS classes FROM g),
j AS (SELECT *, least({classes}) AS class_d, least({words}) AS word_d, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(list_sum(classes) >= {rules.min_chars} AND class_d > {rules.max_class_distance} OR n_words >= {rules.min_judged_words} AND word_d > {rules.max_word_distance}, false) AS kept,
  round(class_d, 6) AS class_distance, round(word_d, 6) AS word_distance FROM j"""

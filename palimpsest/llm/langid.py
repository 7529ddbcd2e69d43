"""Language identification with bit-sliced Bloom filters over character n-grams.

Learning: the n-grams (runs of letters in lower case, marked at both ends, cut into pieces of ``N`` code points) of
all labelled training documents are hashed and counted per language. A language's filter takes the n-grams that make
up at least ``min_share`` of its n-grams, so it holds at most 1 / ``min_share`` of them, however large the corpus. The
filters of all languages lie across each other: row i of one table holds bit i of every language's filter, so the AND
of ``HASHES`` rows gives, at once, all the languages that contain an n-gram. Tables are built by aggregation, one for
each ``BLOCK`` languages, so there may be any number of languages; a text goes from block to block with its best so far.

Prediction: per language the hits among a text's n-grams, less those to be expected by false positives (a language's
share of set bits to the power of ``HASHES``), over the hit rate that the language's own training text has. The language
with most wins; ties go to the first by name, and so does a text with letters but no n-gram that any language has (its
score is 0). The score is the winner's share of the n-grams.

Only rows with text, a label, and crc32(doc_id as text) mod 3 other than 1 are learned from. ``und`` is the answer for
null text, text without a letter, and when nothing was learned. Repeated rows give repeated rows and count as often. A
very long text is one row in memory, some hundred bytes for each of its letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, map_batches, own_columns, written

N = 4
MIN_SHARE = 2e-5
HASHES = 3
#: Bits of a filter for each n-gram that it may hold.
BITS = 16
#: Languages to a table, which is sent to every task: at most BITS / MIN_SHARE rows of as many bits.
BLOCK = 256
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case. What the quick pattern takes for letters besides, such as fractions and Roman
    number signs, divides words like any other sign."""
    words = _WORD.findall(text.lower())
    if not words or "".join(words).isalpha():
        return words
    return [run for w in words for run in "".join(c if c.isalpha() else " " for c in w).split()]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of a text's words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if len(points) < N:
        return _mixed(points[:1] + points[-1:] * np.uint64(1 << 21))
    h = points[: len(points) - N + 1].copy()
    for k in range(1, N):
        h = h * np.uint64(0x100000001B3) + points[k : len(points) - N + 1 + k]
    inner = points[1 : len(points) - N + 2] != 32  # n-grams do not begin with the end of a word
    return _mixed(h[inner] if inner.any() else h)


@dataclass
class Filters:
    """Row i of ``table`` holds bit i of each language's filter, 64 languages to a column."""

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray
    own_rate: np.ndarray

    def rows(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of the languages that contain it."""
        m = np.uint64(len(self.table))
        out = self.table[(h % m).astype(np.int64)]
        for k in range(1, HASHES):
            out = out & self.table[(_mixed(h + np.uint64(k)) % m).astype(np.int64)]
        return out

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Per language, the n-grams it contains."""
        rows = self.rows(h)
        return np.array([int(((rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum()) for k in range(len(self.languages))], dtype=np.float64)

    def best(self, h: np.ndarray) -> tuple[float, str, float]:
        """(fit, language, score) of the first language that fits best."""
        true = np.maximum(self.hits(h) - len(h) * self.false_positive, 0) / (1 - self.false_positive)
        fit = true / self.own_rate
        k = int(np.argmax(fit))
        return float(fit[k]), self.languages[k], float(min(1.0, true[k] / len(h)))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, h, n): how often each n-gram occurs in the training documents of a language."""
    used = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return h, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], schema=schema)

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.setdefault(lang, []).append(text.as_py())
            for lang, own in texts.items():
                for k in range(0, len(own), 256):
                    found = [g for t in own[k : k + 256] if len(g := ngrams(t))]
                    if found:
                        h, n = np.unique(np.concatenate(found), return_counts=True)
                        held.setdefault(lang, []).append((h, n))
            for lang, parts in held.items():
                held[lang] = [merged(parts)]
            size = sum(len(p[0]) for parts in held.values() for p in parts)
            if size > 2_000_000:  # bounded memory, whatever the task holds
                yield from out()
                held = {}
        yield from out()

    return used.mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


def _filters(kept: DataFrame, languages: list[str], sums: dict[str, tuple[int, int, int]]) -> Filters:
    """The filters of a block of languages; ``kept`` is (lang, h)."""
    m = max(64, BITS * max((sums[x][2] for x in languages), default=0))
    order = {x: k for k, x in enumerate(languages)}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k = np.array([order[x] for x in batch.column(0).to_pylist()], np.int64)
        h = batch.column(1).to_numpy().view(np.uint64)
        at = np.concatenate([((h if j == 0 else _mixed(h + np.uint64(j))) % np.uint64(m)).astype(np.int64) for j in range(HASHES)])
        bits = np.tile(np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)).view(np.int64), HASHES)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(k // 64, HASHES)), pa.array(bits)], names=["at", "word", "bits"])

    own = kept.filter(F.col("lang").isin(languages)) if len(languages) < len(sums) else kept
    rows = map_batches(own.select("lang", "h"), run, "at long, word long, bits long").groupBy("at", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros((m, -(-len(languages) // 64)), np.uint64)
    table[rows.column("at").to_numpy(), rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    filled = np.array([float(((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))])
    return Filters(languages, table, filled**HASHES, np.array([max(sums[x][1] / sums[x][0], 1e-6) for x in languages]))


def learn(docs: DataFrame, min_share: float = MIN_SHARE, block: int = BLOCK) -> Iterator[Filters]:
    """Filters from the training part of ``docs``, block by block. The driver gets a row for each language, and of a block
    the rows of its table that are not zero: at most HASHES * BITS / min_share of 24 bytes for 64 languages."""
    counts = written(count_ngrams(own_columns(docs, "doc_id", "text", "lang")), "ngrams")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    small = F.broadcast(totals) if totals.count() <= 1_000_000 else totals
    kept = written(counts.join(small, "lang").filter(F.col("n") >= min_share * F.col("total")).select("lang", "h", "n"), "kept-ngrams")
    held = kept.groupBy("lang").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("grams"))
    sums = {r["lang"]: (r["total"], r["held"] or 0, r["grams"] or 0) for r in totals.join(held, "lang", "left").select("lang", "total", "held", "grams").toLocalIterator()}
    discard(counts)
    discard(totals)
    languages = sorted(sums)
    for at in range(0, len(languages), block):
        yield _filters(kept, languages[at : at + block], sums)
    discard(kept)


def predict(docs: DataFrame, blocks: Iterable[Filters]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); only the text decides."""
    now = own_columns(docs, "doc_id", "text").select("doc_id", "text", F.lit(-1.0).alias("fit"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for filters in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(filters)

        def run(batch: pa.RecordBatch, sent: object = sent) -> Iterator[pa.RecordBatch]:
            f, out = sent.value, []
            for text, *so_far in zip(batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                h = ngrams(text.as_py() or "")
                found = f.best(h) if len(h) else None
                out.append(found if found and found[0] > so_far[0] else tuple(so_far))
            kinds = (pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["doc_id", "text", "fit", "lang_pred", "score"])

        now = map_batches(now, run, "doc_id long, text string, fit double, lang_pred string, score double")
    return now.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify_languages(docs: DataFrame, min_share: float = MIN_SHARE, block: int = BLOCK) -> DataFrame:
    """Learns from the training part of ``docs`` and predicts all of it."""
    return predict(docs, learn(docs, min_share, block))

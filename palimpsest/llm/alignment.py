"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, in each document and overall.

A text is encoded on two sides. Where tokens of both sides end at the same byte it is cut into groups; every token of one
side within a group is linked with every token of the other. For an id pair the corpus-wide count is the number of
documents that hold it linked; a link is best if no other pair of its first id has a higher count. The steps:

1. Tasks tokenize and write, in flushes of about a million entries, each document's summary and its distinct id pairs. A
   flush is packed by stripe: first id modulo the number of stripes. A row has the stripe's pairs (``codes``), for each the
   number of documents (``runs``), and then the documents' numbers within the flush and how often each holds the pair.
2. Pairs go to their stripe, a pair once a flush, and are added with ``np.add.at`` into a dense block of the stripe's first
   ids by all second ids. Row maxima of the block tell which links are best. The block's size depends on the vocabularies
   only. A stripe is split into as many parts as the corpus needs, whose nonzero cells are added once more.
3. The links are partitioned by the same stripes and parts, behind the counts of their stripe, and scored as they stream by;
   sums for the documents of a flush come back to the flush.

A frequent id costs one entry a flush and stripe part, no task or group grows with the corpus, and nothing reaches the driver but a count
of rows. A document's own text, tokens and distinct pairs are in memory at a time.

Null and empty texts, and texts that either side does not reproduce byte for byte (after the leading space), have no tokens
and count for nothing. Special tokens within a text are plain text. Repeated rows are documents of their own; ids may
be null. Ties make several pairs best. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import own_columns, written


@dataclass(frozen=True)
class Vocabularies:
    """The files of the two sides (names that ``public_tokenizers.path`` knows). ``ranks`` is the first vocabulary as a rank
    file, which gives the same ids faster for texts in Latin script; it may be left out."""

    first: str = "byte_bpe_50k.json"
    second: str = "piece_bpe_32k.model"
    ranks: str | None = "byte_bpe_50k.tiktoken"


#: Stripes of first ids; documents to a stripe part; entries and documents to a flush; cells to a packed row of counts.
STRIPES = 32
PART = 4_000_000
FLUSH = 1_000_000
FLUSH_DOCS = 50_000
CELLS = 500_000


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others, in
    order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Sides:
    """The two encoders, and the bytes of each token."""

    def __init__(self, names: Vocabularies) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(names.first))
        self.exact.encode_special_tokens = True
        self.fast = None
        if names.ranks:
            import tiktoken

            with open(public_tokenizers.path(names.ranks), "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(names.second))
        of = byte_level()
        vocabulary = self.exact.get_vocab()
        self.first: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.first[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        p = self.pieces
        self.second = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
        self.n_first, self.n_second = len(self.first), len(self.second)
        self.lengths = tuple(np.array([len(t) for t in side], np.int64) for side in (self.first, self.second))
        ends = ((self.n_first, b",", b"|"), (self.n_second, b",", b";"))
        self.written = np.array([b"%d%s" % (i, end) for n, *two in ends for end in two for i in range(n)], object)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; None unless both give the bytes of a space and the text."""
        data = b" " + text.encode()
        latin = self.fast is not None and (text.isascii() or max(text) < "ɐ") and " " * 4096 not in text
        first = self.fast.encode_ordinary(f" {text}") if latin else self.exact.encode(f" {text}", add_special_tokens=False).ids
        second = self.pieces.encode(text, num_threads=1)
        if b"".join(map(self.first.__getitem__, first)) != data or b"".join(map(self.second.__getitem__, second)) != data:
            return None
        return np.array(first, np.int64), np.array(second, np.int64)


_SIDES: dict[Vocabularies, Sides] = {}


def sides(names: Vocabularies) -> Sides:
    """The encoders, loaded once to a process."""
    if names not in _SIDES:
        _SIDES[names] = Sides(names)
    return _SIDES[names]


@dataclass(frozen=True)
class Alignment:
    """Tokens of both sides, the group of each, and the number of tokens in each group."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    @property
    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b


def align(a: np.ndarray, b: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> Alignment:
    """The groups of two token sequences over the same bytes."""
    end_a, end_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
    both, ends = np.zeros(int(end_a[-1]) + 1, bool), np.zeros(int(end_a[-1]) + 1, bool)
    both[end_a] = True
    ends[end_b] = True
    both &= ends
    upto = np.cumsum(both)
    of_a, of_b = upto[end_a] - both[end_a], upto[end_b] - both[end_b]
    n = int(upto[-1])
    return Alignment(a, b, of_a, of_b, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n))


def written_groups(x: Alignment, s: Sides) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    start_a, start_b = x.starts
    last = lambda of: np.append(of[1:] != of[:-1], True)
    which = np.empty(len(x.a) + len(x.b), np.int64)
    which[np.arange(len(x.a)) + start_b[x.of_a]] = x.a + s.n_first * last(x.of_a)
    which[np.arange(len(x.b)) + (start_a + x.n_a)[x.of_b]] = 2 * s.n_first + x.b + s.n_second * last(x.of_b)
    return b"".join(s.written[which].tolist())[:-1]


def linked_pairs(x: Alignment, n_second: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked pairs, as first id * ``n_second`` + second id, and how many links each has."""
    start_a, start_b = x.starts
    many = x.n_a * x.n_b
    one = many == 1
    codes = [x.a[start_a[one]] * n_second + x.b[start_b[one]]]
    weights = [np.ones(len(codes[0]), np.int64)]
    some = ~one & (many <= 4096)
    if some.any():
        m, width = many[some], np.repeat(x.n_b[some], many[some])
        k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        codes.append(x.a[np.repeat(start_a[some], m) + k // width] * n_second + x.b[np.repeat(start_b[some], m) + k % width])
        weights.append(np.ones(len(k), np.int64))
    for g in np.flatnonzero(many > 4096).tolist():  # by distinct ids: a long group of few ids is a few pairs
        (a, n), (b, m) = (np.unique(ids[s[g] : s[g] + c[g]], return_counts=True) for ids, s, c in ((x.a, start_a, x.n_a), (x.b, start_b, x.n_b)))
        codes.append((a[:, None] * n_second + b).ravel())
        weights.append((n[:, None] * m).ravel())
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    links = np.zeros(len(found), np.int64)
    np.add.at(links, at, np.concatenate(weights))
    return found, links


# ---------------------------------------------------------------- tokens to packed links

SUMMARY = {"place": "int", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
LINKS = {"stripe": "int", "codes": "binary", "runs": "binary", "docs": "binary", "links": "binary", "more": "binary"}
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_ALL = {"flush": "long"} | SUMMARY | LINKS
_schema = lambda columns: ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _batch(columns: dict[str, list], schema: dict[str, str]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], _KINDS[kind]) if c in columns else pa.nulls(n, _KINDS[kind]) for c, kind in schema.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def _packed(held: list[tuple[np.ndarray, np.ndarray]], flush: int, n_second: int, stripes: int) -> Iterator[pa.RecordBatch]:
    """One row per stripe for the pairs of the flush's documents."""
    codes, links = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    if not len(codes):
        return
    docs = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h[0]) for h in held])
    first, second = np.divmod(codes, n_second)
    key = ((first % stripes) << 32) + (first // stripes) * n_second + second
    order = np.argsort(key, kind="stable")
    key, docs, links = key[order], docs[order], links[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    runs = np.diff(np.append(edge, len(key)))
    stripe_of, cell = key[edge] >> 32, (key[edge] & 0xFFFFFFFF).astype(np.uint32)
    rows: dict[str, list] = {c: [] for c in ("flush", *LINKS)}
    used, at = np.unique(stripe_of, return_index=True)
    for stripe, start, end in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(edge)], strict=True):
        own = slice(int(edge[start]), int(edge[end]) if end < len(edge) else len(key))
        n = links[own]
        values = (flush, stripe, cell[start:end].tobytes(), runs[start:end].astype(np.uint32).tobytes(), docs[own].tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].tobytes())
        for column, value in zip(rows.values(), values, strict=True):
            column.append(value)
    yield _batch(rows, _ALL)


def packed_links(docs: DataFrame, names: Vocabularies, stripes: int) -> DataFrame:
    """The summary of each document, and the links of its flush by stripe. A flush is numbered by task, so the rows are to be
    written before they are used twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, flush = sides(names), TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows: dict[str, list] = {c: [] for c in ("flush", *SUMMARY)}
        size, none = 0, np.empty(0, np.int64)
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                ids = s.ids(text) if text else None
                pairs, summary = (none, none), (0, 0, 0, 0, "")
                if ids:
                    x = align(*ids, s.lengths)
                    pairs = linked_pairs(x, s.n_second)
                    summary = (len(x.a), len(x.b), len(x.n_a), int((x.n_a * x.n_b).sum()), hashlib.sha256(written_groups(x, s)).hexdigest())
                for column, v in zip(rows.values(), (flush, len(held), doc_id, *summary), strict=True):
                    column.append(v)
                held.append(pairs)
                size += len(pairs[0])
                if size >= FLUSH or len(held) >= FLUSH_DOCS:
                    yield _batch(rows, _ALL)
                    yield from _packed(held, flush, s.n_second, stripes)
                    held, rows, size, flush = [], {c: [] for c in rows}, 0, flush + 1
        if held:
            yield _batch(rows, _ALL)
            yield from _packed(held, flush, s.n_second, stripes)

    return own_columns(docs, "doc_id", "text").mapInArrow(run, _schema(_ALL))


# ---------------------------------------------------------------- counts by stripe

COUNTS = {"stripe": "int", "part": "int", "codes": "binary", "counts": "binary", "maxima": "binary"}


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {name: batch.column(k)[row].as_py() for k, name in enumerate(batch.schema.names)}


def _block_shape(names: Vocabularies, stripes: int) -> tuple[int, int]:
    s = sides(names)
    return -(-s.n_first // stripes), s.n_second


def _summed(rows: DataFrame, names: Vocabularies, stripes: int, kind: str) -> DataFrame:
    """(stripe, part, codes, counts): the nonzero cells of each stripe part's dense block, with the maxima of its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height, width = _block_shape(names, stripes)
        for (stripe, part), own in groupby(_rows(batches), lambda r: (r["stripe"], r["part"])):
            block = np.zeros(height * width, kind)
            for r in own:
                np.add.at(block, np.frombuffer(r["codes"], np.uint32), np.frombuffer(r["counts"], r["kind"]).astype(kind))
            cells = np.flatnonzero(block).astype(np.uint32)
            counts, maxima = block[cells].astype(np.int64), block.reshape(height, width).max(axis=1).astype(np.int64)
            for start in range(0, len(cells), CELLS):
                at = slice(start, start + CELLS)
                yield _batch({"stripe": [stripe], "part": [part], "codes": [cells[at].tobytes()], "counts": [counts[at].tobytes()], "maxima": [maxima.tobytes()]}, COUNTS)

    dealt = rows.select("stripe", "part", "codes", "counts", "kind").repartition("stripe", "part").sortWithinPartitions("stripe", "part")
    return dealt.mapInArrow(run, _schema(COUNTS))


def _pair_counts(links: DataFrame, parts: int, names: Vocabularies, stripes: int, kind: str) -> DataFrame:
    """The counts of all pairs, a few rows per stripe, written."""
    of_flush = links.select("stripe", F.pmod(F.xxhash64("flush"), F.lit(parts)).cast("int").alias("part"), "codes", F.col("runs").alias("counts"), F.lit("uint32").alias("kind"))
    counts = _summed(of_flush, names, stripes, kind)
    if parts > 1:
        counts = _summed(counts.withColumn("part", F.lit(0)).withColumn("kind", F.lit("int64")), names, stripes, kind)
    return written(counts, "pair-counts")


def _scored(links: DataFrame, counts: DataFrame, parts: int, names: Vocabularies, stripes: int, kind: str) -> DataFrame:
    """(flush, docs, best, sums): for the documents of a flush that have links in a stripe, how many are best and the sum of
    their counts. Links stream behind the counts of their stripe, in the same partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height, width = _block_shape(names, stripes)
        for _, own in groupby(_rows(batches), lambda r: (r["stripe"], r["part"])):
            block, maxima = np.zeros(height * width, kind), np.zeros(height, np.int64)
            for r in own:
                codes = np.frombuffer(r["codes"], np.uint32)
                if r["flush"] is None:
                    block[codes] = np.frombuffer(r["counts"], np.int64)
                    maxima = np.frombuffer(r["maxima"], np.int64)
                    continue
                count, runs = block[codes].astype(np.int64), np.frombuffer(r["runs"], np.uint32)
                best = count == maxima[codes // width]
                n = np.frombuffer(r["links"], np.uint8).astype(np.int64)
                n[n == 255] = np.frombuffer(r["more"], np.int64)
                docs, at = np.unique(np.frombuffer(r["docs"], np.uint16), return_inverse=True)
                n_best, sums = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(sums, at, n * np.repeat(count, runs))
                np.add.at(n_best, at, n * np.repeat(best, runs))
                yield pa.RecordBatch.from_arrays([pa.array([r["flush"]]), *(pa.array([v.tobytes()], pa.binary()) for v in (docs, n_best, sums))], names=["flush", "docs", "best", "sums"])

    part = F.pmod(F.xxhash64("flush"), F.lit(parts)).cast("int").alias("part")
    streams = links.select("stripe", part, "flush", "codes", "runs", "docs", "links", "more")
    behind = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "codes", "counts", "maxima")
    both = behind.unionByName(streams, allowMissingColumns=True)
    return both.repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("flush").asc_nulls_first()).mapInArrow(run, "flush long, docs binary, best binary, sums binary")


def _collected(summaries: DataFrame, scores: DataFrame) -> DataFrame:
    """Each document's summary with the sums over its stripes; a flush is bounded, and so is its group."""

    def run(own: pa.Table, parts: pa.Table) -> pa.Table:
        place = own.column("place").to_numpy()
        n_best, sums = np.zeros(FLUSH_DOCS + 1, np.int64), np.zeros(FLUSH_DOCS + 1, np.int64)
        for docs, best, total in zip(*(parts.column(c) for c in ("docs", "best", "sums")), strict=True):
            at = np.frombuffer(docs.as_py(), np.uint16)
            n_best[at] += np.frombuffer(best.as_py(), np.int64)
            sums[at] += np.frombuffer(total.as_py(), np.int64)
        out = own.select([c for c in SUMMARY if c != "place"])
        return out.append_column("n_best", pa.array(n_best[place])).append_column("count_sum", pa.array(sums[place]))

    columns = {c: k for c, k in SUMMARY.items() if c != "place"} | {"n_best": "long", "count_sum": "long"}
    return summaries.groupBy("flush").cogroup(scores.groupBy("flush")).applyInArrow(run, _schema(columns))


def _prepared(docs: DataFrame, names: Vocabularies, stripes: int, part: int) -> tuple[DataFrame, DataFrame, DataFrame, int, str]:
    n = docs.count()
    parts, kind = 1 + n // part, "int32" if n < 2**31 else "int64"
    tokens = written(packed_links(docs, names, stripes), "links")
    links = tokens.filter("stripe is not null")
    return tokens.filter("stripe is null"), links, _pair_counts(links, parts, names, stripes, kind), parts, kind


def alignment_report(docs: DataFrame, names: Vocabularies = Vocabularies(), stripes: int = STRIPES, part: int = PART) -> DataFrame:  # noqa: B008
    """One row per document: tokens, groups and links, how many links are best, the sum of the links' counts, and a digest of
    the groups. Blocks are int32 while the number of rows is under 2 ** 31, as no count can be higher."""
    summaries, links, counts, parts, kind = _prepared(docs, names, stripes, part)
    scores = _scored(links, counts, parts, names, stripes, kind)
    return _collected(summaries.select("flush", *SUMMARY), scores)


def linked_ids(docs: DataFrame, names: Vocabularies = Vocabularies(), stripes: int = STRIPES, part: int = PART) -> DataFrame:  # noqa: B008
    """(a, b, documents, best): every id pair that some document links, in how many documents, and if it is best of its a."""
    counts = _prepared(docs, names, stripes, part)[2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, width = _block_shape(names, stripes)
        for r in _rows(batches):
            row, b = np.divmod(np.frombuffer(r["codes"], np.uint32).astype(np.int64), width)
            n = np.frombuffer(r["counts"], np.int64)
            best = n == np.frombuffer(r["maxima"], np.int64)[row]
            yield pa.RecordBatch.from_arrays([pa.array(row * stripes + r["stripe"]), pa.array(b), pa.array(n), pa.array(best)], names=["a", "b", "documents", "best"])

    return counts.mapInArrow(run, "a long, b long, documents long, best boolean")


def aligned_groups(docs: DataFrame, names: Vocabularies = Vocabularies()) -> DataFrame:  # noqa: B008
    """(doc_id, a, b, group_a, group_b): the ids of both sides and the number of each token's group, counted from 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(names)
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = s.ids(value.as_py()) if value.as_py() else None
                x = align(*ids, s.lengths) if ids else None
                lists = [x.a, x.b, x.of_a, x.of_b] if x else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.array([v], pa.list_(pa.int64())) for v in lists)], names=["doc_id", "a", "b", "group_a", "group_b"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, a array<long>, b array<long>, group_a array<long>, group_b array<long>")

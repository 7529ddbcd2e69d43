"""Removal of every byte covered by a string of ``length`` bytes that starts in two places or more.

Suffixes are sorted with a difference cover (see ``suffixes``), but sorting the whole corpus so would take many times its
size, so first what needs no sorting is settled by names:

1. Every window of ``length`` bytes has an anchor: the first of its 48-byte grams with the smallest hash. Equal windows
   have their anchors at equal places, so an anchor whose gram occurs once ends the matter for all its windows. Anchors
   are about one byte in eighty. An anchor's context holds all its windows; where a context occurs twice, all windows of
   the anchor are repeated. What is left are anchors with a repeated gram in a new context: the ends of matches.
2. The same once more for stretches of ``STRETCH`` neighbouring windows of such an anchor: the bytes that all of them
   have are their core. Stretches whose core occurs once are done, and so are those that occur twice as a whole.
3. A stretch that is still open, and one for each that occurs twice and shares its core, becomes a string of symbols: the
   bytes left of the core, the core as one symbol, the bytes right of it. These strings' suffixes are sorted with the
   difference cover, and neighbours are compared on their first symbols: those that agree begin equal windows.

Tasks send packed arrays by hash range. Entries that a task holds more than once go out once, and a name that a task
holds in many contexts is dealt by context, so that a passage of a third of all documents fills no bucket. All entries
of such a name say so, also the two that go where its other contexts are looked for: each of its contexts is compared.
What is removed is told apart by 128 bits (two polynomial hashes), and next to cores by the bytes themselves.

Null text counts as empty; texts under ``length`` bytes stay whole; rows that share id and text are told apart by nothing
and each counts as an occurrence. Very long texts are one row in memory, some sixty bytes of arrays for each of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, map_batches, own_columns, written
from palimpsest.llm.hashing import BASES, mix, powers, prefixes, substrings
from palimpsest.llm.suffixes import TASK_ROWS, suffix_ranks

LENGTH = 200
GRAM = 48
#: Windows to a stretch, at most nine: the bytes beside a core fit in a word.
STRETCH = 5
FLUSH = 500_000
#: Bytes of text to a bucket, about, and the most buckets.
BUCKET = 10_000_000
BUCKETS = 1 << 18
#: Contexts of a name in a flush beyond which they are dealt by context.
HOT = 32
#: What windows do: count as repeated; are compared.
COVERED, COMPARED = 1, 2
#: Flags of an entry, above its place: there are more of its context; its name is hot; it is told that it is covered.
FLAG = np.uint64(60)
MORE, HOT_NAME, TOLD = np.uint64(1), np.uint64(2), np.uint64(4)


def anchors(p: np.ndarray, n: int, length: int = LENGTH) -> np.ndarray:
    """For each window of a text of ``n`` bytes with prefix hashes ``p``, the place of its anchor."""
    grams = n - GRAM + 1
    h = mix((p[GRAM:] - p[:grams]) * powers(n + 1)[1][:grams])
    at = np.arange(grams, dtype=np.uint64)
    low = np.uint64((1 << 31) - 1)
    key = (h & ~low) | at  # of equal hashes, the first
    w = length - GRAM + 1
    blocks = -(-grams // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = key
    padded = padded.reshape(blocks, w)
    from_left = np.minimum.accumulate(padded, axis=1).ravel()
    from_right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    return (np.minimum(from_right[:windows], from_left[w - 1 : w - 1 + windows]) & low).astype(np.int64)


def _text(value: pa.Scalar) -> bytes | memoryview:
    """The UTF-8 bytes of a text, as they lie in the batch."""
    return memoryview(value.as_buffer()) if value.is_valid else b""


def _word(key: int) -> np.uint64:
    return np.uint64(key % (1 << 64))


def _names(ps: list[np.ndarray], start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """The 128 bits that name the strings from ``start`` to ``end``, apart by ``salt``."""
    return [mix(substrings(p, start, end, b) ^ mix(salt.astype(np.uint64) + np.uint64(77 + i))) for i, (p, b) in enumerate(zip(ps, BASES, strict=True))]


def anchor_entries(text: bytes, length: int = LENGTH) -> list[np.ndarray]:
    """(gram, context, context, place) of a text's anchors."""
    data = np.frombuffer(text, np.uint8)
    ps = [prefixes(data, b) for b in BASES]
    at = np.unique(anchors(ps[0], len(text), length))
    start, end = np.maximum(at - (length - GRAM), 0), np.minimum(at + length, len(text))
    return [substrings(ps[0], at, at + GRAM), *_names(ps, start, end, at - start), at.astype(np.uint64)]


def segments(at: np.ndarray, n: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """The stretches of a text of ``n`` bytes that hold all windows of the anchors ``at``, and of no anchor in part."""
    reach = length - GRAM + STRETCH  # so that a stretch is cut only where the text ends
    start, end = np.maximum(at - reach, 0), np.minimum(at + length, n)
    apart = np.append(True, start[1:] > np.maximum.accumulate(end)[:-1])
    yield from zip(start[apart].tolist(), np.maximum.reduceat(end, np.flatnonzero(apart)).tolist(), strict=True)


def stretch_entries(text: bytes, compared: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """(core, whole, whole, place, core, left, right) of the stretches that have a window of the anchors ``compared``:
    ``place`` is that of the last window, with the number of bytes that ``left`` and ``right`` of the core have above it."""
    wide, n = STRETCH - 1, len(text)
    padded = np.concatenate([np.zeros(8, np.uint8), np.frombuffer(text, np.uint8), np.zeros(8, np.uint8)])
    side = lambda s: np.ascontiguousarray(padded[s[:, None] + np.arange(8) + 8]).view(np.uint64).ravel()
    found: list[list[np.ndarray]] = []
    for a, b in segments(compared, n, length):
        ps = [prefixes(padded[8 + a : 8 + b], base) for base in BASES]
        of = anchors(ps[0], b - a, length)
        start = np.flatnonzero(np.isin(of + a, compared))
        stretch = np.unique(of[start] << 8 | (of[start] - start) // STRETCH)
        number = stretch & 255
        last = (stretch >> 8) - STRETCH * number
        first = last - wide
        begin, end = np.maximum(first, 0), np.minimum(last + length, b - a)
        core = _names(ps, last, first + length, number)
        whole = _names(ps, begin, end, number * 256 + last - begin)
        counts = (last - begin) << 40 | (end - (first + length)) << 44
        found.append([core[0], *whole, (last + a | counts).astype(np.uint64), core[1], side(last + a - 8), side(first + a + length)])
    return [np.concatenate(c) for c in zip(*found, strict=True)]


# ---------------------------------------------------------------- names that occur twice

PACKED = "bucket long, data binary"


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of uint64 columns, packed by bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, data = bucket[order], np.stack(columns, axis=1)[order]
    used, first = np.unique(bucket, return_index=True)
    ends = [*first[1:].tolist(), len(bucket)]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array([data[s:e].tobytes() for s, e in zip(first.tolist(), ends, strict=True)], pa.binary())], names=["bucket", "data"])


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group, first): rows sorted by columns, the group of each, and whether it begins one."""
    order = np.lexsort(columns[::-1])
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.cumsum(first) - 1, first


def settled(df: DataFrame, entries: Callable[[pa.RecordBatch, int], list[np.ndarray] | None], width: int, buckets: int, answer: Callable[[np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What is to be done about entries (name, context, context, key, place, ...) of ``width`` numbers.

    An entry is covered if its context occurs twice, and compared if its name occurs in other contexts too and its context
    does not occur twice; of a context that does, one entry is compared as well. ``answer`` makes rows of the entries of
    which something is to be done, and of what; an entry that occurs in several rows is answered at least once."""

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        c = [np.concatenate(x) for x in zip(*held, strict=True)]
        order, group, first = _first_of(*c[:3])
        lead = order[first]
        name = c[0][lead]
        of_name = np.cumsum(np.append(True, name[1:] != name[:-1])) - 1
        n_contexts = np.bincount(of_name)
        rank = np.arange(len(lead)) - np.concatenate([[0], np.cumsum(n_contexts)[:-1]])[of_name]
        hot = n_contexts[of_name] > HOT
        flags = np.where(np.bincount(group) > 1, MORE, np.uint64(0)) | np.where(hot, HOT_NAME, np.uint64(0))
        bucket = np.where(hot & (rank >= 2), mix(c[1][lead]), mix(name)) % np.uint64(buckets)
        yield from _by_bucket(bucket, [*(x[lead] for x in c[:4]), c[4][lead] | flags << FLAG, *(x[lead] for x in c[5:])])
        # the others of a context are covered; that is theirs to say, once for each key and place
        rest = order[~first]
        rest = rest[(lambda o, g, f: o[f])(*_first_of(c[3][rest], c[4][rest]))]
        yield from _by_bucket(mix(c[3][rest]) % np.uint64(buckets), [*(x[rest] for x in c[:4]), c[4][rest] | TOLD << FLAG, *(x[rest] for x in c[5:])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                if (e := entries(batch, row)) is not None and len(e[0]):
                    held.append(e)
                    size += len(e[0])
                if size >= FLUSH:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def settle(rows: pa.Table) -> pa.Table:
        data = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in rows.column("data")]).reshape(-1, width)
        flags = data[:, 4] >> FLAG
        told = data[flags == TOLD]
        data, flags = data[flags != TOLD], flags[flags != TOLD]
        order, group, first = _first_of(data[:, 0], data[:, 1], data[:, 2])
        data, flags = data[order], flags[order]
        name = data[:, 0]
        twice = (np.bincount(group) > 1) | (np.bincount(group, weights=flags & MORE) > 0) if len(data) else np.empty(0, bool)
        again, hot = twice[group], (flags & HOT_NAME) > 0
        of_name = np.cumsum(np.append(True, name[1:] != name[:-1])[: len(name)]) - 1
        shared = ((np.bincount(of_name) > 1) | (np.bincount(of_name, weights=again | hot) > 0))[of_name]
        open_name = (np.bincount(of_name, weights=~again | hot) > 0)[of_name] & shared
        what = np.where(again, COVERED, np.where(shared, COMPARED, 0)) | np.where(again & first & open_name, COMPARED, 0)
        data, what = np.concatenate([data[what > 0], told]), np.concatenate([what[what > 0], np.full(len(told), COVERED)])
        data[:, 4] &= (np.uint64(1) << FLAG) - np.uint64(1)
        order, group, first = _first_of(data[:, 3], data[:, 4])
        return answer(data[order[first]], np.bitwise_or.reduceat(what[order], np.flatnonzero(first)) if len(order) else what)

    return df.mapInArrow(run, PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, schema)


def _by_key(key: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """A row for each key, with the bytes of its part of each column; ``key`` is in order."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=False))
    return pa.table({"key": pa.array(key[first].view(np.int64)), **{k: pa.array([c[s:e].tobytes() for s, e in cuts], pa.binary()) for k, c in columns.items()}})


def anchor_replies(docs: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(key, at, what): for texts (key, text) with repeated grams, the anchors of which something is to be done."""

    def entries(batch: pa.RecordBatch, row: int) -> list[np.ndarray] | None:
        text = _text(batch.column(1)[row])
        if len(text) < length:
            return None
        *names, at = anchor_entries(text, length)
        return [*names, np.full(len(at), _word(batch.column(0)[row].as_py())), at]

    def answer(data: np.ndarray, what: np.ndarray) -> pa.Table:
        return _by_key(data[:, 3], {"at": data[:, 4].astype(np.uint32), "what": what.astype(np.uint8)})

    return settled(docs.select("key", "text"), entries, 5, buckets, answer, "key long, at binary, what binary")


def _actions(replies: pa.Scalar, size: int) -> np.ndarray:
    """What the replies say of each place of a text."""
    out = np.zeros(size, np.uint8)
    for r in replies.as_py() or ():
        np.bitwise_or.at(out, np.frombuffer(r["at"], np.uint32), np.frombuffer(r["what"], np.uint8))
    return out


STRETCHES = "key long, last long, n_left int, n_right int, what int, core_a long, core_b long, sides binary, syms array<long>"


def stretch_answers(open_docs: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """The stretches of texts (key, text, compared) that are repeated, or to be compared, or both; ``syms`` is the string of
    symbols of what is compared."""

    def entries(batch: pa.RecordBatch, row: int) -> list[np.ndarray] | None:
        text = _text(batch.column(1)[row])
        core, one, two, place, *rest = stretch_entries(text, batch.column(2)[row].values.to_numpy(), length)
        return [core, one, two, np.full(len(core), _word(batch.column(0)[row].as_py())), place, *rest]

    def answer(data: np.ndarray, what: np.ndarray) -> pa.Table:
        place = data[:, 4].astype(np.int64)
        compared = (what & COMPARED) > 0
        sides = np.ascontiguousarray(data[:, 6:8]).view(np.uint8).reshape(-1, 16)
        beside = sides.astype(np.int64) + 1
        core = (data[:, :1] >> np.uint64(2)).astype(np.int64) | (1 << 60)
        wide = STRETCH - 1
        syms = np.concatenate([beside[:, 8 - wide : 8], core, beside[:, 8 : 8 + wide]], axis=1)
        m = 2 * wide + 1
        ends = np.concatenate([[0], np.cumsum(np.where(compared, m, 0))]).astype(np.int32)
        return pa.table({
            "key": np.ascontiguousarray(data[:, 3]).view(np.int64), "last": place & ((1 << 40) - 1), "n_left": (place >> 40 & 15).astype(np.int32), "n_right": (place >> 44 & 15).astype(np.int32), "what": what.astype(np.int32),
            "core_a": np.ascontiguousarray(data[:, 0]).view(np.int64), "core_b": np.ascontiguousarray(data[:, 5]).view(np.int64), "sides": pa.array([s.tobytes() for s in sides], pa.binary()),
            "syms": pa.ListArray.from_arrays(pa.array(ends), pa.array(syms[compared].ravel())),
        })

    return settled(open_docs.select("key", "text", "compared"), entries, 8, buckets, answer, STRETCHES)


# ---------------------------------------------------------------- suffixes


def equal_neighbours(ordered: DataFrame, same: list[str], carried: list[str]) -> DataFrame:
    """The ``carried`` columns of rows that agree in ``same`` with the row before or behind; ``ordered`` is sorted by
    ``rank`` within tasks by range. What lies at the ends of tasks is compared afterwards, two rows a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, opening, pending = TaskContext.get().partitionId(), False, True, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if pending is not None:
                t = pa.concat_tables([pending, t])
            n, agree = t.num_rows, np.ones(max(t.num_rows - 1, 0), bool)
            for c in same:
                x = t.column(c).combine_chunks()
                agree &= pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            hit = np.append(False, agree)
            hit[:-1] |= agree
            hit[0] |= last
            edge = np.zeros(n, bool)
            edge[0], opening = opening, opening and n == 1
            out = t.append_column("hit", pa.array(hit)).append_column("edge", pa.array(edge)).append_column("task", pa.array(np.full(n, task)))
            # the last row waits for the one behind it
            pending, last, waiting = t.slice(n - 1), bool(hit[-1]), out.slice(n - 1)
            yield from out.slice(0, n - 1).combine_chunks().to_batches()
        if pending is not None:
            waiting = waiting.set_column(waiting.schema.get_field_index("edge"), "edge", pa.array([True]))
            yield from waiting.to_batches()

    columns = ordered.select("rank", *same, *carried)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    found = written(columns.mapInArrow(run, f"{schema}, hit boolean, edge boolean, task long"), "neighbours")
    in_order = Window.orderBy("rank")  # two rows for each task
    side = lambda f: F.least(*(F.coalesce(f(c, 1).over(in_order) == F.col(c), F.lit(False)).cast("int") for c in same)) == 1 if len(same) > 1 else F.coalesce(f(same[0], 1).over(in_order) == F.col(same[0]), F.lit(False))
    ends = found.filter("edge").withColumn("hit", F.col("hit") | side(F.lag) | side(F.lead))
    return found.filter("hit and not edge").select(*carried).unionByName(ends.filter("hit").select(*carried))


def repeated_windows(stretches: DataFrame) -> DataFrame:
    """(key, start): the windows of the compared stretches that are repeated, by sorted suffixes."""
    strings = written(stretches.filter(F.col("what").bitwiseAND(COMPARED) > 0).withColumn("sid", F.monotonically_increasing_id()), "stretch-strings")
    n = strings.count()
    if not n:
        return strings.select("key", F.col("last").alias("start"))
    wide = STRETCH - 1
    ranks = suffix_ranks(strings.select("sid", "syms"), wide)
    windows = ranks.join(strings, "sid").filter((F.col("pos") >= wide - F.col("n_left")) & (F.col("pos") <= F.col("n_right")))
    rows = windows.select("rank", "core_a", "core_b", "pos", F.expr(f"substring(sides, pos + {9 - wide}, {wide})").alias("beside"), "key", (F.col("last") - wide + F.col("pos")).alias("start"), (F.col("what") == COMPARED).alias("asked"))
    rows = written(rows, "window-suffixes")
    ordered = rows.repartitionByRange(2 + n * STRETCH // TASK_ROWS, "rank").sortWithinPartitions("rank")
    found = equal_neighbours(ordered, ["core_a", "core_b", "pos", "beside"], ["key", "start", "asked"])
    for df in (strings, ranks):
        discard(df)
    return found.filter("asked").select("key", "start")


# ---------------------------------------------------------------- report


def runs_of(n: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of marked places among ``n``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked[:n].astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def spans_of(n: int, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of bytes of a text of ``n`` bytes under the windows that begin from ``first`` to
    before ``last``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last - 1 + length, -1)
    return runs_of(n, np.cumsum(change) > 0)


def _result(text: bytes | memoryview, first: np.ndarray, last: np.ndarray, length: int) -> tuple[int, list[int], bytes]:
    starts, ends = spans_of(len(text), first, last, length) if len(first) else (first, last)
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:s])
        at = e
    return len(text), np.stack([starts, ends], axis=1).ravel().tolist(), b"".join([*kept, text[at:]])


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
WHOLE = "doc_id long, n_bytes long, spans array<long>, kept binary"


def _rows(found: list[tuple[int | None, tuple[int, list[int], bytes]]], digest: bool) -> dict[str, pa.Array]:
    out = {"doc_id": pa.array([d for d, _ in found], pa.int64()), "n_bytes": pa.array([r and r[0] for _, r in found], pa.int64())}
    if digest:
        out["n_removed"] = pa.array([r and sum(r[1][1::2]) - sum(r[1][::2]) for _, r in found], pa.int64())
        out["n_spans"] = pa.array([r and len(r[1]) // 2 for _, r in found], pa.int64())
        out["kept_sha256"] = pa.array([r and hashlib.sha256(r[2]).hexdigest() for _, r in found], pa.string())
    else:
        out["spans"] = pa.array([r and r[1] for _, r in found], pa.list_(pa.int64()))
        out["kept"] = pa.array([r and r[2] for _, r in found], pa.binary())
    return out


def repeats_removed(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """One row per document: (doc_id, n_bytes, spans, kept), ``spans`` as starts and ends of the removed runs in turn and
    ``kept`` as the remaining bytes; with ``digest``, sizes and the SHA-256 instead of those two."""
    own = own_columns(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(BUCKETS, 16 + size // BUCKET)
    replies = written(anchor_replies(own, buckets, length).groupBy("key").agg(F.collect_list(F.struct("at", "what")).alias("replies")), "anchor-replies")
    columns = DIGEST if digest else WHOLE

    none = np.empty(0, np.int64)

    def first(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The result of texts without a compared anchor; the others go on, with the runs of their covered windows."""
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            found, on, runs, compared = [], [], [], []
            for row, doc_id in enumerate(b.column(0).to_pylist()):
                text, covered, ask = _text(b.column(2)[row]), (none, none), none
                if b.column(3)[row].is_valid:
                    action = _actions(b.column(3)[row], len(text))
                    windows = action[anchors(prefixes(np.frombuffer(text, np.uint8)), len(text), length)]
                    covered, ask = runs_of(len(windows), (windows & COVERED) > 0), np.flatnonzero(action & COMPARED)
                goes = len(ask) > 0
                found.append((doc_id, None if goes else _result(text, *covered, length)))
                on.append(row if goes else None)
                runs.append(np.stack(covered, axis=1).ravel() if goes else None)
                compared.append(ask if goes else None)
            keep = _rows(found, digest)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (runs, compared)]
            yield pa.RecordBatch.from_arrays([*keep.values(), b.column(1), b.column(2).take(pa.array(on, pa.int64())), *lists], names=[*keep, "key", "text", "covered", "compared"])

    def second(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            found = []
            for row, doc_id in enumerate(b.column(0).to_pylist()):
                covered = b.column(2)[row].values.to_numpy()
                more = b.column(3)[row].values.to_numpy() if b.column(3)[row].is_valid else none
                found.append((doc_id, _result(_text(b.column(1)[row]), np.append(covered[::2], more), np.append(covered[1::2], more + 1), length)))
            rows = _rows(found, digest)
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    joined = own.join(replies, "key", "left").select("doc_id", "key", "text", "replies")
    stage = written(map_batches(joined, first, f"{columns}, key long, text string, covered array<long>, compared array<long>"), "with-replies")
    discard(replies)
    found = stage.filter("compared is not null")
    stretches = written(stretch_answers(found, buckets, length), "stretches")
    wide = STRETCH - 1
    whole = stretches.filter(F.col("what").bitwiseAND(COVERED) > 0).select("key", F.explode(F.sequence(F.col("last") - F.least(F.lit(wide), "n_left"), F.col("last") - wide + F.col("n_right"))).alias("start"))
    starts = whole.unionByName(repeated_windows(stretches)).groupBy("key").agg(F.collect_set("start").alias("windows"))
    again = found.join(starts, "key", "left").select("doc_id", "text", "covered", "windows")
    done = stage.filter("compared is null").select(*(c.split()[0] for c in columns.split(", ")))
    return map_batches(again, second, columns).unionByName(done)


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return repeats_removed(docs, length, digest=True)

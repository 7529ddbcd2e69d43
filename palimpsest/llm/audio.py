"""Media columns: chroma fingerprints of recordings and their alignment.

A recording (16-bit PCM WAV bytes) is resampled to ``RATE`` and becomes frames of energy per pitch class, so frames and
hops are of 0.37 and 0.09 seconds whatever its rate. Filters over rectangles of frames and
classes, read off an integral image, give two bits each; sixteen of them pack into a 32-bit code per frame. Recordings
of equal codes form a class. Queries (classes with an id divisible by ``EVERY``) are laid against every other class at
every offset with an overlap of ``MIN_OVERLAP`` codes; the offset of the smallest share of differing bits is the
alignment. Bits at all offsets of a pair are counted by one correlation, in blocks of classes and queries, so work is
the number of classes times that of queries and no pair within ``MAX_BIT_ERRORS`` is lost.

The test tables have no recordings: :func:`recordings` plays each vector of ``embeddings`` as a row of notes.

Null, empty or unreadable audio, and audio under ``WIDTH`` frames, has no codes, is in no class and matches nothing.
Repeated rows give repeated rows. Copies are not expanded into pairs: only classes are matched. Of equal matches the one of
the smallest id is given, then the longest overlap and the smallest offset; ``n_matches`` counts the classes of queries
that align. A very long recording is one row in memory; its samples are resampled and transformed in blocks.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, map_batches, own_columns, written

#: Samples a second; no pitch over half of it is used.
RATE = 2756
#: Resampled samples, and frames, to a block.
SAMPLES, FRAMES = 4096, 2048
FRAME = 1024
HOP = 256
#: Frames under a filter.
WIDTH = 8
EVERY = 100
MAX_BIT_ERRORS = 0.15
MIN_OVERLAP = 16
#: Queries to a round, and pairs of classes to a task.
ROUND = 50_000
#: Codes of the queries of a round, about: what the driver and every task hold of them at a time.
ROUND_CODES = 4_000_000
TASK_PAIRS = 2_000_000
BROADCAST_ROWS = 1_000_000


def play(vector: list[float | None], note: int = HOP) -> bytes:
    """A WAV of one note per number: semitones around A2, a unit to the octave."""
    x = np.array([0.0 if v is None else v for v in vector], np.float64)
    pitch = 45 + np.clip(np.nan_to_num(np.round(x * 12)), -12, 24)
    step = np.repeat(440 * 2 ** ((pitch - 69) / 12) / RATE, note)
    pcm = (np.sin(2 * np.pi * np.cumsum(step)) * 12000).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def recordings(vectors: DataFrame) -> DataFrame:
    """(id, audio) of a table (vec_id, embedding)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 256):  # a WAV is much larger than its vector
            part = batch.slice(start, 256)
            audio = [play(v) if v else None for v in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], names=["id", "audio"])

    return map_batches(own_columns(vectors, "vec_id", "embedding"), run, "id long, audio binary")


def samples(audio: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and their rate; none if the bytes are no WAV that can be read."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            if w.getsampwidth() != 2:
                return np.empty(0), RATE
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32)
            return x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return np.empty(0), RATE


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    """Samples at ``RATE`` of samples at ``rate``, by a windowed sinc."""
    if rate == RATE or not len(x):
        return x
    step = rate / RATE
    wide = max(1.0, step)  # zero crossings of the filter are so many samples apart
    reach = int(8 * wide) + 1
    out = np.empty(int(len(x) / step), np.float32)
    for at in range(0, len(out), SAMPLES):
        centre = np.arange(at, min(at + SAMPLES, len(out))) * step
        index = centre.astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
        off = (index - centre[:, None]) / wide
        weight = np.sinc(off) * np.where(np.abs(off) < 8, 0.5 + 0.5 * np.cos(np.pi * off / 8), 0) / wide
        out[at : at + len(centre)] = (np.where((index >= 0) & (index < len(x)), x[np.clip(index, 0, len(x) - 1)], 0) * weight).sum(axis=1)
    return out


_TAPER = np.hanning(FRAME).astype(np.float32)


def _pitch_classes() -> np.ndarray:
    """For each frequency of a frame, its pitch class as a row of twelve."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12), np.float32)
    used = (f > 55) & (f < 3520)
    out[np.flatnonzero(used), np.round(12 * np.log2(f[used] / 440)).astype(int) % 12] = 1
    return out


_CLASSES = _pitch_classes()


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch classes, each frame of unit sum (zero if silent)."""
    x = resampled(x, rate)
    if len(x) < FRAME:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    energy = np.concatenate([(np.abs(np.fft.rfft(frames[at : at + FRAMES] * _TAPER, axis=1)) ** 2) @ _CLASSES for at in range(0, len(frames), FRAMES)])
    total = energy.sum(axis=1, keepdims=True)
    return np.where(total > 1e-9, energy / np.maximum(total, 1e-9), 0.0)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, class, height, width) of the sixteen filters: four kinds at four places, from small to large."""
    return [(i % 4, 3 * (i // 4), 2 + (i // 4) % 3, 4 + 4 * (i // 8)) for i in range(16)]


FILTERS = _filters()


def codes(c: np.ndarray) -> np.ndarray:
    """A packed code for each place where a filter of ``WIDTH`` frames fits."""
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for i, (kind, y, h, w) in enumerate(FILTERS):
        y1 = min(12, y + h)
        mid = (y + y1) // 2
        if kind == 0:  # now against later
            a, b = area(0, w // 2, y, y1), area(w // 2, w, y, y1)
        elif kind == 1:  # low against high
            a, b = area(0, w, y, max(mid, y + 1)), area(0, w, max(mid, y + 1), y1) if y1 > y + 1 else area(0, w, 0, y)
        elif kind == 2:  # the place against the rest
            a, b = area(0, w, y, y1), (area(0, w, 0, 12) - area(0, w, y, y1)) * (y1 - y) / 12
        else:  # the middle against the ends
            a, b = area(w // 4, w - w // 4, y, y1), area(0, w // 4, y, y1) + area(w - w // 4, w, y, y1)
        level = np.digitize(np.log((a + 0.01) / (b + 0.01)), (-0.7, 0.0, 0.7)).astype(np.uint32)
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * i)  # neighbours differ in a bit
    return out


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, n_codes, codes array<long>, name): name is the SHA-256 of the codes, null without codes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [codes(chroma(*samples(a.as_py()))) for a in batch.column(1)]
        names = [hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() if len(f) else None for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())), pa.array(names, pa.string())], names=["id", "n_codes", "codes", "name"])

    return map_batches(own_columns(media, "id", "audio"), run, "id long, n_codes long, codes array<long>, name string")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _spectra(block: list[np.ndarray], size: int) -> np.ndarray:
    """(frequency, recording, bit) of codes as +1 and -1 per bit, padded by zeros to ``size``."""
    signs = np.zeros((len(block), 32, size), np.float32 if size <= 4096 else np.float64)  # sums stay exact to a fraction
    for row, c in zip(signs, block, strict=True):
        row[:, : len(c)] = 1 - 2.0 * ((c >> np.arange(32, dtype=np.uint32)[:, None]) & np.uint32(1))
    return np.ascontiguousarray(np.fft.rfft(signs, axis=2).transpose(2, 0, 1))


def _lengths(block: list[np.ndarray]) -> np.ndarray:
    """Lengths of a block, one number if all are equal."""
    n = np.array([len(c) for c in block])
    return n[:1] if (n == n[0]).all() else n


def alignments(classes: list[np.ndarray], queries: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
    """(class, query, offset, overlap, share of differing bits), by place in the lists, of all that match."""
    by_size = sorted(range(len(queries)), key=lambda j: len(queries[j]))
    order = sorted(range(len(classes)), key=lambda i: len(classes[i]))
    longest = max(map(len, queries), default=0)
    at = 0
    while at < len(order):
        some = min(256, max(1, (1 << 15) // (len(classes[order[at]]) + longest)))
        rows, at = order[at : at + some], at + some
        mine, done, spectra = [classes[i] for i in rows], 0, {}
        while done < len(by_size):
            some = min(64, max(1, (1 << 13) // (len(mine[-1]) + len(queries[by_size[done]]))))
            columns, done = by_size[done : done + some], done + some
            theirs = [queries[j] for j in columns]
            size = 1 << int(len(mine[-1]) + len(theirs[-1]) - 1).bit_length()
            if size not in spectra:
                spectra = {size: _spectra(mine, size)}
            product = spectra[size] @ _spectra(theirs, size).conj().transpose(0, 2, 1)
            agree = np.fft.irfft(np.ascontiguousarray(product.transpose(1, 2, 0)), n=size, axis=2)
            offset = np.arange(size)
            offset[len(mine[-1]) :] -= size
            overlap = np.minimum(_lengths(mine)[:, None, None] - np.maximum(offset, 0), _lengths(theirs)[None, :, None] - np.maximum(-offset, 0))
            least = np.where(overlap >= MIN_OVERLAP, 32 * overlap * (1 - 2 * MAX_BIT_ERRORS) - 1, np.inf).astype(agree.dtype)
            for i, j, k in zip(*(x.tolist() for x in np.nonzero(agree >= least)), strict=True):
                d, c, q = int(offset[k]), mine[i], theirs[j]
                n = min(len(c) - max(d, 0), len(q) - max(-d, 0))
                errors = int(np.bitwise_count(c[max(d, 0) :][:n] ^ q[max(-d, 0) :][:n]).sum()) / (32.0 * n)
                if errors <= MAX_BIT_ERRORS:
                    yield rows[i], columns[j], d, n, errors


def _code_lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(c.values, np.int64).astype(np.uint32) for c in column]


FOUND = "class_id long, match_id long, match_offset int, overlap int, bit_errors double, links long"


def _found(classes: DataFrame, ids: list[int], queries: list[np.ndarray]) -> DataFrame:
    """The best match of each class among the queries, and how many match."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, best, all_of = batch.column(0).to_pylist(), {}, {}
        for i, j, d, n, errors in alignments(_code_lists(batch.column(1)), queries):
            rank = (errors, ids[j], -n, abs(d), -d)
            if own[i] != ids[j]:
                all_of.setdefault(i, set()).add(j)
                best[i] = min(rank, best.get(i, rank))
        rows = [(own[i], match, -d, -n, errors, len(all_of[i])) for i, (errors, match, n, _, d) in best.items()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["class_id", "match_id", "match_offset", "overlap", "bit_errors", "links"])

    return map_batches(classes.select("class_id", "codes"), run, FOUND)


def aligned(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, matches): (class_id, name, codes, is_query) and, for each class that aligns with another class of a
    query, the best and the number: (class_id, match_id, match_offset, overlap, bit_errors, n_matches)."""
    query = F.max((F.pmod("id", F.lit(EVERY)) == 0).cast("int")) == 1
    classes = written(prints.filter("name is not null").groupBy("name").agg(F.min("id").alias("class_id"), F.first("codes").alias("codes"), query.alias("is_query")), "audio-classes")
    asked = classes.filter("is_query").select("class_id", "codes")
    n_classes, n_asked = classes.count(), asked.count()
    rounds = max(1, -(-n_asked // ROUND), -(-(asked.agg(F.sum(F.size("codes"))).first()[0] or 0) // ROUND_CODES))
    dealt = classes.repartition(1 + n_classes * min(n_asked, ROUND) // TASK_PAIRS, "name")
    matches = None
    for k in range(rounds):
        t = asked.filter(F.pmod(F.xxhash64("class_id"), F.lit(rounds)) == k).toArrow()
        found = _found(dealt, t.column("class_id").to_pylist(), _code_lists(t.column("codes").combine_chunks()))
        matches = found if matches is None else matches.unionByName(found)
    best = matches.groupBy("class_id").agg(F.min_by(F.struct("match_id", "match_offset", "overlap", "bit_errors"), F.struct("bit_errors", "match_id")).alias("b"), F.sum("links").alias("n_matches"))
    return classes, best.select("class_id", "b.*", "n_matches")


def match_recordings(media: DataFrame) -> DataFrame:
    """One row per recording: (id, n_codes, name, class_id, match_id, match_offset, overlap, bit_errors, n_matches)."""
    prints = written(fingerprints(media), "fingerprints")
    classes, matches = aligned(prints)
    matched = written(classes.select("name", "class_id").join(matches, "class_id", "left"), "audio-matches")
    discard(classes)
    return prints.select("id", "n_codes", "name").join(_small(matched), "name", "left").select("id", "n_codes", "name", "class_id", "match_id", F.col("match_offset").cast("long").alias("match_offset"), F.col("overlap").cast("long").alias("overlap"), "bit_errors", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))

"""Secret scans: credential patterns plus a token-efficiency test.

Text under a byte-pair vocabulary takes a few characters per token; random strings take fewer than two. All runs of key
characters outside the pattern spans are tested so, whatever kinds of characters they hold: digests of known lengths and
UUIDs in them are set aside, and of the tokens of what is left, each of which scores the ratio less its characters, all
maximal scoring stretches are found in one pass. So a key behind a path or behind thousands of letters is found, and the
path stays. Stretches that are identifiers (words of the vocabulary and short numbers, joined by separators or case) are
set aside. All offsets are code points.

Null text counts as empty: no spans. Repeated rows give repeated rows. Spans of equal starts are listed in the order of
the kinds. Work is linear in a text, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import map_batches, own_columns

KINDS = ("assign", "access", "hex", "random")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of fewer fails either way
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_WORD_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])|[A-Z]{3,}(?=[A-Z][a-z])")
_JOINT = re.compile(r"[+/_=-]+|(?<![A-Za-z0-9])[0-9]{1,4}(?![A-Za-z0-9])")

Span = tuple[str, int, int]


@dataclass(frozen=True)
class EfficiencyTest:
    """A stretch of ``least`` characters or more is random if it has fewer than ``ratio`` to a token."""

    ratio: float = 2.0
    least: int = 20
    vocabulary: str = "byte_bpe_50k"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass their length test."""
    spans: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def identifier_like(run: str, encode: Callable[[str], list[int]]) -> bool:
    """Words of the vocabulary, separators and short numbers between them make up nearly all of it."""
    words = sum(len(w) for w in (m.group() for m in _WORD_PART.finditer(run)) if len(w) > 2 and any(len(encode(x)) == 1 for x in (w, f" {w}", f" {w.lower()}")))
    return words + sum(len(m.group()) for m in _JOINT.finditer(run)) >= 0.7 * len(run)


def known(run: str) -> bool:
    return bool(_DIGEST.fullmatch(run) and len(run) in _DIGEST_LENGTHS or _UUID.fullmatch(run))


_KNOWN = re.compile(rf"(?<![0-9A-Za-z])(?:{_UUID.pattern}|{'|'.join(f'[0-9a-fA-F]{{{n}}}' for n in sorted(_DIGEST_LENGTHS))})(?![0-9A-Za-z])")


def maximal_stretches(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring subsequences (start, end) of a list, in order, by the linear algorithm of Ruzzo and Tompa."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum of all before, sum to the end
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start = i
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            start, before = found[k][0], found[k][2]
            del found[k:]
        found.append((start, i + 1, before, total))
    return [(a, b) for a, b, _, _ in found]


def random_windows(run: str, encoding: object, test: EfficiencyTest) -> Iterator[tuple[int, int]]:
    """The stretches of a run that the vocabulary encodes badly, but for identifiers."""
    at = 0
    for start, end in [*(m.span() for m in _KNOWN.finditer(run)), (len(run), len(run))]:
        part = run[at:start]
        if len(part) >= test.least:
            ends = [0]
            for token in encoding.encode_ordinary(part):
                ends.append(ends[-1] + len(encoding.decode_single_token_bytes(token)))
            scores = [test.ratio - (y - x) for x, y in zip(ends, ends[1:], strict=False)]
            sums = [0.0]
            for x in scores:
                sums.append(sums[-1] + x)
            inner = [0 < e < len(part) and part[e - 1].isalnum() and part[e].isalnum() for e in ends]
            lefts = list(range(len(ends)))
            rights = list(range(len(ends)))
            for k in range(1, len(ends)):
                lefts[k] = lefts[k - 1] if inner[k] else k
                rights[-k - 1] = rights[-k] if inner[-k - 1] else rights[-k - 1]
            for i, j in maximal_stretches(scores):
                first, last = lefts[i], rights[j]
                # to the ends of the words it is in, if it is still random then
                i, j = next((x, y) for x, y in ((first, last), (first, j), (i, last), (i, j)) if sums[y] > sums[x])
                a, b = ends[i], ends[j]
                while a < b and not part[a].isalnum():
                    a += 1
                while a < b and not part[b - 1].isalnum():
                    b -= 1
                if b - a >= test.least and not identifier_like(part[a:b], encoding.encode_ordinary):
                    yield at + a, at + b
        at = end


def random_spans(text: str, taken: list[Span], test: EfficiencyTest) -> list[Span]:
    """What the vocabulary encodes badly in runs clear of ``taken``."""
    found: list[Span] = []
    encoding = None
    at = 0
    apart: list[list[int]] = []  # ``taken``, merged
    for _, start, end in sorted(taken, key=lambda s: s[1]):
        if apart and start <= apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], end)
        else:
            apart.append([start, end])
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(apart) and apart[at][1] <= start:
            at += 1
        pieces, k = [], at  # the run without what is taken
        while k < len(apart) and apart[k][0] < end:
            pieces.append((start, apart[k][0]))
            start, k = max(start, apart[k][1]), k + 1
        for a, b in [*pieces, (start, end)]:
            if b - a >= test.least:
                if encoding is None:
                    from palimpsest.llm.packing import public_encoder

                    encoding = public_encoder(test.vocabulary).fast
                last = None
                for x, y in random_windows(text[a:b], encoding, test):
                    if last is not None and x < last:  # stretches that grew into each other
                        found[-1] = ("random", found[-1][1], a + max(y, last))
                    else:
                        found.append(("random", a + x, a + y))
                    last = max(y, last or 0)
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, test: EfficiencyTest = EfficiencyTest()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, counts and digest of the pattern spans, all spans."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, listed = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            spans = sorted(base + random_spans(text, base, test), key=_order)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in spans))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            listed.append(joined(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(counts["random"], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return map_batches(own_columns(docs, "doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact_secrets(docs: DataFrame, test: EfficiencyTest = EfficiencyTest(), mask: str = "[secret]") -> DataFrame:  # noqa: B008
    """(doc_id, text) with every span, merged where they overlap, replaced by ``mask``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for value in batch.column(1):
            text, out, last = value.as_py(), [], 0
            base = base_spans(text or "")
            for _, start, end in sorted(base + random_spans(text or "", base, test), key=_order):
                if start >= last:
                    out += [text[last:start], mask]
                last = max(last, end)
            texts.append(None if text is None else "".join(out) + text[last:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(own_columns(docs, "doc_id", "text"), run, "doc_id long, text string")

"""Personal data: patterns plus a semi-Markov conditional random field.

The field labels segments, not tokens: each candidate segment (a run of up to ``MAX_TOKENS`` tokens with four to ``MAX_DIGITS`` digits or an at sign, on one line) is scored as
an email, IP, card or phone number by features of the whole span: its digit count, the sizes of its digit groups, its
separators, the Luhn test, what stands before and after it. A dynamic program over the tokens of a line picks the best
labelling, boundaries and types together. Weights are fitted by
maximum likelihood on examples made here from a fixed seed (``EXAMPLES``, ``EPOCHS``), so it needs no labelled
corpus. Lines without a digit or at sign outside the patterns' spans are passed over; all others are decoded whole.

The patterns' spans always stay; the field adds those that are clear of them. Offsets are code points. Null text
counts as empty. Repeated rows give repeated rows. Of labellings of equal score the one without a segment is taken, then
the longer segment and the kind listed first. Work is linear in a text, however long its lines are.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import map_batches, own_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has one at sign: from there back over the local part, no further than the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass their test, by kind, then start."""
    spans: list[Span] = [("email", s, e) for s, e in _emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return spans


# ---------------------------------------------------------------- the field

MAX_TOKENS = 16
MAX_DIGITS = 20
EXAMPLES = 500
EPOCHS = 8
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\s0-9A-Za-z]|\s+")
_ANCHOR = re.compile(r"[0-9@]")


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _TOKEN.finditer(text)]


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
    """Features of the segment of tokens i to j - 1, or None if it can be no entity."""
    start, end = tokens[i][0], tokens[j - 1][1]
    span = text[start:end]
    digits = _only_digits(span)
    first, last = span[0], span[-1]
    if len(digits) < 4 and "@" not in span or not (last.isalnum() and last.isascii()) or not (first.isalnum() and first.isascii() or first in "+("):
        return None
    groups = [str(len(g)) for g in re.findall(r"[0-9]+", span)]
    letters = sum(c.isalpha() for c in span)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    before, after = text[start - 1 : start], text[end : end + 1]
    previous = text[tokens[i - 2][0] : tokens[i - 2][1]].lower() if i > 1 and before.isspace() else ""
    side = lambda c: "^" if not c else "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c
    n = len(digits)
    kind = "none" if not letters else "mail" if span.count("@") == 1 and "." in span[span.find("@") :] else "some"
    return [
        f"n={n if n < 20 else 20}", f"groups={'-'.join(groups[:6])}", f"first={'d' if first.isdigit() else 'a' if first.isalpha() else first}",
        f"marks={marks[:6]}", f"letters={kind}", f"before={side(before)}", f"after={side(after)}", f"prev={previous[:8]}",
        f"luhn={n in range(13, 20) and luhn(digits)}", f"quad={len(groups) == 4 and not letters and marks == '.' and all(map(_small, span.split('.')))}",
        f"balanced={span.count('(') == span.count(')')}", f"run={len(groups)}:{marks[:3]}",
    ]


Weights = dict[tuple[str, str], float]


def _segments(text: str, tokens: list[tuple[int, int]]) -> dict[int, list[tuple[int, list[str]]]]:
    """For each end j: (i, features) of the candidate segments."""
    found: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
    anchor = [k for k, (a, _) in enumerate(tokens) if "0" <= text[a] <= "9" or text[a] == "@"]
    at = 0
    for i in range(len(tokens)):
        while at < len(anchor) and anchor[at] < i:
            at += 1
        if at == len(anchor):
            break
        if anchor[at] >= i + MAX_TOKENS:
            continue
        digits, sign = 0, False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            a, b = tokens[j - 1]
            first = text[a]
            digits += b - a if first.isdigit() else 0
            sign |= first == "@"
            if digits > MAX_DIGITS or first.isspace() and text[a:b] != " ":  # no longer segment can be an entity
                break
            if (digits >= 4 or sign) and (f := features(text, tokens, i, j)):
                found[j].append((i, f))
    return found


def decode(text: str, weights: Weights) -> list[Span]:
    """The best labelling of a window; a token outside entities scores 0."""
    tokens = tokens_of(text)
    segments = _segments(text, tokens)
    best = [0.0] * (len(tokens) + 1)
    back: list[tuple[int, str] | None] = [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, f in segments.get(j, ()):
            for kind in KINDS:
                score = best[i] + sum(weights.get((kind, x), 0.0) for x in f)
                if score > best[j]:
                    best[j], back[j] = score, (i, kind)
    spans: list[Span] = []
    j = len(tokens)
    while j:
        if back[j]:
            i, kind = back[j]
            spans.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return spans[::-1]


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Weights:
    """Maximum likelihood by gradient steps; expectations come from the forward and backward sums over segmentations."""
    weights: Weights = defaultdict(float)
    prepared = []
    for text, spans in examples:
        tokens = tokens_of(text)
        prepared.append((len(tokens), [(i, j, f) for j, x in _segments(text, tokens).items() for i, f in x], {(tokens_at(tokens, s), tokens_at(tokens, e, True)): k for k, s, e in spans}))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for n, segments, gold in prepared:
            scored = [(i, j, kind, f, sum(weights[(kind, x)] for x in f)) for i, j, f in segments for kind in KINDS]
            into, out = defaultdict(list), defaultdict(list)
            for i, j, _, _, s in scored:
                into[j].append((i, s))
                out[i].append((j, s))
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                forward[j] = _log_add([forward[j - 1], *(forward[i] + s for i, s in into[j])])
            for i in range(n - 1, -1, -1):
                backward[i] = _log_add([backward[i + 1], *(backward[j] + s for j, s in out[i])])
            for i, j, kind, f, s in scored:
                gradient = (gold.get((i, j)) == kind) - math.exp(forward[i] + s + backward[j] - forward[n])
                if abs(gradient) > 1e-3:
                    for x in f:
                        weights[(kind, x)] += step * (gradient - decay * weights[(kind, x)])
    return dict(weights)


def tokens_at(tokens: list[tuple[int, int]], offset: int, end: bool = False) -> int:
    return next((k + end for k, t in enumerate(tokens) if t[end] == offset), -1)


def _card(r: random.Random, valid: bool) -> str:
    body = "".join(str(r.randrange(10)) for _ in range(15))
    last = next(c for c in "0123456789" if luhn(body + c) == valid)
    d = body + last
    return d if r.random() < 0.5 else r.choice(" -").join(d[k : k + 4] for k in range(0, 16, 4))


def _digits(r: random.Random, *sizes: int) -> list[str]:
    return [str(r.randrange(10 ** (k - 1), 10**k)) for k in sizes]


def made_examples(count: int = EXAMPLES, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Sentences of made-up words with entities and with numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randrange(2, 9)))

    def entity(kind: str) -> str:
        if kind == "email":
            return f"{word()}{r.choice(['.', '_', '', '-'])}{word()}{r.choice(['', str(r.randrange(99))])}@{word()}.{r.choice(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if kind == "card":
            return _card(r, True)
        a, b, c = _digits(r, 3, 3, 4)
        return r.choice([f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randrange(20, 99)} {a} {b} {c}", f"+{r.randrange(1, 99)} {a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"])

    def number() -> str:
        y, m, d = r.randrange(1900, 2100), r.randrange(1, 13), r.randrange(1, 29)
        a, b, c = _digits(r, 3, 3, 4)
        row = " ".join(str(r.randrange(10 ** r.randrange(1, 7))) for _ in range(r.randrange(2, 7)))
        return r.choice([
            row, row, row, str(r.randrange(10)), str(r.randrange(100)), str(r.randrange(10000)), str(r.randrange(10**6)), f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{d:02}:{m:02}", f"{a},{b}.{m:02}", f"{m}.{d}", f"{m}.{d}.{y % 9}", f"{y}-{y + 1}",
            f"{m}.{d}.{y % 9}.{r.randrange(300, 999)}", _card(r, False), f"{word()}{a}", f"#{a}{c}", f"{a}{b}{c}", f"{a} {b}", f"{c} {c}", f"{y} {m} {d}", "%032x" % r.getrandbits(128), "%010x" % r.getrandbits(40), f"@{word()}", f"{a}-{r.randrange(10)}-{c}", f"{a}%", f"${a}.{m:02}", f"v{m}.{d}", f"({y})", f"{a} x {b}",
        ])

    examples = []
    for _ in range(count):
        text, spans = word().capitalize(), []
        for _ in range(r.randrange(1, 4)):
            text += " " + " ".join(word() for _ in range(r.randrange(1, 4))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                s = entity(kind)
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = number()
            text += s + r.choice(["", "", ",", ".", ";"])
        examples.append((text + " " + word() + ".", spans))
    return examples


_FITTED: list[Weights] = []


def fitted() -> Weights:
    """The weights, fitted once to a process."""
    if not _FITTED:
        _FITTED.append(fit(made_examples()))
    return _FITTED[0]


def open_lines(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The lines that have a digit or at sign outside of ``taken``, which is in order and apart."""
    k, done = 0, 0
    for m in _ANCHOR.finditer(text):
        at = m.start()
        if at < done:
            continue
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        if k == len(taken) or taken[k][0] > at:
            end = text.find("\n", at)
            done = len(text) if end < 0 else end
            yield text.rfind("\n", 0, at) + 1, done


def added_spans(text: str, base: list[Span], weights: Weights) -> list[Span]:
    """What the field finds clear of the pattern spans."""
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    found: list[Span] = []
    k = 0
    for a, b in open_lines(text, [(s, e) for s, e in taken]):
        for kind, s, e in decode(text[a:b], weights):
            while k < len(taken) and taken[k][1] <= a + s:
                k += 1
            if k == len(taken) or taken[k][0] >= a + e:
                found.append((kind, a + s, a + e))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_personal_data(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per document: doc_id, counts and digest of the pattern spans, all spans."""
    weights = fitted() if weights is None else weights

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, listed, added = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = extra = []
            if _ANCHOR.search(text):
                base = base_spans(text)
                extra = added_spans(text, base, weights)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            listed.append(joined([*base, *extra]))
            added.append(len(extra))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return map_batches(own_columns(docs, "doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

"""Cross-tokenizer alignment against a plain version that walks both token lists."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import alignment

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = alignment.Vocabularies()


def rows():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäéñß"
    prose = lambda n: " ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n))
    texts = [
        None, "", " ", "  two spaces", "a", "the same words", "the same words", "tab\tand\nline\r\n", "▁ is a piece's space", "<|endoftext|> and <s> and </s> <unk> <0x41>", "😀😀 emoji 漢字 and ｆｕｌｌ width",
        "a" * 3000, "ab" * 2000, "0123456789" * 300, "x" * 70 + " " * 300 + "y", "\x00 null byte", "é combining", " no-break", "日本語のテキスト。" * 200, "= " * 900, "=" * 5000, *(prose(r.randint(1, 200)) for _ in range(40)), prose(9000),
    ]
    out = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return [*out, out[30], out[30], (30, "another text of the same id", None, None, None), (None, "words without an id", "en", "s", 0)]


def walked(text, s):
    """The groups of a text as two lists of ids each; None if it has no tokens."""
    a, b = s.exact.encode(f" {text}", add_special_tokens=False).ids, s.pieces.encode(text or "")
    sides = [[s.first[k] for k in a], [s.second[k] for k in b]]
    if not text or any(b"".join(x) != f" {text}".encode() for x in sides):
        return None
    groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            groups[-1][0].append(a[i])
            at_a += len(sides[0][i])
            i += 1
        else:
            groups[-1][1].append(b[j])
            at_b += len(sides[1][j])
            j += 1
        if at_a == at_b:
            groups.append(([], []))
    return groups[:-1]


def expected(table):
    s = alignment.sides(NAMES)
    groups = [walked(r[1], s) for r in table]
    links = [Counter((p, q) for a, b in g or [] for p in a for q in b) for g in groups]
    counts = Counter(pair for own in links for pair in own)
    highest = defaultdict(int)
    for (p, _), n in counts.items():
        highest[p] = max(highest[p], n)
    out = []
    for r, g, own in zip(table, groups, links, strict=True):
        sha = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest() if g else ""
        sizes = (sum(len(x[0]) for x in g or []), sum(len(x[1]) for x in g or []), len(g or []), sum(own.values()))
        out.append((r[0], *sizes, sum(m for (p, q), m in own.items() if counts[p, q] == highest[p]), sum(m * counts[p] for p, m in own.items()), sha))
    return out, {(p, q, n, n == highest[p]) for (p, q), n in counts.items()}


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
plain = lambda found: sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def brute():
    return expected(rows())


@pytest.mark.parametrize(("stripes", "part", "flush"), [(32, 4_000_000, 1_000_000), (5, 9, 700)])
def test_alignment_report(spark, table, brute, monkeypatch, stripes, part, flush):
    monkeypatch.setattr(alignment, "FLUSH", flush)
    got = plain(alignment.alignment_report(table, stripes=stripes, part=part).collect())
    assert got == sorted(brute[0], key=repr)
    assert sum(r[1] == 0 for r in got) >= 3 and sum(r[4] > r[1] for r in got) > 10


def test_linked_ids(table, brute):
    got = {(r["a"], r["b"], r["documents"], r["best"]) for r in alignment.linked_ids(table, stripes=7, part=20).collect()}
    assert got == brute[1]


def test_aligned_groups(table):
    s = alignment.sides(NAMES)
    for r in alignment.aligned_groups(table).join(table.select("doc_id", "text"), "doc_id").filter("doc_id < 20").collect():
        groups = walked(r["text"], s) or []
        assert [sum(([k] * len(g[side]) for k, g in enumerate(groups)), []) for side in (0, 1)] == [r["group_a"], r["group_b"]]
        assert [sum((g[side] for g in groups), []) for side in (0, 1)] == [r["a"], r["b"]]


def test_rank_file_gives_the_same_ids():
    s = alignment.sides(NAMES)
    for r in rows():
        if r[1]:
            both = [s.fast.encode_ordinary(f" {r[1]}"), s.exact.encode(f" {r[1]}", add_special_tokens=False).ids]
            assert both[0] == both[1] or max(r[1]) >= "ɐ" or " " * 4096 in r[1]


def test_odd_tables(spark, table):
    assert alignment.alignment_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tuple(alignment.alignment_report(spark.createDataFrame([(None,) * 5], SCHEMA)).select(*COLUMNS).first()) == (None, 0, 0, 0, 0, 0, 0, "")
    few = table.filter("doc_id < 25")
    clashing = few.selectExpr("*", "1 AS stripe", "2 AS part", "'x' AS codes", "3 AS flush", "4 AS n_a", "5 AS place")
    assert plain(alignment.alignment_report(clashing).collect()) == plain(alignment.alignment_report(few).collect())

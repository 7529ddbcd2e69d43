"""The pipeline: contracts of its stages and a small run."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from palimpsest.llm import packing, quality  # noqa: E402
from palimpsest.llm.common import DOCUMENT  # noqa: E402
from tests.llm.test_llm import SCHEMA, components_by_force, documents, prose  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(docs.columns) == DOCUMENT
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and kept[names[0]] >= kept[names[1]] > kept[names[2]] > 50 and kept[names[4]] > 0


def test_run(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def quality_by_force(text):
    """Whether a text passes the rules."""
    text, rules = text or "", quality.QualityRules()
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(hit) > 20 * len(words):
        return False

    def distance(counts, shares):
        n = sum(counts)
        term = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
        return math.sqrt(max(0.0, 0.5 * sum(term(c / n, s) + term(s, c / n) for c, s in zip(counts, shares, strict=True))))

    kinds = [sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text), sum("0" <= c <= "9" for c in text), len(text) - sum(map(len, words)), sum(c > "\x7f" for c in text)]
    far = len(text) >= rules.min_chars and min(distance([*kinds, len(text) - sum(kinds)], r.classes) for r in rules.references) > rules.max_class_distance
    common = Counter(w.lower() for w in words)
    own = lambda r: [common[w] for w in r.words]
    return not (far or len(words) >= rules.min_judged_words and min(distance([*own(r), len(words) - sum(own(r))], r.word_shares()) for r in rules.references) > rules.max_word_distance)


def lines_by_force(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, keeper = {}, {}
    for i, text, _, source, _ in rows:
        for x in filter(None, map(key, (text or "").split("\n"))):
            sites.setdefault(x, set()).add(source)
            keeper[x] = min(keeper.get(x, i), i)
    out = []
    for i, text, lang, source, n in rows:
        own = (text or "").split("\n")
        stay = [x for x in own if not (key(x) and len(sites[key(x)]) >= 5 and keeper[key(x)] != i)]
        if len(stay) == len(own):
            out.append((i, text, lang, source, n))
        elif key("\n".join(stay)):
            out.append((i, "\n".join(stay), lang, source, len("\n".join(stay))))
    return out


def copies_by_force(rows, seed=17):
    """How often each row is drawn."""
    n_docs = Counter(r[3] for r in rows)
    weight = {s: n**0.5 for s, n in n_docs.items()}
    out = []
    for r in rows:
        rate = weight[r[3]] / sum(weight.values()) * len(rows) / n_docs[r[3]]
        parts = max(math.ceil(rate / 16), 1)
        mean = rate / parts
        cdf = [sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(n)) for n in range(1, 81)]
        draw = lambda j: int(hashlib.md5(f"{seed}:{r[0]}:{j}".encode()).hexdigest()[:13], 16) / 2**52  # noqa: B023, E731
        out += [r] * sum(sum(c <= draw(j) for c in cdf) for j in range(1, parts + 1))
    return out


def test_run_is_what_brute_force_gives(spark, tmp_path):
    rows = documents() + [(500 + j, f"{prose(800 + j, 60)}\nThe same short line\n{prose(900 + j, 60)}", "en", f"s{j}", 0) for j in range(6)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    good = [r for r in rows if quality_by_force(r[1])]
    stay = lines_by_force(good)
    order = sorted(range(len(stay)), key=lambda k: stay[k][0])  # the smallest id of a component comes first
    roots = components_by_force([stay[k][1] for k in order])
    kept = [stay[order[k]] for k in sorted(set(roots))]
    encode = packing.public_encoder().exact.encode
    expected = Counter()
    for i, text, *_ in copies_by_force(kept):
        ids = np.array([*encode(text, add_special_tokens=False).ids, 0], "<u4")
        for piece, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            expected[i, piece, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert len(rows) > len(good) > len(kept) > 50 and stay != good
    assert got == expected


def test_short_boilerplate_goes(spark, tmp_path):
    rows = [(i, f"Menu\na text of document {i} that stays\n\n  Menu \nonly {i % 2}", "en", f"s{i}", 0) for i in range(6)]
    rows += [(10 + i, f"On four sites\n{i} is a line of its own", "en", f"s{i}", 0) for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert got == {i: text if i in (0, *range(10, 14)) else f"a text of document {i} that stays\n\nonly {i % 2}" for i, text, *_ in rows}

"""Documents of one template, nearly all just under the similarity: whom they are compared with, and that no link is lost."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def template(n, seed, changes, words=400):
    """Texts of one template with some words changed each; every tenth changes few, so that some link."""
    r = random.Random(seed)
    base, reach = [f"w{r.randrange(10**6)}" for _ in range(words)], words // (2 * changes) - 2
    out = []
    for i in range(n):
        text = list(base)
        for k in range(changes if i % 10 else changes // 3):
            text[(2 * k + 1) * words // (2 * changes) + r.randint(-reach, reach)] = f"x{seed}{i}_{k}"
        out.append(" ".join(text))
    return out


def brute(texts):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


@pytest.fixture(scope="module")
def texts():
    shared = template(1, 77, 1, 90)[0]  # a passage that unlike texts have in common
    mixed = [f"{a} {shared} {b}" for a, b in zip(template(12, 5, 8, 120), template(12, 6, 8, 120))]
    return template(90, 1, 9) + template(40, 2, 8, 350) + mixed


@pytest.mark.parametrize(("listed", "block"), [(16, 2048), (3, 16)])
def test_no_link_is_lost(spark, texts, monkeypatch, listed, block):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    expected = brute(texts)
    assert got == expected and 20 < len(set(expected.values())) < len(texts)


def sets_of(spark, texts):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    sizes = jaccard.shingle_sizes(df)
    return jaccard.written(jaccard._sets(df, sizes.select("key", "k", "c")), "sets"), jaccard.band_edges(sizes.agg(F.max("n")).first()[0])


def test_a_template_is_few_rows_a_document(spark):
    sets, edges = sets_of(spark, template(120, 3, 8))
    across = jaccard._met_across(sets.withColumn("root", F.col("k")), 16, edges).filter("large is not null").select(F.col("large").alias("key"), F.col("b").alias("bundle"))
    assert across.count() > 100  # keys that many of the sets share
    groups = jaccard._members(sets, across, edges)
    assert 120 <= groups.count() <= 4 * 120
    assert jaccard._in_blocks(groups).groupBy("pair").count().agg(F.max("count")).first()[0] <= 120


def test_every_pair_of_a_large_key_is_compared_once_at_least(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    sets, edges = sets_of(spark, texts)
    large = jaccard._met_across(sets.withColumn("root", F.col("k")), 16, edges).filter("large is not null").select(F.col("large").alias("key"), F.col("b").alias("bundle"))
    keys = jaccard._keys_of(sets, edges).join(large, "key")
    wanted = {(min(a, b), max(a, b)) for r in keys.groupBy("key").agg(F.collect_set("k").alias("ks")).collect() for a in r["ks"] for b in r["ks"] if a != b}
    seen = set()
    for r in jaccard._in_blocks(jaccard._members(sets, large, edges)).groupBy("pair").agg(F.collect_list(F.struct("side", "k", "first", "whole")).alias("m")).collect():
        sides = [[x for x in r["m"] if x["side"] == s] for s in (0, 1)]
        for x in sides[0]:
            for y in sides[1] or sides[0]:
                if x["k"] != y["k"] and (x["first"] != y["first"] or x["first"] == x["whole"]):
                    seen.add((min(x["k"], y["k"]), max(x["k"], y["k"])))
    assert wanted <= seen

"""The rule ensemble: statistics against plain Python, rules against a walk through the trees, held-out accuracy."""

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import rulefit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
DATA = "/root/testdata/sf0.01"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x]
    n, chars, n_lines = max(len(words), 1), max(len(text), 1), max(len(lines), 1)
    ascii_count = lambda kind: len(re.findall(kind, text)) / chars
    return {
        "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / n_lines, "line_words": len(words) / n_lines,
        "upper": sum(c.isupper() for c in text) / chars, "digits": ascii_count("[0-9]"), "symbols": ascii_count("[$+<=>^`|~]"), "punctuation": ascii_count(r"[!-#%-*,-/:;?@\[-\]_{}]"),
        "bars": ascii_count(r"[|#*$%&<>_=+~^{}\[\]\\]"), "no_letter": sum(not re.search("[^\\W\\d_]", w) for w in words) / n, "repeated_word": sum(a == b for a, b in zip(words, words[1:])) / n,
        "long_words": sum(len(w) > 20 for w in words) / n, "sentence_ends": sum(w[-1] in ".!?" for w in words) / n,
    }


def test_statistics(spark):
    texts = [None, "", " ", "\n\n", "One two. three\nthree three!\n\nx | y | | z", "UPPER Case wörds Ünd ß", "a" * 40 + " b", "12 34 a1 #1 $2 ^~ {x} [y] \\", "the end?", "same\nsame\nsame", "w " * 20_000]
    got = {r["doc_id"]: r for r in rulefit.with_statistics(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        assert {n: got[i][n] for n in rulefit.NAMES} == pytest.approx(plain_statistics(t)), t


def test_rules_of_a_path():
    rule = rulefit._narrowed([("a", True, 1.0), ("b", False, 5.0), ("a", True, 2.0), ("b", False, 7.0), ("a", False, 9.0)])
    assert rule.terms == (("a", False, 9.0), ("a", True, 2.0), ("b", False, 5.0))
    assert str(rule) == "a <= 9 and a > 2 and b <= 5"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def scores(tables):
    return {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in rulefit.quality_scores(*tables).collect()}


def test_held_out_accuracy(tables, scores):
    labels = {r["doc_id"]: r["quality"] for r in tables[1].collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, (h, s, p) in scores.items())
    judged = [scores[i][2] == q for i, q in labels.items() if i in scores and scores[i][0]]
    assert len(judged) > 50 and sum(judged) >= 0.95 * len(judged)


def test_held_out_labels_and_other_columns_are_not_read(spark, tables, scores):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(rulefit.held_out(rulefit.RuleFit()), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.select("doc_id", "text", F.lit("x").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("label"), F.lit("u").alias("upper"), F.lit(2).alias("bits"), F.lit(3).alias("__words")).repartition(5)
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in rulefit.quality_scores(other, turned).collect()}
    assert got == scores


def test_scores_follow_from_the_rules(spark, tables):
    statistics = rulefit.with_statistics(tables[0]).cache()
    train = rulefit.labelled(statistics, tables[1], "quality")
    model = rulefit.fit(train, rulefit.RuleFit(trees=5, depth=2, max_rows=200))
    assert model.weighted and len({r for r, _ in model.weighted}) == len(model.weighted) <= 30
    for r in statistics.withColumn("score", model.score()).limit(100).collect():
        total = model.intercept + sum(w for rule, w in model.weighted if all((r[n] > t) == above for n, above, t in rule.terms))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_odd_tables(spark, tables):
    rows = [(None, "a text without id", None, None, None), (1, None, None, None, None), (2, "", None, None, None), (3, "some words", None, None, None), (3, "some words", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    score = lambda labels: {r["doc_id"]: r["score"] for r in rulefit.quality_scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert set(score([]).values()) == {0.5} and set(score([(None, 1, 1), (3, None, 0), (99, 1, 0)]).values()) == {0.5}
    assert set(score([(3, 1, 0), (3, 1, 0), (3, 0, 0)]).values()) == {1.0} and set(score([(3, 1, 0), (3, 0, 0)]).values()) == {0.0}
    assert set(score([(3, 1, 0), (1, 0, 0)])) == {None, 1, 2, 3}
    empty = spark.createDataFrame([], SCHEMA)
    assert rulefit.quality_scores(empty, tables[1]).count() == 0

"""Fill-in-the-middle against a plain Python version, and exact round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import infill

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " ", "\n\t \x0b\x0c\r", "word", " word", "word ", "two words", "a  b\n\nc \t", "x" * 50_000, "lots of words " * 5_000, "é ü 漢字 😀 a b c d", "<P> inside", "near <S", "<S <S> more", "< P>", "<<P>",
    "<", "a <", "S> b", "P> <", "<M", "M>\n<S", "$1 \\2 $", "| a | b | c |", *(f"{i} some more words {'<' * (i % 3)} to cut {'>' * (i % 4)} at {i}" for i in range(40)),
]


def rows():
    out = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 3)]
    return [*out, out[8], out[8], (8, "another text of the same id", None, None, None), (None, "words without an id " * 3, "en", "s", 0), (-5, "an id below zero", "en", "s", 0), (2**62, "a very large id", "en", "s", 0)]


def expected(doc_id, text, rule):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    cuts = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[: cuts[0]]), "".join(units[cuts[0] : cuts[1]]), "".join(units[cuts[1] :])
    if not text or any(x in text for x in rule.sentinels) or h[2] % 100 >= rule.rate:
        form, out = "plain", text
    elif h[3] % 100 < rule.spm_rate:
        form, out = "spm", f"{rule.suffix}{s}{rule.prefix}{p}{rule.middle}{m}"
    else:
        form, out = "psm", f"{rule.prefix}{p}{rule.suffix}{s}{rule.middle}{m}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(units), form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(text)


@pytest.mark.parametrize("rule", [infill.InfillRule(), infill.InfillRule(rate=100, spm_rate=0), infill.InfillRule(seed=7, rate=100, prefix="<|p|>", suffix="<|s|>", middle="<|m|>")])
def test_infill_report(spark, rule):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted(map(tuple, infill.infill_report(df, rule).collect()), key=repr)
    assert got == sorted((expected(r[0], r[1], rule) for r in rows()), key=repr)
    assert len({g[2] for g in got}) > 1


def test_restored_texts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    done = infill.fill_in_middle(df, infill.InfillRule(rate=100)).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    assert done.filter("form <> 'plain'").count() > 100
    assert done.filter("not again <=> text").count() == 0
    assert done.filter("form <> 'plain' and prefix || middle || suffix <> text").count() == 0


def test_infill_odd_tables(spark):
    assert infill.infill_report(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(rows()[:60], SCHEMA)
    clashing = df.select("*", *(F.lit(1).alias(c) for c in ("units", "n", "form", "output", "prefix", "h1", "first")))
    assert sorted(map(repr, infill.infill_report(clashing).collect())) == sorted(map(repr, infill.infill_report(df).collect()))
    assert tuple(infill.infill_report(spark.createDataFrame([(None,) * 5], SCHEMA)).first())[:5] == (None, 0, "plain", None, None)


def test_infill_plan_has_no_shuffle_and_no_python(spark):
    plan = infill.infill_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan

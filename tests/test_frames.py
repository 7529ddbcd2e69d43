"""Frames of statutory prose on literal sentences."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import frames as X


@pytest.mark.parametrize(("text", "accepted", "refused"), [
    ("Tarkempia säännöksiä annetaan valtioneuvoston asetuksella.", [("delegation", "asetus", "valtioneuvosto", "must")], []), ("Ministeriön asetuksella voidaan säätää maksuista.", [("delegation", "asetus", "ministeriö", "may")], []), ("Asetuksella säädetään menettelystä.", [("delegation", "asetus", None, "must")], []),
    ("Virasto voi antaa määräyksiä lomakkeista.", [("delegation", "määräys", "virasto", "may")], []), ("Siitä säädetään valtioneuvoston asetuksen 34 §:ssä.", [], [("delegation", "cross_reference_instrument")]), ("Ohjeita annetaan tarvittaessa.", [], [("delegation", "no_issuer")]),
    ("Joka rikkoo lakia, on tuomittava sakkoon tai vankeuteen enintään kahdeksi vuodeksi.", [("sanction", "sakko", "kahdeksi vuodeksi", "joka")], []), ("Viranomainen asettaa uhkasakon.", [("sanction", "uhkasakko", None, None)], []), ("Luvan voi peruuttaa, jos ehtoja ei noudateta.", [("sanction", "luvan_peruuttaminen", None, "jos"), ("condition", "jos", None, "ehtoja ei noudateta")], []),
    ("Hallitus peruuttaa kokouksen.", [], [("sanction", "revocation_without_permit")]), ("Tätä lakia ei kuitenkaan sovelleta kuntiin, joissa on satama.", [("exception", "ei kuitenkaan", None, "sovelleta kuntiin")], []), ("Jollei toisin säädetä, maksu on kiinteä.", [("exception", "jollei", None, "toisin säädetä")], []),
    ("Maksu peritään edellyttäen, että tulot riittävät.", [("condition", "edellyttäen että", None, "tulot riittävät")], []), ("Se on niin kun sanotaan.", [], [("condition", "not_clause_initial")]), ("Tämä laki tulee voimaan 1 päivänä tammikuuta 2020.", [("temporal", "fixed_date", "2020-01-01", None)], []),
    ("Laki on voimassa 31 päivään joulukuuta 2025 saakka.", [("temporal", "fixed_term_expiry", "2025-12-31", None)], []), ("Laki on voimassa 31.12.2024 asti.", [("temporal", "fixed_term_expiry", "2024-12-31", None)], []), ("Laki on voimassa toistaiseksi.", [("temporal", "validity_open", None, None)], []), ("Laki on voimassa kauan saakka.", [], [("temporal", "no_end_day")]),
    ("Tämä laki tulee voimaan myöhemmin säädettävänä ajankohtana.", [("temporal", "commencement", None, None)], []), ("Lupa on voimassa, kunnes uusi on annettu.", [("temporal", "event_bound", None, "uusi on annettu")], []), ("Aika lasketaan voimaantulosta lukien.", [("temporal", "duration_from_commencement", None, None)], []), ("Tavallinen lause.", [], []), (None, [], []),
])
def test_frames(spark, text, accepted, refused):
    rows, rejected = X.frames(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    assert sorted((r["frame"], r["kind"], r["value"], r["detail"]) for r in rows.collect()) == sorted(accepted)
    assert [(r["frame"], r["reason"]) for r in rejected.collect()] == refused


def test_sentences_are_counted_apart(spark):
    text = "Asetuksella säädetään maksuista. Joka rikkoo lakia, tuomitaan sakkoon. Tämä laki tulee voimaan 15.6.2021."
    rows, _ = X.frames(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    assert sorted((r["sentence"], r["frame"], r["kind"]) for r in rows.collect()) == [(0, "delegation", "asetus"), (1, "sanction", "rangaistus"), (2, "temporal", "fixed_date")]


def test_prose_dates(spark):
    texts = ["1 päivänä tammikuuta 2020", "31 päivään joulukuuta 1999 saakka", "5.6.2007", "31.2.2020", "ei mitään", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.prose_date(F.col("t"))).collect()] == ["2020-01-01", "1999-12-31", "2007-06-05", None, None, None]


def test_plain_search_comes_before_patterns_and_loses_none(spark):
    r = random.Random(11)
    cues = [X._EXCEPTION, X._CONDITION]
    patterns = [(p, stems) for _, p, stems in X.INSTRUMENTS + X.SANCTIONS] + [(X.REVOKES, ["peruu"])] + [(p, stems) for p, _, stems in cues]
    words = ["asetuksella", "asetus", "asetelma", "määräyksiä", "ohjeita", "ohjelma", "päätös", "päätöksen", "uhkasakon", "uhkasako", "seuraamusmaksu", "rikesakko", "sakon", "sako", "sakkoa", "sakset", "rangaistus", "tuomitaan", "vahingonkorvausta", "peruuttaa", "peruutetaan", "peruu"]
    words += [w for phrase in X.EXCEPTIONS + X.CONDITIONS for w in (phrase, phrase.replace(" ", ", "))] + ["kunta", "josko", "ja", "on", "5"]
    texts = [r.choice(["", " "]) + r.choice([" ", ", ", "; "]).join(r.choice(words) for _ in range(r.randint(1, 4))) + r.choice(["", " x", ","]) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(*(F.struct(X._has(F.col("t"), p, stems), F.col("t").rlike(p)) for p, stems in patterns)).collect()
    assert all(a == b for row in both for a, b in row) and all(any(row[k][0] for row in both) for k in range(len(patterns)))


def test_sentences_end_at_any_white_space(spark):
    text = "Asetuksella\tsäädetään maksuista.\n\x0b Joka rikkoo lakia, tuomitaan  sakkoon;\rTämä laki tulee\nvoimaan 15.6.2021. "
    rows, _ = X.frames(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    assert sorted((r["sentence"], r["frame"], r["kind"]) for r in rows.collect()) == [(0, "delegation", "asetus"), (1, "sanction", "rangaistus"), (2, "temporal", "fixed_date")]


def test_rejected_rows_read_no_more_than_their_reasons(spark):
    rejected = X.frames(spark.createDataFrame([(1, "Ohjeita annetaan.")], "id int, t string"), "id", "t")[1].select("id", "frame", "reason")
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "enintään" not in plan and "luvan_peruuttaminen" not in plan

"""The clause grammar: literal clauses, accounting of all tokens, and clauses made from ops."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import clauses as C


def ops(text):
    return [(a, t, d, f, new) for a, t, d, f, new, _ in C.lowered(C.read_clause(text))]


def plain(text):
    return [(a, t) for a, t, *_ in ops(text)]


def test_several_verbs_and_targets():
    text = "kumotaan lain 3 §, muutetaan 5 §:n 2 momentti ja 7 §:n otsikko sekä lisätään 8 §:ään uusi 3 momentti, jolloin nykyinen 3 momentti siirtyy 4 momentiksi"
    assert ops(text) == [
        ("REPEAL", "section:3", None, None, False), ("REPLACE", "section:5/subsection:2", None, None, False), ("HEADING_REPLACE", "section:7", None, "heading", False),
        ("INSERT", "section:8/subsection:3", None, None, True), ("RENUMBER", "section:8/subsection:3", "section:8/subsection:4", None, False),
    ]
    assert C.read_clause(text).leftovers == []


def test_scopes_close_at_their_level():
    assert plain("muutetaan 2 luvun 3 §:n 1 momentti ja 2 momentin 4 kohta sekä 5 § ja 6 luvun 1 §") == [
        ("REPLACE", "chapter:2/section:3/subsection:1"), ("REPLACE", "chapter:2/section:3/subsection:2/item:4"), ("REPLACE", "chapter:2/section:5"), ("REPLACE", "chapter:6/section:1")]


def test_lists_ranges_and_letters():
    assert [t for _, t in plain("kumotaan 1, 3–5 ja 7 a §")] == ["section:1", "section:3", "section:4", "section:5", "section:7a"]
    assert [t for _, t in plain("kumotaan 3 a–3 c §")] == ["section:3a", "section:3b", "section:3c"]
    assert [(r.text, why) for r, why in C.read_clause("kumotaan 5–3 §").leftovers] == [("–", "no_range")]


def test_renumber_pairs_and_moves():
    assert ops("lisätään 4 §:ään uusi 2 momentti, jolloin nykyiset 2–3 momentti siirtyvät 3–4 momentiksi")[1:] == [
        ("RENUMBER", "section:4/subsection:2", "section:4/subsection:3", None, False), ("RENUMBER", "section:4/subsection:3", "section:4/subsection:4", None, False)]
    assert ops("siirretään 5 ja 6 § 2 lukuun") == [("MOVE", "section:5", "chapter:2/section:5", None, False), ("MOVE", "section:6", "chapter:2/section:6", None, False)]
    short = C.read_clause("lisätään 4 §:ään uusi 2 momentti, jolloin nykyiset 2–3 momentti siirtyvät 3 momentiksi")
    assert [why for _, why in short.leftovers] == ["destinations_do_not_match", "no_destination", "no_destination"] and len(list(C.lowered(short))) == 1


def test_statutes_and_appendices():
    got = list(C.lowered(C.read_clause("muutetaan annetun lain (527/2014) 2 § ja liite seuraavasti:")))
    assert got == [("REPLACE", "section:2", None, None, False, "527/2014"), ("REPLACE", "appendix", None, None, False, "527/2014")]


@pytest.mark.parametrize(("text", "reasons"), [
    ("", []), ("3 §", ["no_verb", "no_verb"]), ("kumotaan 3", ["number_without_unit"]), ("kumotaan banaani 3 §", ["unknown_word"]), ("siirtyy 3 momentiksi", ["nothing_to_renumber", "no_verb", "no_verb"]),
    ("muutetaan otsikko", ["facet_without_scope"]), ("kumotaan – 3 §", ["dash_without_number"]), ("muutetaan 3 §:lla 1 momentti", ["unknown_word"]),
])
def test_leftovers_have_reasons(text, reasons):
    assert sorted(why for _, why in C.read_clause(text).leftovers) == sorted(reasons)


WORDS = [*C.VERBS, *C.UNITS, *C.FACETS, *C.WHOLES, *C.SEPARATORS, "uusi", "nykyinen", "jolloin", "1", "2", "3 a", "–", "(1/2000)", "muu", "§:lla", "!"]


@settings(max_examples=400, deadline=None, database=None)
@given(st.lists(st.sampled_from(WORDS), max_size=25))
def test_every_token_is_used_or_left_over(words):
    text = " ".join(words)
    tokens, surface = C.lex(text), C.read_clause(text)
    left = [t for t, _ in surface.leftovers if t.kind != "target"]
    assert len({(t.start, t.end) for t in left}) == len(left) and set(left) <= set(tokens)
    assert surface.used + len(left) == len(tokens)
    assert all(t.destination for g in surface.groups for t in g.targets if g.action in ("RENUMBER", "MOVE"))


TARGETS = st.lists(st.tuples(st.integers(1, 90), st.sampled_from(["", "a", "b"]), st.none() | st.integers(1, 9)), min_size=1, max_size=5, unique=True)


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.tuples(st.sampled_from(["kumotaan", "muutetaan", "lisätään"]), TARGETS), min_size=1, max_size=4))
def test_clauses_made_from_ops_give_them_back(groups):
    text, expected = [], []
    for verb, targets in groups:
        text.append(f"{verb} " + ", ".join(f"{n} {s}".strip() + (f" §:n {m} momentti" if m else " §") for n, s, m in targets))
        expected += [(C.VERBS[verb], f"section:{n}{s}" + (f"/subsection:{m}" if m else "")) for n, s, m in targets]
    assert plain(" sekä ".join(text)) == expected


def test_parse_clauses(spark):
    df = spark.createDataFrame([(1, "kumotaan 3 § ja jotain"), (2, None), (3, "")], "id int, t string")
    parsed = C.parse_clauses(df, "id", "t")
    assert [tuple(r)[:4] for r in C.clause_ops(parsed, "id").collect()] == [(1, 0, "REPEAL", "section:3")]
    assert [(r["id"], r["leftover"], r["reason"], r["at"]) for r in C.clause_leftovers(parsed, "id").collect()] == [(1, "jotain", "unknown_word", 16)]
    assert {(r["id"], r["tokens"], r["used"]) for r in parsed.filter("tokens is not null").collect()} == {(1, 5, 4), (2, 0, 0), (3, 0, 0)}


@settings(max_examples=400, deadline=None, database=None)
@given(st.lists(st.sampled_from([*WORDS, "5", "a", " ", "\n", "(", "527/2014", ")", "a§", "5a", "İ"]), max_size=25), st.sampled_from(["", " "]))
def test_tokens_are_those_of_the_whole_text(words, between):
    text = between.join(words)
    assert C.lex(text) == C._cut(text.lower())
    surface, fast = C.read_clause(text), C._read(text, placed=False)
    assert list(C.lowered(fast)) == list(C.lowered(surface)) and fast.used == surface.used and C._read(text, placed=True).leftovers == surface.leftovers


def test_what_repeats_is_cut_once(monkeypatch):
    C._chunks.clear()
    cut, calls = C._cut, []
    monkeypatch.setattr(C, "_cut", lambda low: calls.append(low) or cut(low))
    for n in range(100):
        C._read(f"kumotaan {n % 10} §:n 2 momentti sekä muutetaan {n % 10} §", placed=False)
    assert len(calls) == len(set(calls)) == 16


def test_parse_clauses_gives_the_rows_asked_for(spark):
    df = spark.createDataFrame([(1, "kumotaan 3 § ja jotain"), (2, None)], "id int, t string")
    whole = {tuple(r) for r in C.parse_clauses(df, "id", "t").collect()}
    parts = [{tuple(r) for r in C.parse_clauses(df, "id", "t", (kind,)).collect()} for kind in C.KINDS]
    assert [len(p) for p in parts] == [1, 1, 2] and set.union(*parts) == whole


def test_statutes_are_those_of_the_ops():
    clauses = ["kumotaan lain (5/1999) 3 §, muutetaan 5–9 § sekä lisätään lain (7/2001) 4 §:ään uusi 2 momentti, jolloin nykyiset 2–3 momentti siirtyvät 3–4 momentiksi", "kumotaan (1/2000) 3 § ja liite", "muutetaan 5 §:n otsikko (2/2000)", "kumotaan (3/2000)", "(4/2000) 3 §", "kumotaan 3 §"]
    for text in clauses:
        found = {}
        for action, *_, statute in C.lowered(C.read_clause(text)):
            if statute is not None:
                n, only = found.get(statute, (0, True))
                found[statute] = n + 1, only and action == "REPEAL"
        assert C._by_statute(text) == found


def test_order_clauses_deal_line_items_once(spark):
    """One exchange and one scan of line items, and one of orders, for clauses and works."""
    import os

    from palimpsest.plans.drafting_queries import act_texts

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = act_texts(spark, "/root/testdata/sf0.001")[0]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("REPARTITION_BY_COL") == 1
    spread = act_texts(spark, "/root/testdata/sf0.001")[0]._jdf.queryExecution().executedPlan().toString()
    assert spread.count("Exchange hashpartitioning") == 1

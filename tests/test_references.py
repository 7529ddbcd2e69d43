"""Elliptical references, reference sets and definition graphs on literal cases."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import references as X

MENTION = "doc int, pos int, section string, ref_section string, ref_subsection int, ref_item string, anaphor string"


def test_elliptical(spark):
    nodes = spark.createDataFrame([(1, "5", 1, None), (1, "5", 2, "1"), (1, "5", 2, "2"), (1, "6", 1, "1"), (1, "6", 2, "1"), (1, "7", 1, None)], "doc int, section string, subsection int, item string")
    rows = [
        (1, 1, "5", None, 1, None, None), (1, 2, "5", None, 9, None, None), (1, 3, "5", None, None, "2", None), (1, 4, "6", None, None, "1", None), (1, 5, None, None, 2, None, None), (1, 6, "7", None, None, "1", None),
        (1, 7, "5", "12", 3, None, None), (1, 8, "6", None, None, None, "section"), (1, 9, "7", None, 4, "2", "section"), (1, 10, "7", None, None, "8", "subsection"),
        (1, 11, "5", "3", None, None, None), (1, 11, "5", "4", None, None, None), (1, 12, "7", None, None, None, "section"), (1, 13, "6", None, None, "1", None), (1, 14, "6", None, None, None, "section"),
        (1, 15, "5", "20", None, None, None), (1, 16, "5", None, None, None, "subsection"), (2, 1, "5", None, None, None, "section"), (2, 2, "5", None, 1, None, None), (2, 3, "9", None, None, None, "subsection"), (1, 17, "5", None, 2, "1", None),
    ]
    got = {(r["doc"], r["pos"], r["ref_section"]): (r["status"], r["to_section"], r["to_subsection"], r["to_item"], r["confidence"], r["candidates"]) for r in X.resolve_elliptical(spark.createDataFrame(rows, MENTION), X.section_structure(nodes)).collect()}
    assert len(got) == len(rows)
    expected = {
        1: ("resolved", "5", 1, None, "exact", None), 2: ("resolved", "5", 9, None, "approximate", None), 3: ("resolved", "5", 2, "2", "exact", None), 4: ("ambiguous", None, None, None, None, [1, 2]), 5: ("open", None, None, None, None, None),
        6: ("ambiguous", None, None, None, None, []), 8: ("resolved", "12", None, None, "anaphoric", None), 9: ("resolved", "12", 4, "2", "anaphoric", None), 10: ("resolved", "12", 3, "8", "anaphoric", None),
        12: ("ambiguous", None, None, None, None, None), 14: ("ambiguous", None, None, None, None, None), 16: ("open", None, None, None, None, None), 17: ("resolved", "5", 2, "1", "exact", None),
    }
    assert {k: got[1, k, None] for k in expected} == expected
    assert got[1, 7, "12"] == ("not_elliptical", "12", 3, None, "exact", None)
    assert got[2, 1, None][0] == "open" and got[2, 3, None] == ("resolved", "5", 1, None, "anaphoric", None)


@pytest.mark.parametrize(("text", "labels", "rejected", "kind", "back"), [
    ("1-3, 3a and 5", ["1", "2", "3", "3a", "5"], [], "mixed", "1-3, 3a and 5"), ("7", ["7"], [], "single", "7"), ("33—35", ["33", "34", "35"], [], "range", "33-35"), ("1 ja 2", ["1", "2"], [], "coordination", "1 and 2"),
    ("2 a–2 d, 2", ["2a", "2b", "2c", "2d", "2"], [], "mixed", "2 and 2a-2d"), ("5-3, x and 4", ["4"], ["5-3", "x"], "mixed", "4"), ("", [], [], "none", ""), (None, [], [], "none", ""), ("1, 1 and 1", ["1"], [], "coordination", "1"),
    ("10, 9, 8, 7, 3 sekä 2", ["10", "9", "8", "7", "3", "2"], [], "coordination", "2, 3 and 7-10"), ("1-9999", [], ["1-9999"], "range", ""), ("3-5a", [], ["3-5a"], "range", ""), ("12 and 13", ["12", "13"], [], "coordination", "12 and 13"),
])
def test_label_sets(spark, text, labels, rejected, kind, back):
    r = spark.createDataFrame([(text,)], "t string").select(X.label_set(F.col("t")).alias("s")).select("s.*", X.written_labels(F.col("s.labels")).alias("back")).first()
    assert (r["labels"], r["rejected"], r["kind"], r["back"]) == (labels, rejected, kind, back)


def test_reference_sets(spark):
    rows = [("a", "s:1", "exact", "1—3 §"), ("a", "s:2", "exact", "1—3 §"), ("a", "s:3", "exact", "1—3 §"), ("b", "s:1", "exact", "1 §"), ("c", "s:1", "ambiguous", "x"), ("c", "s:2", "ambiguous", "x"), ("d", None, "open", "elsewhere"), ("e", None, "broken", "?"), ("f", "s:1", "exact", "1 ja 2"), ("f", None, "unresolved", "1 ja 2"), ("g", "s:1", "exact", "1, 2—3"), ("g", "s:2", "exact", "1, 2—3")]
    got = {r["k"]: (len(r["targets"]), r["kind"], r["semantics"], r["reference_status"]) for r in X.reference_sets(spark.createDataFrame(rows, "k string, target string, confidence string, surface string"), ["k"]).collect()}
    assert got == {
        "a": (3, "range", "all_valid", "resolved"), "b": (1, "single", "single", "resolved"), "c": (2, "coordination", "candidate_ambiguity", "unresolved"), "d": (0, "single", "open", "unresolved"),
        "e": (0, "single", "no_enumerable_extension", "unresolved"), "f": (1, "single", "all_valid", "partial"), "g": (2, "mixed", "all_valid", "resolved"),
    }


def test_definition_graph(spark):
    definitions = spark.createDataFrame([
        (1, "d1", "Goods", "", "s:1", 1), (1, "d2", "goods ", "c:2", "c:2/s:4", 40), (1, "d3", "Seller", "", "s:2", 5), (1, "d4", "late", "", "s:9", 90), (1, "d5", "twin", "c:3", "c:3/s:1", 50), (1, "d6", "twin", "c:3", "c:3/s:2", 51), (1, "d7", "unused", "", "s:3", 6)],
        "doc int, definition string, term string, scope string, addr string, pos int")
    uses = spark.createDataFrame([(1, "u1", "goods", "s:2", 5), (1, "u2", "GOODS", "c:2/s:5", 60), (1, "u3", "goods", "c:2/s:1", 30), (1, "u4", "late", "s:4", 10), (1, "u5", "twin", "c:3/s:7", 70), (1, "u6", "nobody", "s:1", 8), (1, "u7", "seller", "c:2/s:4", 41), (1, "u8", "goods", "c:20/s:5", 95), (1, "u9", "twin", "s:1", 80)], "doc int, use string, term string, addr string, pos int")
    resolved = X.resolve_terms(uses, definitions)
    got = {r["use"]: (r["definition"], r["status"], r["scope"], r["shadowed"]) for r in resolved.collect()}
    assert got == {
        "u1": ("d1", "resolved", "", 0), "u2": ("d2", "resolved", "c:2", 1), "u3": ("d1", "resolved", "", 0), "u4": (None, "open", None, 0), "u5": (None, "ambiguous", "c:3", 0), "u6": (None, "open", None, 0),
        "u7": ("d3", "resolved", "", 0), "u8": ("d1", "resolved", "", 0), "u9": (None, "open", None, 0),
    }
    assert {tuple(r) for r in X.definition_edges(resolved, definitions).collect()} == {(1, "d3", "d1"), (1, "d2", "d3")}
    assert {(r["lint"], r["subject"]) for r in X.definition_lints(resolved, definitions).collect()} == {
        ("used_before_definition", "u4"), ("unbound_term", "u6"), ("unbound_term", "u9"), ("ambiguous_term_use", "u5"), ("definition_never_used", "d4"), ("definition_never_used", "d5"), ("definition_never_used", "d6"), ("definition_never_used", "d7"), ("duplicate_definition", "c:3")}

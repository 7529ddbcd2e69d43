"""Provision answers, gaps, text graphs, census and reconciliation on literal cases."""

from palimpsest.operators import audits as U
from palimpsest.operators import closure as C
from palimpsest.operators import planning as N
from palimpsest.operators import temporal as T

VERSIONS = "addr string, variant string, effective string, enacted string, expires string, territory string, pos int, content string"
ASKED = "id int, jurisdiction string, provision string, as_of string, query_type string, territory string"


def test_provision_answers(spark):
    versions = [
        ("s:1", "permanent", "2000-01-01", "1999-12-01", None, None, 1, "first"), ("s:1", "permanent", "2010-01-01", "2012-06-01", None, None, 2, "backdated"), ("s:1", "permanent", "2020-01-01", "2013-01-01", None, None, 3, "later"), ("s:1", "temporary", "2015-01-01", "2014-01-01", "2017-01-01", None, 4, "for a while"),
        ("s:2", "permanent", "2000-01-01", "2000-01-01", None, None, 1, "general"), ("s:2", "permanent", "2005-01-01", "2005-01-01", None, "north", 2, "northern"), ("s:3", "permanent", "2000-01-01", None, None, None, 1, None), ("s:4", "temporary", "2000-01-01", None, "2010-01-01", None, 1, "t"), ("s:4", "permanent", "2009-12-31", None, None, None, 2, "handed"),
    ]
    asked = [
        (1, "fi", "s:1", "2011-01-01", "governing", None), (2, "fi", "s:1", "2011-01-01", "in_force", None), (3, "fi", "s:1", "2014-06-01", "enacted", None), (4, "fi", "s:1", "2016-01-01", "governing", None), (5, "fi", "s:1", "2018-01-01", "governing", None), (6, "fi", "s:1", "1990-01-01", "governing", None),
        (7, "fi", "s:2", "2010-01-01", "governing", None), (8, "fi", "s:2", "2010-01-01", "governing", "north"), (9, "fi", "s:2", "2010-01-01", "governing", "south"), (10, "fi", "s:3", "2010-01-01", "governing", None), (11, "se", "s:1", "2010-01-01", "governing", None), (12, "fi", "s:1", "2010", "governing", None), (13, "fi", "s", "2010-01-01", "governing", None),
        (14, "fi", "s:1", "2010-01-01", "other", None), (15, "fi", "s:9", "2010-01-01", "governing", None), (16, "fi", "s:4", "2009-12-31", "governing", None), (17, "fi", "s:2", "2003-01-01", "governing", None), (18, "fi", "s:3", "2010-01-01", "enacted", None),
    ]
    got = {r["id"]: (r["status"], r["rail"], r["content"], r["candidates"]) for r in N.provision_answers(spark.createDataFrame(asked, ASKED), spark.createDataFrame(versions, VERSIONS), ["fi"]).collect()}
    assert got == {
        1: ("found", "permanent", "backdated", None), 2: ("found", "permanent", "first", None), 3: ("found", None, "for a while", None), 4: ("found", "temporary", "for a while", None), 5: ("found", "permanent", "backdated", None), 6: ("absent", None, None, None), 7: ("ambiguous", None, None, ["north"]), 8: ("found", "permanent", "northern", None),
        9: ("found", "permanent", "general", None), 10: ("tombstone", "permanent", None, None), 11: ("unsupported_jurisdiction", None, None, None), 12: ("invalid_query", None, None, None), 13: ("invalid_selector", None, None, None), 14: ("invalid_query", None, None, None), 15: ("absent", None, None, None), 16: ("found", "permanent", "handed", None), 17: ("found", "permanent", "general", None), 18: ("absent", None, None, None),
    }


def test_extension_gaps(spark):
    rows = [("a", "2000-01-01", 1, "2000-12-31"), ("a", "2001-01-01", 2, "2001-06-30"), ("a", "2001-08-01", 3, None), ("a", "2009-01-01", 4, "2010-01-01"), ("b", "2000-01-01", 1, "1999-01-01"), ("b", "2000-01-01", 2, "2001-01-01")]
    got = {tuple(r) for r in T.extension_gaps(spark.createDataFrame(rows, "k string, effective string, seq int, valid_until string"), "k").collect()}
    assert got == {("a", "2001-08-01", "2001-07-01"), ("b", "2000-01-01", "1999-01-02")}


def test_text_edges(spark):
    texts = spark.createDataFrame([(1, "kumotaan lain (5/1999) 3 § ja katso 7/2001", "HE 1/2000 ja muistio"), (2, "muutetaan lain (5/1999) 3 §", "direktiivi (EU) 2016/680"), (3, None, None)], "id int, clause string, works string")
    edges, failures = C.text_edges(texts, "id", "clause", "works", spark.createDataFrame([("5/1999",)], "act string"))
    assert {(r["id"], r["relation"], r["target"], r["resolved"]) for r in edges.collect()} == {(1, "repeals", "5/1999", True), (1, "cites", "7/2001", False), (1, "prepared_by", "HE 1/2000", None), (2, "amends", "5/1999", True), (2, "implements", "32016L0680", None)}
    assert {(r["id"], r["stage"], r["detail"]) for r in failures.collect()} >= {(1, "preparatory", "ja muistio"), (1, "clause", "unknown_word: katso")}


def test_text_edges_come_out_of_one_pass(spark):
    """One reading of the texts, and of their clauses those that may cite; what a key's texts say is counted together, with parsed clauses kept or not."""
    rows = [
        (1, "kumotaan lain (5/1999) 3 § ja katso 7/2001 ja 7/2001 sekä 5/1999", "HE 1/2000, HE 01/2000 vp ja muistio"), (1, "muutetaan lain (5/1999) 3 ja 4 §", None), (2, "kumotaan lain (5/1999) 3 §, muutetaan lain (6/1999) 1–3 §", "EUVL L 3, 3.3.2013, s. 3"), (3, None, "HE 9/2010"),
        (4, "kumotaan 3 §", None), (5, "katso (8/1999)", ""), (6, "kumotaan 3 § ( 4 / 1999 )", "(EU) 2019/3")]
    texts, acts = spark.createDataFrame(rows, "id int, clause string, works string"), spark.createDataFrame([("5/1999",), ("5/1999",), (None,), ("7/2001",)], "act string")
    expected = [
        (1, "amends", "5/1999", 3, True), (1, "cites", "7/2001", 2, True), (1, "prepared_by", "HE 1/2000", 2, None), (2, "repeals", "5/1999", 1, True), (2, "amends", "6/1999", 3, False), (2, "cites", "EUVL L 3", 1, None), (3, "prepared_by", "HE 9/2010", 1, None),
        (5, "cites", "8/1999", 1, False), (6, "cites", "EU 2019/3", 1, None)]
    for both in (False, True):
        edges, _ = C.text_edges(texts, "id", "clause", "works", acts, both)
        assert sorted(tuple(r[c] for c in ("id", "relation", "target", "n", "resolved")) for r in edges.collect()) == sorted(expected)
    plan = C.text_edges(texts, "id", "clause", "works", acts)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan and plan.count("Join") == 1 and plan.count("Generate") == 1


def test_graph_census(spark):
    nodes = spark.createDataFrame([("a", "act"), ("b", "act"), ("c", "section"), ("a", "act")], "node string, kind string")
    edges = spark.createDataFrame([("a", "cites", "b"), ("a", "cites", "b"), ("a", "amends", "x"), ("y", "cites", "b")], "src string, relation string, dst string")
    got = {(r["census"], r["kind"]): r["n"] for r in U.graph_census(nodes, edges).collect()}
    assert got == {("nodes", "act"): 2, ("nodes", "section"): 1, ("isolated", "section"): 1, ("edges", "cites"): 3, ("edges", "amends"): 1, ("unknown_source", "cites"): 1, ("unknown_target", "amends"): 1, ("repeated", "cites"): 1, ("degree", "0"): 1, ("degree", "3-9"): 2}


def test_reconcile(spark):
    left = spark.createDataFrame([("s", "1", "A, b"), ("s", "2", "x"), ("s", "3", None), ("s", "4", "only"), ("t", "1", "")], "statute string, selector string, text string")
    right = spark.createDataFrame([("s", "1", "a B."), ("s", "2", "y"), ("s", "3", "z"), ("t", "1", " - ")], "statute string, selector string, text string")
    rows, totals = U.reconcile(left, right)
    assert {(r["statute"], r["selector"]): r["status"] for r in rows.collect()} == {("s", "1"): "agree", ("s", "2"): "differs", ("s", "3"): "only_oracle", ("s", "4"): "only_replay", ("t", "1"): "agree"}
    assert {r["statute"]: (r["agree"], r["differs"], r["only_replay"], r["only_oracle"], r["share"]) for r in totals.collect()} == {"s": (1, 1, 1, 1, 0.25), "t": (1, 0, 0, 0, 1.0)}

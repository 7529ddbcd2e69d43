"""Routing, grouping, pair planning, sunsets, candidates and proposals on literal cases."""

from palimpsest.operators import routing as R


def test_route_amendments(spark):
    rows = [
        ("2012/715", "2009/953", "muutetaan lain (953/2009) 3 §", None, None, "", "references_parent"), ("2012/715", "2009/953", None, None, None, "", "references_parent"), ("2012/x", "2009/953", "(1/2000)", None, None, "", "no_guard_needed"), ("2012/953", "2009/953", "muutetaan lain (1/2000) 3 §", None, None, "", "num_collision_skip"),
        ("2012/715", "2009/953", "muutetaan lain (1/2000) 3 §", None, None, "", "citation_mismatch_skip"), ("2012/715", "2009/953", "säädetään lain (1/2000) nojalla", None, None, "", "delegated_authority_nojalla_skip"), ("2012/715", "2009/953", "lain (1/2000) mukaisesti", "kumotaan laki (953/2009)", None, "", "references_parent"),
        ("2012/715", "2009/953", "muutetaan lain (1/2000) 3 §", None, "laki vesilain muuttamisesta annetun lain muuttamisesta", "vesilain", "pending_amendment_of_parent_skip"), ("2012/715", "2009/953", "muutetaan lain (953/2009) 3 §", None, "laki (7/1999) muuttamisesta", "", "citation_mismatch_skip"),
    ]
    df = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], "k int, amendment_id string, parent_id string, preamble string, section_one string, title string, parent_title string")
    got = {r["k"]: (r["routing"], r["applies"]) for r in R.route_amendments(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: r[-1] for k, r in enumerate(rows)} and all(v[1] == (not v[0].endswith("skip")) for v in got.values())


def test_group_by_target(spark):
    rows = [(1, 1, "section", "3 §", "2 luku", None), (1, 2, "section", "3", None, None), (1, 3, "section", "4", "1", None), (1, 4, "section", "4", "2", None), (1, 5, "section", "4", None, None), (1, 6, "part", "III", None, None), (1, 7, "part", "3", None, None), (1, 8, "section", "9", None, None), (2, 1, "section", "3", None, None)]
    got = {(r["doc_id"], r["seq"]): (r["group_label"], r["group_chapter"], r["scope"]) for r in R.group_by_target(spark.createDataFrame(rows, "doc_id long, seq long, unit string, section string, chapter string, part string")).collect()}
    assert got == {(1, 1): ("3", "2luku", "own"), (1, 2): ("3", "2luku", "inherited"), (1, 3): ("4", "1", "own"), (1, 4): ("4", "2", "own"), (1, 5): ("4", None, "ambiguous"), (1, 6): ("3", None, "own"), (1, 7): ("3", None, "own"), (1, 8): ("9", None, "own"), (2, 1): ("3", None, "own")}


def test_lineage_order(spark):
    rows = [(1, "e3", "2020", "c:1/s:1", "c:1/s:2", "a"), (1, "e1", "2020", "c:2", "c:3", "z"), (1, "e2", "2019", "c:9/s:9/i:1", "x", "a"), (1, "e4", "2020", "c:1/s:1", "c:1/s:2", "a")]
    got = {r["event_id"]: r["position"] for r in R.lineage_order(spark.createDataFrame(rows, "doc_id long, event_id string, effective string, from_addr string, to_addr string, source string")).collect()}
    assert got == {"e2": 0, "e1": 1, "e3": 2, "e4": 3}


def test_plan_pairs(spark):
    bases = spark.createDataFrame([("b1", "2020-01-01", "g1", True), ("b2", "2020-01-01", "g2", False), ("b3", "2000-01-01", "g1", True), ("b4", "2020-01-01", "g4", True), ("b5", "2020-01-01", None, False)], "base_id string, as_of string, group_id string, consolidated boolean")
    redactions = spark.createDataFrame([("g1", "o1", "2010-01-01"), ("g1", "o2", "2019-06-01"), ("g1", "o3", "2021-01-01"), ("g2", "o9", "2015-01-01"), ("g4", "b4", "2018-01-01")], "group_id string, oracle_id string, effective string")
    refs = spark.createDataFrame([("b1", "a1", "s", "2010-01-01"), ("o2", "a1", "s", "2010-01-01"), ("o2", "a2", "s", "2019-01-01"), ("o2", "a2", "s", "2019-05-05"), ("o2", "a3", "s", "2025-01-01"), ("o2", "a4", "s", None), ("b2", "a7", "s", "2012-01-01"), ("b3", "a8", "s", "1999-01-01")], "id string, act string, slice string, starts string")
    plans, amendments = R.plan_pairs(bases, redactions, refs)
    assert {r["base_id"]: (r["oracle_id"], r["comparison"]) for r in plans.collect()} == {"b1": ("o2", "consolidated"), "b2": ("o9", "source"), "b3": (None, "no_oracle"), "b4": ("b4", "oracle_is_base"), "b5": (None, "no_oracle")}
    assert {(r["base_id"], r["act"], r["timing"]) for r in amendments.collect()} == {("b1", "a2", "effective"), ("b1", "a3", "future"), ("b1", "a4", "undated"), ("b2", "a7", "effective")}


def test_sunset_reversions(spark):
    editions = spark.createDataFrame([("1", 2005, "Old  text"), ("1", 2001, "old text"), ("2", 2012, "late")], "section string, year int, text string")
    note = "Amendment reverts to the prior text, ceases to be effective December 31, 2014."
    rows = [("1", 2010, 2014, "temporary", "old text", None), ("2", 2010, 2014, "x", "late", [note]), ("3", 2010, 2014, "x", "y", ["enacted on July 4, 2012."]), ("4", 2010, 2014, "x", "y", []), ("5", 2010, 2014, "x", "X ", [note]), ("6", 2010, 2013, "x", "y", [note]), ("1", 2003, 2014, "t", "old text", [note])]
    got = {(r["section"], r["before_year"]): (r["classification"], r["channels"], r["reverts_to"], r["sunset_day"]) for r in R.sunset_reversions(spark.createDataFrame(rows, "section string, before_year int, after_year int, before_text string, after_text string, notes array<string>"), editions).collect()}
    assert got == {("1", 2010): ("sunset_reversion", "prior_edition", 2001, None), ("2", 2010): ("sunset_reversion", "note", None, "2014-12-31"), ("3", 2010): ("insufficient_signal", None, None, None), ("4", 2010): (None, None, None, None), ("5", 2010): (None, None, None, None), ("6", 2010): ("insufficient_signal", None, None, None), ("1", 2003): ("sunset_reversion", "prior_edition+note", 2001, "2014-12-31")}


def test_consolidation_candidates(spark):
    d = spark.createDataFrame([("b", "s:1", 5), ("b", "s:2", 9), ("b", "s:3", 7), ("b", "s:4", 50)], "base_id string, addr string, size int")
    records = spark.createDataFrame([("b", "s:1", "oracle_wrong"), ("b", "s:4", "replay_bug"), ("b", "s:3", "oracle_wrong")], "base_id string, addr string, bucket string")
    acts = spark.createDataFrame([("b", "s:1", "a1"), ("b", "s:1", "a2")], "base_id string, addr string, act string")
    got = [(r["addr"], r["tier"], r["bucket"], r["act"]) for r in R.consolidation_candidates(d, records, acts, ["oracle_wrong"]).orderBy("rank").collect()]
    assert got == [("s:3", "strong", "oracle_wrong", None), ("s:1", "strong", "oracle_wrong", "a2"), ("s:2", "triage", "unadjudicated_needs_review", None)]


def test_proposal_ops(spark):
    rows = [("HE 1/2020", 2020, 1, "kumotaan lain (5/1999) 3 § ja 4 §", None), ("HE 2/2020", 2020, 2, "muutetaan jokin 3 §", "2000/1"), ("HE 3/2020", 2020, 3, "ei mitään", "2000/1"), ("HE 4/2020", 2020, 4, None, None)]
    got = sorted((r["he_id"], r["operation_kind"], r["target_provision_ref"], r["target_statute_id"], r["parse_status"], r["target_resolution"]) for r in R.proposal_ops(spark.createDataFrame(rows, "he_id string, he_year int, he_number int, clause string, statute string")).fillna("", ["operation_kind", "target_provision_ref", "target_statute_id", "target_resolution"]).collect())
    assert got == [("HE 1/2020", "REPEAL", "section:3", "1999/5", "full", "cited"), ("HE 1/2020", "REPEAL", "section:4", "1999/5", "full", "cited"), ("HE 2/2020", "REPLACE", "section:3", "2000/1", "partial", "given"), ("HE 3/2020", "", "", "2000/1", "failed", ""), ("HE 4/2020", "", "", "", "not_applicable", "")]

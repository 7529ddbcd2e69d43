"""Text selectors, range renumbering, effect lowering and preparatory references on literal cases."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import preparatory as P
from palimpsest.operators import selectors as S

TEXT = "The fee is 10 euros. The second fee is 20 euros; the fee (net) is due. a.b a.b"


@pytest.mark.parametrize(("quote", "before", "after", "nth", "expected"), [
    ("second", None, None, None, (25, 6, "unique")), ("fee", None, None, None, (None, None, "ambiguous")), ("fee", "second", None, None, (32, 3, "unique")), ("fee", None, "(net)", None, (53, 3, "unique")), ("fee", "no", None, None, (None, None, "context_not_found")),
    ("fee", None, None, 2, (32, 3, "nth")), ("fee", None, None, 4, (None, None, "no_such_place")), ("fee", None, None, 0, (None, None, "all")), ("gone", None, None, None, (None, None, "not_found")), ("", None, None, None, (None, None, "empty_quote")), (None, None, None, None, (None, None, "empty_quote")),
    ("a.b", None, None, 2, (75, 3, "nth")), ("(net)", "fee", "is", None, (57, 5, "unique")), ("fee", "the", "is", None, (None, None, "context_not_found")), ("fee", "The", "is 10", None, (4, 3, "unique")),
])
def test_located(spark, quote, before, after, nth, expected):
    df = spark.createDataFrame([(TEXT, quote, before, after, nth)], "t string, q string, b string, a string, n int")
    got = df.select(S.located(*(F.col(c) for c in "tqban")).alias("s")).first()["s"]
    assert tuple(got) == expected
    if expected[0] is not None:
        assert TEXT[got["start"] : got["start"] + got["length"]] == quote


def test_select_and_patch(spark):
    texts = spark.createDataFrame([(k, TEXT) for k in range(1, 9)], "id int, text string")
    edits = [
        (1, "substitute", "20 euros", None, None, None, "30 euros"), (2, "omit", " (net)", None, None, None, None), (3, "insert_after", "fee", "second", None, None, " (gross)"), (4, "insert_before", "euros", "10", None, None, "good "), (5, "substitute", "fee", None, None, None, "x"),
        (6, "substitute", "fee", None, None, 0, "charge"), (7, "omit", "fee", None, None, 1, None), (7, "omit", "fee", None, None, 2, None), (99, "omit", "fee", None, None, 1, None),
    ]
    after, receipts = S.select_and_patch(texts, spark.createDataFrame(edits, "id int, action string, quote string, before string, after string, nth int, payload string"), ["id"])
    got = {r["id"]: r["text"] for r in after.collect()}
    assert got == {1: TEXT.replace("20 euros", "30 euros"), 2: TEXT.replace(" (net)", ""), 3: TEXT.replace("second fee", "second fee (gross)"), 4: TEXT.replace("10 euros", "10 good euros"), 5: TEXT, 6: TEXT.replace("fee", "charge"), 7: TEXT, 8: TEXT}
    assert {(r["id"], r["outcome"], r["reason"]) for r in receipts.collect()} == {(1, "applied", "unique"), (2, "applied", "unique"), (3, "applied", "unique"), (4, "applied", "unique"), (5, "refused", "ambiguous"), (6, "applied", "all"), (7, "refused", "conflicting_edits"), (99, "refused", "text_missing")}


def test_range_renumbering(spark):
    rows = [(1, 1, "chapter:2", "section", "5-7", "6-8"), (1, 2, "", "section", "9, 10", "3 and 4"), (1, 3, "", "section", "1-3", "2-3"), (1, 4, "", "section", "1, 2", "2, 1"), (1, 5, "", "item", "x", "1"), (2, 1, "section:1", "item", "3a-3b", "3b-3c")]
    ops, refused = S.expand_renumbering(spark.createDataFrame(rows, "doc_id long, seq long, parent string, level string, labels string, new_labels string"))
    got = [(r["doc_id"], r["seq"], r["target"], r["destination"]) for r in ops.orderBy("doc_id", "seq").collect()]
    assert got == [
        (1, 10000, "chapter:2/section:7", "chapter:2/section:8"), (1, 10001, "chapter:2/section:6", "chapter:2/section:7"), (1, 10002, "chapter:2/section:5", "chapter:2/section:6"), (1, 20000, "section:9", "section:3"), (1, 20001, "section:10", "section:4"),
        (2, 10000, "section:1/item:3b", "section:1/item:3c"), (2, 10001, "section:1/item:3a", "section:1/item:3b")]
    assert {(r["seq"], r["refusal"]) for r in refused.collect()} == {(3, "lengths_differ"), (4, "overlapping_cycle"), (5, "labels_unreadable")}


def test_effects(spark):
    rows = [("g", 0, "commencement", "2020-01-01", False, ""), ("g", 1, "commencement", None, True, ""), ("g", 2, "commencement", None, None, ""), ("g", 3, "expiry", "2020-12-31", None, ""), ("g", 4, "expiry", None, None, ""), ("g", 5, "suspension", "2021-05-05", None, ""), ("g", 6, "revival", "2022-01-01", None, ""), ("g", 7, "applicability", None, None, " to ships "), ("g", 8, "something", None, None, "")]
    df = spark.createDataFrame([(*r, "2019-01-01", None, "1/2000") for r in rows], "group_id string, nth int, kind string, day string, contingent boolean, raw_text string, source_issued string, source_effective string, statute string")
    got = {r["event_id"]: (r["kind"], r["effective"], r["expires"], r["activation"], r["predicate"]) for r in S.lower_effects(df).collect()}
    assert got == {
        "g:1": ("commence", "2020-01-01", "", "fixed_date", None), "g:2": ("commence", "", "", "pending_decree", None), "g:3": ("commence", "2019-01-01", "", "immediate", None), "g:4": ("expire", "", "2021-01-01", None, None), "g:5": ("expire", "", "", None, None),
        "g:6": ("suspend", "", "2021-05-05", None, None), "g:7": ("revive", "2022-01-01", "", None, None), "g:8": ("set_applicability", "2019-01-01", "", None, "to ships"), "g:9": ("unsupported", "", "", None, None)}


def test_preparatory_references(spark):
    text = "HE 195/2025 vp, HaVM 12/2025, PeVL 3/2024 ja EV 88/2025; LA 4/2020, EVK 1/1999. Euroopan parlamentin direktiivi (EU) 2016/680 (32016L0680); EUVL L 119, 4.5.2016, s. 89, asetus (EY) N:o 45/2001, (EU) 2019/1 EUVL C 7, muistio 5"
    rows, rejected = P.preparatory_references(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t")
    got = [(r["kind"], r["canonical_id"], r["confidence"]) for r in rows.orderBy("id", "nth").collect()]
    assert got == [
        ("he", "HE 195/2025", "exact"), ("committee_report", "HaVM 12/2025", "exact"), ("committee_opinion", "PeVL 3/2024", "exact"), ("parliament_response", "EV 88/2025", "exact"), ("law_initiative", "LA 4/2020", "exact"), ("parliament_response_comm", "EVK 1/1999", "exact"), ("eu_directive", "32016L0680", "exact"),
        ("eu_directive", "32016L0680", "exact"), ("oj_reference", "EUVL L 119", "exact"), ("eu_regulation", "32001R0045", "exact"), ("eu_regulation", "EU 2019/1", "approximate"), ("oj_reference", "EUVL C 7", "approximate")]
    journal = rows.filter("oj_page is not null").first()
    assert (journal["oj_series"], journal["oj_date"], journal["oj_number"], journal["oj_page"]) == ("L", "2016-05-04", 119, 89) and rows.filter("he_number = 195 and he_year = 2025").count() == 1
    assert {r["candidate"] for r in rejected.collect()} == {"ja", "Euroopan parlamentin", "muistio 5"}


def test_names_of_works_are_those_of_the_references(spark):
    texts = [
        "HE 2/2012 vp, EV 2/2012, direktiivi (EY) N:o 3/2002; EUVL L 3, 3.3.2003, s. 3", "PeVL 007/2000 vp; EVK 0010/2001  LA\t0004/2020 vp, EVM 1/2000, AVL 22/2222", "asetuksen (EU) 2016/0679 päätös (ETY) 12/87 (EEY) N:o 5/5 32016R0679, 32010D0001; EUVL C0009",
        "direktiivin (EU) 2014/2015, (EY) 2014/2014 HE 0000/2000", "muistio 5", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    references = P.preparatory_references(docs, "id", "t")[0].orderBy("id", "nth").collect()
    named = {r["id"]: [tuple(x) for x in r["n"] or []] for r in docs.select("id", P.named_works(F.col("t")).alias("n")).collect()}
    assert named == {k: [(r["kind"], r["canonical_id"]) for r in references if r["id"] == k] for k in range(len(texts))}
    assert [x[1] for k in range(4) for x in named[k]] == [
        "HE 2/2012", "EV 2/2012", "32002L0003", "EUVL L 3", "PeVL 7/2000", "EVK 10/2001", "LA 4/2020", "EVM 1/2000", "AVL 22/2222", "EU 2016/679", "31987D0012", "EU 1905/5", "32016R0679", "32010D0001", "EUVL C 9", "32015L2014", "EU 2014/2014", "HE 0/2000"]

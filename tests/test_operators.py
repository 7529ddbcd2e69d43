"""Operators on literal fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import extraction as X
from palimpsest.functions import text as S
from palimpsest.operators import aggregates as A
from palimpsest.operators import evidence as E
from palimpsest.operators import filters as P
from palimpsest.operators import graph as G
from palimpsest.operators import joins as J
from palimpsest.operators import replay as R
from palimpsest.operators import temporal as T
from palimpsest.operators import windows as W
from palimpsest.sources import tables, xml_nodes
from palimpsest.streaming import streams

PROPOSALS = [("HE 176/2025 vp", "pending"), ("HE 157/2025 vp", "pending"), ("HE 141/2025 vp", "pending"), ("HE 191/2025 vp", "pending"), ("HE 100/2024 vp", "enacted")]
LAW_REFS = [
    ("HE 176/2025 vp", "1995/1558", "1995/1558/31"), ("HE 176/2025 vp", "1995/1558", "1995/1558/32"), ("HE 157/2025 vp", "1995/1558", "1995/1558/31"), ("HE 157/2025 vp", "1995/1558", "1995/1558/40"),
    ("HE 141/2025 vp", "1995/1558", "1995/1558/55"), ("HE 100/2024 vp", "1995/1558", "1995/1558/10"), ("HE 191/2025 vp", "572/2014", "572/2014/5"),
]


def test_competing_proposals(spark):
    corpus = spark.createDataFrame(PROPOSALS, "he_id string, state string")
    refs = spark.createDataFrame(LAW_REFS, "he_id string, act string, provision string")
    pending = refs.filter("act = '1995/1558'").join(corpus.filter("state = 'pending'"), "he_id", "left_semi")
    assert pending.select("he_id").distinct().count() == 3
    shared = {tuple(r) for r in J.contested(pending, "he_id", "provision").collect()}
    assert shared == {("1995/1558/31", "HE 176/2025 vp"), ("1995/1558/31", "HE 157/2025 vp")}


def versions(spark, rows):
    return spark.createDataFrame(rows, "addr string, effective string, enacted string, expires string, variant string, pos int, content string")


@pytest.mark.parametrize(
    ("rows", "day", "expected"),
    [
        ([("a", "0000-00-00", "", "", "permanent", 0, "base")], "1990-01-01", "base"),
        ([("a", "2000-01-01", "", "", "permanent", 0, "old"), ("a", "2001-01-01", "", "", "permanent", 1, "new")], "2001-01-01", "new"),
        ([("a", "2000-01-01", "", "", "permanent", 0, "p"), ("a", "2000-06-01", "", "2000-09-01", "temporary", 1, "t")], "2000-08-31", "t"),
        ([("a", "2000-01-01", "", "", "permanent", 0, "p"), ("a", "2000-06-01", "", "2000-09-01", "temporary", 1, "t")], "2000-09-01", "p"),
        ([("a", "2000-08-31", "", "", "permanent", 0, "p"), ("a", "2000-06-01", "", "2000-09-01", "temporary", 1, "t")], "2000-08-31", "p"),
        ([("a", "2000-08-30", "", "", "permanent", 0, "p"), ("a", "2000-06-01", "", "2000-09-01", "temporary", 1, "t")], "2000-08-31", "t"),
        ([("a", "2000-06-01", "", "2000-09-01", "temporary", 1, "t")], "2000-10-01", None),
    ],
)
def test_point_in_time(spark, rows, day, expected):
    found = T.select_point_in_time(versions(spark, rows), day).collect()
    assert ([r["content"] for r in found] or [None])[0] == expected


def test_in_force_needs_enactment(spark):
    v = versions(spark, [("a", "2000-01-01", "2000-05-01", "", "permanent", 0, "x")])
    assert T.select_point_in_time(v, "2000-02-01").count() == 1
    assert T.select_point_in_time(v, "2000-02-01", "in_force").count() == 0


def reference_pit(rows, day):
    live = [(r[1], r[2], r[5], r) for r in rows if r[1] <= day and (not r[3] or r[3] > day)]
    rail = {k: max((x for x in live if x[3][4] == k), default=None) for k in ("temporary", "permanent")}
    o, b = rail["temporary"], rail["permanent"]
    if o and b and b[0] > o[0] and o[3][3] and b[0] >= f"{o[3][3][:8]}{int(o[3][3][8:]) - 1:02}":
        o = None
    return (o or b or (None,) * 4)[3] and (o or b)[3][6]


days = st.sampled_from([f"2020-01-{d:02}" for d in range(2, 28, 3)])


def test_point_in_time_against_a_model(spark):
    cases = []

    @settings(max_examples=60, deadline=None, database=None)
    @given(st.lists(st.tuples(days, days, st.sampled_from(["permanent", "temporary"]), st.booleans(), days), min_size=1, max_size=5), days)
    def collect(vs, day):
        a = f"a{len(cases)}"
        cases.append(([(a, e, n, x if k == "temporary" and has else "", k, i, f"{a}:{i}") for i, (e, n, k, has, x) in enumerate(vs)], day))

    collect()
    for day in sorted({d for _, d in cases}):
        mine = [(rows, d) for rows, d in cases if d == day]
        got = {r["addr"]: r["content"] for r in T.select_point_in_time(versions(spark, [r for rows, _ in mine for r in rows]), day).collect()}
        for rows, d in mine:
            assert got.get(rows[0][0]) == reference_pit(rows, d), (rows, d)


def test_prefix_modes(spark):
    df = spark.createDataFrame([("a/7",), ("a/70",), ("a/7/1",)], "p string")
    assert df.filter(P.provision_prefix("p", "a/7")).count() == 3
    assert df.filter(P.provision_prefix("p", "a/7", "strict")).count() == 2


def test_selector(spark):
    df = spark.createDataFrame([("§3:7.2.a",), ("§7",), ("12 §",), ("plain",)], "s string")
    assert [r[0] for r in df.select(P.selector_locator("s")).collect()] == ["chapter:3/section:7/subsection:2/paragraph:a", "section:7", "section:12", "plain"]


def test_group_atomicity(spark):
    df = spark.createDataFrame([("g", "kept"), ("g", "pending"), (None, "pending"), ("h", "kept")], "group_id string, disposition string")
    assert sorted(r["disposition"] for r in P.group_atomicity(df).collect()) == ["kept", "pending", "rejected", "rejected"]


def test_label_order(spark):
    df = spark.createDataFrame([("10",), ("2a",), ("x-text",), ("2",), ("IV",), ("",)], "label string")
    assert [r[0] for r in df.orderBy(W.label_sort_key("label")).collect()] == ["2", "2a", "IV", "10", "", "x-text"]


def test_roman(spark):
    df = spark.range(1, 400)
    assert df.filter(W.roman_value(S.arabic_to_roman(F.col("id"))) != F.col("id")).count() == 0


def test_normalise(spark):
    df = spark.createDataFrame([("a ( b )  ,c – d",), ("clean",)], "t string")
    rows = S.normalise(df, "t").collect()
    assert rows[0]["normal"] == "a (b),c — d" and "fold_dashes" in rows[0]["fired"]
    assert rows[1]["fired"] == []


@settings(max_examples=80, deadline=None, database=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_indel_ratio(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert S.indel_ratio(a, b) == pytest.approx(2 * rows[-1][-1] / (len(a) + len(b)) if a or b else 1.0)


def test_bfs_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r["node"]: r["hops"] for r in G.breadth_first(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert {r[0] for r in G.reachable(edges, spark.createDataFrame([("b",)], "node string")).collect()} == {"a", "b", "c", "d"}


def test_unknown_act_is_unverifiable(spark):
    acts = spark.createDataFrame([("x", "2000-01-01", "2010-01-01")], "act string, in_force string, repealed string")
    cites = spark.createDataFrame([("x", "2005-01-01"), ("x", "2010-01-01"), ("y", "2005-01-01")], "act string, d string")
    assert sorted(r["lifecycle"] for r in J.lifecycle(cites, acts, "act", "d").collect()) == ["broken", "in_force", "unverifiable"]


def test_partition_law(spark):
    df = spark.createDataFrame([("a",), ("z",), ("zero",)], "b string")
    assert {tuple(r) for r in A.partition_violations(df, "b", ["a", "b", "zero"], ["zero"]).collect()} == {("b", 0, "missing"), ("z", 1, "undeclared"), ("zero", 1, "must_be_zero")}


def test_ink_census(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    glyphs = spark.createDataFrame([(1, 1, 1.0, 1.0, 2.0, 2.0, False), (1, 2, 9.0, 9.0, 12.0, 12.0, False), (2, 3, 0.0, 0.0, 1.0, 1.0, True)], "page int, glyph_id int, x0 double, y0 double, x1 double, y1 double, furniture boolean")
    got = {r["page"]: (r["content"], r["claimed"], r["ratio"]) for r in A.ink_census(boxes, glyphs, "page", 0.5).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 1.0)}


def test_evidence_policy(spark):
    att = spark.createDataFrame([("s", "review", "k1", "2020"), ("s", "build", "k2", "2021"), ("r", "retracted", "k1", "2020")], "subject string, kind string, signer string, ts string")
    got = {r["subject"]: r["authorized"] for r in E.authorize(att, {"signed": {"op": "signed_by", "key": "k1"}, "live": {"op": "not_retracted"}}).collect()}
    assert got == {"s": True, "r": False}
    with pytest.raises(ValueError, match="unknown op"):
        E.clause_column({"op": "magic"})


def test_event_log_batch(spark):
    log = spark.createDataFrame([("a", 1, "draft"), ("a", 2, "final"), ("b", 1, "draft"), ("b", 2, "gone")], "subject string, ord int, state string")
    got = {r["subject"]: (r["state"], r["illegal"]) for r in E.effective_state(log, "subject", "ord", "state", {"draft": ["final"]}).collect()}
    assert got == {"a": ("final", None), "b": ("gone", "draft>gone")}


OPS = "doc_id long, seq long, action string, target string, payload string, find string, occurrence long, destination string, anchor string, group_id string"


def test_replay(spark):
    nodes = spark.createDataFrame([(1, "section:1", 1.0, "section", "one one", "live"), (1, "section:2", 2.0, "section", "two", "live"), (2, "section:1", 1.0, "section", "x", "live")], R.NODES)
    ops = spark.createDataFrame([
        (1, 1, "RENUMBER", "section:1", None, None, None, "section:2", None, None), (1, 2, "RENUMBER", "section:2", None, None, None, "section:3", None, None),
        (1, 3, "TEXT_PATCH", "section:2", "uno", "one", -2, None, None, None), (1, 4, "INSERT", "section:1", "fresh", None, None, None, None, None), (2, 1, "REPEAL", "section:1", None, None, None, None, None, None), (2, 2, "REPLACE", "section:9", "y", None, None, None, None, None),
    ], OPS)
    vacate = R.Ordering(vacate=True)  # what leaves section 2 first has to be asked for
    after, receipts = R.replay(nodes, ops, ordering=vacate)
    assert {(r["doc_id"], r["addr"]): r["text"] for r in after.collect()} == {(1, "section:1"): "fresh", (1, "section:2"): "one uno", (1, "section:3"): "two", (2, "section:1"): None}
    assert sorted((r["doc_id"], r["seq"], r["outcome"]) for r in receipts.collect()) == [(1, 1, "applied"), (1, 2, "applied"), (1, 3, "applied"), (1, 4, "applied"), (2, 1, "applied"), (2, 2, "target_missing")]
    assert R.state_hash(after).exceptAll(R.state_hash(R.replay(nodes, ops, ordering=vacate)[0])).count() == 0


def test_replay_keeps_the_order_of_dependent_ops(spark):
    nodes = spark.createDataFrame([(1, "s:1", 1.0, "s", "one", "live"), (2, "s:1", 1.0, "s", "one", "live"), (2, "s:1/p:1", 1.0, "p", "below", "live"), (3, "s:1", 1.0, "s", "x", "live"), (3, "s:2", 2.0, "s", "y", "live")], R.NODES)
    rows = [
        (1, 2, "REPEAL", "s:2", None, None, None, None, None, None), (1, 1, "INSERT", "s:2", "new", None, None, None, None, None),
        (2, 1, "TEXT_PATCH", "s:1", "uno", "one", 0, None, None, None), (2, 2, "RENUMBER", "s:1", None, None, None, "s:2", None, None), (2, 3, "REPLACE", "s:2/p:1", "still below", None, None, None, None, None),
        (3, 1, "RENUMBER", "s:1", None, None, None, "s:2", None, "g"), (3, 2, "REPEAL", "s:2", None, None, None, None, None, "g"), (3, 3, "RENUMBER", "s:2", None, None, None, "s:3", None, "g"),
    ]
    after, receipts = R.replay(nodes, spark.createDataFrame(rows, OPS))
    got = {(r["doc_id"], r["addr"]): (r["text"], r["status"]) for r in after.collect()}
    assert got[1, "s:2"] == (None, "tombstone") and got[2, "s:2"] == ("uno", "live") and got[2, "s:2/p:1"] == ("still below", "live") and (2, "s:1") not in got
    assert {(r["doc_id"], r["seq"]): r["outcome"] for r in receipts.collect()}[3, 1] == "slot_occupied"  # without a profile that asks for it
    ordered = [o["seq"] for o in R.applied_order([dict(zip([c.split()[0] for c in OPS.split(", ")], r, strict=True)) for r in rows if r[0] == 3], R.Ordering(vacate=True))]
    assert ordered == [2, 3, 1]
    dated = spark.createDataFrame([(1, 1, "REPLACE", "s:1", "late", None, None, None, None, None, "2024-02-01"), (1, 2, "REPLACE", "s:1", "early", None, None, None, None, None, "2024-01-01"), (1, 3, "REPEAL", "s:1", None, None, None, None, None, None, "2030-01-01")], OPS + ", effective string")
    after, receipts = R.replay(nodes.filter("doc_id = 1"), dated, as_of="2025-01-01", both=True)
    assert [r["text"] for r in after.collect()] == ["late"] and sorted(r["outcome"] for r in receipts.collect()) == ["applied", "applied", "not_yet_effective"]


def test_rename_cycles_take_their_smallest_address(spark):
    moves = spark.createDataFrame([("c", "b"), ("b", "d"), ("d", "c"), ("x", "c"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "t")], "from_addr string, to_addr string")
    got = {r["addr"]: r["final"] for r in G.follow_renames(spark.createDataFrame([(a,) for a in "bcdxpqsz"], "addr string"), moves).collect()}
    assert got == {"b": "b", "c": "b", "d": "b", "x": "b", "p": "t", "q": "t", "s": "t", "z": "z"}


def test_patch_text():
    assert R.patch_text("a b a", "a", "c") == "c b a"
    assert R.patch_text("a b a", "a", "c", 1) == "a b c"
    assert R.patch_text("a b a", "a", "c", -1) == "c b c"
    assert R.patch_text("a b a", "a", "c", -2) == "a b c"
    assert R.patch_text("a b a", "a", "c", 2) is None


def test_occupancy(spark):
    df = spark.createDataFrame([("substantive", "REPLACE"), ("absent", "REPLACE")], "state string, action string")
    assert [tuple(r) for r in R.occupancy_violations(df).collect()] == [("absent", "REPLACE")]


def test_mentions(spark):
    df = spark.createDataFrame([(1, "Under 12/1999 and 12/1499, § 3a on 2020-01-31 you must pay 30 days.")], "id int, t string")
    rows, rejected = X.mentions(df, "id", "t")
    assert {(r["kind"], r["raw"]) for r in rows.collect()} == {("act", "12/1999"), ("section", "§ 3a"), ("date", "2020-01-31"), ("modal", "must"), ("quantity", "30 days")}
    assert [r["raw"] for r in rejected.collect()] == ["12/1499"]


def test_xml(spark):
    df = spark.createDataFrame([(1, "<act><body><section num='1'><content>Text</content></section><foo/></body></act>"), (2, "<broken")], "doc_id long, xml string")
    rows = xml_nodes.xml_nodes(df).collect()
    assert {(r["doc_id"], r["addr"], r["text"]) for r in rows if r["text"]} == {(1, "section:1", "Text")}
    assert sorted(r["finding"].split(":")[0] for r in rows if r["finding"]) == ["unmapped_element", "xml_error"]


def test_tables(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    tables.write(df, f"{folder}/t.parquet", meta={"rev": "1"})
    (tmp_path / "t.jsonl").write_text('{"id": 9}\n')
    (tmp_path / "u.jsonl").write_text('{"id": 9}\n')
    assert {k: v.rsplit("/", 1)[1] for k, v in tables.discover(spark, folder).items()} == {"t": "t.parquet", "u": "u.jsonl"}
    assert tables.run_sql(spark, folder, "SELECT count(*) AS n FROM t JOIN u ON t.id < u.id").first()["n"] == 2
    assert not tables.stale(spark, f"{folder}/t.parquet", {"rev": "1"}) and tables.stale(spark, f"{folder}/t.parquet", {"rev": "2"})
    assert tables.fingerprint(df).first() == tables.fingerprint(df.repartition(3)).first()


def test_several_tables(spark, tmp_path):
    base = spark.range(10).withColumn("odd", F.col("id") % 2 == 1)
    views = {"odd": lambda df: df.filter("odd").select("id"), "counts": lambda df: df.groupBy("odd").count()}
    tables.write_tables(base, views, str(tmp_path), {"rev": "7"})
    assert spark.read.parquet(f"{tmp_path}/odd.parquet").count() == 5 and {r["count"] for r in spark.read.parquet(f"{tmp_path}/counts.parquet").collect()} == {5}
    assert not tables.stale(spark, f"{tmp_path}/odd.parquet", {"rev": "7"})
    with pytest.raises(ValueError):
        tables.write_tables(base, views, str(tmp_path), {})


def test_incremental_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).withColumn("ok", F.col("id") % 2 == 0).coalesce(1).write.parquet(source)
    build = lambda b: (b.filter("ok"), b.filter("not ok"))
    for _ in range(2):
        streams.incremental_build(streams.stream_table(spark, source), build, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 5 and spark.read.parquet(str(tmp_path / "out/diagnostics")).count() == 5


def test_stream_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 1), ("2024-01-01 02:00:00", "b", 2)], "ts string, k string, id int").withColumn("ts", F.to_timestamp("ts")).write.parquet(source)
    counts = streams.windowed_counts(streams.stream_table(spark, source), "ts", ["k"], "1 hour")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"]) for r in spark.table("w").collect()} == {("a", 2), ("b", 1)}


def test_coverage_and_chain(spark):
    units = spark.createDataFrame([("u1", "s:1", None), ("u2", "s:2", "known"), ("u3", "s:3", None)], "unit_id string, kind_label string, class string")
    claims = spark.createDataFrame([("u1",)], "claim string")
    assert {r["unit_id"]: r["state"] for r in A.coverage(units, claims).collect()} == {"u1": "covered", "u2": "known", "u3": "UNIT_UNCLASSIFIED"}


HISTORY = [("HE 195/2025 vp", "2014/527", "2014/527/225"), ("HE 83/2025 vp", "2014/527", "2014/527/1"), ("HE 83/2025 vp", "2014/527", "2014/527/210"), ("HE 102/2024 vp", "2014/527", "2014/527/10"), ("HE 176/2025 vp", "1995/1558", "1995/1558/31"), ("HE 176/2025 vp", "1995/1558", "1995/1558/32")]
STATES = [("HE 195/2025 vp", 2025, 195, "pending"), ("HE 83/2025 vp", 2025, 83, "closed"), ("HE 102/2024 vp", 2024, 102, "enacted"), ("HE 176/2025 vp", 2025, 176, "pending")]


def test_proposal_history(spark):
    refs = spark.createDataFrame(HISTORY, "he_id string, act string, provision string").filter("act = '2014/527'")
    lists = refs.groupBy("he_id").agg(A.sorted_distinct("provision").alias("provisions"))
    corpus = spark.createDataFrame(STATES, "he_id string, year int, number int, state string")
    rows = corpus.join(lists, "he_id").orderBy(F.desc("year"), F.desc("number")).collect()
    assert [r["he_id"] for r in rows] == ["HE 195/2025 vp", "HE 83/2025 vp", "HE 102/2024 vp"]
    assert rows[1]["provisions"] == "2014/527/1, 2014/527/210"
    assert [r["he_id"] for r in rows if r["state"] == "pending"] == ["HE 195/2025 vp"]


def test_change_versions(spark):
    snaps = spark.createDataFrame([("a", "1", "x"), ("a", "2", "x"), ("a", "4", "y"), ("b", "2", "z"), ("b", "3", None), ("b", "4", "z")], "addr string, day string, content string")
    got = sorted(map(tuple, W.change_versions(snaps, "addr", "day", "content", snaps).collect()))
    assert got == [("a", "1", "x"), ("a", "3", None), ("a", "4", "y"), ("b", "2", "z"), ("b", "3", None), ("b", "4", "z")]


def test_applicable_and_bridge(spark):
    from palimpsest.operators import selection as L

    df = spark.createDataFrame([("32016R0679",), ("31995L0046",), ("x",)], "c string")
    assert [r[0] for r in df.select(L.celex_to_eli(F.col("c"))).collect()] == ["reg/2016/679", "dir/1995/46", None]
    credit = spark.createDataFrame([("Pub. L. 94-553, Oct. 19, 1976; amended",)], "c string").select(L.credit_acts(F.col("c"))).first()[0]
    assert [(x["law"], x["dated"]) for x in credit] == [("94-553", "Oct. 19, 1976"), ("", "")]


def test_event_log_stream(spark, tmp_path):
    source, sink = str(tmp_path / "log"), str(tmp_path / "states")
    spark.createDataFrame([("a", 1, "draft"), ("a", 2, "final"), ("b", 1, "draft"), ("b", 2, "gone")], "subject string, ord long, state string").coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = streams.log_states(streams.stream_table(spark, source), {"draft": ["final"]})
        states.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(sink)).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [("a", 1, "draft", True), ("a", 2, "final", True), ("b", 1, "draft", True), ("b", 2, "draft", False)]


def test_fingerprint_of_many_rows(spark):
    """Twenty million rows: their 40-bit digests together leave a long."""
    many = spark.range(20_000_000)
    assert tables.fingerprint(many).first()["n"] == 20_000_000
    assert tables.fingerprint(many).first() == tables.fingerprint(many.repartition(3)).first() != tables.fingerprint(many.withColumn("id", F.col("id") + 1)).first()
    few = many.filter("id < 1000")
    total = few.agg(F.sum(F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)))).first()[0]
    assert tables.fingerprint(few).first()["digest"] == total and tables.fingerprint(few.limit(0)).first()["digest"] == 0


def test_recursion_is_not_bounded_by_rows(spark, tmp_path):
    spark.range(600_000).write.parquet(f"{tmp_path}/starts.parquet")
    found = tables.run_sql(spark, str(tmp_path), "WITH RECURSIVE r(n, k) AS (SELECT 0, id FROM starts UNION ALL SELECT n + 1, k FROM r WHERE n < 1) SELECT n, count(*) AS rows FROM r GROUP BY n")
    assert {(r["n"], r["rows"]) for r in found.collect()} == {(0, 600_000), (1, 600_000)}

"""The order of ops: what is asked for and no more, no op lost, conflicts as rows."""

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import replay as R

OPS = "doc_id long, seq long, action string, target string, payload string, find string, occurrence long, destination string, anchor string, group_id string, effective string, act string"


def op(seq, action, target, destination=None, payload=None, group=None, day=None, act=None, doc=1):
    return (doc, seq, action, target, payload, None, 0, destination, None, group, day, act)


def as_dict(row):
    return dict(zip([c.split()[0] for c in OPS.split(", ")], row, strict=True))


def test_sequence_decides_unless_more_is_asked(spark):
    nodes = spark.createDataFrame([(1, "s:1", 1.0, "s", "one", "live")], R.NODES)
    ops = spark.createDataFrame([op(1, "RENUMBER", "s:1", "s:2"), op(2, "RENUMBER", "s:2", "s:3")], OPS)
    after, receipts = R.replay(nodes, ops)
    assert [r["addr"] for r in after.collect()] == ["s:3"] and [r["outcome"] for r in receipts.collect()] == ["applied", "applied"]


def test_repeated_targets_keep_all_ops(spark):
    rows = [op(1, "RENUMBER", "s:1", "s:2"), op(2, "RENUMBER", "s:0", "s:1"), op(3, "RENUMBER", "s:1", "s:4")]
    for vacate in (False, True):
        assert [o["seq"] for o in R.applied_order(map(as_dict, rows), R.Ordering(vacate=vacate))] == [1, 2, 3]
    nodes = spark.createDataFrame([(1, "s:1", 1.0, "s", "one", "live"), (1, "s:0", 0.0, "s", "zero", "live")], R.NODES)
    after, receipts = R.replay(nodes, spark.createDataFrame(rows, OPS), ordering=R.Ordering(vacate=True))
    assert {r["addr"]: r["text"] for r in after.collect()} == {"s:2": "one", "s:4": "zero"} and receipts.count() == 3


OP = st.tuples(st.sampled_from(["RENUMBER", "RENUMBER", "REPEAL", "REPLACE"]), st.integers(0, 4), st.integers(0, 4), st.sampled_from([None, "g", "h"]), st.sampled_from([None, "2020-01-01", "2021-01-01"]), st.sampled_from(["a", "b"]))


@settings(max_examples=300, deadline=None, database=None)
@given(st.lists(OP, max_size=12), st.booleans(), st.booleans())
def test_every_op_is_applied_once(drawn, by_act, vacate):
    ops = [as_dict(op(k, a, f"s:{t}", f"s:{d}" if a == "RENUMBER" else None, None, g, day, act)) for k, (a, t, d, g, day, act) in enumerate(drawn)]
    out = R.applied_order(ops, R.Ordering(by_act, vacate))
    assert sorted(o["seq"] for o in out) == list(range(len(ops)))
    days = [o["effective"] or "" for o in out]
    assert days == sorted(days)
    if not vacate:
        assert out == sorted(ops, key=lambda o: (o["effective"] or "", o["act"] if by_act else "", o["seq"]))
    else:
        key = lambda o: (o["effective"] or "", o["act"] if by_act else "", o["group_id"])
        rank = {"REPEAL": 0, "RENUMBER": 1}
        runs = [key(o) for k, o in enumerate(out) if k == 0 or key(o) != key(out[k - 1])]
        assert len(runs) == len(set(runs))  # groups are not torn
        assert all(rank.get(a["action"], 2) <= rank.get(b["action"], 2) for a, b in zip(out, out[1:]) if key(a) == key(b))


def test_positions_are_those_of_the_order(spark):
    rows = [op(s, a, t, d, None, g, day, act, doc) for doc in (1, 2) for s, (a, t, d, g, day, act) in enumerate([
        ("RENUMBER", "s:1", "s:2", "g", None, "b"), ("REPLACE", "s:1", None, None, "2020-01-01", "a"), ("RENUMBER", "s:2", "s:3", "g", None, "b"), ("REPEAL", "s:3", None, "g", None, "b"), ("RENUMBER", "s:5", "s:6", None, None, "a"), ("RENUMBER", "s:6", "s:5", None, None, "a")])]
    for ordering in (R.Ordering(), R.Ordering(by_act=True), R.Ordering(vacate=True), R.Ordering(True, True)):
        got = {(r["doc_id"], r["seq"]): r["position"] for r in R.applied_positions(spark.createDataFrame(rows, OPS), ordering).collect()}
        assert got == {(doc, o["seq"]): k for doc in (1, 2) for k, o in enumerate(R.applied_order([as_dict(r) for r in rows if r[0] == doc], ordering))}


def test_conflicts_are_rows(spark):
    rows = [
        op(1, "REPLACE", "s:1", payload="x", day="2020-01-01", act="a"), op(2, "REPLACE", "s:1", payload="y", day="2020-01-01", act="b"), op(3, "REPLACE", "s:2", payload="x", day="2020-01-01", act="a"), op(4, "REPLACE", "s:2", payload="x", day="2020-01-01", act="b"),
        op(5, "RENUMBER", "s:3", "s:9", day="2020-01-01", act="a"), op(6, "RENUMBER", "s:4", "s:9", day="2020-01-01", act="a"), op(7, "RENUMBER", "s:3", "s:8", day="2020-01-01", act="a"),
    ]
    ops = spark.createDataFrame(rows, OPS)
    got = {(r["target"], r["finding"], r["resolution"], r["blocking"]) for r in R.order_conflicts(ops).collect()}
    assert got == {("s:1", "same_moment_conflict", "sequence_order_unproven", True), ("s:9", "destination_contested", "sequence_order_unproven", False), ("s:3", "target_renumbered_again", "sequence_order_unproven", False)}
    claims = spark.createDataFrame([(1, "2020-01-01", "s:1")], "doc_id long, day string, target string")
    assert R.order_conflicts(ops, claims).filter("blocking").count() == 0


def test_ops_not_commenced_leave_a_receipt(spark):
    nodes = spark.createDataFrame([(1, "s:1", 1.0, "s", "one", "live")], R.NODES)
    ops = spark.createDataFrame([(*op(1, "REPLACE", "s:1", payload="two"), True), (*op(2, "REPLACE", "s:1", payload="three"), None)], OPS + ", commenced boolean")
    after, receipts = R.replay(nodes, ops)
    assert [r["text"] for r in after.collect()] == ["two"] and sorted(r["outcome"] for r in receipts.collect()) == ["applied", "not_commenced"]


def test_documents_are_folded_one_after_the_other(spark):
    """Documents longer than a batch, some without nodes or without ops; no call of Python for each."""
    nodes = spark.range(40).selectExpr("id % 8 AS doc_id", "concat('s:', id) AS addr", "cast(id AS double) AS ord", "'s' AS kind", "'t' AS text", "'live' AS status")
    ops = spark.range(40).selectExpr("id % 10 AS doc_id", "id AS seq", "'REPLACE' AS action", "concat('s:', id) AS target", "'new' AS payload", "cast(null AS string) AS find", "0L AS occurrence", "cast(null AS string) AS destination", "cast(null AS string) AS anchor", "cast(null AS string) AS group_id")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        after, receipts = R.replay(nodes, ops)
        assert "CoGroup" not in after._jdf.queryExecution().executedPlan().toString()
        same = {k for k in range(40) if k % 8 == k % 10}
        assert {(r["seq"], r["outcome"]) for r in receipts.collect()} == {(k, "applied" if k in same else "target_missing") for k in range(40)}
        assert {(r["addr"], r["text"]) for r in after.collect()} == {(f"s:{k}", "new" if k in same else "t") for k in range(40)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_places_of_many_documents_without_a_call_for_each(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", None)
    rows = [op(k, a, f"s:{k % 3}", f"s:{(k + 1) % 3}" if a == "RENUMBER" else None, None, g, day, act, doc) for doc in (1, 2, None) for k, (a, g, day, act) in enumerate([("RENUMBER", None, None, "b"), ("RENUMBER", "g", "2020-01-01", "a"), ("REPLACE", None, None, "a"), ("REPEAL", None, None, "b"), ("RENUMBER", "g", "2020-01-01", None)])]
    for by_act in (False, True):
        ordering = R.Ordering(by_act, vacate=True)
        got = {(r["doc_id"], r["seq"]): r["position"] for r in R.applied_positions(spark.createDataFrame(rows, OPS), ordering).collect()}
        assert got == {(doc, o["seq"]): k for doc in (1, 2, None) for k, o in enumerate(R.applied_order([as_dict(r) for r in rows if r[0] == doc], ordering))}

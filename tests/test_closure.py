"""Closures, layers and cycles; spliced timelines against a day-by-day model; drift of checkpoints."""

import random

import pytest

from palimpsest.operators import closure as C
from palimpsest.operators import replay as R
from palimpsest.operators import temporal as T


def test_amendment_edges(spark):
    rows = [("b", "a", "amends", "2020-01-01", "2020-02-01"), ("b", "a", "amends", "2020-01-01", "2020-02-01"), ("c", "a", "corrects", "2021-01-01", None), ("d", "a", "amends", None, " "), ("a", "a", "amends", None, None), ("e", None, "amends", None, None), ("f", "a", "cites", None, None)]
    edges, rejected = C.amendment_edges(spark.createDataFrame(rows, "amending string, base string, relation string, in_force string, applies string"))
    assert {tuple(r) for r in edges.collect()} == {("b", "a", "amends", "2020-02-01"), ("c", "a", "corrects", "2021-01-01"), ("d", "a", "amends", "")}
    assert sorted(r["reason"] for r in rejected.collect()) == ["missing_id", "self_loop", "unknown_relation"]


EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b"), ("x", "y"), ("d", "z"), (None, "b"), ("a", "b")]


def test_acquisition_closure(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    nodes = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    got = {r["node"]: (r["layer"], r["state"]) for r in C.acquisition_closure(edges, nodes("a"), nodes("a", "b", "d", "e", "y")).collect()}
    assert got == {"a": (0, "expanded"), "b": (1, "expanded"), "c": (1, "frontier"), "d": (2, "expanded"), "e": (3, "expanded"), "z": (3, "frontier")}
    short = {r["node"]: (r["layer"], r["state"]) for r in C.acquisition_closure(edges, nodes("a"), nodes("a", "b", "d"), depth=1).collect()}
    assert short == {"a": (0, "expanded"), "b": (1, "unexpanded"), "c": (1, "frontier")}
    assert C.acquisition_closure(edges, nodes("q"), nodes("a")).collect() == [("q", 0, "frontier")]


def test_layers_and_cycles(spark):
    edges = spark.createDataFrame([*EDGES, ("z", "w")], "src string, dst string")
    got = {r["node"]: (r["layer"], r["state"]) for r in C.dependency_layers(edges).collect()}
    assert got == {"a": (0, "layered"), "c": (1, "layered"), "x": (0, "layered"), "y": (1, "layered"), "b": (None, "cycle"), "d": (None, "cycle"), "e": (None, "cycle"), "z": (None, "behind_cycle"), "w": (None, "behind_cycle")}
    long = C.dependency_layers(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string"))
    assert {(r["node"], r["layer"]) for r in long.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r["state"] for r in C.dependency_layers(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")).collect()} == {"cycle"}
    assert C.dependency_layers(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_edges_are_dealt_once_and_never_broadcast(spark, monkeypatch):
    """Frontiers beyond the bound meet bucketed edges: the plan of a hop deals the frontier only. Small ones are broadcast, edges are not."""
    from palimpsest.operators import graph as G

    edges = spark.range(40).selectExpr("cast(id as int) as node", "2 * id + 1 as next").repartition(3)
    dealt = G.DealtEdges(edges, "node", 40)
    few = spark.range(5).selectExpr("cast(id as int) as node").repartition(2)
    plan = lambda n: dealt.of(few, n)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(5) and "BuildRight" in plan(5)
    assert "SortMergeJoin" in plan(G.FRONTIER_ROWS + 1) and "Broadcast" not in plan(G.FRONTIER_ROWS + 1)
    assert sorted(map(tuple, dealt.of(few, 10**9).collect())) == sorted(map(tuple, dealt.of(few, 5).collect())) == [(k, 2 * k + 1) for k in range(5)]
    dealt.drop()
    monkeypatch.setattr(G, "FRONTIER_ROWS", 0)
    chain = spark.createDataFrame([(1, 2), (2, None), (2, 1)], "src int, dst long")
    assert sorted((r[0] for r in G.reachable(chain, spark.createDataFrame([(2,)], "node int")).collect()), key=str) == [1, 2, None]


DAYS = [f"{y}-{m:02d}-01" for y in range(1990, 2040) for m in (1, 4, 9)]


def painted(writes):
    """Day by day: what the last write that holds it says."""
    out = {}
    for addr in {w[0] for w in writes}:
        own = [w for w in sorted(writes, key=lambda w: w[1]) if w[0] == addr and w[2] and not (w[3] and w[3] <= w[2])]
        line = []
        for day in DAYS:
            held = [w for w in own if w[2] <= day and (not w[3] or day < w[3])]
            line.append((held[-1][4],) if held else None)
        out[addr] = line
    return out


@pytest.mark.parametrize("block_years", [3, 25, 1000])
def test_spliced_timeline_against_days(spark, block_years):
    r = random.Random(4)
    writes = []
    for addr in "abcdefgh":
        for seq in range(r.randint(1, 14)):
            start, stop = r.choice(DAYS), r.choice([*DAYS, "", None])
            writes.append((addr, seq, start, stop, r.choice(["x", "y", None, f"{addr}{seq}"])))
    writes += [("z", 1, "2000-01-01", "2000-01-01", "none"), ("z", 2, None, None, "none"), ("y", 1, "2001-01-01", "2003-01-01", "p"), ("y", 2, "2010-01-01", "", "q")]
    windows, receipts = T.spliced_timeline(spark.createDataFrame(writes, "addr string, seq long, effective string, expires string, content string"), block_years)
    rows = sorted(map(tuple, windows.collect()), key=lambda w: (w[0], w[1]))
    for addr, line in painted(writes).items():
        own = [w for w in rows if w[0] == addr]
        for before, after in zip(own, own[1:]):
            assert before[2] == after[1]  # neither overlap nor gap
            assert before[4] or after[4] or before[3] != after[3]  # neighbours differ
        for day, held in zip(DAYS, line):
            at = [w for w in own if w[1] <= day and (not w[2] or day < w[2])]
            assert (at[0][3],) == held if held else not at or at[0][4], (addr, day)
    fates = {(x["addr"], x["seq"]): (x["fate"], x["pieces"]) for x in receipts.collect()}
    assert len(fates) == len(writes) and fates["z", 1] == ("empty_interval", 0) == fates["z", 2] and fates["y", 1] == ("whole", 1)
    assert ("y", "2003-01-01", "2010-01-01", None, True) in rows
    assert {f for f, _ in fates.values()} == {"whole", "trimmed", "cut", "buried", "empty_interval"}


def test_splicing_sweeps_blocks_one_after_the_other(spark, monkeypatch):
    """No call for each block of an address, and one exchange of the pieces for the windows, that reads them once."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", None)
    writes = spark.createDataFrame([("a", k, f"{1990 + k}-05-01", "", "x" if k % 3 else "y") for k in range(9)] + [(None, 1, "2000-01-01", "2020-01-01", "n")], "addr string, seq long, effective string, expires string, content string")
    windows, receipts = T.spliced_timeline(writes, 2)
    rows = {(r["addr"], r["effective"], r["expires"], r["content"]) for r in windows.collect()}
    assert rows == {(None, "2000-01-01", "2020-01-01", "n"), *(("a", f"{1990 + k}-05-01", f"{1991 + k if k % 3 == 0 else 1992 + k}-05-01" if k < 7 else "", "x" if k % 3 else "y") for k in (0, 1, 3, 4, 6, 7))}
    assert {(r["addr"], r["seq"]): (r["fate"], r["pieces"]) for r in receipts.collect()} == {(None, 1): ("whole", 1), ("a", 8): ("whole", 1), **{("a", k): ("trimmed", 1) for k in range(8)}}
    assert windows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


OPS = "doc_id long, seq long, action string, target string, payload string, find string, occurrence long, destination string, anchor string, group_id string, effective string, act string"


def test_version_drift(spark):
    nodes = [(d, f"s:{k}", float(k), "s", f"old {k}", "live") for d in (1, 2, 3, 4) for k in (1, 2)]
    op = lambda d, seq, act, target, payload, action="REPLACE", to=None: (d, seq, action, target, payload, None, 0, to, None, None, None, act)
    ops = [op(1, 1, "A", "s:1", "new 1"), op(1, 2, "B", "s:2", "new 2"), op(1, 3, "B", "s:3", "added", "INSERT"), op(1, 4, "C", "s:1", "newer"), op(1, 5, "D", "s:3", None, "REPEAL"), op(2, 1, "A", "s:1", "new"), op(2, 2, "B", "s:2", "new"), op(3, 1, "A", "s:1", "x"), op(4, 1, "A", "s:1", None, "RENUMBER", "s:9"), op(4, 2, "B", "s:2", "nobody says this")]
    oracle = [(1, "s:1", "NEW, 1."), (1, "s:2", "new 2"), (1, "s:3", "added"), (2, "s:1", "new"), (2, "s:2", "New!"), (3, "s:1", "y"), (4, "s:9", "old 1"), (4, "s:2", "else")]
    scores = R.checkpoint_scores(spark.createDataFrame(nodes, R.NODES), spark.createDataFrame(ops, OPS), spark.createDataFrame(oracle, "doc_id long, addr string, text string"))
    steps = {(r["doc_id"], r["step"]): (r["act"], round(r["score"], 4)) for r in scores.collect()}
    assert steps == {(1, 0): ("A", 0.4), (1, 1): ("B", 1.0), (1, 2): ("C", 0.6667), (1, 3): ("D", 0.4), (2, 0): ("A", 0.5), (2, 1): ("B", 1.0), (3, 0): ("A", 0.0), (4, 0): ("A", 0.5), (4, 1): ("B", 0.5)}
    got = {r["doc_id"]: (r["status"], r["best_step"], r["matched_at"], r["behind_by"], r["unapplied"]) for r in R.version_drift(scores).collect()}
    assert got == {1: ("drift", 1, "B", 2, ["C", "D"]), 2: ("current", 1, None, None, None), 3: ("too_few_steps", 0, None, None, None), 4: ("unmatched", 0, None, None, None)}

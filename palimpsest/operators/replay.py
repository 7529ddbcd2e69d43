"""Ordered replay: typed edits folded over the flat tree of each document.

Documents are node tables (doc_id, addr, ord, kind, text, status); ops are rows (doc_id, seq, action, target, payload,
find, occurrence, destination, anchor, group_id). A fold depends on order, so it takes a document with its ops at a time,
out of rows dealt and sorted by document; documents are independent and bounded by their own size. Everything before and
after the fold is relational.

Ops may have two more columns: ``effective`` (ISO day) and ``act``. They apply in the order of effective day and
sequence; sequence alone is the order of equal days, and ops without a day come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.graph import cut_lineage
from palimpsest.session import ship

# Actions, and the legal (state before, action) pairs with the state after.
ACTIONS = ("REPLACE", "REPEAL", "INSERT", "RENUMBER", "MOVE", "HEADING_REPLACE", "META", "TEXT_PATCH")
OCCUPANCY = (
    ("substantive", "REPLACE", "substantive"),
    ("absent", "INSERT", "substantive"),
    ("tombstone", "INSERT", "substantive"),
    ("scaffold", "INSERT", "substantive"),
    ("substantive", "REPEAL", "tombstone"),
    ("tombstone", "REPEAL", "tombstone"),
)

NODES = "doc_id long, addr string, ord double, kind string, text string, status string"
RECEIPTS = "doc_id long, seq long, action string, target string, landed string, outcome string"


def occupancy_violations(transitions: DataFrame) -> DataFrame:
    """Transitions (state, action, …) that are not legal."""
    legal = transitions.sparkSession.createDataFrame(list(OCCUPANCY), "state string, action string, after string")
    return transitions.join(F.broadcast(legal), ["state", "action"], "left_anti")  # six rows


def op_findings(ops: DataFrame) -> DataFrame:
    """(doc_id, seq, finding): ops that their own guards reject; they stay in the input and leave a receipt."""
    finding = (
        F.when(~F.col("action").isin(*ACTIONS), "unknown_action").when(F.col("action").isin("RENUMBER", "MOVE") & F.col("destination").isNull(), "destination_missing")
        .when(F.col("destination").isNotNull() & ~F.col("action").isin("RENUMBER", "MOVE"), "destination_not_allowed").when(F.col("anchor").isNotNull() & (F.col("action") != "INSERT"), "anchor_not_allowed")
        .when(F.col("action").isin("REPLACE", "INSERT") & F.col("payload").isNull(), "payload_missing").when((F.col("action") == "TEXT_PATCH") & F.col("find").isNull(), "selector_missing")
    )
    return ops.withColumn("finding", finding).filter("finding is not null").select("doc_id", "seq", "finding")


def patch_text(text: str, find: str, put: str, occurrence: int = 0) -> str | None:
    """``find`` replaced by ``put``: all places for -1, the last for -2, the n-th from 0 otherwise; None if there is none."""
    if not find or find not in text:
        return None
    if occurrence == -1:
        return text.replace(find, put)
    if occurrence == -2:
        head, _, tail = text.rpartition(find)
        return head + put + tail
    at = -1
    for _ in range(occurrence + 1):
        at = text.find(find, at + 1 if at < 0 else at + len(find))
        if at < 0:
            return None
    return text[:at] + put + text[at + len(find) :]


@dataclass(frozen=True)
class Ordering:
    """How ops are put in order. Day and sequence decide unless more is asked for. ``by_act``: acts of one day apply in the
    order of their ids. ``vacate``: within a group (the ops of one day, act if ``by_act``, and ``group_id``) repeals go first, then
    renumberings so that a place is left before it is taken, then the rest."""

    by_act: bool = False
    vacate: bool = False


def _left_first(renumberings: list[dict]) -> list[dict]:
    """The renumberings so that each comes after the first that leaves its destination; otherwise in their order, and a cycle
    is cut where it is entered. Ops are told apart by their place in the list, so that none is lost, whatever they share."""
    leaves: dict[str, int] = {}
    for at, op in enumerate(renumberings):
        leaves.setdefault(op["target"], at)
    done: set[int] = set()
    out: list[dict] = []
    for at in range(len(renumberings)):
        path: list[int] = []
        step: int | None = at
        while step is not None and step not in done:
            done.add(step)
            path.append(step)
            step = leaves.get(renumberings[step]["destination"])
        out += (renumberings[k] for k in reversed(path))
    return out


def applied_order(ops: Iterable[dict], ordering: Ordering = Ordering()) -> list[dict]:  # noqa: B008
    """The ops of a document in the order in which they apply: all of them, each once."""
    day = lambda o: o.get("effective") or ""
    act = lambda o: (o.get("act") or "") if ordering.by_act else ""
    ordered = sorted(ops, key=lambda o: (day(o), act(o), o["seq"]))
    if not ordering.vacate:
        return ordered
    groups: dict[tuple, list[dict]] = {}
    for o in ordered:  # groups stand where their first op does
        groups.setdefault((day(o), act(o), o.get("group_id")), []).append(o)
    out: list[dict] = []
    for rows in groups.values():
        out += [o for o in rows if o["action"] == "REPEAL"]
        out += _left_first([o for o in rows if o["action"] == "RENUMBER"])
        out += [o for o in rows if o["action"] not in ("REPEAL", "RENUMBER")]
    return out


POSITIONS = "doc_id long, seq long, position long"


def applied_positions(ops: DataFrame, ordering: Ordering = Ordering()) -> DataFrame:  # noqa: B008
    """(doc_id, seq, position): the place of each op in :func:`applied_order`. Without ``vacate`` that is a window; with it,
    documents are dealt by id and sorted as in a replay, and a task orders its own one after the other."""
    day = F.coalesce(F.col("effective"), F.lit("")) if "effective" in ops.columns else F.lit("")
    act = F.coalesce(F.col("act"), F.lit("")) if ordering.by_act and "act" in ops.columns else F.lit("")
    keyed = ops.select("doc_id", "seq", "action", "target", "destination", day.alias("day"), act.alias("act"), "group_id")
    if not ordering.vacate:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("day", "act", "seq")) - 1
        return keyed.select("doc_id", "seq", place.cast("long").alias("position"))
    held = keyed.select("doc_id", "seq", "action", "target", "destination", F.col("day").alias("effective"), "act", "group_id")
    names = held.columns

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        docs, seqs, positions = [], [], []
        for doc, group in groupby(rows, key=itemgetter(0)):
            order = applied_order([dict(zip(names, r, strict=True)) for r in group], ordering)
            docs += [doc] * len(order)
            seqs += [o["seq"] for o in order]
            positions += range(len(order))
            if len(docs) >= 10_000:
                yield packed(docs, seqs, positions)
                docs, seqs, positions = [], [], []
        if docs:
            yield packed(docs, seqs, positions)

    def packed(*columns: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "seq", "position"])

    ship(ops.sparkSession)
    return held.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(places, POSITIONS)


def order_conflicts(ops: DataFrame, precedence: DataFrame | None = None) -> DataFrame:
    """(doc_id, day, target, finding, ops, acts, resolution, blocking): what sequence alone decides, though the acts do not say so.

    same_moment_conflict: acts of one day do different things to one target. destination_contested: several renumberings of
    one day arrive at one address. target_renumbered_again: an address is renumbered more than once in a day. A conflict of acts is
    settled if ``precedence`` (doc_id, day, target) names it, and blocks otherwise; nothing is reordered or dropped."""
    day = F.coalesce(F.col("effective"), F.lit("")).alias("day")
    does = F.to_json(F.struct("action", "payload", "destination"))
    rows = ops.select("doc_id", "seq", day, F.coalesce("act", F.lit("")).alias("act"), "target", "destination", F.col("action").isin("RENUMBER", "MOVE").alias("moves"), does.alias("does"))

    def found(over: DataFrame, at: str, name: str, condition: Column) -> DataFrame:
        grouped = over.groupBy("doc_id", "day", F.col(at).alias("target")).agg(F.count(F.lit(1)).alias("ops"), F.count_distinct("act").alias("acts"), F.count_distinct("does").alias("deeds"))
        return grouped.filter(condition).select("doc_id", "day", "target", F.lit(name).alias("finding"), "ops", "acts")

    moving = rows.filter("moves and destination is not null")
    out = found(rows, "target", "same_moment_conflict", (F.col("acts") > 1) & (F.col("deeds") > 1)).unionByName(found(moving, "destination", "destination_contested", F.col("ops") > 1)).unionByName(found(moving, "target", "target_renumbered_again", F.col("ops") > 1))
    claimed = precedence.select("doc_id", "day", "target").distinct().withColumn("claimed", F.lit(True)) if precedence is not None else None
    joined = out.join(claimed, ["doc_id", "day", "target"], "left") if claimed is not None else out.withColumn("claimed", F.lit(None).cast("boolean"))
    settled = F.coalesce(F.col("claimed"), F.lit(False))
    across = F.col("finding") == "same_moment_conflict"
    resolution = F.when(across & settled, "precedence_claim").otherwise("sequence_order_unproven")
    return joined.select("doc_id", "day", "target", "finding", "ops", "acts", resolution.alias("resolution"), (across & ~settled).alias("blocking"))


def order_positions(ops: DataFrame, doc: str, effective: str, seq: str, act: str | None = None) -> DataFrame:
    """``ops`` with ``position`` from 0 within each document, by effective day, act if one is named, and sequence."""
    keys = [F.coalesce(F.col(effective), F.lit("")), *([F.coalesce(F.col(act), F.lit(""))] if act else []), F.col(seq)]
    return ops.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(*keys)) - 1)


class Tree:
    """The nodes of one document by address, and the children of each address."""

    def __init__(self, nodes: Iterable[dict]) -> None:
        self.nodes: dict[str, dict] = {}
        self.children: dict[str, set[str]] = {}
        for r in nodes:
            self.put(r["addr"], {k: r[k] for k in ("ord", "kind", "text", "status")})

    def put(self, addr: str, node: dict) -> None:
        self.nodes[addr] = node
        while "/" in addr:  # parents that are no nodes still lead to their children
            parent = addr.rpartition("/")[0]
            known = self.children.setdefault(parent, set())
            if addr in known:
                return
            known.add(addr)
            addr = parent
        self.children.setdefault("", set()).add(addr)

    def under(self, top: str) -> Iterator[str]:
        """The nodes at and below an address."""
        stack = [top]
        while stack:
            addr = stack.pop()
            stack += self.children.get(addr, ())
            if addr in self.nodes:
                yield addr

    def take(self, addr: str) -> dict:
        node = self.nodes.pop(addr)
        if not self.children.get(addr):
            self.children.get(addr.rpartition("/")[0], set()).discard(addr)
        return node

    def apply(self, op: dict) -> tuple[str | None, str]:
        """(landed address, outcome)."""
        action, target = op["action"], op["target"]
        node = self.nodes.get(target)
        live = node is not None and node["status"] == "live"
        if action in ("REPLACE", "HEADING_REPLACE"):
            if not live or op["payload"] is None:
                return None, "target_missing" if not live else "payload_missing"
            node["text"] = op["payload"]
        elif action == "INSERT":
            if live:
                return None, "slot_occupied"
            if op["payload"] is None:
                return None, "payload_missing"
            self.put(target, {"ord": self.place(op), "kind": (node or {}).get("kind") or target.rpartition("/")[2].partition(":")[0], "text": op["payload"], "status": "live"})
        elif action == "REPEAL":
            if node is None:
                return None, "target_missing"
            for addr in self.under(target):
                self.nodes[addr] |= {"status": "tombstone", "text": None}
        elif action == "TEXT_PATCH":
            patched = patch_text(node["text"] or "", op["find"] or "", op["payload"] or "", int(op["occurrence"] or 0)) if live else None
            if patched is None:
                return None, "text_not_found" if live else "target_missing"
            node["text"] = patched
        elif action in ("RENUMBER", "MOVE"):
            to = op["destination"]
            if not live or not to:
                return None, "target_missing" if to else "destination_missing"
            if to in self.nodes and self.nodes[to]["status"] == "live":
                return None, "slot_occupied"
            for addr, moved in [(addr, self.take(addr)) for addr in list(self.under(target))]:
                self.put(to + addr[len(target) :], moved)
            return to, "applied"
        else:
            return None, "unsupported"
        return target, "applied"

    def place(self, op: dict) -> float:
        """After the anchor if there is one, else after the last sibling."""
        parent = op["target"].rpartition("/")[0]
        siblings = sorted(self.nodes[a]["ord"] for a in self.children.get(parent, ()) if a in self.nodes)
        anchor = self.nodes.get(op.get("anchor") or "")
        if anchor is None:
            return (siblings[-1] if siblings else 0.0) + 1.0
        later = [o for o in siblings if o > anchor["ord"]]
        return (anchor["ord"] + later[0]) / 2 if later else anchor["ord"] + 1.0


def cofolded(nodes: DataFrame, ops: DataFrame, fold: Callable[[list[dict], list[dict]], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``fold`` gives for the nodes and the ops of each document. Documents are dealt by id and sorted, and a task goes through its own
    one after the other: it holds one document and one batch, and a document costs its rows and no call of its own."""
    sides = {"n": nodes, "o": ops}
    kinds = {c: df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType for c, df in sides.items()}
    tagged = [df.select("doc_id", *((F.struct(*df.columns) if c == side else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items())) for side, df in sides.items()]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [(n, types[t]) for n, t in (c.split() for c in schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, key=itemgetter(0)):
            found = list(group)
            out += fold([n for _, n, _ in found if n is not None], [o for _, _, o in found if o is not None])
            while len(out) >= 10_000:
                yield packed(out[:10_000])
                del out[:10_000]
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    ship(nodes.sparkSession)
    return tagged[0].unionByName(tagged[1]).repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema)


FOLDED = f"{NODES}, seq long, action string, target string, landed string, outcome string"


def folded(nodes: DataFrame, ops: DataFrame, ordering: Ordering = Ordering()) -> DataFrame:  # noqa: B008
    """Nodes after the ops (``seq`` null) and receipts (``addr`` null) of each document, out of one fold."""

    def fold(rows: list[dict], edits: list[dict]) -> list[tuple]:
        tree = Tree(rows)
        doc = (rows or edits)[0]["doc_id"]
        out = []
        for op in applied_order(edits, ordering):
            landed, outcome = tree.apply(op)
            out.append((doc, None, None, None, None, None, op["seq"], op["action"], op["target"], landed, outcome))
        return out + [(doc, a, x["ord"], x["kind"], x["text"], x["status"], None, None, None, None, None) for a, x in sorted(tree.nodes.items())]

    return cofolded(nodes, ops, fold, FOLDED)


def replay(nodes: DataFrame, ops: DataFrame, as_of: str | None = None, ordering: Ordering = Ordering(), both: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(nodes after, receipts): one receipt for each op, whatever became of it. With ``as_of`` only ops that are effective
    by that day apply; the others are receipted as not_yet_effective. Where ops have a column ``commenced``, those for which it is
    not true are receipted as not_commenced. With ``both`` the fold is checkpointed, for callers
    that read nodes and receipts."""
    waiting = []
    for name, held in (("not_yet_effective", as_of is not None and F.coalesce(F.col("effective") > as_of, F.lit(False))), ("not_commenced", "commenced" in ops.columns and ~F.coalesce(F.col("commenced"), F.lit(False)))):
        if held is not False:
            waiting.append(ops.filter(held).select("doc_id", "seq", "action", "target", F.lit(None).cast("string").alias("landed"), F.lit(name).alias("outcome")))
            ops = ops.filter(~held)
    rows = folded(nodes, ops, ordering)
    rows = cut_lineage(rows) if both else rows
    receipts = rows.filter("addr is null").select("doc_id", "seq", "action", "target", "landed", "outcome")
    for more in waiting:
        receipts = receipts.unionByName(more)
    return rows.filter("addr is not null").select("doc_id", "addr", "ord", "kind", "text", "status"), receipts


STEPS = "doc_id long, step long, effective string, act string, score double, matched long, live long"


def _plain(text: str | None) -> str:
    """Letters and digits in lower case: what is compared."""
    return "".join(c for c in (text or "").lower() if c.isalnum())


class Agreement:
    """How much of a tree says what another text says at the same address, kept up as ops change the tree."""

    def __init__(self, tree: Tree, other: dict[str, str]) -> None:
        self.tree, self.other = tree, other
        self.matched = self.live = 0
        self.count(tree.nodes, 1)

    def count(self, addresses: Iterable[str], sign: int) -> None:
        for addr in addresses:
            node = self.tree.nodes.get(addr)
            if node is not None and node["status"] == "live":
                self.live += sign
                self.matched += sign * (self.other.get(addr) == _plain(node["text"]))

    def apply(self, op: dict) -> None:
        touched = {*self.tree.under(op["target"]), *self.tree.under(op["destination"] or op["target"])}
        self.count(touched, -1)
        self.tree.apply(op)
        self.count(touched | {*self.tree.under(op["target"]), *self.tree.under(op["destination"] or op["target"])}, 1)

    @property
    def score(self) -> float:
        both = self.live + len(self.other)
        return 2 * self.matched / both if both else 1.0


def checkpoint_scores(nodes: DataFrame, ops: DataFrame, oracle: DataFrame, ordering: Ordering = Ordering()) -> DataFrame:  # noqa: B008
    """(doc_id, step, effective, act, score, matched, live): the state after each amending act against the oracle text (doc_id, addr, text).

    One fold a document, as in a replay; a step is a run of ops of one day and act. The score is the share of live nodes and oracle texts
    that agree at their address in letters and digits (2 x agreeing / both); it is kept up from op to op, so a document costs what its ops
    touch and not its length times its steps."""
    side = lambda df, name: df.select("doc_id", "addr", *(F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in (("ord", "double"), ("kind", "string"), ("text", "string"), ("status", "string"))), F.lit(name).alias("side"))
    optional = [F.col(c) if c in ops.columns else F.lit(None).cast("string").alias(c) for c in ("effective", "act")]
    # columns of their own: nodes and ops may come from one table
    edits = ops.select(*(F.col(c).alias(c) for c in ops.columns if c not in ("effective", "act")), *optional)

    def fold(rows: list[dict], made: list[dict]) -> list[tuple]:
        state = Agreement(Tree(r for r in rows if r["side"] == "node"), {r["addr"]: _plain(r["text"]) for r in rows if r["side"] == "oracle"})
        out: list[tuple] = []
        before = None
        for op in applied_order(made, ordering):
            moment = (op["effective"] or "", op["act"] or "")
            state.apply(op)
            row = (op["doc_id"], len(out), *moment, state.score, state.matched, state.live)
            if moment == before:
                out[-1] = (row[0], row[1] - 1, *row[2:])
            else:
                out.append(row)
            before = moment
        return out

    return cofolded(side(nodes, "node").unionByName(side(oracle, "oracle")), edits, fold, STEPS)


def version_drift(scores: DataFrame, perfect: float = 0.9999) -> DataFrame:
    """(doc_id, steps, final, best, best_step, status, matched_at, behind_by, unapplied) of :func:`checkpoint_scores`.

    current: the last state is perfect. drift: it is not, but an earlier one is, so the oracle is behind by the acts since (the first such state
    counts). unmatched: none is. too_few_steps: fewer than two acts."""
    end = F.col("step")
    agg = scores.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("steps"), F.max_by("score", end).alias("final"), F.max("score").alias("best"), F.max_by("step", F.struct("score", -end)).alias("best_step"), F.max_by("act", F.struct("score", -end)).alias("matched_at"),
        F.array_sort(F.collect_list(F.struct("step", "act"))).alias("acts"),
    )
    status = F.when(F.col("steps") < 2, "too_few_steps").when(F.col("final") >= perfect, "current").when(F.col("best") >= perfect, "drift").otherwise("unmatched")
    drift = F.col("status") == "drift"
    later = F.transform(F.filter("acts", lambda x: x["step"] > F.col("best_step")), lambda x: x["act"])
    return agg.withColumn("status", status).select("doc_id", "steps", "final", "best", "best_step", "status", F.when(drift, F.col("matched_at")).alias("matched_at"), F.when(drift, F.col("steps") - 1 - F.col("best_step")).alias("behind_by"), F.when(drift, later).alias("unapplied"))


def mutation_boundary(before: DataFrame, after: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc_id, addr): changed nodes under no declared prefix (column prefix)."""
    a = before.select("doc_id", "addr", F.col("text").alias("a"), F.col("status").alias("sa"))
    b = after.select("doc_id", "addr", F.col("text").alias("b"), F.col("status").alias("sb"))
    changed = a.join(b, ["doc_id", "addr"], "full").filter(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("sa").eqNullSafe(F.col("sb"))).select("doc_id", "addr")
    parts = F.split("addr", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    covered = changed.withColumn("prefix", F.explode(up)).join(declared.select("doc_id", "prefix").distinct(), ["doc_id", "prefix"], "left_semi").select("doc_id", "addr").distinct()
    return changed.join(covered, ["doc_id", "addr"], "left_anti")


def state_hash(nodes: DataFrame) -> DataFrame:
    """(doc_id, root): SHA-256 of the document's serialised nodes in address order; equal replays have equal roots."""
    row: Column = F.struct("addr", F.concat_ws("\x00", "kind", "status", F.coalesce("text", F.lit(""))).alias("v"))
    return nodes.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256).alias("root"))


def repeal_and_reenact(ops: DataFrame) -> DataFrame:
    """A REPEAL and another op on one target in one group become one REPLACE with the other's payload; the rest stays."""
    keys = ["doc_id", "group_id", "target"]
    other = F.col("action").isin("REPLACE", "INSERT")
    merged = ops.groupBy(*keys).agg(F.max(F.col("action") == "REPEAL").alias("r"), F.max(other).alias("o"), F.max_by("seq", F.when(other, F.col("seq"))).alias("keep"))
    joined = ops.join(merged, keys)
    both = F.col("r") & F.col("o")
    return joined.filter(~both | (F.col("seq") == F.col("keep"))).withColumn("action", F.when(both, "REPLACE").otherwise(F.col("action"))).drop("r", "o", "keep")


"""Suffix sorting of many short strings by a difference cover, as DataFrame code.

The cover is {1, 2} modulo 3. Suffixes at sampled places are named by sorting their triples of symbols; where names
repeat, the strings of names are sorted by recursion, each a third as long. The suffixes at the other places follow from
their first symbols and the rank of the sampled suffix behind them, and are merged in: each goes behind the last sampled
suffix that is not greater, which two sorts find, one against each residue of the cover.

All sorts are by range, so no task holds a symbol's suffixes alone; ranks are unique, and increase with the suffix. Equal
suffixes of several strings have neighbouring ranks in any order. Every sort reads a written table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, written

#: Strings of so many symbols are sorted whole.
WHOLE = 6
#: Suffixes to a task.
TASK_ROWS = 500_000


def _named(distinct: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """``distinct`` with ``name``: a number that increases with the keys, from 1 on."""
    ordered = distinct.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("name", F.monotonically_increasing_id() + 1), "names")


def _predecessors(rows: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """(sid, pos, p) of the rows without ``r0``: the largest ``r0`` of the rows before, in the order of the keys."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, top = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            r0 = b.column(2).fill_null(0).to_numpy()
            p = np.maximum(np.maximum.accumulate(r0), top)
            top = int(p[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array(np.full(len(p), task)), b.column(2)], names=["sid", "pos", "p", "task", "r0"])

    ordered = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("sid", "pos", "r0")
    scanned = written(ordered.mapInArrow(scan, "sid long, pos int, p long, task long, r0 long"), "predecessors")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    carried = scanned.groupBy("task").agg(F.max("p").alias("top")).select("task", F.coalesce(F.max("top").over(before), F.lit(0)).alias("carried"))
    return scanned.filter("r0 is null").join(F.broadcast(carried), "task").select("sid", "pos", F.greatest("p", "carried").alias("p"))


def suffix_ranks(strings: DataFrame, upto: int | None = None) -> DataFrame:
    """(sid, pos, rank), written, of the suffixes of ``strings`` (sid long, syms array<long>, symbols from 1 on) that begin
    at ``upto`` or before, or of all; an end sorts before any symbol. ``sid`` is unique, not negative and far under
    2 ** 62."""
    strings = strings.filter(F.size("syms") > 0)
    size = strings.agg(F.max(F.size("syms")).alias("longest"), F.sum(F.size("syms")).alias("n")).first()
    tasks = 2 + (size["n"] or 0) // TASK_ROWS
    zero = F.lit(0).cast("long")
    places = strings.select("sid", "syms", F.explode(F.sequence(F.lit(0), F.size("syms") - 1)).alias("pos"))
    at = lambda k: F.coalesce(F.get("syms", F.col("pos") + k), zero)
    wanted = F.lit(True) if upto is None else F.col("pos") <= upto
    if (size["longest"] or 0) <= WHOLE:
        keys = [f"k{i}" for i in range(WHOLE)]
        rows = places.filter(wanted).select("sid", "pos", *(at(i).alias(k) for i, k in enumerate(keys)))
        names = _named(rows.select(keys).distinct(), keys, tasks)
        ranks = written(rows.join(names, keys).select("sid", "pos", F.col("name").alias("rank")), "ranks")
        discard(names)
        return ranks
    sampled = places.filter("pos % 3 <> 0").select("sid", "pos", *(at(k).alias(c) for k, c in enumerate("xyz")))
    names = _named(sampled.select("x", "y", "z").distinct(), ["x", "y", "z"], tasks)
    named = sampled.join(names, ["x", "y", "z"]).select("sid", "pos", "name")
    if names.count() == sampled.count():  # no name repeats
        ranks = written(named.select("sid", "pos", F.col("name").alias("rank")), "ranks")
    else:
        gathered = named.groupBy("sid", (F.col("pos") % 3).alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("a"))
        shorter = written(gathered.select((2 * F.col("sid") + F.col("part") - 1).alias("sid"), F.col("a.name").alias("syms")), "strings-of-names")
        deeper = suffix_ranks(shorter)
        part = F.col("sid") % 2 + 1
        ranks = deeper.select(F.expr("sid div 2").alias("sid"), (3 * F.col("pos") + part).cast("int").alias("pos"), "rank")
        discard(shorter)
    discard(names)
    of_string = ranks.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    # the sampled places are 1, 2, 4, 5, ...: all but each third
    rank = lambda k: F.coalesce(F.get("ranks.rank", (F.col("pos") + k) - F.floor((F.col("pos") + k) / 3).cast("int") - 1), zero)
    both = places.filter(wanted).join(of_string, "sid", "left")
    keyed = written(both.select("sid", "pos", at(0).alias("x"), at(1).alias("y"), F.when(F.col("pos") % 3 != 0, rank(0)).alias("r0"), F.when(F.col("pos") % 3 != 2, rank(1)).alias("r1"), F.when(F.col("pos") % 3 != 1, rank(2)).alias("r2")), "suffixes")
    rest = F.col("pos") % 3 == 0
    one = _predecessors(keyed.filter("pos % 3 <> 2").withColumn("f", rest), ["x", "r1", "f"], tasks)
    two = _predecessors(keyed.filter("pos % 3 <> 1").withColumn("f", rest), ["x", "y", "r2", "f"], tasks)
    placed = one.unionByName(two).groupBy("sid", "pos").agg(F.max("p").alias("p"))
    merged = keyed.filter(rest).join(placed, ["sid", "pos"]).select("sid", "pos", "p", F.lit(1).alias("f"), "x", "r1").unionByName(keyed.filter(~rest).select("sid", "pos", F.col("r0").alias("p"), F.lit(0).alias("f"), zero.alias("x"), zero.alias("r1")))
    order = written(merged, "merged")
    keys = ["p", "f", "x", "r1"]
    out = written(order.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("sid", "pos", (F.monotonically_increasing_id() + 1).alias("rank")), "ranks")
    for df in (keyed, order):
        discard(df)
    return out

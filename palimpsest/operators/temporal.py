"""Bitemporal version algebra on version tables.

A version table has ``addr``, ``effective``, ``enacted``, ``expires`` (ISO strings; '' or null in
``expires`` is open), ``variant`` ('permanent' or 'temporary'), ``pos`` (its place in the timeline) and
``content``. Dates stay strings and compare as strings, so the base date 0000-00-00 is fine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import ship


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def eligible(as_of: str, mode: str = "governing", expires_as_of: str | None = None) -> Column:
    """Whether a version counts at a date: expiry is exclusive; mode 'in_force' also asks that it was enacted by then."""
    if mode not in ("governing", "in_force"):
        raise ValueError(f"unknown mode {mode!r}")
    expires, enacted = F.col("expires"), F.col("enacted")
    found = (F.col("effective") <= as_of) & (blank(expires) | (expires > (expires_as_of or as_of)))
    return found & (blank(enacted) | (enacted <= as_of)) if mode == "in_force" else found


def day_before(c: Column) -> Column:
    """The ISO day before an ISO date; null if it is no valid date."""
    return F.date_format(F.date_sub(F.try_to_date(c, "yyyy-MM-dd"), 1), "yyyy-MM-dd")


def select_point_in_time(versions: DataFrame, as_of: str, mode: str = "governing", expires_as_of: str | None = None) -> DataFrame:
    """The version of each address at ``as_of``: (addr, rail, effective, enacted, expires, pos, content).

    On each rail the latest by (effective, enacted, pos) stands. The temporary winner hides the permanent one unless
    that started later and not before the last day of the temporary's term. One aggregation by address, no window.
    """
    key = F.struct("effective", "enacted", "pos")
    row = F.struct("effective", "enacted", "expires", "pos", "content")
    rail = lambda name: F.max_by(row, F.when(F.col("variant") == name, key))
    winners = versions.filter(eligible(as_of, mode, expires_as_of)).groupBy("addr").agg(rail("temporary").alias("o"), rail("permanent").alias("b"))
    handed_off = (F.col("b.effective") > F.col("o.effective")) & ~blank(F.col("o.expires")) & (F.col("b.effective") >= day_before(F.col("o.expires")))
    overlay = F.col("o").isNotNull() & ~F.coalesce(handed_off, F.lit(False))
    chosen = F.when(overlay, F.col("o")).otherwise(F.col("b"))
    return winners.select("addr", F.when(overlay, "temporary").otherwise("permanent").alias("rail"), chosen.alias("c")).filter("c is not null").select("addr", "rail", "c.*")


def visible(selected: DataFrame) -> DataFrame:
    """Drops selected versions hidden by an ancestor (newer, or temporary over permanent) and tombstones (null content).

    Addresses are paths; each is joined to its proper prefixes, so the work is linear in their depth.
    """
    parts = F.split("addr", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    own = selected.withColumn("ancestor", F.explode_outer(F.when(F.size(parts) > 1, prefixes)))
    above = selected.select(F.col("addr").alias("ancestor"), F.col("effective").alias("a_effective"), F.col("rail").alias("a_rail"))
    hidden = own.join(above, "ancestor").filter((F.col("a_effective") > F.col("effective")) | ((F.col("a_rail") == "temporary") & (F.col("rail") == "permanent"))).select("addr").distinct()
    return selected.filter("content is not null").join(hidden, "addr", "left_anti")


def temporal_status(kind: Column, fixed: Column, resolved: Column, superseded: Column, day: str) -> Column:
    """'active', 'scheduled', 'pending' or 'inactive' of an activation rule at a date."""
    dated = lambda c: F.when(c <= day, "active").otherwise("scheduled")
    return F.when(superseded, "inactive").when(kind == "immediate", "active").when(kind == "fixed_date", dated(fixed)).when(resolved.isNull(), "pending").otherwise(dated(resolved))


def overall_status(status: Column) -> Column:
    """Over many rules: pending, then active, then scheduled; nothing at all is inactive."""
    has = lambda s: F.max(F.coalesce(status == s, F.lit(False)))
    return F.when(has("pending"), "pending").when(has("active"), "active").when(has("scheduled"), "scheduled").otherwise("inactive")


def op_overrides(ops: DataFrame, events: DataFrame) -> DataFrame:
    """Per op: effective (earliest commence or revive), expires (earliest expire or suspend), contingent, from the events on its group."""
    at = lambda *kinds: F.min(F.when(F.col("event_kind").isin(*kinds), F.col("event_day")))
    found = events.groupBy("group_id").agg(at("commence", "revive").alias("effective"), at("expire", "suspend").alias("expires"), F.coalesce(F.max("contingent"), F.lit(False)).alias("contingent"))
    return ops.join(found, "group_id", "left").fillna(False, ["contingent"])


def cap_versions(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Expiring events (addr, day): the address's live versions that began on or before the day end there, as temporary ones."""
    first = events.groupBy("addr").agg(F.min("day").alias("day"))
    joined = versions.join(first, "addr", "left")
    hit = F.col("day").isNotNull() & (F.col("effective") <= F.col("day")) & (blank(F.col("expires")) | (F.col("expires") > F.col("day")))
    return joined.withColumn("variant", F.when(hit, "temporary").otherwise(F.col("variant"))).withColumn("expires", F.when(hit, F.col("day")).otherwise(F.col("expires"))).drop("day")


def splice_windows(writes: DataFrame, occupants: DataFrame) -> DataFrame:
    """Writes (addr, effective, expires, proven, …) with a decision: 'spliced', or why it stays unresolved. Nothing is dropped."""
    starts = occupants.groupBy("addr").agg(F.collect_set("effective").alias("starts"))  # no more than the address has versions
    following = F.array_min(F.filter("starts", lambda x: x > F.col("effective")))
    joined = writes.join(starts, "addr", "left").withColumn("next_start", following).drop("starts")
    case = F.when(~F.coalesce(F.col("proven"), F.lit(False)), "unproven").when(blank(F.col("expires")) | (F.col("effective") >= F.col("expires")), "empty_interval").when(F.col("next_start") < F.col("expires"), "past_next_occupant")
    return joined.withColumn("decision", case.otherwise("spliced"))


PIECES = "addr string, effective string, expires string, seq long, content string"


def _swept(writes: list[tuple[str, str | None, int, str | None]]) -> Iterator[tuple[str, str | None, int, str | None]]:
    """Disjoint pieces (start, end, seq, content) of windows (start, end, seq, content): at every moment the window of the highest seq that holds
    it. Ends are exclusive, None is open. A heap of what has begun; what has ended is dropped when it comes to the top."""
    begun: list[tuple[int, str | None, str | None]] = []
    starts = sorted(writes, key=lambda w: (w[0], w[2]))
    points = sorted({p for w in writes for p in w[:2] if p is not None})
    at = 0
    for here, there in zip(points, [*points[1:], None], strict=True):
        while at < len(starts) and starts[at][0] <= here:
            heapq.heappush(begun, (-starts[at][2], starts[at][1], starts[at][3]))
            at += 1
        while begun and begun[0][1] is not None and begun[0][1] <= here:
            heapq.heappop(begun)
        if begun:
            yield here, there, -begun[0][0], begun[0][2]


def spliced_timeline(writes: DataFrame, block_years: int = 25) -> tuple[DataFrame, DataFrame]:
    """(windows, receipts) of writes (addr, seq, effective, expires, content) that came in the order of ``seq``.

    A later write cuts, trims or buries what it covers, and nothing else: windows (addr, effective, expires, content) of an address are disjoint, and
    together hold every day that some write holds. Neighbours of equal content are joined again; expires '' is open. Days between windows that no
    write holds are windows with ``gap`` true and null content, so that a timeline is gapless from its first day to its last. Receipts (addr, seq,
    fate, pieces): whole, trimmed (one shorter piece is left), cut (several), buried, or empty_interval (a write that ends where it begins or
    before, or has no start; it changes nothing).

    Addresses are cut into blocks of years, each swept on its own in time n log n, and joined again at the seams, so that a
    long history is not one task's. Blocks are dealt and sorted, and a task sweeps its own one after the other, so that a block costs its rows and no
    call of its own. Seq is unique within an address."""
    end = F.when(blank(F.col("expires")), F.lit(None)).otherwise(F.col("expires"))
    bad = blank(F.col("effective")) | (F.coalesce(end, F.lit("9999-99-99")) <= F.col("effective"))
    rows = writes.select("addr", F.col("seq").cast("long").alias("seq"), "effective", end.alias("expires"), "content", bad.alias("bad"))
    block = lambda day: F.floor(F.substring(day, 1, 4).cast("int") / block_years).cast("int")
    good = rows.filter("not bad")
    last = F.max(F.greatest("effective", F.coalesce("expires", "effective"))).over(Window.partitionBy("addr"))
    dealt = good.withColumn("until", block(F.coalesce("expires", last))).withColumn("block", F.explode(F.sequence(block(F.col("effective")), "until")))
    border = lambda b: F.concat(F.lpad((b * block_years).cast("string"), 4, "0"), F.lit("-00-00"))
    clipped = dealt.select(
        "addr", "block", F.greatest("effective", border(F.col("block"))).alias("start"), F.when(F.col("block") < F.col("until"), border(F.col("block") + 1)).otherwise(F.col("expires")).alias("stop"), "seq", "content",
    ).filter("stop is null or stop > start")

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for (addr, _), group in groupby(rows, key=itemgetter(0, 1)):
            fresh = True
            for start, stop, seq, content in _swept([r[2:] for r in group]):
                if not fresh and out[-1][2] == start and out[-1][3] == seq:
                    out[-1] = (addr, out[-1][1], stop, seq, content)
                else:
                    out.append((addr, start, stop, seq, content))
                fresh = False
            if len(out) >= 10_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    ship(writes.sparkSession)
    pieces = clipped.repartition("addr", "block").sortWithinPartitions("addr", "block").mapInArrow(sweep, PIECES)

    # a window begins where the piece before ends earlier or says something else, and ends where the last piece before the next one does
    order = Window.partitionBy("addr").orderBy("effective")
    before = F.lag("expires").over(order)
    begins = F.coalesce(before != F.col("effective"), F.lit(True)) | ~F.lag("content").over(order).eqNullSafe(F.col("content"))
    edges = pieces.select("addr", "effective", "expires", "content", before.alias("before"), begins.alias("begins"), F.lead("effective").over(order).isNull().alias("ends")).filter("begins or ends")
    stop = F.when(F.col("ends"), F.col("expires")).when(F.lead("begins").over(order), F.lead("before").over(order)).otherwise(F.lead("expires").over(order))
    windows = edges.withColumn("stop", stop).filter("begins")
    window = F.struct("effective", F.coalesce("stop", F.lit("")).alias("expires"), "content", F.lit(False).alias("gap"))
    gap = F.struct(F.col("before").alias("effective"), F.col("effective").alias("expires"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("gap"))
    out = windows.select("addr", F.explode(F.when(F.col("before") < F.col("effective"), F.array(gap, window)).otherwise(F.array(window))).alias("w")).select("addr", "w.*")

    # a write and its pieces meet by its number; pieces that touch are one
    of_write = Window.partitionBy("addr", "seq").orderBy("effective")
    none = F.lit(None).cast("string")
    both = good.select("addr", "seq", none.alias("effective"), none.alias("expires"), F.col("effective").alias("began"), F.col("expires").alias("ended")).unionByName(pieces.select("addr", "seq", "effective", "expires", none.alias("began"), none.alias("ended")))
    apart = both.withColumn("apart", F.col("effective").isNotNull() & F.coalesce(F.lag("expires").over(of_write) != F.col("effective"), F.lit(True)))
    of = lambda c: F.max_by(c, F.col("effective")).alias(f"__{c}")
    left = apart.groupBy("addr", "seq").agg(F.count_if("apart").alias("pieces"), F.min("effective").alias("__effective"), of("expires"), F.max("began").alias("began"), F.max("ended").alias("ended"))
    as_was = (F.col("__effective") == F.col("began")) & F.col("__expires").eqNullSafe(F.col("ended"))
    fate = F.when(F.col("pieces") == 0, "buried").when(F.col("pieces") > 1, "cut").when(as_was, "whole").otherwise("trimmed")
    unused = rows.filter("bad").select("addr", "seq", F.lit("empty_interval").alias("fate"), F.lit(0).cast("long").alias("pieces"))
    return out, left.select("addr", "seq", fate.alias("fate"), "pieces").unionByName(unused)


def governing_bound(bounds: DataFrame, key: str, as_of: str) -> DataFrame:
    """The latest eligible bound per key by (effective, seq): (key, expires_on, ambiguous, expired). ``valid_until`` is an inclusive last day."""
    use = bounds.filter(F.col("effective") <= as_of)
    expires = F.date_format(F.date_add(F.try_to_date("valid_until", "yyyy-MM-dd"), 1), "yyyy-MM-dd")
    top = use.withColumn("expires_on", expires).groupBy(key).agg(F.max("effective").alias("e"), F.max_by("expires_on", F.struct("effective", "seq")).alias("expires_on"))
    ends = use.withColumn("x", expires).groupBy(key, F.col("effective").alias("e")).agg(F.count_distinct("x").alias("ends"))
    return top.join(ends, [key, "e"]).select(key, "expires_on", (F.col("ends") > 1).alias("ambiguous"), F.coalesce(F.lit(as_of) >= F.col("expires_on"), F.lit(False)).alias("expired"))


def extension_gaps(bounds: DataFrame, key: str) -> DataFrame:
    """(key, effective, ended): bounds (key, effective, seq, valid_until) that came only after the term before them had run out. ``valid_until`` is an inclusive last
    day, so the term ends the day after; a bound without one leaves the term open."""
    order = Window.partitionBy(key).orderBy("effective", "seq")
    ends = F.date_format(F.date_add(F.try_to_date("valid_until", "yyyy-MM-dd"), 1), "yyyy-MM-dd")
    before = bounds.withColumn("ended", F.lag(ends).over(order))
    return before.filter(F.col("effective") > F.col("ended")).select(key, "effective", "ended")


def year_of(act: Column) -> Column:
    """The year of an act id such as 2014/527; null if it has none."""
    return F.split_part(act, F.lit("/"), F.lit(1)).try_cast("int")


def ops_between(ops: DataFrame, act: str, first: int, last: int) -> DataFrame:
    """Ops of acts of the years from ``first`` to ``last``; ids without a year are left out."""
    return ops.filter(year_of(F.col(act)).between(first, last))

"""Ordered operators: last writer, change detection, ranks and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writer(ops: DataFrame, target: str, order: Sequence[str], row: Sequence[str], skipped: Column | None = None) -> DataFrame:
    """The op that wrote each target last: the largest ``order``; an aggregation, not a window."""
    used = ops if skipped is None else ops.filter(~F.coalesce(skipped, F.lit(False)))
    return used.groupBy(target).agg(F.max_by(F.struct(*row), F.struct(*order)).alias("w")).select(target, "w.*")


def blame_order(sequence: str = "sequence", act: str = "act", content: str = "is_content") -> list[Column]:
    """Later acts win; within an act a content op beats a re-key op, then the larger sequence."""
    return [F.col(act), F.col(content), F.col(sequence)]


def change_versions(snapshots: DataFrame, addr: str, day: str, content: str, days: DataFrame) -> DataFrame:
    """(addr, day, content): a version wherever the content differs from the snapshot before; null on the day that it is gone.

    Work is linear in the snapshots: instead of a grid of addresses and days, each row looks at its neighbours and at the
    days before and after its own.
    """
    order = Window.orderBy(day)  # over distinct days, which are few
    around = days.select(day).distinct().withColumn("day_before", F.lag(day).over(order)).withColumn("day_after", F.lead(day).over(order))
    w = Window.partitionBy(addr).orderBy(day)
    seen = snapshots.select(addr, day, content).join(around, day).withColumns({"last_day": F.lag(day).over(w), "last_content": F.lag(content).over(w), "next_day": F.lead(day).over(w)})
    previous = F.when(F.col("last_day") == F.col("day_before"), F.col("last_content"))
    changed = seen.filter(~F.col(content).eqNullSafe(previous)).select(addr, day, content)
    gone = seen.filter(F.col(content).isNotNull() & F.col("day_after").isNotNull() & ~F.col("next_day").eqNullSafe(F.col("day_after")))
    return changed.unionByName(gone.select(addr, F.col("day_after").alias(day), F.lit(None).cast(snapshots.schema[content].dataType).alias(content)))


def score_drops(scores: DataFrame, unit: str, step: str, score: str, least: float = 0.0) -> DataFrame:
    """Steps at which a score fell, with the fall."""
    w = Window.partitionBy(unit).orderBy(step)
    return scores.withColumn("drop", F.lag(score).over(w) - F.col(score)).filter(F.col("drop") > least)


def ordinal_gaps(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """(group, after, missing): holes in an ascending run of numbers."""
    w = Window.partitionBy(group).orderBy(ordinal)
    nxt = F.lead(ordinal).over(w)
    return rows.select(group, ordinal).distinct().withColumn("nxt", nxt).filter("nxt > {0} + 1".format(ordinal)).select(group, F.col(ordinal).alias("after"), (F.col("nxt") - F.col(ordinal) - 1).alias("missing"))


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in an order that leaves no ties to chance."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")


def stride_sample(rows: DataFrame, key: str, every: int, limit: int | None = None) -> DataFrame:
    """Every ``every``-th row by key. Ranks come from per-range counts, so no task sees all rows."""
    parts = rows.select("*").repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("pid", F.spark_partition_id())
    counts = parts.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("pid", "base")
    ranked = parts.withColumn("local", F.row_number().over(Window.partitionBy("pid").orderBy(key)) - 1).join(F.broadcast(base), "pid")
    found = ranked.filter(F.pmod(F.col("base") + F.col("local"), F.lit(every)) == 0).drop("pid", "base", "local")
    return found if limit is None else found.orderBy(key).limit(limit)


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(c: Column) -> Column:
    """The number of a canonical Roman numeral in either case; null if it is none."""
    ok = F.upper(c).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (c != "")
    digits = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    value = F.transform(digits, lambda x: F.element_at(F.create_map(*(y for k, v in ROMAN.items() for y in (F.lit(k), F.lit(v)))), x))
    signed = F.transform(value, lambda v, i: F.when(v < F.coalesce(F.get(value, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(ok, F.aggregate(signed, F.lit(0), lambda a, x: a + x))


def label_sort_key(c: str | Column) -> Column:
    """An array to order labels by: 2 < 2a < 10 < text; a lone Roman numeral is a number; no label comes last."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))

    def part(x: Column) -> Column:
        number, letter = F.regexp_extract(x, r"^(\d+)([A-Za-z]?)$", 1), F.lower(F.regexp_extract(x, r"^(\d+)([A-Za-z]?)$", 2))
        roman = roman_value(x)
        key = lambda kind, n, s: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), s.alias("s"))
        return F.when(number != "", key(0, F.try_to_number(number, F.lit("999999999")).cast("long"), letter)).when(roman.isNotNull(), key(0, roman, F.lit(""))).otherwise(key(1, F.lit(0), x))

    return F.transform(F.split(text, "_"), part)

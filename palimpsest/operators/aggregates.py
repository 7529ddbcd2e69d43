"""Aggregations: rollups, distributions, guards and accounting laws. Aggregates are partial before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_distinct(c: str | Column, separator: str = ", ") -> Column:
    """string_agg(DISTINCT x ORDER BY x)."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def harmonisation(rows: DataFrame, text: str, work: str) -> DataFrame:
    """(content, n_rows, n_works) for each text that two works or more share."""
    return rows.groupBy(F.md5(F.col(text)).alias("content")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(work).alias("n_works")).filter("n_works >= 2")


def leaf_dedup(rows: DataFrame, text: str) -> DataFrame:
    """One row: (rows, distinct_leaves, shared_leaves, bytes_total, bytes_saved)."""
    leaves = rows.groupBy(F.md5(F.col(text)).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length(F.col(text))).alias("size"))
    return leaves.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("distinct_leaves"), F.count(F.when(F.col("n") > 1, 1)).alias("shared_leaves"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).cast("long").alias("bytes_total"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).cast("long").alias("bytes_saved"),
    )


def rollup_counts(parts: dict[str, tuple[DataFrame, Column]], bucket: str, base: str) -> DataFrame:
    """Counts of several tables per bucket, full-joined, with the density of each over ``base`` (three places)."""
    out = None
    for name, (df, by) in parts.items():
        counted = df.groupBy(by.alias(bucket)).agg(F.count(F.lit(1)).alias(name))
        out = counted if out is None else out.join(counted, bucket, "full")
    out = out.fillna(0, list(parts))
    return out.withColumns({f"{n}_density": F.round(F.col(n) / F.greatest(F.col(base), F.lit(1)), 3) for n in parts if n != base})


def distribution(scores: DataFrame, score: str, scored: Column) -> DataFrame:
    """One row: mean, count, and how many scores are perfect, at least .99 and .95, under .90, or no scores at all."""
    s = F.when(scored, F.col(score))
    at = lambda c: F.count(F.when(c, 1))
    return scores.agg(F.avg(s).alias("mean"), F.count(s).alias("n"), at(s >= 0.9999).alias("perfect"), at(s >= 0.99).alias("ge_99"), at(s >= 0.95).alias("ge_95"), at(s < 0.90).alias("lt_90"), at(~F.coalesce(scored, F.lit(False))).alias("errors"))


def residue_totals(rows: DataFrame, residue: str, scored: Column) -> DataFrame:
    """(bucket, total) over MAP values of scored rows."""
    return rows.filter(scored).select(F.explode(residue).alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("total"))


def regressions(before: DataFrame, after: DataFrame, unit: str, score: str, tolerance: float = 0.001) -> DataFrame:
    """Units of both runs that got worse by more than the tolerance, worst first."""
    joined = before.select(unit, F.col(score).alias("before")).join(after.select(unit, F.col(score).alias("after")), unit)
    return joined.withColumn("delta", F.col("after") - F.col("before")).filter(F.col("delta") < -tolerance).orderBy("delta", unit)


def headline_error(*axes: str) -> Column:
    """The largest error of the axes that were attempted; null if none was."""
    return F.greatest(*axes) if len(axes) > 1 else F.col(axes[0])


def partition_violations(rows: DataFrame, bucket: str, declared: Sequence[str], must_be_zero: Sequence[str] = ()) -> DataFrame:
    """(bucket, n, problem): declared buckets without rows, rows in undeclared buckets, rows where none may be."""
    spark = rows.sparkSession
    counted = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    listed = spark.createDataFrame([(b, b in must_be_zero) for b in declared], "bucket string, zero boolean")
    joined = counted.join(listed, "bucket", "full")
    problem = F.when(F.col("zero").isNull(), "undeclared").when(F.col("zero") & (F.coalesce("n", F.lit(0)) > 0), "must_be_zero").when(~F.col("zero") & F.col("n").isNull(), "missing")
    return joined.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem")).filter("problem is not null")


def bijection_violations(effects: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """(key, n_effects, n_receipts) wherever an effect has not exactly one receipt, or a receipt no effect."""
    e = effects.groupBy(key).agg(F.count(F.lit(1)).alias("n_effects"))
    r = receipts.groupBy(key).agg(F.count(F.lit(1)).alias("n_receipts"))
    return e.join(r, key, "full").fillna(0, ["n_effects", "n_receipts"]).filter("n_effects <> n_receipts or n_effects <> 1")


def coverage(units: DataFrame, claims: DataFrame, unit: str = "unit_id", label: str = "kind_label") -> DataFrame:
    """Units with their state: covered by id or by label, classified otherwise, or UNIT_UNCLASSIFIED; nothing is lost."""
    by_id = claims.select(F.col("claim").alias(unit)).distinct().withColumn("by_id", F.lit(True))
    by_label = claims.select(F.col("claim").alias(label)).distinct().withColumn("by_label", F.lit(True))
    joined = units.join(by_id, unit, "left").join(by_label, label, "left")
    state = F.when(F.col("by_id") | F.col("by_label"), "covered").when(F.coalesce(F.col("by_id"), F.col("by_label")).isNotNull(), "covered")
    return joined.withColumn("state", state.otherwise(F.coalesce("class", F.lit("UNIT_UNCLASSIFIED")))).drop("by_id", "by_label")


def holdout(scores: DataFrame, as_of: str, score: str, cutoff: str) -> DataFrame:
    """One row: counts and means before and after the cutoff; rows without a date or with a negative score count nowhere."""
    use = scores.filter(F.col(as_of).isNotNull() & (F.col(score) >= 0))
    train = F.col(as_of) <= cutoff
    side = lambda c: F.when(c, F.col(score))
    return use.agg(F.count(side(train)).alias("n_train"), F.avg(side(train)).alias("mean_train"), F.count(side(~train)).alias("n_held"), F.avg(side(~train)).alias("mean_held"))


def ink_census(boxes: DataFrame, glyphs: DataFrame, page: str, least: float) -> DataFrame:
    """(page, content, claimed, ratio): a glyph is claimed if one box covers at least ``least`` of it; furniture counts
    nowhere; a page without content has the ratio 1."""
    g, b = glyphs.filter("not furniture").alias("g"), boxes.alias("b")
    overlap = lambda lo, hi: F.greatest(F.least(F.col(f"g.{hi}"), F.col(f"b.{hi}")) - F.greatest(F.col(f"g.{lo}"), F.col(f"b.{lo}")), F.lit(0.0))
    area = (F.col("g.x1") - F.col("g.x0")) * (F.col("g.y1") - F.col("g.y0"))
    share = F.when(area > 0, overlap("x0", "x1") * overlap("y0", "y1") / area).otherwise(0.0)
    best = g.join(b, F.col(f"g.{page}") == F.col(f"b.{page}"), "left").groupBy(F.col(f"g.{page}").alias(page), F.col("g.glyph_id").alias("glyph_id")).agg(F.max(F.coalesce(share, F.lit(0.0))).alias("share"))
    per = best.groupBy(page).agg(F.count(F.lit(1)).alias("content"), F.count(F.when(F.col("share") >= least, 1)).alias("claimed"))
    pages = glyphs.select(page).distinct()
    return pages.join(per, page, "left").fillna(0, ["content", "claimed"]).withColumn("ratio", F.when(F.col("content") == 0, 1.0).otherwise(F.col("claimed") / F.col("content")))


def chain_completeness(sections: DataFrame, blockers: DataFrame) -> DataFrame:
    """(section, status, blockers): complete iff nothing blocks it; statute-wide blockers hit every section of the statute."""
    own = blockers.filter("section is not null").select("statute", "section", "blocker")
    wide = blockers.filter("section is null").select("statute", "blocker").join(sections.select("statute", "section"), "statute").select("statute", "section", "blocker")
    found = own.unionByName(wide).groupBy("statute", "section").agg(F.array_sort(F.collect_set("blocker")).alias("blockers"))
    joined = sections.join(found, ["statute", "section"], "left")
    return joined.withColumn("status", F.when(F.col("blockers").isNull(), "complete").otherwise("blocked"))

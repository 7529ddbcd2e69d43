"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: its target share of the output over its share of the
input. A document's number of copies inverts the Poisson distribution function with that mean at a
uniform number hashed from the seed and the id, so the expected output of every source meets its
target, no document waits for another, and a rerun gives the same copies. The distribution
functions are tabulated once per source, on the small table of sources; rows look theirs up. Rates
over ``MAX_PART`` are split into equal parts with a draw of its own each (sums of Poisson variables
are Poisson), so the tables stay short.

The copies are shuffled globally: a hash of seed, id and copy gives each a random place, rows go to
the partition of that hash and are sorted by it there.

Null source is a source of its own. Null id hashes like the empty string. Rows that share an id share
their draw. An empty table gives an empty result. ``text`` is not read, so any text is fine.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import DOCUMENT, own_columns, total, written

MAX_PART = 16.0
#: Entries of a table: at a mean of 16 the probability beyond 80 is under 2 ** -60.
ENTRIES = 80
#: Sources up to which their table is broadcast; with more it is joined by shuffle, but for the largest.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of the MD5 of the parts."""
    text = F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, (str, int)) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate, parts, cdf) for each source. The target share is ``weights[source]`` over their sum if
    weights are given (0 for sources that have none), else proportional to ``n_docs ** alpha``; the output holds
    ``epochs`` times the input's rows."""
    counted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha)))
    else:
        cases = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))) if weights else None
        share = F.coalesce(cases[F.col("source")], F.lit(0.0)) if cases is not None else F.lit(0.0)
    counted = counted.withColumn("w", share)
    totals = counted.agg(F.sum("w").alias("sum_w"), F.sum("n_docs").alias("sum_n"))
    rate = F.when(F.col("sum_w") > 0, F.col("w") / F.col("sum_w") * F.col("sum_n") * float(epochs) / F.col("n_docs")).otherwise(0.0)
    rated = counted.join(F.broadcast(totals)).select("source", "n_docs", rate.alias("rate"))  # one row
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    factorials = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(ENTRIES)))
    terms = F.transform(factorials, lambda g, k: F.exp(F.when(k > 0, k * F.ln("mean")).otherwise(0.0) - F.col("mean") - g))
    cdf = F.transform(F.sequence(F.lit(1), F.lit(ENTRIES)), lambda n: total(F.slice("terms", F.lit(1), n), "double"))
    return rated.withColumn("terms", F.when(F.col("mean") > 0, terms).otherwise(F.array(F.lit(1.0)))).withColumn("cdf", F.when(F.col("mean") > 0, cdf).otherwise(F.array(F.lit(1.0)))).drop("terms", "mean")


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 17, alpha: float = 0.5, epochs: float = 1.0, columns: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """Each row of ``docs`` as often as drawn, with ``copies``, ``copy_no`` (from 0) and ``place``, its random place in [0, 1)."""
    own = own_columns(docs, *columns)
    rates = written(source_rates(own, weights, alpha, epochs).select(F.col("source").alias("r_source"), "parts", "cdf", F.col("n_docs").alias("r_n")), "rates")
    same = F.col("source").eqNullSafe(F.col("r_source"))
    stats = rates.agg(F.count(F.lit(1)).alias("n"), F.sum("r_n").alias("rows")).first()
    if stats["n"] <= BROADCAST_SOURCES:
        joined = own.join(F.broadcast(rates), same)
    else:  # no more than so many sources can hold as large a share each; none of the others is a hot key
        heavy = F.broadcast(rates.filter(F.col("r_n") * BROADCAST_SOURCES >= stats["rows"]))
        joined = own.join(heavy, same).unionByName(own.join(heavy, same, "left_anti").join(rates, same))
    drawn = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(seed, F.col("doc_id"), j)),
        F.lit(0),
        lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)),
    )
    copied = joined.withColumn("copies", drawn.cast("long")).filter("copies > 0").drop("r_source", "parts", "cdf", "r_n")
    exploded = copied.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return exploded.withColumn("place", uniform(seed, F.col("doc_id"), "place", F.col("copy_no")))


def shuffled(copies: DataFrame) -> DataFrame:
    """Rows dealt to random partitions and sorted by their random place: a global shuffle."""
    return copies.repartition(F.col("place"), F.col("copy_no")).sortWithinPartitions("place")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 17) -> DataFrame:
    """The mixed documents, shuffled, with the columns of the documents table."""
    return shuffled(replicate(docs, weights, seed)).select(*DOCUMENT)


def mixing_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row for each copy in the mixture, shuffled: (doc_id, source, copies, copy_no, place)."""
    return shuffled(replicate(docs, None, seed, columns=("doc_id", "source"))).select("doc_id", "source", "copies", "copy_no", "place")


def mixing_sql(seed: int = 17, alpha: float = 0.5) -> str:
    """The same rows by DuckDB over ``documents``."""
    u = lambda x: f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || {x}), 1, 13))::BIGINT / {float(2**52)!r}"
    return f"""
WITH n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
r AS (SELECT source, pow(n_docs::DOUBLE, {alpha}) / (SELECT sum(pow(n_docs::DOUBLE, {alpha})) FROM n) * (SELECT sum(n_docs) FROM n) / n_docs AS rate FROM n),
p AS (SELECT *, greatest(ceil(rate / {MAX_PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {MAX_PART}), 1) AS mean FROM r),
t AS (SELECT source, k, sum(exp(CASE WHEN k > 0 THEN k * ln(mean) ELSE 0.0 END - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p, range({ENTRIES}) AS g(k)),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM t GROUP BY source),
d AS (SELECT doc_id, documents.source, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda x: x <= {u("j::VARCHAR")}))))::BIGINT AS copies
  FROM documents JOIN p ON documents.source IS NOT DISTINCT FROM p.source JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, copies, copy_no, {u("'place:' || copy_no::VARCHAR")} AS place
FROM (SELECT *, unnest(range(copies)) AS copy_no FROM d WHERE copies > 0)"""

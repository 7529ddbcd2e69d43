"""Line dedup: lines that spread over many sites are boilerplate.

A line's spread is the number of distinct sites (``source``) that hold it. Lines of one site are set aside by the
smallest and largest site hash, which is exact. For the others a HyperLogLog sketch of the sites per line merges by
aggregation; lines whose estimate is within the sketch's error of the threshold get an exact distinct count. A line
at or over the threshold stays in the document of the smallest id that has it and goes from all others.

Lines are split at \\n and compared without white space at their ends; those under ``min_chars`` never count. They are
told apart by a 64-bit hash. Null source is a site of its own; null text has no lines and counts as empty; rows that
share an id are one document, and rows without id together one. A very long text is one row; its lines are rows of their
own while they are counted. All of it is DataFrame code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import DOCUMENT, discard, own_columns, written

#: Rows up to which a table of (hash, id) is broadcast: 16 bytes a row.
BROADCAST_ROWS = 1_000_000
#: Parts of a line that is dealt because the table of found lines is too large to be sent along.
SALTS = 16
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class SpreadRule:
    min_sites: int = 5
    #: Lines under so many characters without the white space at their ends never count; blank ones never do.
    min_chars: int = 1
    #: Sketches have 2 ** lg_k registers.
    lg_k: int = 10

    def near(self) -> tuple[float, float]:
        """Estimates that need an exact count: three standard errors around the threshold, and a site for rounding."""
        error = 3 * 1.04 / math.sqrt(2**self.lg_k)
        return self.min_sites * (1 - error) - 1, self.min_sites * (1 + error) + 1


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return own_columns(docs, *columns).withColumn("__key", F.xxhash64("doc_id", "text"))


def _lines(docs: DataFrame, rule: SpreadRule) -> DataFrame:
    """(h, site, doc_id, key), written: a row for each line that counts. ``key`` tells rows of different id or text apart."""
    site = F.when(F.col("source").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("source"))
    lines = docs.select("doc_id", "__key", site.alias("site"), F.explode(F.split("text", "\n")).alias("line")).withColumn("line", _key(F.col("line")))
    return written(lines.filter(F.char_length("line") >= rule.min_chars).select(F.xxhash64("line").alias("h"), "site", "doc_id", F.col("__key").alias("key")), "lines")


def _of_sites(lines: DataFrame, several: DataFrame) -> DataFrame:
    """(h, site, low) of the lines in ``several``: a row for each site, so that a line that all documents have is no hot
    key. A small table is sent along; beyond that, lines are aggregated before they meet it."""
    each = lambda x: x.groupBy("h", "site").agg(F.min("doc_id").alias("low"))
    if several.count() <= BROADCAST_ROWS:
        return each(lines.join(F.broadcast(several), "h", "left_semi"))
    return each(lines).join(several, "h", "left_semi")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _met(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with the boilerplate that they are. A found line may be in a large part of all documents, so where the table of them is too
    large to send along, its rows are dealt ``SALTS`` times and each line meets one of them."""
    if found.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(found), "h")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(found.withColumn("salt", salts), ["h", "salt"]).drop("salt")


def _boilerplate(lines: DataFrame, rule: SpreadRule) -> DataFrame:
    """(h, keeper) of the boilerplate among (h, site, doc_id), written; ``keeper`` is the id of the document that keeps the
    line."""
    spread = lines.groupBy("h").agg(F.min("site").alias("a"), F.max("site").alias("b"))
    several = written(spread.filter("a <> b").select("h"), "several-sites")
    shared = written(_of_sites(lines, several), "lines-by-site")
    sketched = shared.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", rule.lg_k)).alias("sites"), F.min("low").alias("keeper"))
    low, high = rule.near()
    estimated = written(sketched.filter(F.col("sites") >= low), "spread")
    doubtful = estimated.filter(F.col("sites") <= high)
    counted = shared.join(_small(doubtful.select("h")), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("exact"))
    sure = estimated.filter(F.col("sites") > high).select("h", "keeper")
    exact = doubtful.join(counted, "h").filter(F.col("exact") >= rule.min_sites).select("h", "keeper")
    out = written(sure.unionByName(exact), "boilerplate")
    for df in (several, shared, estimated):
        discard(df)
    return out


def boilerplate(docs: DataFrame, rule: SpreadRule = SpreadRule()) -> DataFrame:  # noqa: B008
    """(h, keeper) of the boilerplate lines of documents, written."""
    return _boilerplate(_lines(_keyed(docs, "doc_id", "source", "text"), rule), rule)


def without_boilerplate(docs: DataFrame, rule: SpreadRule = SpreadRule()) -> DataFrame:  # noqa: B008
    """The documents, with ``text`` less its boilerplate lines, ``n_lines`` and ``n_removed``. Texts are split and hashed
    once; they are shuffled only if more lines go than a task may be sent."""
    own = _keyed(docs, *DOCUMENT)
    all_lines = _lines(own, rule)
    found = _boilerplate(all_lines, rule)
    goes = _met(all_lines, found).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("key", "h").distinct()
    goes = written(goes, "lines-that-go")
    gone = goes.groupBy(F.col("key").alias("g_key")).agg(F.collect_set("h").alias("gone"))
    discard(all_lines)
    discard(found)
    joined = own.join(F.broadcast(gone) if goes.count() <= BROADCAST_ROWS else gone, F.col("__key") == F.col("g_key"), "left").drop("g_key", "__key")
    lines = F.split("text", "\n")
    stays = lambda x: ~((F.char_length(_key(x)) >= rule.min_chars) & F.array_contains("gone", F.xxhash64(_key(x))))
    kept = F.when(F.col("gone").isNotNull(), F.filter(lines, stays))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    counted = joined.withColumn("kept", kept).withColumn("n_lines", n_lines.cast("long"))
    counted = counted.withColumn("n_removed", F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join("kept", "\n"))
    return counted.withColumn("text", text).select(*DOCUMENT, "n_lines", "n_removed")


def keep_lines(docs: DataFrame, rule: SpreadRule = SpreadRule()) -> DataFrame:  # noqa: B008
    """Documents after line dedup, with the columns of the documents table and ``n_chars`` anew. Those of which
    nothing but white space is left go; those that lost no line stay as they are."""
    out = without_boilerplate(docs, rule)
    n = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return out.filter((F.col("n_removed") == 0) | (F.char_length(_key(F.col("text"))) > 0)).withColumn("n_chars", n).select(*DOCUMENT)


def line_report(docs: DataFrame, rule: SpreadRule = SpreadRule()) -> DataFrame:  # noqa: B008
    """One row per document: (doc_id, n_lines, n_removed, kept_sha256)."""
    return without_boilerplate(docs, rule).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_sql(rule: SpreadRule = SpreadRule()) -> str:  # noqa: B008
    """The same rows by DuckDB over ``documents``."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS site, text FROM documents),
l AS (SELECT rid, doc_id, site, u.i, u.line, trim(u.line, {space}) AS k FROM (SELECT *, string_split(text, chr(10)) AS a FROM d) , unnest(a) WITH ORDINALITY AS u(line, i)),
b AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= {rule.min_chars} GROUP BY k HAVING count(DISTINCT site) >= {rule.min_sites}),
m AS (SELECT l.*, b.k IS NOT NULL AND l.doc_id IS DISTINCT FROM b.keeper AS gone FROM l LEFT JOIN b ON l.k = b.k),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(CASE WHEN coalesce(n_removed, 0) = 0 THEN coalesce(text, '') ELSE kept END) AS kept_sha256
FROM d LEFT JOIN g USING (rid)"""

"""Tables of a folder: discovery, views, description, freshness, sinks. All paths go through Spark's file systems."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discover(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to path of the tables of a folder: Parquet first, JSONL only where no Parquet has the name."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    found = {n[: -len(".parquet")]: f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(".parquet")}
    for n in names:
        if n.endswith(".jsonl"):
            found.setdefault(n[: -len(".jsonl")], f"{folder.rstrip('/')}/{n}")
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table by the kind of its path."""
    return spark.read.json(path) if path.endswith(".jsonl") else spark.read.parquet(path)


def register(spark: SparkSession, folder: str) -> dict[str, str]:
    """A temporary view for each table of a folder."""
    found = discover(spark, folder)
    for name, path in found.items():
        read(spark, path).createOrReplaceTempView(name)
    return found


def describe(spark: SparkSession, folder: str) -> DataFrame:
    """(name, columns, n) of each table."""
    parts = None
    for name, path in discover(spark, folder).items():
        df = read(spark, path)
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(", ".join(f"{c} {k}" for c, k in df.dtypes)).alias("columns"), "n")
        parts = row if parts is None else parts.unionByName(row)
    return parts if parts is not None else spark.createDataFrame([], "name string, columns string, n long")


def sql(spark: SparkSession, text: str) -> DataFrame:
    """SQL over the views, unchanged. Recursion is bounded by its levels and not by its rows, which grow with the tables; the session keeps that, as the
    bound is read when the query runs."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(text)


def run_sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The user's SQL over the folder's views, unchanged."""
    register(spark, folder)
    return sql(spark, text)


def write(df: DataFrame, path: str, kind: str = "parquet", meta: Mapping[str, str] | None = None) -> None:
    """A sink: parquet (zstd), json, jsonl or csv. ``meta`` goes to a sidecar table, since Parquet rewrites lose key-value data."""
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "csv":
        writer.option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown output kind {kind!r}")
    if meta is not None:
        df.sparkSession.createDataFrame([(k, v) for k, v in meta.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}._meta")


def write_projection(rows: DataFrame, diagnostics: DataFrame, path: str, meta: Mapping[str, str]) -> None:
    """A projection with its diagnostics: JSONL always, Parquet with its fingerprints."""
    if not meta:
        raise ValueError("a projection is written with its fingerprints")
    write(rows, f"{path}.jsonl", "jsonl")
    write(rows, f"{path}.parquet", "parquet", meta)
    write(diagnostics, f"{path}_diagnostics.jsonl", "jsonl")


def write_tables(base: DataFrame, views: Mapping[str, Callable[[DataFrame], DataFrame]], folder: str, meta: Mapping[str, str]) -> None:
    """Several named tables out of one: ``base`` is computed once and cut off from its lineage, and each view of it is
    written with the fingerprints."""
    from palimpsest.operators.graph import cut_lineage

    if not meta:
        raise ValueError("tables are written with their fingerprints")
    once = cut_lineage(base)
    for name, view in views.items():
        write(view(once), f"{folder.rstrip('/')}/{name}.parquet", "parquet", meta)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, digest): independent of order and partitioning."""
    row = (F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)) if df.columns else F.lit(0)).cast("long").bitwiseAND(F.lit((1 << 40) - 1))
    # the sum of 40 bits a row would leave a long after some ten million rows, so that its halves are summed apart; the digest is the sum up to 62 bits
    half = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    high, low = half(F.shiftright(row, 20)), half(row.bitwiseAND(F.lit((1 << 20) - 1)))
    return df.agg(F.count(F.lit(1)).alias("n"), (F.shiftleft(high.bitwiseAND(F.lit((1 << 42) - 1)), 20) + low).alias("digest"))


def stale(spark: SparkSession, path: str, expected: Mapping[str, str]) -> bool:
    """Whether a projection's sidecar is missing or differs from the expected fingerprints."""
    p, fs = _fs(spark, f"{path}._meta")
    if not fs.exists(p):
        return True
    held = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}._meta").limit(1000).collect()}
    return any(held.get(k) != v for k, v in expected.items())


def json_safe(value: object) -> object:
    """Scalars as they are, lists item by item, anything else as a string."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return [json_safe(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


def to_json_line(row: Mapping[str, object]) -> str:
    return json.dumps({k: json_safe(v) for k, v in row.items()}, ensure_ascii=False, sort_keys=True)

"""Chunked, resumable runs with a journal.

A long computation over a keyed table goes chunk by chunk. The input is dealt once, by a hash of its key, to a folder for each
chunk, so that a chunk reads its own rows only and all rows of a key are together. The rows of a chunk are computed as one Spark job
(distributed, with task retries), written to a folder of their own, and then entered in the journal. A run that is
started again skips the chunks that the journal has and whose rows are in place; a chunk that was cut off before its entry, or
whose entry is malformed, is computed again and replaces what it left. The manifest holds what the run was of: another
input, number of chunks or version of the computation starts afresh and never reuses what is there.

    run_folder/
      manifest.json              what the run is of
      input/chunk=0 …            the input, dealt
      rows/chunk=0 …             what was computed, Parquet
      journal/chunk-00000.json   one entry a finished chunk

The folder may be any that Spark can write to and that driver and executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.sources.tables import _fs, fingerprint

SCHEMA = "chunked-run.1"


@dataclass(frozen=True)
class Manifest:
    """What a run is of: the input's rows and digest, the chunks, and the caller's name for the computation."""

    key: str
    chunks: int
    version: str
    n: int
    digest: int
    schema: str = SCHEMA


@dataclass(frozen=True)
class Entry:
    """A finished chunk: its rows and their digest, and whether this run computed it or found it done."""

    chunk: int
    n: int
    digest: int
    source: str = "computed"


def chunk_of(key: Column, chunks: int) -> Column:
    """The chunk of a key: the first 32 bits of its MD5, modulo ``chunks``; a null key is an empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(chunks)).cast("int")


class RunFolder:
    """The files of a run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> dict | None:
        """A JSON file of the run; None if there is none or it is not whole."""
        at, fs = _fs(self.spark, f"{self.path}/{name}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def put(self, name: str, content: dict) -> None:
        """Writes a JSON file under another name and renames it, so that nobody reads half of it."""
        at, fs = _fs(self.spark, f"{self.path}/{name}")
        draft, _ = _fs(self.spark, f"{self.path}/{name}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        fs.delete(at, False)
        if not fs.rename(draft, at):
            raise OSError(f"cannot rename {draft} to {at}")

    def exists(self, name: str) -> bool:
        at, fs = _fs(self.spark, f"{self.path}/{name}")
        return bool(fs.exists(at))

    def remove(self, name: str = "") -> None:
        at, fs = _fs(self.spark, f"{self.path}/{name}" if name else self.path)
        fs.delete(at, True)

    def entry(self, chunk: int) -> Entry | None:
        """The journal's entry of a chunk whose rows are in place."""
        found = self.read(f"journal/chunk-{chunk:05d}.json")
        try:
            done = Entry(int(found["chunk"]), int(found["n"]), int(found["digest"]), "resumed") if found else None
        except (KeyError, TypeError, ValueError):
            return None
        return done if done and done.chunk == chunk and self.exists(f"rows/chunk={chunk}/_SUCCESS") else None


def _dealt(source: DataFrame, folder: RunFolder, key: str, chunks: int) -> None:
    """The input by chunk. Partitions are even, however many rows a key has."""
    if folder.exists("input/_SUCCESS"):
        return
    marked = source.withColumn("chunk", chunk_of(F.col(key), chunks))
    marked.hint("rebalance", F.col("chunk")).write.mode("overwrite").partitionBy("chunk").parquet(f"{folder.path}/input")


def chunk_steps(source: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, chunks: int, version: str = "1", resume: bool = True) -> Iterator[Entry]:
    """Runs ``compute`` over the rows of each chunk and yields its entry once the journal has it. ``compute`` sees all rows of the keys
    of its chunk and none of others. Stopping between or within steps loses the step at hand at most."""
    if chunks < 1:
        raise ValueError("a run has one chunk at least")
    if "chunk" in source.columns:
        raise ValueError("the run's own column is named chunk")
    spark = source.sparkSession
    folder = RunFolder(spark, path)
    size = fingerprint(source).first()
    manifest = asdict(Manifest(key, chunks, version, size["n"], size["digest"]))
    if not resume or folder.read("manifest.json") != manifest:
        folder.remove()
        folder.put("manifest.json", manifest)
    _dealt(source, folder, key, chunks)
    schema: StructType = source.schema
    for chunk in range(chunks):
        done = folder.entry(chunk)
        if done is None:
            part = f"{folder.path}/input/chunk={chunk}"
            rows = compute(spark.read.schema(schema).parquet(part) if folder.exists(f"input/chunk={chunk}") else spark.createDataFrame([], schema))
            rows.write.mode("overwrite").parquet(f"{folder.path}/rows/chunk={chunk}")
            written = spark.read.schema(rows.schema).parquet(f"{folder.path}/rows/chunk={chunk}")
            total = fingerprint(written).first()
            done = Entry(chunk, total["n"], total["digest"])
            folder.put(f"journal/chunk-{chunk:05d}.json", {**asdict(done), "schema": rows.schema.json()})
        yield done


def run_chunked(source: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, chunks: int, version: str = "1", resume: bool = True) -> DataFrame:
    """What ``compute`` gives over all chunks: the same rows as over the whole input, for a computation that goes by key."""
    for _ in chunk_steps(source, key, compute, path, chunks, version, resume):
        pass
    return chunk_rows(source.sparkSession, path)


def chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the chunks that the journal has: all of a finished run, what there is of one that is under way."""
    folder = RunFolder(spark, path)
    manifest = folder.read("manifest.json")
    if manifest is None:
        raise FileNotFoundError(f"no run in {path}")
    done = [c for c in range(manifest["chunks"]) if folder.entry(c)]
    if not done:
        raise FileNotFoundError(f"no finished chunk in {path}")
    schema = StructType.fromJson(json.loads(folder.read(f"journal/chunk-{done[0]:05d}.json")["schema"]))
    return spark.read.schema(schema).parquet(*(f"{folder.path}/rows/chunk={c}" for c in done))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, status, n, digest): done or open, for each chunk of the run."""
    folder = RunFolder(spark, path)
    manifest = folder.read("manifest.json")
    if manifest is None:
        raise FileNotFoundError(f"no run in {path}")
    entries = [(c, folder.entry(c)) for c in range(manifest["chunks"])]
    rows = [(c, "done", e.n, e.digest) if e else (c, "open", None, None) for c, e in entries]
    return spark.createDataFrame(rows, "chunk int, status string, n long, digest long")

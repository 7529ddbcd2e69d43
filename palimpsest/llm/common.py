"""What the operators share: table access, shared storage, expression helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import ship

#: White space that separates words; every other code point belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: The columns of the documents table.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local master gets one of
    our own, and a cluster an error: its executors would each write to a disk of their own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove_local, folder)
    return folder.rstrip("/")


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of :func:`written` that no plan needs any more."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column, kind: str = "long") -> Column:
    """Sum of an array, 0 if empty."""
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: a + x)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over single batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only: extra columns of the input, whatever their names, cannot clash with ours."""
    ship(df.sparkSession)
    return df.select(*(df[f"`{n}`"] for n in names))

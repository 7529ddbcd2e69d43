"""Structured Streaming: windowed counts, deduplication, incremental builds, an event log as state.

Event-time windows go beyond parity: the batch engine keeps late rows 'unresolved' rather than dropping them, and so do
the builds here; only the windowed counts use a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.session import ship


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files present."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding window; works on streams and tables alike."""
    bucket = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    marked = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = marked.withWatermark(ts, late) if events.isStreaming else marked
    return marked.groupBy(bucket.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Counts per session: rows less than ``gap`` apart."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = marked.withWatermark(ts, late) if events.isStreaming else marked
    return marked.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row per key; on a stream, within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def incremental_build(source: DataFrame, project: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, checkpoint: str) -> Any:
    """Runs a projection over what is new in ``source`` and appends rows and diagnostics; the checkpoint remembers the last
    batch, and a batch that is run again replaces its own output."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows, diagnostics = project(batch)
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        diagnostics.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/diagnostics/batch={batch_id}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class EventLog(StatefulProcessor):
    """The state of each subject of an event log; transitions that are not legal are reported and change nothing."""

    def __init__(self, legal: dict[str, list[str]]) -> None:
        self.legal = legal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("ord").itertuples():
            ok = now is None or r.state in self.legal.get(now, [])
            now = r.state if ok else now
            out.append((key[0], r.ord, now, ok))
        self.state.update((now,))
        yield pd.DataFrame(out, columns=["subject", "ord", "state", "legal"])

    def close(self) -> None:
        pass


def log_states(events: DataFrame, legal: dict[str, list[str]]) -> DataFrame:
    """(subject, ord, state, legal) of a log (subject, ord, state)."""
    ship(events.sparkSession)
    return events.groupBy("subject").transformWithStateInPandas(EventLog(legal), "subject string, ord long, state string, legal boolean", "Update", "None")



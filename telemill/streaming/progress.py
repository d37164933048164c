"""Progress of streaming queries as a table: a listener that misses no batch, however long a query runs."""

from __future__ import annotations

import queue
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = ("id string, run_id string, name string, batch_id long, at string, input_rows long, output_rows long, dropped_rows long, state_rows long, state_bytes long, duration_ms long,"
            " add_batch_ms long, watermark string, end_offsets array<string>")


def row_of(p) -> tuple:
    """A progress report as a row of ``PROGRESS``."""
    total = lambda name: sum(int(getattr(s, name) or 0) for s in p.stateOperators)
    durations = p.durationMs or {}
    return (
        str(p.id), str(p.runId), p.name or str(p.id), int(p.batchId), p.timestamp, int(p.numInputRows or 0), max(0, int(p.sink.numOutputRows or 0)), total("numRowsDroppedByWatermark"), total("numRowsTotal"),
        total("memoryUsedBytes"), int(durations.get("triggerExecution") or 0), int(durations.get("addBatch") or 0), (p.eventTime or {}).get("watermark"), [str(s.endOffset) for s in p.sources],
    )


class ProgressTable(StreamingQueryListener):
    """Appends every report of every query to a Parquet table at ``path``, ``rows_per_file`` at a time and when it is closed.

    Reports come on Spark's listener thread, which only queues them; a thread of its own writes. Used as ``with ProgressTable(spark, path) as log:``; leaving it waits
    for the queries that were started meanwhile to end and for what is queued to be written.
    """

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 500, wait_seconds: float = 60) -> None:
        self.spark, self.path, self.rows_per_file, self.wait_seconds = spark, path, rows_per_file, wait_seconds
        self._running: set[str] = set()
        self._queued: queue.Queue = queue.Queue()
        self._failure: Exception | None = None
        self._writer = threading.Thread(target=self._write, daemon=True)

    def __enter__(self) -> ProgressTable:
        self.spark.createDataFrame([], PROGRESS).write.mode("append").parquet(self.path)
        self._writer.start()
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        until = time.monotonic() + self.wait_seconds
        while self._running and time.monotonic() < until:
            time.sleep(0.05)
        self.spark.streams.removeListener(self)
        self._queued.put(None)
        self._writer.join()
        if self._failure:
            raise self._failure

    def onQueryStarted(self, event) -> None:
        self._running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        self._queued.put(row_of(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._running.discard(str(event.runId))

    def _write(self) -> None:
        rows: list[tuple] = []
        try:
            while (row := self._queued.get()) is not None:
                rows.append(row)
                if len(rows) >= self.rows_per_file:
                    self._append(rows)
                    rows = []
            if rows:
                self._append(rows)
        except Exception as failure:  # told to the caller when the table is closed
            self._failure = failure

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Each batch once: the last report of a batch that ran again after a restart."""
    n = F.row_number().over(W.partitionBy("id", "batch_id").orderBy(F.desc("at"), F.desc("run_id")))
    return spark.read.schema(PROGRESS).parquet(path).withColumn("_n", n).where("_n = 1").drop("_n")

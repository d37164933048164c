"""The three continuous queries, their sinks and their supervision."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill.functions import contracts as C
from telemill.operators import detectors, policy, scorer
from telemill.operators.features import derived, sliding
from telemill.sources import ingest

#: The state store for long-lived keyed state: on disk, outside the heap.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def validation(raw: DataFrame, watermark_seconds: int = 90, late_detection: bool = True) -> DataFrame:
    """Raw records to dead letters and late notes, each with its destination; stateless."""
    return ingest.side_outputs(ingest.parse(raw), watermark_seconds=watermark_seconds, enabled=late_detection)


def features(samples: DataFrame, window_seconds: int = 60, slide_seconds: int = 10, watermark_seconds: int = 90) -> DataFrame:
    """Samples to window features; the same definition as in batch."""
    return derived(sliding(samples, window_seconds, slide_seconds, watermark_seconds))


def accepted_samples(raw: DataFrame, watermark_seconds: int = 90, late_detection: bool = True) -> DataFrame:
    good, _ = ingest.split_valid(ingest.parse(raw))
    on_time, _ = ingest.split_late(good, watermark_seconds, late_detection)
    return on_time


def scoring(windows: DataFrame, model: dict, version: dict[str, str], threshold: float, scored_at: Column | None = None, **gate) -> DataFrame:
    """Windows of features to scored messages: a trained model's score, calibrated, with the gates, the contributors and all features.

    ``model``: any detector's, from ``training.fitted`` or ``artifacts.load``; workers load it once (``scorer``).
    """
    rows = scorer.score(windows, model).withColumns({"threshold": F.lit(threshold), "z": detectors.contributions(C.feature_names(), model["reference_profile"])})
    return policy.encoded(policy.scored_event(rows, version, F.current_timestamp() if scored_at is None else scored_at, **gate))


def distinct_samples(samples: DataFrame, watermark_seconds: int = 90) -> DataFrame:
    """Samples without repeated deliveries; the state forgets an event once the watermark has passed it."""
    return samples.withWatermark("event_time", f"{watermark_seconds} seconds").dropDuplicatesWithinWatermark(["event_id"])


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", name: str | None = None, trigger: dict | None = None, partition_by: str | None = None) -> StreamingQuery:
    """Start a query with its own checkpoint. File sinks append; in update mode each batch goes to a folder of its own, so a repeated batch overwrites itself."""
    trigger = trigger or {"availableNow": True}
    for k, v in STATE_STORE.items():
        df.sparkSession.conf.set(k, v)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
    writer = writer.queryName(name) if name else writer
    if mode == "append" and df.columns:
        writer = writer.format("parquet").option("path", path)
        return (writer.partitionBy(partition_by) if partition_by else writer).start()
    return writer.foreachBatch(lambda batch, i: batch.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{path}/batch={i}")).start()


def upserts(df: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A query whose batches are merged into a table by ``apply``; at-least-once delivery into an idempotent merge."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def run_bounded(queries: list[StreamingQuery], seconds: float | None = None, poll: float = 0.2) -> list[str]:
    """Wait until all have ended, one has failed or the time is up; stop what still runs; the failures' texts."""
    until = time.monotonic() + seconds if seconds is not None else None
    while any(q.isActive for q in queries) and not any(q.exception() for q in queries) and (until is None or time.monotonic() < until):
        time.sleep(poll)
    for q in queries:
        if q.isActive:
            q.stop()
    return [str(q.exception()) for q in queries if q.exception()]

"""Streams that stop and go on: state, timers, tables with a commit log, progress."""

import pytest
from pyspark.sql import functions as F

from telemill.operators import alerting
from telemill.sources import ingest, tables, versions
from telemill.streaming import alert_state, jobs, progress

WINDOWS = "machine_id string, window_start long, anomaly_score double"


def anomalous(spark, path):
    stream = ingest.read_stream(spark, "parquet", spark.createDataFrame([], WINDOWS).schema, path, maxFilesPerTrigger="1")
    return stream.withColumn("event_time", F.timestamp_seconds("window_start")).withWatermark("event_time", "0 seconds")


def test_state_and_timers_go_on_after_a_restart(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [
        [("a", 100, 0.9), ("b", 100, 0.8), ("c", 80, 0.7), ("c", 90, 0.7)],  # c opens
        [("a", 110, 0.5), ("a", 110, 0.95)],  # a opens, by its stronger update
        [("d", 1000, 0.9)],  # all the others fall silent
        [("a", 2000, 0.9), ("d", 1010, 0.8), ("b", 2000, 0.6)],  # a and b start anew; d opens
        [("a", 2010, 0.9)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, WINDOWS).coalesce(1).write.mode("append").parquet(path)
        if i in (0, 3, 4):  # a new query from the checkpoint each time
            jobs.start(alert_state.episodes(anomalous(spark, path), 2, 60, closings=True), out, checkpoint).awaitTermination()
    rows = [(r["machine_id"], r["window_start"], r["consecutive_windows"], r["anomaly_score"]) for r in spark.read.parquet(out).collect()]
    opened = sorted(r for r in rows if r[2])
    assert opened == [("a", 110, 2, 0.95), ("a", 2010, 2, 0.9), ("c", 90, 2, 0.7), ("d", 1010, 2, 0.8)]
    closed = sorted(r[:2] for r in rows if not r[2])
    assert closed == [("c", 90), ("d", 1010)]  # c's timer is of the first run and fires in the second; a and b came back in the batch in which theirs would have fired
    every = spark.createDataFrame([r for b in batches for r in b], WINDOWS).withColumn("at", F.monotonically_increasing_id())
    batch = alerting.episode_alerts(alerting.strongest(every, "at"), 60).select("machine_id", "window_start").collect()
    assert sorted(map(tuple, batch)) == [r[:2] for r in opened]


ALERTS = "alert_id long, status string, severity string"


def test_commit_log_survives_a_stop_between_write_and_commit(spark, tmp_path):
    path, schema = str(tmp_path / "table"), spark.createDataFrame([], ALERTS).schema
    new = lambda: versions.VersionedTable(spark, path, schema, F.col("alert_id") % 3)
    batch = lambda ids, severity: spark.createDataFrame([(i, "NEW", severity) for i in ids], ALERTS)
    rows = lambda: sorted(map(tuple, new().read().collect()))
    assert rows() == []
    new().apply(batch(range(6), "HIGH"), 0, tables.upsert_alerts)
    before = rows()
    assert len(before) == 6

    def stop(batch_id):
        raise InterruptedError

    with pytest.raises(InterruptedError):
        new().apply(batch([1, 7], "CRITICAL"), 1, tables.upsert_alerts, stop)
    assert rows() == before  # nothing of it is seen
    merged = new().apply(batch([1, 7], "CRITICAL"), 1, tables.upsert_alerts)
    assert {r["alert_id"]: (r["was_inserted"], r["was_changed"]) for r in merged.collect()} == {1: (False, True), 4: (False, False), 7: (True, False)}  # the part it touches
    after = rows()
    assert len(after) == 7 and (1, "NEW", "CRITICAL") in after and (7, "NEW", "CRITICAL") in after
    assert new().apply(batch([1, 99], "MEDIUM"), 1, tables.upsert_alerts) is None and rows() == after  # delivered again
    assert new().apply(batch([], "MEDIUM"), 2, tables.upsert_alerts) is None
    other = versions.VersionedTable(spark, path, schema, F.col("alert_id") % 3, source="replay")
    other.apply(batch([2], "MEDIUM"), 0, tables.upsert_alerts)  # another query counts its batches for itself
    assert (2, "NEW", "MEDIUM") in rows() and len(rows()) == 7


def test_stream_cut_off_and_started_again_keeps_every_alert_once(spark, tmp_path):
    path, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    schema = spark.createDataFrame([], ALERTS).schema
    for i in range(4):
        spark.createDataFrame([(k, "NEW", "HIGH") for k in range(i * 5, i * 5 + 10)], ALERTS).coalesce(1).write.mode("append").parquet(path)

    def stop(batch_id):
        if batch_id == 2:
            raise InterruptedError

    for before_commit in (stop, None):
        stream = ingest.read_stream(spark, "parquet", schema, path, maxFilesPerTrigger="1")
        sink = versions.VersionedTable(spark, table, schema, F.col("alert_id") % 2)(tables.upsert_alerts, before_commit)
        failed = jobs.run_bounded([jobs.upserts(stream, checkpoint, sink)])
        assert len(failed) == (before_commit is not None)
    found = versions.VersionedTable(spark, table, schema, F.col("alert_id") % 2)
    assert sorted(r["alert_id"] for r in found.read().collect()) == list(range(25))
    assert sorted(r["batch_id"] for r in found.commits().select("batch_id").distinct().collect()) == [0, 1, 2, 3]


def test_progress_of_more_than_a_hundred_batches(spark, tmp_path):
    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.range(0, 1300, 1, 8).withColumn("p", F.col("id") % 104).repartition(104, "p").write.partitionBy("p").parquet(path)
    stream = lambda: spark.readStream.schema("id long, p int").option("maxFilesPerTrigger", "1").parquet(path)
    with progress.ProgressTable(spark, log, rows_per_file=40):
        q = stream().writeStream.format("noop").queryName("many").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    with progress.ProgressTable(spark, log):  # a restart with nothing new adds no batch of rows
        stream().writeStream.format("noop").queryName("many").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = progress.batches(spark, log).where("input_rows > 0").collect()
    assert len(q.recentProgress) <= 100 < 104 == len(rows) and sum(r["input_rows"] for r in rows) == 1300
    assert len({r["batch_id"] for r in rows}) == 104 and {r["name"] for r in rows} == {"many"} and all(r["duration_ms"] > 0 for r in rows)

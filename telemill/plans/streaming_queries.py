"""Queries that run streams over the driver's tables to their end and return what they wrote."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S
from telemill.operators import alerting, artifacts, reports, training
from telemill.plans import feature_queries as fq
from telemill.plans import ingest_queries as iq
from telemill.plans import ml_queries as mq
from telemill.plans import tables as t
from telemill.plans.registry import query
from telemill.plans.scratch import kept, scratch
from telemill.sources import ingest, tables, versions
from telemill.streaming import alert_state, jobs, progress


def raw_stream(spark, path, **options):
    return ingest.read_stream(spark, "parquet", spark.read.parquet(path).schema, path, **options)


def run(spark, df, mode="append", name=None):
    out = scratch(spark, "stream-out")
    jobs.start(df, out, scratch(spark, "stream-checkpoint"), mode, name).awaitTermination()
    return spark.read.parquet(out)


def watched(spark, df, mode="append", name=None):
    """What the query wrote, and the reports of its batches that had rows."""
    path = scratch(spark, "progress")
    with progress.ProgressTable(spark, path):
        out = run(spark, df, mode, name)
    return out, progress.batches(spark, path).where((F.col("input_rows") > 0) & (F.col("name") == name))


@query("src_raw_stream", t.with_(t.SAMPLES) + 'SELECT "partition", count(*) AS n FROM samples GROUP BY 1')
def src_raw_stream(spark, d):
    return run(spark, raw_stream(spark, t.topic(spark, d))).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query("str_trigger_rate_limit", t.with_(t.SAMPLES) + "SELECT 4 AS batches, count(*) AS n FROM samples")
def str_trigger_rate_limit(spark, d):
    """Four files, one a batch."""
    path = scratch(spark, "raw-topic")
    t.records(spark, d).repartition(4).write.parquet(path)
    out, reported = watched(spark, raw_stream(spark, path, maxFilesPerTrigger="1"), name="limited")
    batches = reported.agg(F.count(F.lit(1)).alias("batches"))
    return out.agg(F.count(F.lit(1)).alias("n")).crossJoin(batches)  # single rows


@query("str_validation_query", iq.SIDES)
def str_validation_query(spark, d):
    return run(spark, jobs.validation(raw_stream(spark, t.topic(spark, d)))).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("str_late_side_output", iq.FAULTY + "SELECT count(*) AS n FROM parsed WHERE dlq_reason IS NULL AND lag > 90")
def str_late_side_output(spark, d):
    return run(spark, jobs.validation(raw_stream(spark, t.topic(spark, d)))).where("topic = 'telemetry.late'").agg(F.count(F.lit(1)).alias("n"))


LONG_ENOUGH = 40 * 86_400  # over the span of the table: nothing is late


def sample_topic(spark, d, twice=False):
    """Samples as files: (their folder, their schema)."""
    s = t.samples(spark, d)
    path = scratch(spark, "samples-topic")
    (s.unionByName(s) if twice else s).write.options(**t.FILE_ROWS).parquet(path)
    return path, s.schema


def sample_stream(spark, d, twice=False):
    path, schema = sample_topic(spark, d, twice)
    return ingest.read_stream(spark, "parquet", schema, path)


@query("str_dedup_samples", t.with_(t.SAMPLES) + "SELECT machine_id, count(*) AS n FROM samples GROUP BY 1")
def str_dedup_samples(spark, d):
    return run(spark, jobs.distinct_samples(sample_stream(spark, d, twice=True), LONG_ENOUGH)).groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))


LATE = "(\"offset\" % 50 = 7 AND event_time < TIMESTAMP '2024-01-10')"
ON_TIME = t.with_(t.SAMPLES, f"on_time AS (SELECT * FROM samples WHERE NOT {LATE})", t.window_sql(source="on_time"), t.features_sql())


def late_stream(spark, d):
    """Samples in three batches; those of the third are weeks behind what the watermark has reached by then.

    A batch is so many files, enough for tasks of a bounded size, and each of the first two parts has as many.
    """
    s = t.samples(spark, d)
    late = (F.col("offset") % 50 == 7) & (F.col("event_time") < F.timestamp_seconds(F.lit(1704844800)))
    early = F.col("event_time") < F.timestamp_seconds(F.lit(1705968000))
    path = scratch(spark, "late-topic")
    counts = s.agg(F.count_if(~late & early), F.count_if(~late & ~early), F.count_if(late)).first()
    files = max(1, min(-(-max(counts) // 200_000), min(counts[:2]) // 1_000))  # none of them empty
    for part in (~late & early, ~late & ~early, late):
        dealt = s.where(part).coalesce(1) if files == 1 else s.where(part).repartition(files)
        dealt.write.mode("append").parquet(path)
    return ingest.read_stream(spark, "parquet", s.schema, path, maxFilesPerTrigger=str(files))


@query("str_watermark_window", ON_TIME + "SELECT machine_id, window_start, sample_count, round(temperature_c_mean, 6) + 0 AS temperature_c_mean, TRUE AS some_dropped FROM features")
def str_watermark_window(spark, d):
    """Windows in update mode, the last emission of each: the batch result without the samples that came behind the watermark, which are dropped and counted."""
    stream = jobs.features(late_stream(spark, d), t.WINDOW, t.SLIDE, t.WINDOW)
    out, reported = watched(spark, stream.select("machine_id", F.unix_seconds("window_start").alias("window_start"), "sample_count", "temperature_c_mean"), "update", "watermark")
    dropped = reported.agg((F.sum("dropped_rows") > 0).alias("some_dropped"))
    last = alerting.latest_emission(out.withColumn("offset", F.col("batch_id")), "offset").select("machine_id", "window_start", "sample_count", "temperature_c_mean")
    return t.rounded(last.crossJoin(dropped))  # single row


GRID = mq.FITTED + """, grid AS (SELECT quantile_cont(raw_score, [""" + ", ".join(str(i / 1000) for i in range(1001)) + """]) AS g FROM model_scores),
placed AS (SELECT m.*, g, (SELECT count(*) FROM (SELECT unnest(g) AS v) WHERE v <= raw_score) AS n FROM model_scores m, grid),
graded AS (SELECT machine_id, window_start, raw_score, CASE WHEN n = 1001 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE (n - 1 + CASE WHEN g[n + 1] > g[n] THEN (raw_score - g[n]) / (g[n + 1] - g[n]) ELSE 0 END) / 1000 END AS score FROM placed)
"""


def scored_messages(spark, d, detector):
    """A detector trained on the windows of the table, saved and loaded, scores the stream; (the last message of each window, the loaded model).

    Samples are made from the table once; training and the stream read the same files.
    """
    path, schema = sample_topic(spark, d)
    f = t.features_of(spark.read.schema(schema).parquet(path))  # written by the training, which reads it many times
    model = artifacts.load(spark, artifacts.save(spark, scratch(spark, "model"), training.fitted(f, mq.ALL, detector)), mq.ALL)
    windows = jobs.features(ingest.read_stream(spark, "parquet", schema, path), t.WINDOW, t.SLIDE, LONG_ENOUGH)
    out = run(spark, jobs.scoring(windows, model, {**fq.MODEL, "name": detector}, 0.90005, F.col("window_end") + F.expr("INTERVAL 5 SECONDS"), min_samples=t.GATE), "update")
    m = out.select("batch_id", F.from_json("value", C.SCORED_DDL).alias("m")).select(
        F.col("batch_id").alias("offset"), "m.machine_id", F.unix_seconds(S.parse_instant(F.col("m.window_start"))).alias("window_start"), "m.is_scored", "m.skip_reason", "m.raw_score",
        F.col("m.anomaly_score").alias("score"), "m.is_anomaly", F.size("m.top_contributors").alias("contributors"), F.try_element_at("m.features", F.lit("null_ratio")).alias("null_ratio"), F.col("m.model.name").alias("model"), "m.features",
    )
    return alerting.latest_emission(m).drop("offset"), model


@query("str_scoring_query", GRID + f"""SELECT machine_id, window_start, skip_reason IS NULL AS is_scored, skip_reason, CASE WHEN skip_reason IS NULL THEN round(raw_score, 5) + 0 END AS raw_score,
  CASE WHEN skip_reason IS NULL THEN round(score, 5) + 0 END AS score, CASE WHEN skip_reason IS NULL THEN score >= 0.90005 END AS is_anomaly, CASE WHEN skip_reason IS NULL THEN 3 ELSE 0 END AS contributors,
  round(null_ratio, 5) + 0 AS null_ratio, 'three_sigma' AS model
FROM (SELECT *, {fq.SKIP} AS skip_reason FROM features JOIN graded USING (machine_id, window_start))""")
def str_scoring_query(spark, d):
    """Samples to windows to scores by a trained artefact (profiles, gaps, scales, detector, grid of 1001 quantiles) to messages, on a stream."""
    return t.rounded(scored_messages(spark, d, "three_sigma")[0].drop("features"), 5)


def stream_equals_batch(detector):
    """A query that compares the scores in the messages of a stream with ``training.score`` over the features that the messages carry."""

    @query(f"str_scoring_{detector}", fq.BASE + f"SELECT machine_id, window_start, {fq.SKIP} IS NULL AS is_scored, TRUE AS same, '{detector}' AS model FROM features")
    def compared(spark, d):
        messages, model = scored_messages(spark, d, detector)
        messages = kept(messages, "messages")
        windows = messages.select("machine_id", "window_start", *[F.try_element_at("features", F.lit(c)).alias(c) for c in mq.ALL])
        batch = training.score(windows, model).select("machine_id", "window_start", F.col("raw_score").alias("_raw"), F.col("score").alias("_score"))
        close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(b)))
        same = ~F.col("is_scored") | (close("raw_score", "_raw") & close("score", "_score"))
        return messages.join(batch, ["machine_id", "window_start"], "full_outer").select("machine_id", "window_start", "is_scored", F.coalesce(same, F.lit(False)).alias("same"), "model")

    return compared


for _detector in ("three_sigma_all", "mahalanobis", "isolation_forest", "one_class"):
    stream_equals_batch(_detector)


def anomalous_stream(spark, d):
    rows = mq.scored(spark, d).where("score >= 0.35").select("machine_id", "window_start", F.col("score").alias("anomaly_score"))
    path = scratch(spark, "scored-topic")
    rows.unionByName(rows.withColumn("anomaly_score", F.col("anomaly_score") / 2)).write.parquet(path)  # every window is updated once
    return ingest.read_stream(spark, "parquet", rows.schema, path)


STATE_SQL = mq.EV + mq.EPISODE_ALERTS.replace("SELECT machine_id, window_start, consecutive_windows FROM opened", "SELECT machine_id, window_start, round(score, 6) AS anomaly_score, consecutive_windows FROM opened")


@query("str_alert_state", STATE_SQL)
def str_alert_state(spark, d):
    stream = anomalous_stream(spark, d).withColumn("event_time", F.timestamp_seconds("window_start")).withWatermark("event_time", f"{LONG_ENOUGH} seconds")
    return t.rounded(run(spark, alert_state.alerts(stream, 2, 2 * t.SLIDE)))


WEEK = 7 * 86_400


@query("str_event_time_timeout", STATE_SQL.replace("consecutive_windows FROM opened", "consecutive_windows, TRUE AS some_fell_silent FROM opened"))
def str_event_time_timeout(spark, d):
    """Windows come week by week and the watermark follows, so machines that stay silent over the gap time out: the openings are those of the batch rule all the same."""
    rows = kept(mq.scored(spark, d).where("score >= 0.35").select("machine_id", "window_start", F.col("score").alias("anomaly_score")), "anomalous")
    path = scratch(spark, "weekly-topic")
    first, last = rows.agg(F.min("window_start"), F.max("window_start")).first()
    weeks = range(first or 0, (last or 0) + 1, WEEK)  # a file per week, in order of time
    for start in weeks:
        rows.where(F.col("window_start").between(start, start + WEEK - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = ingest.read_stream(spark, "parquet", rows.schema, path, maxFilesPerTrigger="1").withColumn("event_time", F.timestamp_seconds("window_start")).withWatermark("event_time", "0 seconds")
    out = kept(run(spark, alert_state.alerts(stream, 2, 2 * t.SLIDE, closings=True)), "openings")
    silent = out.agg((F.count_if(F.col("consecutive_windows") == 0) > 0).alias("some_fell_silent"))
    return t.rounded(out.where("consecutive_windows > 0").crossJoin(silent))  # single row


@query("udf_state_handler", STATE_SQL.replace("consecutive_windows FROM opened", "consecutive_windows, TRUE AS some_fell_silent FROM opened"))
def udf_state_handler(spark, d):
    """A stateful processor with a value state and a timer per machine. The stream is stopped in the middle of the month and started again: state and timers go on from the checkpoint."""
    rows = kept(mq.scored(spark, d).where("score >= 0.35").select("machine_id", "window_start", F.col("score").alias("anomaly_score")), "anomalous")
    path, out, checkpoint = scratch(spark, "halves-topic"), scratch(spark, "halves-out"), scratch(spark, "halves-checkpoint")
    first, last = rows.agg(F.min("window_start"), F.max("window_start")).first()
    cut = ((first or 0) + (last or 0)) // 2
    for part in (F.col("window_start") <= cut, F.col("window_start") > cut):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
        stream = ingest.read_stream(spark, "parquet", rows.schema, path, maxFilesPerTrigger="1").withColumn("event_time", F.timestamp_seconds("window_start")).withWatermark("event_time", "0 seconds")
        jobs.start(alert_state.episodes(stream, 2, 2 * t.SLIDE, closings=True), out, checkpoint).awaitTermination()
    found = kept(spark.read.parquet(out), "openings")
    silent = found.agg((F.count_if(F.col("consecutive_windows") == 0) > 0).alias("some_fell_silent"))
    return t.rounded(found.where("consecutive_windows > 0").crossJoin(silent))  # single row


@query("src_scored_stream", mq.EV + "SELECT machine_id, window_start, round(score, 6) AS anomaly_score FROM scored WHERE score >= 0.35")
def src_scored_stream(spark, d):
    """Scored messages as JSON, read and decoded as a stream."""
    rows = mq.scored(spark, d).where("score >= 0.35").select(F.to_json(F.struct("machine_id", "window_start", F.col("score").alias("anomaly_score"))).alias("value"))
    path = scratch(spark, "scored-json")
    rows.write.parquet(path)
    stream = ingest.read_stream(spark, "parquet", rows.schema, path)
    event = F.from_json("value", "machine_id string, window_start long, anomaly_score double")
    return t.rounded(run(spark, stream.select(event.alias("event")).select("event.*")))


@query("str_checkpoint_per_query", t.with_(t.SAMPLES) + "SELECT count(*) AS n, 2::BIGINT AS runs FROM samples")
def str_checkpoint_per_query(spark, d):
    """A query stopped half-way through its input goes on from its checkpoint and delivers every row once."""
    s = t.samples(spark, d)
    path, out, checkpoint = scratch(spark, "resumed-topic"), scratch(spark, "resumed-out"), scratch(spark, "resumed-checkpoint")
    for part in ("partition < 2", "partition >= 2"):
        s.where(part).write.mode("append").parquet(path)
        jobs.start(ingest.read_stream(spark, "parquet", s.schema, path), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.lit(2).cast("long").alias("runs"))


@query("str_bounded_run", iq.FAULTY + "SELECT 0::BIGINT AS failures, count(*) AS n FROM parsed WHERE dlq_reason IS NOT NULL OR lag > 90")
def str_bounded_run(spark, d):
    """Two queries on one topic together until both have ended, however long that takes: a time limit would cut off what is counted."""
    out, path = scratch(spark, "bounded-out"), t.topic(spark, d)
    a = jobs.start(jobs.validation(raw_stream(spark, path)), out, scratch(spark, "bounded-a"))
    b = jobs.start(raw_stream(spark, path), scratch(spark, "bounded-copy"), scratch(spark, "bounded-b"))
    failures = jobs.run_bounded([a, b])
    return spark.read.parquet(out).agg(F.lit(len(failures)).cast("long").alias("failures"), F.count(F.lit(1)).alias("n"))


FILES = 104  # more than the hundred reports that a query itself remembers


@query("str_progress_metrics", f"SELECT 'progress' AS name, row_number() OVER (ORDER BY n, p) AS place, n AS input_rows, 0::BIGINT AS dropped_rows FROM (SELECT event_id % {FILES} AS p, count(*) AS n FROM events GROUP BY 1)")
def str_progress_metrics(spark, d):
    """A row per batch of a query over 104 files, a file a batch, ordered by the rows it read."""
    batch, path = t.records(spark, d).withColumn("part", F.col("offset") % FILES), scratch(spark, "progress-topic")
    batch.repartition(FILES, "part").write.partitionBy("part").parquet(path)
    stream = ingest.read_stream(spark, "parquet", batch.schema, path, maxFilesPerTrigger="1")
    reported = watched(spark, stream.select("offset"), name="progress")[1]
    place = F.row_number().over(W.orderBy("input_rows", "batch_id")).cast("long")  # a row per batch
    return reported.select("name", place.alias("place"), "input_rows", "dropped_rows")


@query("agg_progress_totals", "SELECT 'totals' AS name, 3::BIGINT AS batches, count(*) AS input_rows, TRUE AS some_dropped FROM events")
def agg_progress_totals(spark, d):
    """Batches, rows in and rows dropped by the watermark, summed over a windowed query with late samples."""
    reported = watched(spark, jobs.features(late_stream(spark, d), t.WINDOW, t.SLIDE, t.WINDOW), "update", "totals")[1]
    return reports.progress_totals(reported).select("name", "batches", "input_rows", (F.col("dropped_rows") > 0).alias("some_dropped"))


@query("str_upsert_sinks", t.with_(t.ALERTS) + "SELECT count(*) AS alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, TRUE AS was_cut_off FROM alerts")
def str_upsert_sinks(spark, d):
    """Alerts delivered twice, merged by batch into a versioned table. The run is cut off between the writing and the committing of its second batch and started again: every alert once."""
    a = t.alerts(spark, d).select("alert_id", "machine_id", F.lit("NEW").alias("status"), "severity", "anomaly_score", "detected_at")
    path, checkpoint = scratch(spark, "alerts-topic"), scratch(spark, "alerts-checkpoint")
    for _ in range(2):
        a.repartition(2, "alert_id").write.mode("append").parquet(path)
    part = F.date_format("detected_at", "yyyy")
    place = scratch(spark, "alerts-table")

    def cut_off(batch_id):
        if batch_id == 1:
            raise InterruptedError("cut off before the commit")

    merge = lambda stored, new: tables.upsert_alerts(stored, new.dropDuplicates(["alert_id"]))
    failures = []
    for before_commit in (cut_off, None):  # a new table object each time: nothing is remembered in the driver
        stream = ingest.read_stream(spark, "parquet", a.schema, path, maxFilesPerTrigger="1")
        failures += jobs.run_bounded([jobs.upserts(stream, checkpoint, versions.VersionedTable(spark, place, a.schema, part)(merge, before_commit))])
    merged = versions.VersionedTable(spark, place, a.schema, part).read()
    return merged.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.lit(len(failures) == 1).alias("was_cut_off"))

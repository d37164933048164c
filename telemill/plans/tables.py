"""The driver's tables in the roles of the telemetry model, in Spark and (as common table expressions) in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S
from telemill.plans.registry import near
from telemill.plans.scratch import scratch

WINDOW, SLIDE, GATE = 86_400, 21_600, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples of fifteen machines with five sensors."""
    e = table(spark, sf_dir, "events")
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.concat(F.lit("E-"), i.cast("string")).alias("event_id"),
        F.concat(F.lit("M-"), F.lpad((u % 15).cast("string"), 3, "0")).alias("machine_id"),
        F.concat(F.lit("LINE-"), F.substring(F.lit("ABCDE"), (u % 5 + 1).cast("int"), F.lit(1))).alias("line_id"),
        F.col("ts").alias("event_time"), (F.col("ts") + F.make_dt_interval(secs=(i % 400).cast("decimal(18,6)"))).alias("ingest_time"),
        F.when((F.col("event_type") == "error") & (i % 4 == 0), "IDLE").otherwise("RUNNING").alias("machine_state"),
        F.when(i % 11 != 3, 20 + v * 0.1).alias("temperature_c"), F.when(i % 13 != 5, k * 0.1 + (i % 7) * 0.05).alias("vibration_mm_s"),
        F.when(u % 15 == 0, 5.0).otherwise(1 + k * 0.02 + v * 0.01).alias("pressure_bar"), F.when(i % 17 != 2, v).alias("power_kw"),
        F.when(i % 19 == 0, 0.5).otherwise(100 + k * 10).alias("rotation_rpm"), i.alias("offset"), (i % 4).cast("int").alias("partition"),
    )


SAMPLES = """samples AS (
  SELECT 'E-' || event_id AS event_id, 'M-' || lpad(CAST(user_id % 15 AS VARCHAR), 3, '0') AS machine_id,
    'LINE-' || substr('ABCDE', CAST(user_id % 5 + 1 AS INTEGER), 1) AS line_id, ts AS event_time, ts + to_seconds(event_id % 400) AS ingest_time,
    CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'IDLE' ELSE 'RUNNING' END AS machine_state,
    CASE WHEN event_id % 11 <> 3 THEN 20 + value * 0.1 END AS temperature_c,
    CASE WHEN event_id % 13 <> 5 THEN k * 0.1 + (event_id % 7) * 0.05::DOUBLE END AS vibration_mm_s,
    CASE WHEN user_id % 15 = 0 THEN 5.0::DOUBLE ELSE 1 + k * 0.02::DOUBLE + value * 0.01::DOUBLE END AS pressure_bar,
    CASE WHEN event_id % 17 <> 2 THEN value END AS power_kw,
    CASE WHEN event_id % 19 = 0 THEN 0.5::DOUBLE ELSE 100 + k * 10 END AS rotation_rpm, event_id AS "offset", CAST(event_id % 4 AS INTEGER) AS "partition"
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth derived from the samples: a day with high power is an episode."""
    s = samples(spark, sf_dir)
    return s.where(F.col("power_kw") >= 100).select(
        "event_id", "machine_id", "event_time", F.lit(True).alias("is_anomaly"),
        F.when(F.col("offset") % 3 == 0, "OVERHEAT").when(F.col("offset") % 3 == 1, "POWER_SURGE").otherwise("BEARING_WEAR").alias("anomaly_type"),
        F.concat_ws("-", F.lit("EP"), "machine_id", F.date_format("event_time", "yyyyMMdd")).alias("episode_id"),
        (F.col("event_time") + F.make_dt_interval(secs=(F.col("offset") % 97).cast("decimal(18,6)"))).alias("emitted_at"),
        F.when(F.col("offset") % 5 == 0, "OPERATOR").otherwise("SIMULATOR").alias("source"),
    )


LABELS = """labelled AS (
  SELECT event_id, machine_id, event_time, TRUE AS is_anomaly,
    CASE "offset" % 3 WHEN 0 THEN 'OVERHEAT' WHEN 1 THEN 'POWER_SURGE' ELSE 'BEARING_WEAR' END AS anomaly_type,
    'EP-' || machine_id || '-' || strftime(event_time, '%Y%m%d') AS episode_id, event_time + to_seconds("offset" % 97) AS emitted_at,
    CASE WHEN "offset" % 5 = 0 THEN 'OPERATOR' ELSE 'SIMULATOR' END AS source
  FROM samples WHERE power_kw >= 100
)"""


#: Rows of a file of a topic: files of bounded size, so that a large topic is read by many tasks and none of them by its length.
FILE_ROWS = {"maxRecordsPerFile": "200000"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples encoded as raw messages; every few rows one is broken, foreign, incomplete or has a bad instant."""
    return spark.read.parquet(topic(spark, sf_dir))


def topic(spark: SparkSession, sf_dir: str) -> str:
    """The folder that ``records`` are written to."""
    s = samples(spark, sf_dir)
    fault = F.col("offset") % 50
    message = F.struct(
        F.when(fault == 1, "2.0").when(fault == 2, F.lit(None)).otherwise("1.0").alias("schema_version"), "event_id",
        F.when(fault != 3, F.col("machine_id")).alias("machine_id"), "line_id",
        F.when(fault == 4, "yesterday").otherwise(S.format_instant(F.col("event_time"))).alias("event_time"),
        S.format_instant(F.col("ingest_time")).alias("ingest_time"), "machine_state", F.struct(*C.SENSORS).alias("readings"),
    )
    text = F.to_json(message, {"ignoreNullFields": "false"})
    path = scratch(spark, "topic")  # messages are bytes at rest, as in a topic
    s.select(
        F.lit("telemetry.raw").alias("topic"), "partition", "offset", F.encode("machine_id", "UTF-8").alias("key"),
        F.encode(F.when(fault == 5, F.substring(text, 1, 40)).otherwise(text), "UTF-8").alias("value"),
    ).write.options(**FILE_ROWS).parquet(path)
    return path


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as stored alerts."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("alert_id"), F.col("o_custkey").alias("machine_id"),
        F.when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "ACKNOWLEDGED").when(k % 3 == 0, "DISMISSED").otherwise("RESOLVED").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH").otherwise("MEDIUM").alias("severity"),
        (F.col("o_totalprice") / 500_000).alias("anomaly_score"), F.col("o_orderdate").alias("detected_at"), (k % 5).alias("version"),
    )


ALERTS = """alerts AS (
  SELECT o_orderkey AS alert_id, o_custkey AS machine_id,
    CASE WHEN o_orderstatus = 'O' THEN 'NEW' WHEN o_orderstatus = 'P' THEN 'ACKNOWLEDGED' WHEN o_orderkey % 3 = 0 THEN 'DISMISSED' ELSE 'RESOLVED' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    o_totalprice / 500000 AS anomaly_score, o_orderdate AS detected_at, o_orderkey % 5 AS version FROM orders
)"""


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as the machine dimension; the nation names the line."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("machine_id"), F.col("c_name").alias("code"), F.col("n_name").alias("line_code"))


MACHINES = "machines AS (SELECT c_custkey AS machine_id, c_name AS code, n_name AS line_code FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as the history of alerts: odd lines acknowledge, even ones resolve."""
    first = F.col("l_linenumber") % 2 == 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("alert_id"), F.when(first, "NEW").otherwise("ACKNOWLEDGED").alias("previous_status"),
        F.when(first, "ACKNOWLEDGED").otherwise("RESOLVED").alias("new_status"), F.col("l_shipdate").alias("occurred_at"), "l_linenumber", "l_partkey", "l_extendedprice",
    )


ACKS = """acks AS (
  SELECT l_orderkey AS alert_id, CASE WHEN l_linenumber % 2 = 1 THEN 'NEW' ELSE 'ACKNOWLEDGED' END AS previous_status,
    CASE WHEN l_linenumber % 2 = 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS new_status, l_shipdate AS occurred_at, l_linenumber, l_partkey, l_extendedprice FROM lineitem
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def micros(c: str | Column) -> Column:
    return F.unix_micros(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, instants as microseconds since 1970: what both engines print alike."""
    out = {}
    for c, kind in df.dtypes:
        if kind == "double":
            out[c] = near(c, digits) + 0.0
        elif kind == "timestamp":
            out[c] = F.unix_micros(c)
    return df.withColumns(out) if out else df


def window_sql(window: int = WINDOW, slide: int = SLIDE, source: str = "samples", name: str = "windowed") -> str:
    """Samples with their covering windows (epoch seconds)."""
    return f"""{name} AS (
  SELECT s.*, (epoch_us(event_time) // 1000000 // {slide}) * {slide} - i * {slide} AS window_start
  FROM {source} s, range({window // slide}) t(i)
)"""


def features_sql(source: str = "windowed", name: str = "features", digits: int | None = None) -> str:
    """The 52 features per machine and window, written from the contract's names."""
    shape = (lambda x: f"round({x}, {digits}) + 0") if digits is not None else (lambda x: x)
    prepared = "*, " + ", ".join(f"CASE WHEN rotation_rpm >= 1 THEN {s} / rotation_rpm END AS {r}" for r, s in C.RATIOS.items())
    cols, out = [], {}
    for s in (*C.SENSORS, *C.RATIOS):
        cols += [f"avg({s}) AS {s}_mean", f"CASE WHEN count({s}) > 1 THEN stddev_samp({s}) END AS {s}_stddev", f"min({s}) AS {s}_min", f"max({s}) AS {s}_max",
                 f"arg_min({s}, event_time) FILTER (WHERE {s} IS NOT NULL) AS {s}_first", f"arg_max({s}, event_time) FILTER (WHERE {s} IS NOT NULL) AS {s}_last",
                 f"(epoch_us(max(event_time) FILTER (WHERE {s} IS NOT NULL)) - epoch_us(min(event_time) FILTER (WHERE {s} IS NOT NULL))) / 1e6 AS {s}_elapsed"]
        out |= {f"{s}_{k}": f"{s}_{k}" for k in ("mean", "stddev", "min", "max")}
        out[f"{s}_range"] = f"{s}_max - {s}_min"
        out[f"{s}_slope_per_second"] = f"CASE WHEN {s}_elapsed > 0 THEN ({s}_last - {s}_first) / {s}_elapsed END"
        out[f"{s}_deviation_from_mean"] = f"{s}_last - {s}_mean"
        out[f"{s}_zscore_last"] = f"CASE WHEN {s}_stddev > 0 THEN ({s}_last - {s}_mean) / {s}_stddev END"
    for a, b in C.CORRELATED:
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        cols.append(
            f"CASE WHEN count(*) FILTER (WHERE {both}) >= 2 AND min({a}) FILTER (WHERE {both}) < max({a}) FILTER (WHERE {both})"
            f" AND min({b}) FILTER (WHERE {both}) < max({b}) FILTER (WHERE {both})"
            f" THEN greatest(-1, least(1, corr({a}, {b}))) END AS corr_{a}__{b}"
        )
    out["null_ratio"] = "nulls / (sample_count * 5.0)"
    cols += ["count(*) AS sample_count", "sum(" + " + ".join(f"({s} IS NULL)::INT" for s in C.SENSORS) + ") AS nulls",
             "avg(CASE WHEN machine_state = 'RUNNING' THEN 1.0 ELSE 0.0 END) AS running_ratio", "min(event_time) AS first_event", "max(event_time) AS last_event",
             "arg_max(machine_state, event_time) AS machine_state", "arg_max(line_id, event_time) AS line_id"]
    final = ", ".join(f"{n} AS {n}" if n == "sample_count" else f"{shape(out.get(n, n))} AS {n}" for n in C.feature_names())
    return f"""{name} AS (
  SELECT machine_id, window_start, line_id, running_ratio, machine_state, first_event, last_event, {final}
  FROM (SELECT machine_id, window_start, {', '.join(cols)} FROM (SELECT {prepared} FROM {source}) GROUP BY ALL)
)"""


def features(spark: SparkSession, sf_dir: str, window: int = WINDOW, slide: int = SLIDE) -> DataFrame:
    """Features of the samples' windows, window bounds in epoch seconds."""
    return features_of(samples(spark, sf_dir), window, slide)


def features_of(samples: DataFrame, window: int = WINDOW, slide: int = SLIDE) -> DataFrame:
    from telemill.operators.features import window_features

    return window_features(samples, window, slide).withColumns(
        {"window_start": F.unix_seconds("window_start"), "window_end": F.unix_seconds("window_end")}
    )

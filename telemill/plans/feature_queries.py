"""Queries on windows and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S
from telemill.operators import detectors, policy
from telemill.operators import features as X
from telemill.plans import tables as t
from telemill.plans.registry import near, query

KEYS = ["machine_id", "window_start"]
BASE = t.with_(t.SAMPLES, t.window_sql(), t.features_sql())
PLAIN = t.with_(t.SAMPLES, t.window_sql(t.WINDOW, t.WINDOW), t.features_sql())


def pick(name: str, *columns: str) -> None:
    """Register a query for some columns of the feature table."""
    sql = BASE + "SELECT machine_id, window_start, " + ", ".join(c if c in ("sample_count", "machine_state", "line_id") else f"round({c}, 6) + 0 AS {c}" for c in columns) + " FROM features"
    query(name, sql)(lambda spark, d: t.rounded(t.features(spark, d).select(*KEYS, *columns)))


for _kind in ("mean", "min", "max", "range", "deviation_from_mean", "zscore_last"):
    pick(f"agg_{_kind}", *[f"{s}_{_kind}" for s in C.SENSORS])
pick("agg_stddev_samp", *[f"{s}_stddev" for s in (*C.SENSORS, *C.RATIOS)])
pick("agg_slope", *[f"{s}_slope_per_second" for s in (*C.SENSORS, *C.RATIOS)])
pick("agg_corr", *[f"corr_{a}__{b}" for a, b in C.CORRELATED])
pick("agg_count", "sample_count")
pick("agg_null_ratio", "null_ratio")
pick("agg_running_ratio", "running_ratio")
pick("agg_last_state", "machine_state")
pick("agg_last_line", "line_id")
pick("agg_feature_vector", *C.feature_names())
pick("udaf_feature_spec", "sample_count", "power_per_rpm_mean", "corr_power_kw__rotation_rpm")
pick("fn_power_per_rpm", "power_per_rpm_mean", "power_per_rpm_stddev", "power_per_rpm_slope_per_second")
pick("fn_vibration_per_rpm", "vibration_per_rpm_mean", "vibration_per_rpm_stddev", "vibration_per_rpm_slope_per_second")
pick("win_sliding", "sample_count", "temperature_c_mean")


@query("win_tumbling", PLAIN + "SELECT machine_id, window_start, sample_count, round(temperature_c_mean, 6) + 0 AS temperature_c_mean FROM features")
def win_tumbling(spark, d):
    return t.rounded(t.features(spark, d, t.WINDOW, t.WINDOW).select(*KEYS, "sample_count", "temperature_c_mean"))


@query("win_assign_expand", t.with_(t.SAMPLES, t.window_sql()) + "SELECT event_id, window_start FROM windowed")
def win_assign_expand(spark, d):
    return X.assign_windows(t.samples(spark, d), t.WINDOW, t.SLIDE).select("event_id", "window_start")


@query("udtf_assign_windows", t.with_(t.SAMPLES, t.window_sql(43_200, t.SLIDE)) + "SELECT window_start, count(*) AS n FROM windowed GROUP BY 1")
def udtf_assign_windows(spark, d):
    return X.assign_windows(t.samples(spark, d), 43_200, t.SLIDE).groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


@query("agg_coverage", BASE + "SELECT machine_id, window_start, epoch_us(first_event) AS first_us, epoch_us(last_event) AS last_us FROM features")
def agg_coverage(spark, d):
    return t.features(spark, d).select(*KEYS, t.micros("first_event").alias("first_us"), t.micros("last_event").alias("last_us"))


@query("agg_sum", t.with_(t.SAMPLES) + "SELECT machine_id, round(sum(power_kw), 4) AS power, count(power_kw) AS n FROM samples GROUP BY 1")
def agg_sum(spark, d):
    return t.samples(spark, d).groupBy("machine_id").agg(near(F.sum("power_kw"), 4).alias("power"), F.count("power_kw").alias("n"))


@query("agg_first_last_by_time", t.with_(t.SAMPLES, t.window_sql()) + """
SELECT machine_id, window_start, round(arg_min(power_kw, event_time) FILTER (WHERE power_kw IS NOT NULL), 6) AS first_power,
  round(arg_max(power_kw, event_time) FILTER (WHERE power_kw IS NOT NULL), 6) AS last_power FROM windowed GROUP BY ALL""")
def agg_first_last_by_time(spark, d):
    rows = X.sliding(t.samples(spark, d), t.WINDOW, t.SLIDE)
    return rows.select("machine_id", F.unix_seconds("window_start").alias("window_start"), near("_power_kw_first", 6).alias("first_power"), near("_power_kw_last", 6).alias("last_power"))


@query("pane_features", t.with_(t.SAMPLES, t.window_sql(), t.features_sql()) + "SELECT machine_id, window_start, " + ", ".join(f"round({c}, 6) + 0 AS {c}" if c != "sample_count" else c for c in C.feature_names()) + ", TRUE AS same FROM features")
def pane_features(spark, d):
    """All 52 features from panes, and whether each equals that of windows aggregated sample by sample to a billionth."""
    panes, direct = X.pane_features(t.samples(spark, d), t.WINDOW, t.SLIDE), X.derived(X.sliding(t.samples(spark, d), t.WINDOW, t.SLIDE))
    direct = direct.select("machine_id", F.unix_seconds("window_start").alias("window_start"), *[F.col(c).alias(f"_{c}") for c in C.feature_names()])
    same = F.lit(True)
    for c in C.feature_names():
        a, b = F.col(c), F.col(f"_{c}")
        same &= a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b)), F.lit(False))
    return t.rounded(panes.join(direct, KEYS, "full_outer").select(*KEYS, *C.feature_names(), same.alias("same")))


@query("join_range_window_samples", t.with_(t.SAMPLES, t.window_sql()) + "SELECT machine_id, window_start, count(*) AS n FROM windowed GROUP BY ALL")
def join_range_window_samples(spark, d):
    """Membership by interval, as a cross-check of the expansion: an equi-join on day buckets with the range condition on top."""
    s = t.samples(spark, d).withColumn("at", F.floor(F.unix_micros("event_time") / 1_000_000))
    windows = X.assign_windows(t.samples(spark, d), t.WINDOW, t.SLIDE).select(*KEYS).distinct()
    spread = windows.withColumn("bucket", F.explode(F.array(F.floor(F.col("window_start") / t.WINDOW), F.floor(F.col("window_start") / t.WINDOW) + 1)))
    a, b = s.withColumn("bucket", F.floor(F.col("at") / t.WINDOW)), spread.withColumnRenamed("machine_id", "m")
    hit = (a["bucket"] == b["bucket"]) & (F.col("machine_id") == F.col("m")) & (F.col("at") >= F.col("window_start")) & (F.col("at") < F.col("window_start") + t.WINDOW)
    return a.join(b, hit).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


MATURE = f"""greatest(epoch_us(first_event) / 1e6 - window_start, window_start + {t.WINDOW} - epoch_us(last_event) / 1e6, 0) * (sample_count - 1)
  <= (epoch_us(last_event) - epoch_us(first_event)) / 1e6 * 2.0 AND sample_count >= 2 AND last_event > first_event"""
SKIP = f"""CASE WHEN sample_count < {t.GATE} THEN 'INSUFFICIENT_SAMPLES' WHEN running_ratio < 0.9 OR machine_state <> 'RUNNING' THEN 'MACHINE_NOT_RUNNING'
  WHEN NOT ({MATURE}) THEN 'WINDOW_NOT_MATURE' END"""


def stamped(spark, d):
    """Features with their bounds as instants, as the admission rules take them."""
    return t.features(spark, d).withColumns({c: F.timestamp_seconds(c) for c in ("window_start", "window_end")})


@query("prj_maturity", BASE + f"SELECT machine_id, window_start, ({MATURE}) AS is_mature FROM features")
def prj_maturity(spark, d):
    return stamped(spark, d).select("machine_id", F.unix_seconds("window_start").alias("window_start"), policy.is_mature().alias("is_mature"))


@query("prj_admission", BASE + f"SELECT machine_id, window_start, {SKIP} AS skip_reason FROM features")
def prj_admission(spark, d):
    return stamped(spark, d).select("machine_id", F.unix_seconds("window_start").alias("window_start"), policy.skip_reason(t.GATE).alias("skip_reason"))


@query("flt_admission_train", BASE + f"SELECT machine_id, window_start, sample_count FROM features WHERE sample_count >= {t.GATE} AND running_ratio >= 0.9")
def flt_admission_train(spark, d):
    return t.features(spark, d).where(policy.admitted_for_training(t.GATE)).select(*KEYS, "sample_count")


@query("prj_severity", t.with_(t.ALERTS) + """SELECT alert_id, CASE WHEN p >= 0.7 THEN 'CRITICAL' WHEN p >= 0.4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT alert_id, (anomaly_score - 0.5) / greatest(1 - 0.5, 1e-9) AS p FROM alerts)""")
def prj_severity(spark, d):
    return t.alerts(spark, d).select("alert_id", policy.severity(F.col("anomaly_score"), F.lit(0.5)).alias("severity"))


@query("fn_null_count", t.with_(t.SAMPLES) + "SELECT event_id, " + " + ".join(f"({s} IS NULL)::INT" for s in C.SENSORS) + " AS nulls FROM samples")
def fn_null_count(spark, d):
    return t.samples(spark, d).select("event_id", S.null_count().alias("nulls"))


@query("fn_features_array", BASE + "SELECT machine_id, window_start, 52 AS n, round(temperature_c_mean, 6) + 0 AS first, round(null_ratio, 6) + 0 AS last FROM features")
def fn_features_array(spark, d):
    a = t.features(spark, d).select(*KEYS, S.feature_array().alias("a"))
    return t.rounded(a.select(*KEYS, F.size("a").alias("n"), F.element_at("a", 1).alias("first"), F.element_at("a", -1).alias("last")))


@query("fn_feature_map", BASE + "SELECT machine_id, window_start, round(power_kw_mean, 6) + 0 AS power FROM features")
def fn_feature_map(spark, d):
    return t.rounded(t.features(spark, d).select(*KEYS, F.try_element_at(S.feature_map(), F.lit("power_kw_mean")).alias("power")))


@query("prj_window_means", BASE + "SELECT machine_id, window_start, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in (*(f"{s}_mean" for s in C.SENSORS), "null_ratio")) + " FROM features")
def prj_window_means(spark, d):
    return t.rounded(t.features(spark, d).select(*KEYS, *policy.window_means(S.feature_map())))


FIVE = [f"{s}_mean" for s in C.SENSORS]
SIGMA = BASE + ", stats AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) > 1e-12 THEN stddev_samp({c}) ELSE 1 END AS s_{c}" for c in FIVE) + " FROM features)\n"
SIGMA_SCORE = "greatest(" + ", ".join(f"abs(({c} - m_{c}) / s_{c})" for c in FIVE) + ")"


@query("ml_three_sigma", SIGMA + f"SELECT machine_id, window_start, round({SIGMA_SCORE}, 6) + 0 AS raw_score FROM features, stats")
def ml_three_sigma(spark, d):
    f = t.features(spark, d)
    return t.rounded(f.select(*KEYS, detectors.three_sigma(detectors.fit_three_sigma(f, FIVE)).alias("raw_score")))


@query("flagship_scored_windows", SIGMA + f"""SELECT machine_id, window_start, sample_count, round(score, 6) + 0 AS score,
  CASE WHEN p >= 0.7 THEN 'CRITICAL' WHEN p >= 0.4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, skip_reason
FROM (SELECT *, (score - 0.5) / 0.5 AS p FROM (SELECT *, {SIGMA_SCORE} / (1 + {SIGMA_SCORE}) AS score, {SKIP} AS skip_reason FROM features, stats))""")
def flagship_scored_windows(spark, d):
    """Samples to windows, features, scores, grades and the admission verdict."""
    f = stamped(spark, d)
    raw = detectors.three_sigma(detectors.fit_three_sigma(f, FIVE))
    scored = f.withColumn("score", raw / (1 + raw))
    return t.rounded(scored.select(
        "machine_id", F.unix_seconds("window_start").alias("window_start"), "sample_count", "score", policy.severity(F.col("score"), F.lit(0.5)).alias("severity"),
        policy.skip_reason(t.GATE).alias("skip_reason"),
    ))


Z = "(temperature_c_mean - 25) / 5, (power_kw_mean - 50) / 20, pressure_bar_mean - 2, null_ratio".split(", ")


@query("srt_top_contributors", BASE + "SELECT machine_id, window_start, " + " + ".join(f"({z} IS NOT NULL)::BIGINT" for z in Z)
       + " AS n, round(greatest(" + ", ".join(f"abs({z})" for z in Z) + "), 6) + 0 AS most FROM features")
def srt_top_contributors(spark, d):
    names = F.array(*map(F.lit, ("temperature", "power", "pressure", "nulls")))
    z = F.array(*[F.expr(x).cast("double") for x in Z])
    rows = t.features(spark, d).select(*KEYS, policy.top_contributors(names, z, 4).alias("top"))
    return t.rounded(rows.select(*KEYS, F.size("top").cast("long").alias("n"), F.abs(F.col("top")[0]["z_score"]).alias("most")))


@query("prj_scored_event", SIGMA + f"""SELECT machine_id, window_start, skip_reason IS NULL AS is_scored, skip_reason, CASE WHEN skip_reason IS NULL THEN round(score, 6) + 0 END AS anomaly_score,
  CASE WHEN skip_reason IS NULL THEN score >= 0.6 END AS is_anomaly, round(null_ratio, 6) + 0 AS null_ratio, 5000::BIGINT AS processing_delay_ms
FROM (SELECT *, {SIGMA_SCORE} / (1 + {SIGMA_SCORE}) AS score, {SKIP} AS skip_reason FROM features, stats)""")
def prj_scored_event(spark, d):
    return t.rounded(scored_events(spark, d).select(
        "machine_id", F.unix_seconds("window_start").alias("window_start"), "is_scored", "skip_reason", "anomaly_score", "is_anomaly",
        F.try_element_at("features", F.lit("null_ratio")).alias("null_ratio"), "processing_delay_ms",
    ))


MODEL = {"name": "three_sigma", "version": "1.0.0", "trained_at": "2024-01-01T00:00:00.000Z", "artifact_sha256": "0" * 64}


def scored_events(spark, d):
    f = stamped(spark, d)
    raw = detectors.three_sigma(detectors.fit_three_sigma(f, FIVE))
    z = F.array(*[F.col(n).cast("double") for n in C.feature_names()])
    rows = f.withColumns({"raw_score": raw, "score": raw / (1 + raw), "threshold": F.lit(0.6), "z": z})
    return policy.scored_event(rows, MODEL, F.col("window_end") + F.expr("INTERVAL 5 SECONDS"), min_samples=t.GATE)


@query("flt_scored_anomalous", SIGMA + f"""SELECT machine_id, window_start, round(score, 6) + 0 AS anomaly_score, 'three_sigma' AS model_name
FROM (SELECT *, {SIGMA_SCORE} / (1 + {SIGMA_SCORE}) AS score, {SKIP} AS skip_reason FROM features, stats) WHERE skip_reason IS NULL AND score >= 0.6""")
def flt_scored_anomalous(spark, d):
    return t.rounded(policy.anomalous(scored_events(spark, d)).select("machine_id", F.unix_seconds("window_start").alias("window_start"), "anomaly_score", "model_name"))

"""The stores' constraints as queries for the rows that break them, and checks of incoming messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def without_parent(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return rows.join(parent.select(key), key, "left_anti")


def failing(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with ``violations``: the sorted names of the checks that do not hold (null counts as holding, as in SQL)."""
    found = F.array_sort(F.array_compact(F.array(*[F.when(~check, F.lit(name)) for name, check in checks.items()])))
    return rows.withColumn("violations", F.array_join(found, "; ")).where(F.col("violations") != "")


def alert_checks() -> dict[str, Column]:
    return {
        "status": F.col("status").isin(*C.ALERT_STATUSES), "severity": F.col("severity").isin(*C.SEVERITIES),
        "anomaly_score": F.col("anomaly_score").between(0, 1), "score_threshold": F.col("score_threshold").between(0, 1),
        "window_order": F.col("window_end") > F.col("window_start"), "detected_at": F.col("detected_at") == F.col("window_end"),
        "consecutive_windows": F.col("consecutive_windows") >= 1,
    }


def wrong_alert_ids(alerts: DataFrame) -> DataFrame:
    """Alerts whose identifier is not the one their parts give."""
    return alerts.where(~F.col("alert_id").eqNullSafe(S.alert_id(F.col("machine_id"), F.col("window_start"), F.col("model_name"), F.col("model_version"))))


def _messages(fields: dict[str, tuple[Column, str]]) -> Column:
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{n} {m}")) for n, (ok, m) in fields.items()]))), "; ")


def consumed_alerts(records: DataFrame) -> DataFrame:
    """Records (``value`` as text) with ``reject_reason`` and ``reject_detail``, both null for an alert that may be stored."""
    m = F.from_json("value", C.ALERT_DDL + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = records.withColumn("m", m)
    get = lambda n: F.col(f"m.{n}")
    version = F.coalesce(get("schema_version").rlike(r"^1\.[0-9]+$"), F.lit(False))
    fields = {
        "schemaVersion": (version, "unsupported version"), "alertId": (get("alert_id").rlike(C.UUID5_PATTERN), "no UUIDv5"),
        "machineId": (get("machine_id").rlike(C.MACHINE_ID_PATTERN), "malformed"), "lineId": (get("line_id").rlike(C.LINE_ID_PATTERN), "malformed"),
        "severity": (get("severity").isin(*C.SEVERITIES), "unknown"), "anomalyScore": (get("anomaly_score").between(0, 1), "out of range"),
        "scoreThreshold": (get("score_threshold").between(0, 1), "out of range"),
        "consecutiveWindows": (F.coalesce(get("consecutive_windows"), F.lit(1)) >= 1, "below 1"), "model": (get("model").isNotNull(), "missing"),
        **{a: (S.parse_instant(get(b)).isNotNull(), "missing") for a, b in (
            ("detectedAt", "detected_at"), ("windowStart", "window_start"), ("windowEnd", "window_end"), ("publishedAt", "published_at"))},
    }
    detail = _messages(fields)
    start, end, found = (S.parse_instant(get(n)) for n in ("window_start", "window_end", "detected_at"))
    late_checks = F.when(~(end > start), "window_end must be after window_start").when(found != end, "detected_at must equal window_end")
    broken = F.col("value").isNull() | F.col("m").isNull() | F.col("m._bad").isNotNull()
    return rows.select(
        *records.columns,
        F.when(broken, "MALFORMED_JSON").when(~version, "UNSUPPORTED_SCHEMA_VERSION")
        .when((detail != "") | late_checks.isNotNull(), "SCHEMA_VALIDATION_FAILED").alias("reject_reason"),
        F.when(F.col("value").isNull(), "tombstone").when(broken, "payload is not valid JSON").when(detail != "", detail).otherwise(late_checks).alias("reject_detail"),
    )


def consumed_windows(records: DataFrame) -> DataFrame:
    """As ``consumed_alerts``, for scored windows; the rejected ones are dropped by the caller, not dead-lettered."""
    m = F.from_json("value", C.SCORED_DDL + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = records.withColumn("m", m)
    get = lambda n: F.col(f"m.{n}")
    fields = {
        "schemaVersion": (get("schema_version").rlike(r"^1\.[0-9]+$"), "unsupported version"), "machineId": (get("machine_id").rlike(C.MACHINE_ID_PATTERN), "malformed"),
        "lineId": (get("line_id").rlike(C.LINE_ID_PATTERN), "malformed"), "sampleCount": (get("sample_count") >= 0, "below 0"),
        "windowStart": (S.parse_instant(get("window_start")).isNotNull(), "missing"), "windowEnd": (S.parse_instant(get("window_end")).isNotNull(), "missing"),
    }
    detail = _messages(fields)
    order = F.when(~(S.parse_instant(get("window_end")) > S.parse_instant(get("window_start"))), "window_end must be after window_start")
    broken = F.col("value").isNull() | F.col("m").isNull() | F.col("m._bad").isNotNull()
    return rows.select(
        *records.columns, F.when(broken, "MALFORMED_JSON").when((detail != "") | order.isNotNull(), "SCHEMA_VALIDATION_FAILED").alias("reject_reason"),
        F.when(F.col("value").isNull(), "tombstone").when(broken, "payload is not valid JSON").when(detail != "", detail).otherwise(order).alias("reject_detail"),
    )


LABEL_COLUMNS = ("is_anomaly", "anomaly_type", "episode_id", "anomaly_fraction", "anomalous_samples")


def leakage(features: DataFrame, split_windows: DataFrame) -> DataFrame:
    """(check, found): label columns among the features, and pairs of neighbouring splits whose windows overlap in time."""
    columns = sum(c in LABEL_COLUMNS for c in features.columns)
    spans = split_windows.groupBy("split").agg(F.min("window_start").alias("a"), F.max("window_end").alias("b"))
    pairs = spans.alias("x").join(spans.alias("y"), (F.col("x.split") < F.col("y.split")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b")))  # three rows
    return pairs.agg(F.lit("overlapping_splits").alias("check"), F.count(F.lit(1)).alias("found")).unionByName(
        features.sparkSession.range(1).select(F.lit("label_columns").alias("check"), F.lit(columns).cast("long").alias("found"))
    )

"""Queries over stored alerts and windows: search, pages, series, statistics, lifecycle.

alerts: alert_id, machine_id, status, severity, anomaly_score, detected_at, ... ; machines: machine_id,
code, line_code; acknowledgements: alert_id, previous_status, new_status, occurred_at, ...
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.operators.ranking import quantile_columns

SORTABLE = ("detected_at", "anomaly_score", "severity", "status")
GRANULARITIES = ("hour", "day")
SUMMARY = ("alert_id", "code", "line_code", "severity", "status", "anomaly_score", "detected_at")


def with_machine(alerts: DataFrame, machines: DataFrame) -> DataFrame:
    """Alerts with their machine; a small dimension is broadcast by its measured size, a large one is shuffled."""
    return alerts.join(machines, "machine_id")


def search(
    rows: DataFrame, machine: str | None = None, line: str | None = None, severities: list[str] | None = None, statuses: list[str] | None = None,
    start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    """Rows that meet all conditions given; both ends of the time range count."""
    wanted = [
        F.col("code") == machine if machine else None, F.col("line_code") == line if line else None,
        F.col("severity").isin(*severities) if severities else None, F.col("status").isin(*statuses) if statuses else None,
        F.col("detected_at") >= start if start is not None else None, F.col("detected_at") <= end if end is not None else None,
    ]
    return rows.where(reduce(Column.__and__, [c for c in wanted if c is not None], F.lit(True)))


def page(rows: DataFrame, number: int = 0, size: int = 20, sort: str = "detected_at", descending: bool = True, most: int = 100) -> DataFrame:
    """One page with ``total``; ties are ordered by alert_id, so pages never overlap."""
    if sort not in SORTABLE:
        raise ValueError(f"rows cannot be sorted by {sort}")
    size = max(1, min(size, most))
    order = F.desc(sort) if descending else F.asc(sort)
    picked = rows.orderBy(order, "alert_id").offset(number * size).limit(size)
    return picked.crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))  # one row


def series(windows: DataFrame, machine: str, start: Column, end: Column, most: int = 500, cap: int = 5000) -> DataFrame:
    """One machine's windows in order, with ``truncated`` when there are more than asked for."""
    n = max(1, min(most, cap))
    rows = windows.where((F.col("machine_id") == machine) & F.col("window_start").between(start, end)).orderBy("window_start").limit(n + 1)
    numbered = rows.withColumn("_n", F.row_number().over(W.orderBy("window_start"))).withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy()) > n)
    return numbered.where(F.col("_n") <= n).drop("_n")  # n + 1 rows at most reach the window


def after_cursor(alerts: DataFrame, cursor: int, severities: list[str] | None = None, line: str | None = None, most: int = 500) -> DataFrame:
    return search(alerts, line=line, severities=severities).where(F.col("event_seq") > cursor).orderBy("event_seq").limit(most)


def newest(alerts: DataFrame, n: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("detected_at"), "alert_id").limit(n)


def top_machines(rows: DataFrame, n: int = 10, most: int = 50) -> DataFrame:
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("alerts")).orderBy(F.desc("alerts"), "code").limit(min(n, most))


def count_by(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.groupBy(column).agg(F.count(F.lit(1)).alias("alerts"))


def count_over_time(alerts: DataFrame, granularity: str) -> DataFrame:
    if granularity not in GRANULARITIES:
        raise ValueError(f"no such granularity: {granularity}")
    return alerts.groupBy(F.date_trunc(granularity, "detected_at").alias("bucket")).agg(F.count(F.lit(1)).alias("alerts"))


def acknowledgement_rate(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.coalesce(F.avg((F.col("status") != "NEW").cast("double")), F.lit(0.0)).alias("ack_rate"))


def first_acknowledgements(acknowledgements: DataFrame) -> DataFrame:
    return acknowledgements.where("new_status = 'ACKNOWLEDGED'").groupBy("alert_id").agg(F.min("occurred_at").alias("acknowledged_at"))


def seconds_to_acknowledge(alerts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    took = (F.unix_micros("acknowledged_at") - F.unix_micros("detected_at")) / 1e6
    return alerts.join(first_acknowledgements(acknowledgements), "alert_id").select("alert_id", took.alias("seconds"))


def median_time_to_acknowledge(alerts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    return seconds_to_acknowledge(alerts, acknowledgements).transform(lambda x: quantile_columns(x, [], "seconds", {"median_seconds": 0.5}))


def history(alerts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Alerts with their acknowledgements, newest first."""
    events = acknowledgements.groupBy("alert_id").agg(
        F.sort_array(F.collect_list(F.struct("occurred_at", "previous_status", "new_status")), asc=False).alias("history")
    )
    return alerts.join(events, "alert_id", "left").withColumn("history", F.coalesce("history", F.array()))


def statistics(alerts: DataFrame) -> DataFrame:
    """(kind, value, alerts): counts by severity, by status and in all, in one pass over the alerts."""
    return alerts.groupingSets([["severity"], ["status"], []], "severity", "status").agg(
        F.count(F.lit(1)).alias("alerts"), F.grouping_id().alias("_g")
    ).select(F.when(F.col("_g") == 1, "severity").when(F.col("_g") == 2, "status").otherwise("all").alias("kind"), F.coalesce("severity", "status").alias("value"), "alerts")


def acknowledge(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each request (request_id, alert_id, expected_version, requested_at): applied, or why it conflicts.

    The first request of an alert can apply; only NEW alerts of the expected version (if one is expected) can be acknowledged.
    """
    turn = F.row_number().over(W.partitionBy("alert_id").orderBy("requested_at", "request_id"))
    joined = requests.withColumn("_turn", turn).join(alerts.select("alert_id", "status", "version"), "alert_id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status") != "NEW", "NOT_NEW")
        .when(F.col("expected_version").isNotNull() & (F.col("expected_version") != F.col("version")), "STALE_VERSION")
    )
    # an earlier request that applied takes the alert
    first = F.min(F.when(outcome.isNull(), F.col("_turn"))).over(W.partitionBy("alert_id"))
    outcome = outcome.isNull() & (F.col("_turn") > first), outcome
    return joined.withColumn("outcome", F.when(outcome[0], "NOT_NEW").otherwise(F.coalesce(outcome[1], F.lit("APPLIED")))).drop("_turn")


# The transitions that the life of an alert allows.
TRANSITIONS = (("NEW", "ACKNOWLEDGED"), ("NEW", "DISMISSED"), ("ACKNOWLEDGED", "RESOLVED"), ("ACKNOWLEDGED", "DISMISSED"))


def transition(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of requests (alert_id, target): the allowed transitions apply, others conflict."""
    allowed = reduce(Column.__or__, [(F.col("status") == a) & (F.col("target") == b) for a, b in TRANSITIONS])
    return requests.join(alerts.select("alert_id", "status"), "alert_id", "left").withColumn(
        "outcome", F.when(F.col("status").isNull(), "NOT_FOUND").when(allowed, "APPLIED").otherwise("CONFLICT")
    )


def observed_precision(alerts: DataFrame) -> DataFrame:
    """Share of resolved among closed alerts, and its complement; null without closed alerts."""
    p = F.try_divide(F.count_if(F.col("status") == "RESOLVED"), F.count_if(F.col("status").isin("RESOLVED", "DISMISSED")))
    return alerts.agg(p.alias("observed_precision"), (1 - p).alias("false_positive_rate"))


def live_counters(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("MEDIUM", "HIGH", "CRITICAL")], F.count_if(F.col("status") == "NEW").alias("unread")
    )


def chart_series(windows: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """Long form (machine_id, window_start, signal, value, is_marker): a null value breaks the line, markers sit on anomalies that have a value."""
    long = windows.select("machine_id", "window_start", "is_anomaly", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])).alias("e"))
    return long.select("machine_id", "window_start", "e.signal", "e.value", (F.coalesce("is_anomaly", F.lit(False)) & F.col("e.value").isNotNull()).alias("is_marker"))

"""Queries on stored alerts: search, pages, statistics, lifecycle, constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S
from telemill.operators import constraints, service
from telemill.plans import tables as t
from telemill.plans.registry import query

ALL = t.with_(t.ALERTS, t.MACHINES, t.ACKS)
FROM, TO = 852076800, 915148800  # 1997 and 1998, in epoch seconds
JOINED = "alerts JOIN machines USING (machine_id)"
COLUMNS = "alert_id, code, line_code, severity, status, anomaly_score, epoch_us(detected_at) AS detected_at"


def joined(spark, d):
    return service.with_machine(t.alerts(spark, d), t.machines(spark, d))


def summary(rows):
    return rows.select(*service.SUMMARY).withColumn("detected_at", F.unix_micros("detected_at"))


@query("join_alert_machine", ALL + f"SELECT {COLUMNS} FROM {JOINED}")
def join_alert_machine(spark, d):
    return summary(joined(spark, d))


@query("prj_alert_summary", ALL + f"SELECT {COLUMNS} FROM {JOINED} WHERE status = 'NEW'")
def prj_alert_summary(spark, d):
    return summary(service.search(joined(spark, d), statuses=["NEW"]))


@query("flt_alert_search", ALL + f"SELECT {COLUMNS} FROM {JOINED} WHERE severity IN ('HIGH', 'CRITICAL') AND status IN ('NEW', 'ACKNOWLEDGED') AND line_code = 'FRANCE' AND detected_at BETWEEN to_timestamp({FROM})::TIMESTAMP AND to_timestamp({TO})::TIMESTAMP")
def flt_alert_search(spark, d):
    return summary(service.search(joined(spark, d), line="FRANCE", severities=["HIGH", "CRITICAL"], statuses=["NEW", "ACKNOWLEDGED"],
                                  start=F.timestamp_seconds(F.lit(FROM)), end=F.timestamp_seconds(F.lit(TO))))


@query("srt_page", ALL + f"SELECT {COLUMNS}, (SELECT count(*) FROM {JOINED}) AS total FROM {JOINED} ORDER BY severity, alert_id LIMIT 20 OFFSET 40")
def srt_page(spark, d):
    rows = service.page(joined(spark, d), 2, 20, "severity", descending=False)
    return rows.select(*service.SUMMARY, "total").withColumn("detected_at", F.unix_micros("detected_at"))


@query("srt_series", """SELECT l_suppkey AS machine_id, epoch_us(l_shipdate) AS window_start, l_orderkey, n > 50 AS truncated FROM (
  SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r, count(*) OVER () AS n FROM lineitem WHERE l_suppkey = 7 AND l_shipdate >= TIMESTAMP '1996-01-01') WHERE r <= 50 AND l_orderkey >= 0""")
def srt_series(spark, d):
    rows = t.table(spark, d, "lineitem").where("l_suppkey = 7").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    # distinct instants: the day plus the row's own place, so that the order is total
    windows = rows.select(F.col("l_suppkey").cast("string").alias("machine_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("window_start"))
    low, high = (F.struct(F.timestamp_seconds(F.lit(s)).alias("l_shipdate"), F.lit(k).cast("long").alias("l_orderkey"), F.lit(n).alias("l_linenumber")) for s, k, n in ((820454400, -1, 0), (4102444800, 0, 0)))
    got = service.series(windows, "7", low, high, 50)
    return got.select(F.col("machine_id").cast("long").alias("machine_id"), F.unix_micros("window_start.l_shipdate").alias("window_start"), F.col("window_start.l_orderkey").alias("l_orderkey"), "truncated")


@query("srt_cursor_replay", ALL + f"SELECT {COLUMNS} FROM {JOINED} WHERE alert_id > 1000 AND severity IN ('CRITICAL') ORDER BY alert_id LIMIT 500")
def srt_cursor_replay(spark, d):
    return summary(service.after_cursor(joined(spark, d).withColumn("event_seq", F.col("alert_id")), 1000, ["CRITICAL"]))


@query("srt_live_feed", ALL + f"SELECT {COLUMNS} FROM {JOINED} ORDER BY alerts.detected_at DESC, alert_id LIMIT 100")
def srt_live_feed(spark, d):
    return summary(service.newest(joined(spark, d)))


@query("srt_top_machines", ALL + f"SELECT code, count(*) AS alerts FROM {JOINED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def srt_top_machines(spark, d):
    return service.top_machines(joined(spark, d))


@query("srt_head_counts", ALL + "SELECT machine_id, count(*) AS n FROM alerts WHERE status = 'DISMISSED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def srt_head_counts(spark, d):
    rows = t.alerts(spark, d).where("status = 'DISMISSED'").groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "machine_id").limit(10)


@query("agg_count_by", ALL + "SELECT severity, count(*) AS alerts FROM alerts GROUP BY 1")
def agg_count_by(spark, d):
    return service.count_by(t.alerts(spark, d), "severity")


@query("agg_count_over_time", ALL + "SELECT epoch_us(date_trunc('day', detected_at)) AS bucket, count(*) AS alerts FROM alerts GROUP BY 1")
def agg_count_over_time(spark, d):
    return t.rounded(service.count_over_time(t.alerts(spark, d), "day"))


@query("agg_ack_rate", ALL + "SELECT round(avg((status <> 'NEW')::INT), 6) AS ack_rate FROM alerts")
def agg_ack_rate(spark, d):
    return t.rounded(service.acknowledgement_rate(t.alerts(spark, d)))


FIRST = "firsts AS (SELECT alert_id, min(occurred_at) AS acknowledged_at FROM acks WHERE new_status = 'ACKNOWLEDGED' GROUP BY 1)"
WITH_FIRST = t.with_(t.ALERTS, t.ACKS, FIRST)


@query("join_alert_first_ack", WITH_FIRST + "SELECT alert_id, epoch(acknowledged_at) - epoch(detected_at) AS seconds FROM alerts JOIN firsts USING (alert_id)")
def join_alert_first_ack(spark, d):
    return t.rounded(service.seconds_to_acknowledge(t.alerts(spark, d), t.acknowledgements(spark, d)))


@query("agg_median_time_to_ack", WITH_FIRST + "SELECT quantile_cont(epoch(acknowledged_at) - epoch(detected_at), 0.5) AS median_seconds FROM alerts JOIN firsts USING (alert_id)")
def agg_median_time_to_ack(spark, d):
    return t.rounded(service.median_time_to_acknowledge(t.alerts(spark, d), t.acknowledgements(spark, d)))


HISTORY = WITH_FIRST + "SELECT alert_id, status, count(k.occurred_at) AS entries, epoch_us(max(k.occurred_at)) AS newest_us FROM alerts LEFT JOIN acks k USING (alert_id) GROUP BY 1, 2"


@query("join_alert_history", HISTORY)
def join_alert_history(spark, d):
    rows = service.history(t.alerts(spark, d), t.acknowledgements(spark, d))
    return rows.select("alert_id", "status", F.size("history").cast("long").alias("entries"), F.unix_micros(F.try_element_at("history", F.lit(1))["occurred_at"]).alias("newest_us"))


@query("prj_alert_detail", t.with_(t.ALERTS, t.ACKS, t.MACHINES) + """SELECT alert_id, code, line_code, severity, status, round(anomaly_score, 6) + 0 AS anomaly_score, count(k.occurred_at) AS entries,
  string_agg(new_status, '>' ORDER BY occurred_at DESC, k.previous_status DESC, new_status DESC) AS path FROM alerts JOIN machines USING (machine_id) LEFT JOIN acks k USING (alert_id) GROUP BY ALL""")
def prj_alert_detail(spark, d):
    """One alert's view: its own fields, its machine's names and its history, newest first."""
    rows = service.history(t.alerts(spark, d).join(t.machines(spark, d), "machine_id"), t.acknowledgements(spark, d))
    path = F.when(F.size("history") > 0, F.array_join(F.transform("history", lambda h: h["new_status"]), ">"))
    return t.rounded(rows.select("alert_id", "code", "line_code", "severity", "status", "anomaly_score", F.size("history").cast("long").alias("entries"), path.alias("path")))


@query("agg_alert_statistics", ALL + "SELECT 'severity' AS kind, severity AS value, count(*) AS alerts FROM alerts GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM alerts GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM alerts")
def agg_alert_statistics(spark, d):
    return service.statistics(t.alerts(spark, d))


@query("agg_live_counters", ALL + "SELECT " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in C.SEVERITIES) + ", count(*) FILTER (WHERE status = 'NEW') AS unread FROM alerts")
def agg_live_counters(spark, d):
    return service.live_counters(t.alerts(spark, d))


@query("anti_missing_machines", "SELECT DISTINCT o_custkey AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def anti_missing_machines(spark, d):
    known = t.table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("code"))
    return constraints.without_parent(t.table(spark, d, "orders").select(F.col("o_custkey").alias("code")), known, "code").distinct()


@query("set_except_machines", "SELECT o_custkey AS code FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0")
def set_except_machines(spark, d):
    known = t.table(spark, d, "customer").where("c_custkey % 5 <> 0").select("c_custkey")
    return t.table(spark, d, "orders").select(F.col("o_custkey").alias("code")).subtract(known)


REQUESTS = """requests AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS alert_id, l_shipdate AS requested_at, CASE WHEN l_linenumber = 1 THEN 0 END AS expected_version FROM lineitem),
judged AS (SELECT r.*, a.status, a.version, row_number() OVER (PARTITION BY r.alert_id ORDER BY requested_at, request_id) AS turn,
  CASE WHEN a.status IS NULL THEN 'NOT_FOUND' WHEN a.status <> 'NEW' THEN 'NOT_NEW' WHEN expected_version IS NOT NULL AND expected_version <> a.version THEN 'STALE_VERSION' END AS refused
  FROM requests r LEFT JOIN alerts a ON r.alert_id = a.alert_id)"""


@query("lc_acknowledge", t.with_(t.ALERTS, REQUESTS) + """SELECT request_id, CASE WHEN refused IS NOT NULL THEN refused
  WHEN turn > min(turn) FILTER (WHERE refused IS NULL) OVER (PARTITION BY alert_id) THEN 'NOT_NEW' ELSE 'APPLIED' END AS outcome FROM judged""")
def lc_acknowledge(spark, d):
    requests = t.acknowledgements(spark, d).select((F.col("alert_id") * 10 + F.col("l_linenumber")).alias("request_id"), "alert_id", F.col("occurred_at").alias("requested_at"),
                                                   F.when(F.col("l_linenumber") == 1, 0).alias("expected_version"))
    return service.acknowledge(t.alerts(spark, d), requests).select("request_id", "outcome")


@query("lc_resolve_dismiss", t.with_(t.ALERTS) + """SELECT alert_id, target, CASE WHEN (status, target) IN (('NEW', 'ACKNOWLEDGED'), ('NEW', 'DISMISSED'), ('ACKNOWLEDGED', 'RESOLVED'), ('ACKNOWLEDGED', 'DISMISSED'))
  THEN 'APPLIED' ELSE 'CONFLICT' END AS outcome FROM (SELECT *, CASE WHEN alert_id % 2 = 0 THEN 'RESOLVED' ELSE 'DISMISSED' END AS target FROM alerts)""")
def lc_resolve_dismiss(spark, d):
    a = t.alerts(spark, d)
    requests = a.select("alert_id", F.when(F.col("alert_id") % 2 == 0, "RESOLVED").otherwise("DISMISSED").alias("target"))
    return service.transition(a, requests).select("alert_id", "target", "outcome")


@query("st_observed_precision", t.with_(t.ALERTS) + "SELECT round(p, 6) AS observed_precision, round(1 - p, 6) AS false_positive_rate FROM (SELECT count(*) FILTER (WHERE status = 'RESOLVED') / count(*) FILTER (WHERE status IN ('RESOLVED', 'DISMISSED')) AS p FROM alerts)")
def st_observed_precision(spark, d):
    return t.rounded(service.observed_precision(t.alerts(spark, d)))


@query("prj_chart_series", t.with_(t.SAMPLES) + """SELECT event_id AS machine_id, epoch_us(event_time) AS window_start, signal, round(value, 6) + 0 AS value, is_anomaly AND value IS NOT NULL AS is_marker
FROM (SELECT event_id, event_time, pressure_bar > 4 AS is_anomaly, 'power_kw' AS signal, power_kw AS value FROM samples UNION ALL SELECT event_id, event_time, pressure_bar > 4, 'temperature_c', temperature_c FROM samples)""")
def prj_chart_series(spark, d):
    rows = t.samples(spark, d).select(F.col("event_id").alias("machine_id"), F.col("event_time").alias("window_start"), (F.col("pressure_bar") > 4).alias("is_anomaly"), "power_kw", "temperature_c")
    return t.rounded(service.chart_series(rows, ("power_kw", "temperature_c")))


# constraints


@query("dq_unique_natural", "SELECT l_suppkey, epoch_us(l_shipdate) AS l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_unique_natural(spark, d):
    return t.rounded(constraints.repeated(t.table(spark, d, "lineitem"), "l_suppkey", "l_shipdate"))


@query("dq_foreign_key", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def dq_foreign_key(spark, d):
    parent = t.table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return constraints.without_parent(t.table(spark, d, "orders"), parent, "o_custkey").select("o_orderkey")


@query("dq_checks", t.with_(t.ALERTS) + """SELECT alert_id, CASE WHEN anomaly_score * 1.1 > 1 THEN 'anomaly_score' ELSE '' END || CASE WHEN anomaly_score * 1.1 > 1 AND alert_id % 9 = 0 THEN '; ' ELSE '' END
  || CASE WHEN alert_id % 9 = 0 THEN 'window_order' ELSE '' END AS violations FROM alerts WHERE anomaly_score * 1.1 > 1 OR alert_id % 9 = 0""")
def dq_checks(spark, d):
    rows = t.alerts(spark, d).withColumns({
        "anomaly_score": F.col("anomaly_score") * 1.1, "score_threshold": F.lit(0.5), "window_end": F.col("detected_at"), "consecutive_windows": F.lit(2),
        "window_start": F.when(F.col("alert_id") % 9 == 0, F.col("detected_at")).otherwise(F.col("detected_at") - F.expr("INTERVAL 1 HOUR")),
    })
    return constraints.failing(rows, constraints.alert_checks()).select("alert_id", "violations")


@query("dq_alert_id_derivation", "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0")
def dq_alert_id_derivation(spark, d):
    machine = F.concat(F.lit("M-"), F.col("o_custkey").cast("string"))
    rows = t.table(spark, d, "orders").select("o_orderkey", machine.alias("machine_id"), F.col("o_orderdate").alias("window_start"), F.lit("m").alias("model_name"), F.lit("1").alias("model_version"))
    rows = rows.withColumn("alert_id", S.alert_id(F.col("machine_id"), F.col("window_start"), F.col("model_name"), F.when(F.col("o_orderkey") % 13 == 0, "2").otherwise("1")))
    return constraints.wrong_alert_ids(rows).select("o_orderkey")


@query("dq_unique_sample", t.with_(t.SAMPLES) + "SELECT machine_id, epoch_us(date_trunc('minute', event_time)) AS minute, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) > 1")
def dq_unique_sample(spark, d):
    """At minute resolution, so that there is something to find."""
    rows = t.samples(spark, d).withColumn("minute", F.unix_micros(F.date_trunc("minute", "event_time")))
    return constraints.repeated(rows, "machine_id", "minute")

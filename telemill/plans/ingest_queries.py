"""Queries on sources, sinks, parsing and topic reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S
from telemill.operators import alerting, constraints, reports
from telemill.sources import ingest, tables, versions
from telemill.plans import tables as t
from telemill.plans.registry import near, query
from telemill.plans.scratch import scratch

FAULT = """CASE WHEN "offset" % 50 = 5 THEN 'MALFORMED_JSON' WHEN "offset" % 50 = 1 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN "offset" % 50 IN (2, 3, 4) THEN 'SCHEMA_VALIDATION_FAILED' END"""
FAULTY = t.with_(t.SAMPLES, f"parsed AS (SELECT *, {FAULT} AS dlq_reason, \"offset\" % 400 AS lag FROM samples)")


def parsed(spark, d):
    return ingest.parse(t.records(spark, d))


@query("src_raw_batch", t.with_(t.SAMPLES) + 'SELECT "partition", count(*) AS n, max("offset") AS last FROM samples GROUP BY 1')
def src_raw_batch(spark, d):
    path = scratch(spark, "records")
    t.records(spark, d).write.parquet(path)
    return ingest.read_batch(spark, "parquet", path).groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))


@query("src_parquet_dataset", t.with_(t.SAMPLES, t.LABELS) + "SELECT s.machine_id, count(*) AS samples, count(l.event_id) AS labels FROM samples s LEFT JOIN labelled l USING (event_id) GROUP BY 1")
def src_parquet_dataset(spark, d):
    return t.samples(spark, d).join(t.labels(spark, d).select("event_id", "is_anomaly"), "event_id", "left").groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("samples"), F.count("is_anomaly").alias("labels"))


@query("src_topic_snapshot", FAULTY + "SELECT machine_id, count(*) AS n, epoch_us(date_trunc('millisecond', max(event_time))) AS last_us FROM parsed WHERE dlq_reason IS NULL GROUP BY 1")
def src_topic_snapshot(spark, d):
    s = ingest.snapshot(t.records(spark, d), scratch(spark, "snapshot"))
    return s.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("event_time")).alias("last_us"))


@query("src_manifest", FAULTY + """SELECT count(*) AS records, count(dlq_reason) AS failures, count(*) - count(dlq_reason) AS samples, 0::BIGINT AS duplicates,
  epoch_us(date_trunc('millisecond', min(event_time) FILTER (WHERE dlq_reason IS NULL))) AS first_us, epoch_us(date_trunc('millisecond', max(event_time) FILTER (WHERE dlq_reason IS NULL))) AS last_us,
  count(DISTINCT machine_id) FILTER (WHERE dlq_reason IS NULL) AS machines, 4::BIGINT AS partitions, (SELECT CAST(sum(e) AS BIGINT) FROM (SELECT max("offset") + 1 AS e FROM samples GROUP BY "partition")) AS end_offsets FROM parsed""")
def src_manifest(spark, d):
    return ingest.manifest(t.records(spark, d), parsed(spark, d))


@query("prj_parse_json", FAULTY + "SELECT \"offset\", machine_id, round(power_kw, 6) AS power_kw, epoch_us(date_trunc('millisecond', event_time)) AS event_us FROM parsed WHERE dlq_reason IS NULL")
def prj_parse_json(spark, d):
    good, _ = ingest.split_valid(parsed(spark, d))
    return good.select("offset", "machine_id", near("power_kw", 6).alias("power_kw"), F.unix_micros("event_time").alias("event_us"))


@query("prj_dlq_reason", FAULTY + 'SELECT "offset", dlq_reason FROM parsed')
def prj_dlq_reason(spark, d):
    return parsed(spark, d).select("offset", "dlq_reason")


@query("prj_dlq_detail", FAULTY + """SELECT "offset", CASE "offset" % 50 WHEN 1 THEN 'version 2.0 is not of the 1.x family' WHEN 2 THEN 'schema_version'
  WHEN 3 THEN 'machine_id' WHEN 4 THEN 'event_time; event_time was yesterday' WHEN 5 THEN 'unreadable message: ' || substr('{"schema_version":"1.0","event_id":"' || event_id || '","machine_id"', 1, 40) END AS dlq_detail FROM parsed""")
def prj_dlq_detail(spark, d):
    return parsed(spark, d).select("offset", "dlq_detail")


@query("flt_split_valid", FAULTY + "SELECT dlq_reason IS NULL AS accepted, count(*) AS n FROM parsed GROUP BY 1")
def flt_split_valid(spark, d):
    good, bad = ingest.split_valid(parsed(spark, d))
    count = F.count(F.lit(1)).alias("n")
    return good.agg(count).withColumn("accepted", F.lit(True)).unionByName(bad.agg(count).withColumn("accepted", F.lit(False)))


@query("flt_split_late", FAULTY + 'SELECT "offset", lag AS lateness_seconds FROM parsed WHERE dlq_reason IS NULL AND lag > 90')
def flt_split_late(spark, d):
    _, late = ingest.split_late(ingest.split_valid(parsed(spark, d))[0])
    return late.select("offset", "lateness_seconds")


def sides(spark, d):
    return ingest.side_outputs(parsed(spark, d), F.timestamp_seconds(F.lit(1704067200)))


SIDES = FAULTY + "SELECT CASE WHEN dlq_reason IS NOT NULL THEN 'telemetry.dlq' ELSE 'telemetry.late' END AS topic, count(*) AS n FROM parsed WHERE dlq_reason IS NOT NULL OR lag > 90 GROUP BY 1"


@query("set_union_routed", SIDES)
def set_union_routed(spark, d):
    return sides(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("snk_routed", SIDES)
def snk_routed(spark, d):
    path = scratch(spark, "routed")
    ingest.write_routed(sides(spark, d), path)
    return spark.read.json(path).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("snk_dead_letter", FAULTY + 'SELECT dlq_reason, "partition" AS source_partition, "offset" AS source_offset FROM parsed WHERE dlq_reason IS NOT NULL')
def snk_dead_letter(spark, d):
    e = F.from_json("value", "dlq_reason string, source_partition int, source_offset long")
    return sides(spark, d).where("topic = 'telemetry.dlq'").select(e.alias("e")).select("e.*")


@query("snk_late", FAULTY + "SELECT machine_id, event_id, lag AS lateness_seconds, 90 AS watermark_seconds FROM parsed WHERE dlq_reason IS NULL AND lag > 90")
def snk_late(spark, d):
    e = F.from_json("value", "machine_id string, event_id string, lateness_seconds long, watermark_seconds int")
    return sides(spark, d).where("topic = 'telemetry.late'").select(e.alias("e")).select("e.*")


@query("src_dlq_replay", FAULTY + 'SELECT "offset", machine_id AS key_text, TRUE AS same_bytes FROM parsed WHERE dlq_reason IS NOT NULL')
def src_dlq_replay(spark, d):
    back = ingest.replayed(sides(spark, d).where("topic = 'telemetry.dlq'"))
    original = t.records(spark, d).select("offset", F.col("value").alias("original"))
    return back.join(original, "offset").select("offset", F.decode("key", "UTF-8").alias("key_text"), (F.col("value") == F.col("original")).alias("same_bytes"))


# of a message that breaks off nothing can be read
UNREADABLE = "; ".join(sorted([*ingest.REQUIRED, *(f"readings.{s}" for s in C.SENSORS)]))


@query("flt_contract_raw_strict", FAULTY + f"""SELECT "offset", CASE "offset" % 50 WHEN 2 THEN 'schema_version' WHEN 3 THEN 'machine_id' WHEN 5 THEN '{UNREADABLE}' ELSE '' END AS errors FROM parsed""")
def flt_contract_raw_strict(spark, d):
    return ingest.strict_errors(t.records(spark, d)).select("offset", "errors")


@query("set_dedup_event_id", t.with_(t.SAMPLES) + "SELECT event_id, min(\"offset\") AS \"offset\" FROM samples GROUP BY 1")
def set_dedup_event_id(spark, d):
    twice = t.samples(spark, d).unionByName(t.samples(spark, d).withColumn("offset", F.col("offset") + 1_000_000_000))
    return ingest.first_by_event(twice, "offset").select("event_id", "offset")


@query("set_union_chunks", t.with_(t.SAMPLES) + "SELECT machine_id, count(*) AS n FROM samples GROUP BY 1")
def set_union_chunks(spark, d):
    s = t.samples(spark, d)
    return s.where("partition < 2").unionByName(s.where("partition >= 2")).groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))


# scalar functions


@query("fn_epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def fn_epoch_millis(spark, d):
    return t.table(spark, d, "events").select("event_id", S.epoch_millis(F.col("ts")).alias("ms"))


@query("fn_format_instant", "SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS text FROM events")
def fn_format_instant(spark, d):
    return t.table(spark, d, "events").select("event_id", S.format_instant(F.col("ts")).alias("text"))


@query("fn_parse_instant", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(date_trunc('millisecond', ts)) END AS us FROM events")
def fn_parse_instant(spark, d):
    text = S.format_instant(F.col("ts"))
    text = F.when(F.col("event_id") % 3 == 0, F.substring(text, 1, 19)).otherwise(text)  # a third has no zone
    return t.table(spark, d, "events").select("event_id", F.unix_micros(S.parse_instant(text)).alias("us"))


NS = "unhex('" + C.ALERT_NAMESPACE.replace("-", "") + "')"


@query("fn_alert_id", f"""SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1)
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS alert_id FROM (SELECT event_id, sha1({NS} || encode('M-' || (user_id % 15) || '|' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z|three_sigma|1.0.0')) AS h FROM events)""")
def fn_alert_id(spark, d):
    e = t.table(spark, d, "events")
    machine = F.concat(F.lit("M-"), (F.col("user_id") % 15).cast("string"))
    return e.select("event_id", S.alert_id(machine, F.col("ts"), F.lit("three_sigma"), F.lit("1.0.0")).alias("alert_id"))


@query("fn_source_lag_ms", t.with_(t.SAMPLES) + 'SELECT event_id, ("offset" % 400) * 1000 AS lag_ms FROM samples')
def fn_source_lag_ms(spark, d):
    return t.samples(spark, d).select("event_id", (F.unix_millis("ingest_time") - F.unix_millis("event_time")).alias("lag_ms"))


@query("fn_processing_delay_ms", "SELECT l_orderkey, l_linenumber, epoch_ms(l_shipdate) - epoch_ms(o_orderdate) AS delay_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fn_processing_delay_ms(spark, d):
    j = t.table(spark, d, "lineitem").join(t.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", (S.epoch_millis(F.col("l_shipdate")) - S.epoch_millis(F.col("o_orderdate"))).alias("delay_ms"))


@query("fn_detection_latency_ms", "SELECT o_orderkey, min(epoch_ms(l_shipdate)) - epoch_ms(o_orderdate) AS latency_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def fn_detection_latency_ms(spark, d):
    first = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    j = first.join(t.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("o_orderkey", (S.epoch_millis(F.col("first")) - S.epoch_millis(F.col("o_orderdate"))).alias("latency_ms"))


@query("fn_schema_major", "SELECT event_id, event_id % 3 <> 2 AS accepted FROM events")
def fn_schema_major(spark, d):
    version = F.element_at(F.array(F.lit("1.0"), F.lit("1.7"), F.lit("10.1")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.table(spark, d, "events").select("event_id", S.schema_major_is_one(version).alias("accepted"))


@query("fn_enum_tolerant", "SELECT event_id, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'IDLE' ELSE 'UNKNOWN' END AS state FROM events")
def fn_enum_tolerant(spark, d):
    word = F.when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "click", "IDLE").otherwise(F.upper("event_type"))
    return t.table(spark, d, "events").select("event_id", S.tolerant(word, C.MACHINE_STATES).alias("state"))


@query("fn_enum_strict", "SELECT event_id, event_type IN ('view', 'click') OR event_id % 9 = 0 AS accepted FROM events")
def fn_enum_strict(spark, d):
    word = F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "click", "IDLE").otherwise(F.upper("event_type"))
    return t.table(spark, d, "events").select("event_id", S.strict(word, C.MACHINE_STATES).alias("accepted"))


@query("fn_epoch_floor", "SELECT event_id, (epoch_us(ts) // 1000000 // 10) * 10 AS slot FROM events")
def fn_epoch_floor(spark, d):
    return t.table(spark, d, "events").select("event_id", S.epoch_floor(F.unix_seconds("ts"), 10).alias("slot"))


@query("fn_json_encode", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":' || CASE WHEN event_id % 2 = 0 THEN '"' || event_type || '"' ELSE 'null' END || '}' AS json FROM events""")
def fn_json_encode(spark, d):
    s = F.struct("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type"))
    return t.table(spark, d, "events").select("event_id", S.json_encode(s).alias("json"))


@query("fn_json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_decode(spark, d):
    return t.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("fn_base64", "SELECT event_id, base64(encode(repeat(props, 12))) AS text FROM events")
def fn_base64(spark, d):
    return t.table(spark, d, "events").select("event_id", S.base64_plain(F.encode(F.repeat("props", F.lit(12)), "UTF-8")).alias("text"))


@query("fn_unbase64", "SELECT event_id, repeat(props, 12) AS text FROM events")
def fn_unbase64(spark, d):
    coded = F.base64(F.encode(F.repeat("props", F.lit(12)), "UTF-8"))  # with Spark's line breaks
    return t.table(spark, d, "events").select("event_id", F.decode(S.unbase64_tolerant(coded), "UTF-8").alias("text"))


@query("fn_partition_key", t.with_(t.SAMPLES) + "SELECT event_id, hex(encode(machine_id)) AS key FROM samples")
def fn_partition_key(spark, d):
    return t.samples(spark, d).select("event_id", F.hex(S.partition_key(F.col("machine_id"))).alias("key"))


@query("fn_sha256_digest", """WITH h AS (SELECT sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events),
s AS (SELECT count(*) AS rows, """ + ", ".join(f"sum(CAST('0x' || substr(h, {at}, 15) AS UBIGINT)) AS s{i}" for i, at in enumerate((1, 16, 31, 46))) + """ FROM h)
SELECT rows, sha256(concat_ws('|', rows, s0, s1, s2, s3)) AS digest FROM s""")
def fn_sha256_digest(spark, d):
    return S.fingerprint(t.table(spark, d, "events").select("event_id", "event_type", "user_id"))


# topic reports


SKIPPED = "CASE l_linenumber % 4 WHEN 1 THEN 'MACHINE_NOT_RUNNING' WHEN 2 THEN 'INSUFFICIENT_SAMPLES' WHEN 3 THEN 'WINDOW_NOT_MATURE' END"


@query("agg_update_ratio", f"WITH m AS (SELECT l_suppkey, l_shipdate, l_quantity > 20 AS scored, l_discount > 0.05 AS bad, CASE WHEN l_quantity <= 20 THEN {SKIPPED} END AS reason FROM lineitem) "
       + "SELECT count(*) AS messages, count(DISTINCT (l_suppkey, l_shipdate)) AS windows, (SELECT max(n) FROM (SELECT count(*) AS n FROM m GROUP BY l_suppkey, l_shipdate)) AS most, round(count(*) / count(DISTINCT (l_suppkey, l_shipdate)), 6) AS ratio,"
       + " count(DISTINCT l_suppkey) AS machines, count(*) FILTER (WHERE scored) AS scored, count(*) FILTER (WHERE scored AND bad) AS anomalous, "
       + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS skipped_{r.lower()}" for r in C.SKIP_REASONS) + " FROM m")
def agg_update_ratio(spark, d):
    scored = F.col("l_quantity") > 20
    rows = t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("machine_id"), F.col("l_shipdate").alias("window_start"), scored.alias("is_scored"), (F.col("l_discount") > 0.05).alias("is_anomaly"), F.when(~scored, F.expr(SKIPPED)).alias("skip_reason"))
    return t.rounded(reports.update_ratio(rows))


@query("agg_delay_stats", "SELECT " + ", ".join(f"{f}(x){flt} AS {n}_{k}" for k, flt in (("all", ""), ("scored", " FILTER (WHERE l_quantity > 10)")) for n, f in (("min", "min"), ("median", "median"), ("max", "max")))
       + " FROM (SELECT *, epoch_ms(l_shipdate) - 800000000000 AS x FROM lineitem)")
def agg_delay_stats(spark, d):
    rows = t.table(spark, d, "lineitem").select((F.unix_millis("l_shipdate") - 800_000_000_000).alias("processing_delay_ms"), (F.col("l_quantity") > 10).alias("is_scored"))
    return t.rounded(reports.delay_statistics(rows))


GRADE = "CASE l_linenumber % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END"


@query("agg_duplicate_deliveries", "SELECT count(*) AS messages, count(DISTINCT l_orderkey) AS alert_ids, count(*) - count(DISTINCT l_orderkey) AS duplicates, min(l_linenumber) AS fewest_windows, max(l_linenumber) AS most_windows, "
       + ", ".join(f"count(*) FILTER (WHERE {GRADE} = '{x}') AS severity_{x.lower()}" for x in C.SEVERITIES) + ", count(DISTINCT l_suppkey) AS machines FROM lineitem")
def agg_duplicate_deliveries(spark, d):
    rows = t.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("alert_id"), F.col("l_suppkey").alias("machine_id"), F.col("l_linenumber").alias("consecutive_windows"), F.expr(GRADE).alias("severity"))
    return reports.duplicate_deliveries(rows)


@query("agg_dlq_report", FAULTY + "SELECT dlq_reason, count(*) AS messages, count(*) AS recoverable FROM parsed WHERE dlq_reason IS NOT NULL GROUP BY 1")
def agg_dlq_report(spark, d):
    e = F.from_json("value", "dlq_reason string, raw_payload string")
    return reports.dead_letters(sides(spark, d).where("topic = 'telemetry.dlq'").select(e.alias("e")).select("e.*"))


@query("agg_late_report", FAULTY + "SELECT count(*) AS messages, min(lag) AS least, median(lag) AS median, max(lag) AS most FROM parsed WHERE dlq_reason IS NULL AND lag > 90")
def agg_late_report(spark, d):
    return reports.late_records(ingest.split_late(ingest.split_valid(parsed(spark, d))[0])[1])


RANK = "(SELECT lag FROM (SELECT lag, row_number() OVER (ORDER BY lag) - 1 AS i FROM late) WHERE i = (SELECT CAST(round_even({q} * (count(*) - 1), 0) AS BIGINT) FROM late))"


KEYED = "CASE WHEN \"offset\" % 29 = 0 THEN NULL WHEN \"offset\" % 31 = 0 THEN 'M-999' ELSE machine_id END"
ONE_ROW = f"""SELECT count(*) AS messages, count(*) - count(key) AS missing_keys, count(*) FILTER (WHERE key <> machine_id) AS key_mismatches, CAST(sum({' + '.join(f'({s} IS NULL)::INT' for s in C.SENSORS)}) AS BIGINT) AS null_readings,
  epoch_us(min(event_time)) AS first_us, epoch_us(max(event_time)) AS last_us, (SELECT max(lag) FROM late) AS lateness_max,
  (SELECT count(*) FROM (SELECT machine_id FROM samples GROUP BY 1 HAVING count(DISTINCT "partition") > 1)) AS machines_on_partitions, count(DISTINCT machine_id) AS machines,
  (SELECT count(*) FROM (SELECT event_time, max(event_time) OVER (PARTITION BY machine_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM samples) WHERE event_time < m) AS out_of_order,
  {RANK.format(q=0.5)} AS lateness_p50, {RANK.format(q=0.95)} AS lateness_p95, {RANK.format(q=0.99)} AS lateness_p99 FROM (SELECT *, {KEYED} AS key FROM samples)"""


@query("agg_raw_topic_report", t.with_(t.SAMPLES, 'late AS (SELECT "offset" % 400 AS lag FROM samples)', f"one AS ({ONE_ROW})") + """
SELECT kind, NULL AS value, n FROM (SELECT """ + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in (
    "messages", "missing_keys", "key_mismatches", "null_readings", "first_us", "last_us", "lateness_max", "machines_on_partitions", "machines", "out_of_order", "lateness_p50", "lateness_p95", "lateness_p99")) + """ FROM one) UNPIVOT (n FOR kind IN (COLUMNS(*)))
UNION ALL SELECT 'state', machine_state, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'machine', machine_id, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'partition', CAST("partition" AS VARCHAR), count(*) FROM samples GROUP BY 2""")
def agg_raw_topic_report(spark, d):
    rows = t.samples(spark, d).withColumns({"key": F.expr(KEYED.replace('"', "`")), "null_count": S.null_count(), "lateness_seconds": ingest.lateness()})
    return reports.raw_topic(rows)


LAG_RANK = "(SELECT lag FROM (SELECT lag, row_number() OVER (ORDER BY lag) - 1 AS i FROM lags) WHERE i = (SELECT CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) FROM lags))"


@query("agg_label_topic_report", t.with_(t.SAMPLES, t.LABELS, "lags AS (SELECT epoch_ms(emitted_at) - epoch_ms(event_time) AS lag FROM labelled)") + f"""SELECT 'is_anomaly' AS kind, 'true' AS value, count(*) AS n FROM labelled UNION ALL SELECT 'type', anomaly_type, count(*) FROM labelled GROUP BY 2
UNION ALL SELECT 'machine', machine_id, count(*) FROM labelled GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM labelled GROUP BY 2 UNION ALL SELECT 'episodes', NULL, count(DISTINCT episode_id) FROM labelled
UNION ALL SELECT 'lag_max_ms', NULL, max(lag) FROM lags UNION ALL SELECT 'lag_p50_ms', NULL, {LAG_RANK}""")
def agg_label_topic_report(spark, d):
    return reports.label_topic(t.labels(spark, d))


@query("wfn_out_of_order", t.with_(t.SAMPLES) + """SELECT event_id FROM (SELECT event_id, event_time, max(event_time) OVER (PARTITION BY machine_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM samples) WHERE event_time < m""")
def wfn_out_of_order(spark, d):
    return alerting.out_of_order(t.samples(spark, d), "offset").select("event_id")


# merges


def windows_by_supplier(spark, d, least: int, most: int):
    """``lineitem`` rows of some lines as window writes."""
    return t.table(spark, d, "lineitem").where(F.col("l_linenumber").between(least, most)).select(
        F.col("l_suppkey").alias("machine_id"), F.col("l_shipdate").alias("window_start"), F.col("l_extendedprice").alias("score"), F.col("l_orderkey").alias("seq"), "l_linenumber")


WRITES = """w AS (SELECT l_suppkey AS machine_id, l_shipdate AS window_start, l_extendedprice AS score, l_orderkey AS seq, l_linenumber FROM lineitem),
stored AS (SELECT * FROM w WHERE l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY machine_id, window_start ORDER BY seq DESC, l_linenumber DESC) = 1),
incoming AS (SELECT * FROM w WHERE l_linenumber > 2 QUALIFY row_number() OVER (PARTITION BY machine_id, window_start ORDER BY seq DESC, l_linenumber DESC) = 1)"""


@query("snk_upsert_window", t.with_(WRITES) + """SELECT coalesce(i.machine_id, s.machine_id) AS machine_id, epoch_us(coalesce(i.window_start, s.window_start)) AS window_start, coalesce(i.score, s.score) AS score,
  s.machine_id IS NULL AS was_inserted FROM stored s FULL JOIN incoming i ON s.machine_id = i.machine_id AND s.window_start = i.window_start""")
def snk_upsert_window(spark, d):
    order = [F.col("seq"), F.col("l_linenumber")]
    first, later = windows_by_supplier(spark, d, 1, 2), windows_by_supplier(spark, d, 3, 99)
    table = versions.VersionedTable(spark, scratch(spark, "windows-table"), first.schema, F.col("machine_id") % 4)
    merge = lambda stored, new: tables.upsert_windows(stored, new, order)
    table.apply(first, 0, merge)
    merged = table.apply(later, 1, merge)
    assert table.apply(later, 1, merge) is None  # delivered again
    untouched = table.read().join(merged.select("machine_id", "window_start"), ["machine_id", "window_start"], "left_anti").withColumn("was_inserted", F.lit(False))
    return merged.select(*first.columns, "was_inserted").unionByName(untouched).select("machine_id", F.unix_micros("window_start").alias("window_start"), "score", "was_inserted")


@query("wfn_latest_emission", t.with_(WRITES) + "SELECT machine_id, epoch_us(window_start) AS window_start, max(seq) AS seq FROM w GROUP BY ALL")
def wfn_latest_emission(spark, d):
    return alerting.latest_emission(windows_by_supplier(spark, d, 1, 99), "seq").select("machine_id", F.unix_micros("window_start").alias("window_start"), "seq")


MERGED = """incoming AS (SELECT alert_id, machine_id, 'NEW' AS status, 'CRITICAL' AS severity, 0.99::DOUBLE AS anomaly_score FROM alerts WHERE alert_id % 4 = 0
  UNION ALL SELECT alert_id + 100000000, machine_id, 'NEW', 'HIGH', 0.5 FROM alerts WHERE alert_id % 100 = 0),
merged AS (SELECT coalesce(a.alert_id, i.alert_id) AS alert_id, coalesce(a.status, i.status) AS status,
  CASE WHEN a.alert_id IS NULL OR (i.alert_id IS NOT NULL AND a.status = 'NEW') THEN i.severity ELSE a.severity END AS severity,
  a.alert_id IS NULL AS was_inserted, coalesce(i.alert_id IS NOT NULL AND a.status = 'NEW', FALSE) AS was_changed FROM alerts a FULL JOIN incoming i ON a.alert_id = i.alert_id)"""


def alert_writes(spark, d):
    """Stored alerts, and a batch of known and new ones."""
    stored = t.alerts(spark, d).select("alert_id", "machine_id", "status", "severity", "anomaly_score")
    again = stored.where("alert_id % 4 = 0").withColumns({"status": F.lit("NEW"), "severity": F.lit("CRITICAL"), "anomaly_score": F.lit(0.99)})
    new = stored.where("alert_id % 100 = 0").withColumns({"alert_id": F.col("alert_id") + 100_000_000, "status": F.lit("NEW"), "severity": F.lit("HIGH"), "anomaly_score": F.lit(0.5)})
    return stored, again.unionByName(new)


def merged_alerts(spark, d):
    return tables.upsert_alerts(*alert_writes(spark, d))


@query("snk_upsert_alert", t.with_(t.ALERTS, MERGED) + "SELECT * FROM merged")
def snk_upsert_alert(spark, d):
    """Two batches merged into a versioned table; the rows as the second one wrote them."""
    first, later = alert_writes(spark, d)
    table = versions.VersionedTable(spark, scratch(spark, "alerts-table"), first.schema, F.pmod(F.xxhash64("alert_id"), F.lit(4)))
    table.apply(first, 0, tables.upsert_alerts)
    return table.apply(later, 1, tables.upsert_alerts).select("alert_id", "status", "severity", "was_inserted", "was_changed")


@query("lc_change_feed", t.with_(t.ALERTS, MERGED) + "SELECT alert_id, CASE WHEN was_inserted THEN 'created' ELSE 'updated' END AS event FROM merged WHERE was_inserted OR was_changed")
def lc_change_feed(spark, d):
    rows = merged_alerts(spark, d).where("was_inserted or was_changed")
    return rows.select("alert_id", F.when(F.col("was_inserted"), "created").otherwise("updated").alias("event"))


@query("agg_ingestion_outcomes", t.with_(t.ALERTS, MERGED) + "SELECT count(*) FILTER (WHERE was_inserted) AS inserted, count(*) FILTER (WHERE NOT was_inserted) AS duplicate, 7::BIGINT AS rejected, 1500.0::DOUBLE AS mean_latency_ms FROM merged")
def agg_ingestion_outcomes(spark, d):
    rows = merged_alerts(spark, d).withColumns({"published_at": F.timestamp_millis(F.lit(1_000_000)), "committed_at": F.timestamp_millis(F.lit(1_001_500))})
    return reports.ingestion_outcomes(rows, 7)


@query("snk_machine_provision", "SELECT o_custkey AS code, 'LINE-X' AS line_code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def snk_machine_provision(spark, d):
    known = t.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("code"))
    seen = t.table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.lit("LINE-X").alias("line_code"))
    return tables.provision(known, seen)


@query("enrich_machines", "SELECT c_custkey AS code, CASE WHEN c_custkey % 3 = 0 THEN 'SEED' ELSE c_mktsegment END AS kind FROM customer")
def enrich_machines(spark, d):
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("kind"))
    return tables.enrich(c, c.where("code % 3 = 0").withColumn("kind", F.lit("SEED")))


@query("snk_retention_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR")
def snk_retention_purge(spark, d):
    return tables.purge(t.table(spark, d, "events"), "ts", F.timestamp_seconds(F.lit(1705708800))).select("event_id")


@query("wfn_event_seq", "SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS event_seq FROM events")
def wfn_event_seq(spark, d):
    return tables.event_sequence(t.table(spark, d, "events"), ["ts", "event_id"], 100).select("event_id", "event_seq")


# consumers' checks


def alert_messages(spark, d):
    """Alert messages encoded from ``orders``, some broken in one place."""
    o, bad = t.table(spark, d, "orders"), F.col("o_orderkey") % 10
    end = F.col("o_orderdate")
    start = F.when(bad == 1, end).otherwise(end - F.expr("INTERVAL 60 SECONDS"))
    machine = F.concat(F.lit("M-"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    m = F.struct(
        F.when(bad == 2, "3.0").otherwise("1.0").alias("schema_version"), S.alert_id(machine, start, F.lit("m"), F.lit("1")).alias("alert_id"),
        F.when(bad == 3, "machine").otherwise(machine).alias("machine_id"), F.lit("LINE-A").alias("line_id"), F.lit("HIGH").alias("severity"), F.lit("NEW").alias("status"),
        F.when(bad == 4, 1.5).otherwise(0.9).alias("anomaly_score"), F.lit(0.8).alias("score_threshold"),
        S.format_instant(F.when(bad == 5, start).otherwise(end)).alias("detected_at"), S.format_instant(start).alias("window_start"), S.format_instant(end).alias("window_end"),
        S.format_instant(end).alias("published_at"), F.lit(2).alias("consecutive_windows"), F.struct(F.lit("m").alias("name"), F.lit("1").alias("version")).alias("model"),
    )
    text = F.to_json(m)
    return o.select("o_orderkey", F.when(bad == 6, F.lit(None)).when(bad == 7, F.substring(text, 1, 30)).otherwise(text).alias("value"))


@query("flt_contract_alert", """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'SCHEMA_VALIDATION_FAILED' WHEN 2 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN 3 THEN 'SCHEMA_VALIDATION_FAILED'
  WHEN 4 THEN 'SCHEMA_VALIDATION_FAILED' WHEN 5 THEN 'SCHEMA_VALIDATION_FAILED' WHEN 6 THEN 'MALFORMED_JSON' WHEN 7 THEN 'MALFORMED_JSON' END AS reject_reason,
  CASE o_orderkey % 10 WHEN 1 THEN 'window_end must be after window_start' WHEN 2 THEN 'schemaVersion unsupported version' WHEN 3 THEN 'machineId malformed'
  WHEN 4 THEN 'anomalyScore out of range' WHEN 5 THEN 'detected_at must equal window_end' WHEN 6 THEN 'tombstone' WHEN 7 THEN 'payload is not valid JSON' END AS reject_detail FROM orders""")
def flt_contract_alert(spark, d):
    return constraints.consumed_alerts(alert_messages(spark, d)).select("o_orderkey", "reject_reason", "reject_detail")


@query("flt_contract_window", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (6, 7) THEN 'MALFORMED_JSON' WHEN o_orderkey % 10 IN (1, 2, 3) THEN 'SCHEMA_VALIDATION_FAILED' END AS reject_reason FROM orders""")
def flt_contract_window(spark, d):
    rows = alert_messages(spark, d).withColumn("value", F.regexp_replace("value", r"\}$", ',"sample_count":60}'))
    rows = rows.withColumn("value", F.when(F.col("o_orderkey") % 10 == 7, F.substring("value", 1, 30)).otherwise(F.col("value")))
    return constraints.consumed_windows(rows).select("o_orderkey", "reject_reason")

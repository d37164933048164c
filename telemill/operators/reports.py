"""Reports over topics: what came, how often, how late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.operators.alerting import out_of_order
from telemill.operators.ranking import quantile_columns, running


def update_ratio(scored: DataFrame) -> DataFrame:
    """One row on scored messages: how often windows are emitted again, how many were scored and anomalous, and why the others were not scored."""
    per = scored.groupBy("machine_id", "window_start").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_scored").alias("_scored"), F.count_if(F.col("is_scored") & F.col("is_anomaly")).alias("_anomalous"),
        *[F.count_if(~F.col("is_scored") & F.col("skip_reason").eqNullSafe(r)).alias(f"_{r}") for r in C.SKIP_REASONS],
    )
    return per.agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("windows"), F.max("n").alias("most"), F.try_divide(F.sum("n"), F.count(F.lit(1))).alias("ratio"), F.count_distinct("machine_id").alias("machines"),
        F.sum("_scored").alias("scored"), F.sum("_anomalous").alias("anomalous"), *[F.sum(f"_{r}").alias(f"skipped_{r.lower()}") for r in C.SKIP_REASONS],
    )


def delay_statistics(scored: DataFrame) -> DataFrame:
    """Least, median and greatest delay, of all windows and of the scored ones."""
    kinds = {"all": F.col("processing_delay_ms"), "scored": F.when(F.col("is_scored"), F.col("processing_delay_ms"))}
    out = scored.agg(*[f(x).alias(f"{name}_{kind}") for kind, x in kinds.items() for name, f in (("min", F.min), ("max", F.max))])
    for kind, x in kinds.items():
        out = out.crossJoin(quantile_columns(scored, [], x, {f"median_{kind}": 0.5}))  # single rows
    return out


def duplicate_deliveries(alerts: DataFrame) -> DataFrame:
    """One row on alert messages: distinct alerts, deliveries beyond the first, machines, messages by severity, least and most windows at opening."""
    per = alerts.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("consecutive_windows").alias("a"), F.max("consecutive_windows").alias("b"), *[F.count_if(F.col("severity") == x).alias(f"_{x}") for x in C.SEVERITIES],
    )
    machines = alerts.agg(F.count_distinct("machine_id").alias("machines"))
    return per.agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("alert_ids"), F.sum(F.col("n") - 1).alias("duplicates"), F.min("a").alias("fewest_windows"), F.max("b").alias("most_windows"),
        *[F.sum(f"_{x}").alias(f"severity_{x.lower()}") for x in C.SEVERITIES],
    ).crossJoin(machines)  # single rows


def dead_letters(envelopes: DataFrame) -> DataFrame:
    """Per reason: messages and those whose original bytes are there."""
    return envelopes.groupBy("dlq_reason").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.length("raw_payload") > 0).alias("recoverable"))


def late_records(late: DataFrame) -> DataFrame:
    x = F.col("lateness_seconds")
    ends = late.agg(F.count(F.lit(1)).alias("messages"), F.min(x).alias("least"), F.max(x).alias("most"))
    return ends.crossJoin(quantile_columns(late, [], x, {"median": 0.5}))  # single rows


def nearest_rank(rows: DataFrame, column: str, fractions: tuple[float, ...]) -> DataFrame:
    """(fraction, value): the value at place round-half-even(fraction * (n - 1)) in order.

    Values are counted first; the running sum is over distinct values in range partitions.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, [], "value", ["_c"]).withColumnsRenamed({"upto__c": "_to", "all__c": "_n"})
    spread = placed.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    place = F.bround(F.col("fraction") * (F.col("_n") - 1), 0)
    return spread.where((place >= F.col("_to") - F.col("_c")) & (place < F.col("_to"))).select("fraction", "value")


def long_rows(row: DataFrame) -> DataFrame:
    """A single row as (kind, value, n), a row per column, ``value`` null."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(None).cast("string").alias("value"), F.col(c).cast("long").alias("n")) for c in row.columns]))
    return row.select(each.alias("e")).select("e.kind", "e.value", "e.n")


def counted(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, value, n): how often each value of each column occurs, in one pass; missing values are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in kinds.items()]))
    return rows.select(each.alias("e")).where(F.col("e.value").isNotNull()).groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))


def raw_topic(records: DataFrame) -> DataFrame:
    """(kind, value, n) on raw samples with their coordinates and key: missing and mismatched keys, spread machines, order, nulls, lateness, span; counts by state, machine and partition."""
    spread = records.groupBy("machine_id").agg(F.count_distinct("partition").alias("_p")).agg(F.count_if(F.col("_p") > 1).alias("machines_on_partitions"), F.count(F.lit(1)).alias("machines"))
    late = nearest_rank(records, "lateness_seconds", (0.5, 0.95, 0.99)).groupBy().pivot("fraction", [0.5, 0.95, 0.99]).agg(F.first("value")).toDF("lateness_p50", "lateness_p95", "lateness_p99")
    turned = out_of_order(records, "offset").agg(F.count(F.lit(1)).alias("out_of_order"))
    one = records.agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("key").isNull()).alias("missing_keys"), F.count_if(F.col("key") != F.col("machine_id")).alias("key_mismatches"),
        F.sum("null_count").alias("null_readings"), F.unix_micros(F.min("event_time")).alias("first_us"), F.unix_micros(F.max("event_time")).alias("last_us"), F.max("lateness_seconds").alias("lateness_max"),
    ).crossJoin(spread).crossJoin(turned).crossJoin(late)  # single rows
    return long_rows(one).unionByName(counted(records, {"state": "machine_state", "machine": "machine_id", "partition": "partition"}))


def label_topic(labels: DataFrame) -> DataFrame:
    """(kind, value, n): anomalous and normal labels, by type, by source and by machine, the number of episodes, and the lag of labels behind their events."""
    rows = labels.withColumn("_lag", F.unix_millis("emitted_at") - F.unix_millis("event_time"))
    one = rows.agg(F.count_distinct("episode_id").alias("episodes"), F.max("_lag").alias("lag_max_ms"))
    middle = nearest_rank(rows, "_lag", (0.5,)).agg(F.max("value").alias("lag_p50_ms"))
    return counted(labels, {"is_anomaly": "is_anomaly", "type": "anomaly_type", "machine": "machine_id", "source": "source"}).unionByName(long_rows(one.crossJoin(middle)))  # single rows


def tables(**named: tuple[DataFrame, str]) -> DataFrame:
    """Report tables in long form, (table, row, metric, value): for each name a table and the column that names its rows; its numbers and flags are the metrics."""
    out = None
    for name, (df, key) in named.items():
        metrics = [c for c, kind in df.dtypes if c != key and (kind in ("int", "bigint", "double", "float", "boolean") or kind.startswith("decimal"))]
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        rows = df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("row"), each.alias("e")).select("table", "row", "e.metric", "e.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def admission_counts(windows: DataFrame) -> DataFrame:
    """How many windows each gate refuses, alone and together."""
    few, idle, state = F.col("sample_count") < F.col("min_samples"), F.col("running_ratio") < 0.9, F.col("machine_state") != "RUNNING"
    return windows.agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(few).alias("few_samples"), F.count_if(idle).alias("ratio_gate"), F.count_if(state).alias("state_gate"),
        F.count_if(idle & state).alias("both_gates"), F.count_if(state & ~idle & ~few).alias("state_alone"),
        F.coalesce(F.try_divide(F.count_if(state & ~idle & ~few), F.count_if(~idle & ~few)), F.lit(0.0)).alias("state_alone_share"),
    )


def ingestion_outcomes(merged: DataFrame, rejected: int = 0) -> DataFrame:
    """Inserted and duplicate rows of a merge with ``committed_at`` and ``published_at``, and the mean of the latencies that are not negative."""
    lag = F.unix_millis("committed_at") - F.unix_millis("published_at")
    return merged.agg(
        F.count_if("was_inserted").alias("inserted"), F.count_if(~F.col("was_inserted")).alias("duplicate"), F.lit(rejected).cast("long").alias("rejected"),
        F.avg(F.when(lag >= 0, lag)).alias("mean_latency_ms"),
    )


def progress_totals(progress: DataFrame) -> DataFrame:
    """Per query: batches, rows in and out, rows dropped by the watermark."""
    return progress.groupBy("name").agg(
        F.count_distinct("batch_id").alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("output_rows").alias("output_rows"), F.sum("dropped_rows").alias("dropped_rows")
    )

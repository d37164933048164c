"""From raw records to samples: parsing, classification, side outputs, replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S

RECORD = ("topic", "partition", "offset", "key", "value")
REQUIRED = ("schema_version", "event_id", "machine_id", "line_id", "event_time", "machine_state")


def read_stream(spark: SparkSession, fmt: str, schema=None, path: str | None = None, **options: str) -> DataFrame:
    """Streaming scan of any format with the record columns; Kafka needs its connector on the class path.

    For Kafka the options ``subscribe``, ``startingOffsets`` and ``maxOffsetsPerTrigger`` pass through and lost data
    fails the query; for files ``maxFilesPerTrigger`` limits the rate.
    """
    defaults = {"startingOffsets": "earliest", "failOnDataLoss": "true"} if fmt == "kafka" else {}
    reader = spark.readStream.format(fmt).options(**{**defaults, **options})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def read_batch(spark: SparkSession, fmt: str, path: str | None = None, **options: str) -> DataFrame:
    """Bounded scan of the same relation, from the earliest to the latest record."""
    defaults = {"startingOffsets": "earliest", "endingOffsets": "latest"} if fmt == "kafka" else {}
    reader = spark.read.format(fmt).options(**{**defaults, **options})
    return reader.load(path) if path else reader.load()


def parse(raw: DataFrame) -> DataFrame:
    """Records with their message's fields, ``dlq_reason`` and ``dlq_detail``; original bytes and coordinates stay."""
    text = F.col("value").cast("string")
    read = F.from_json(text, C.RAW_DDL + ", _rest string", {"columnNameOfCorruptRecord": "_rest"})
    # a generated row of one: each message is read once, however many fields a filter or a projection above asks for
    rows = raw.select("*", F.explode(F.array(read)).alias("_m"))
    unreadable = F.col("_m").isNull() | F.col("_m._rest").isNotNull()  # no JSON, or not of the contract's types
    plain = [n for n in (*REQUIRED, "firmware_version") if n != "event_time"]
    found = {**{n: F.col(f"_m.{n}") for n in plain}, **{n: S.parse_instant(F.col(f"_m.{n}")) for n in ("event_time", "ingest_time")}, **{s: F.col(f"_m.readings.{s}") for s in C.SENSORS}}
    # faults in order of rank, each with its reason and what a person needs to see; the first that holds is the record's
    foreign = found["schema_version"].isNotNull() & ~S.schema_major_is_one(found["schema_version"])
    lacks = reduce(Column.__or__, [found[n].isNull() for n in REQUIRED])
    absent = F.array_join(F.array_compact(F.array(*[F.when(found[n].isNull(), F.lit(n)) for n in REQUIRED])), ", ")
    bad_time = F.col("_m.event_time").isNotNull() & found["event_time"].isNull()
    faults = (
        (unreadable, "MALFORMED_JSON", F.concat(F.lit("unreadable message: "), F.substring(F.coalesce(text, F.lit("")), 1, 200))),
        (foreign, "UNSUPPORTED_SCHEMA_VERSION", F.concat(F.lit("version "), found["schema_version"], F.lit(" is not of the 1.x family"))),
        (lacks, "SCHEMA_VALIDATION_FAILED", F.when(bad_time, F.concat(absent, F.lit("; event_time was "), F.col("_m.event_time"))).otherwise(absent)),
    )
    # a column each, so that what asks for the reason only makes no details
    first = lambda values: F.coalesce(*[F.when(holds, value) for (holds, *_), value in zip(faults, values, strict=True)])
    reason, detail = first([F.lit(r) for _, r, _ in faults]), first([x for *_, x in faults])
    return rows.select(
        "topic", "partition", "offset", F.col("key").alias("raw_key"), F.col("value").alias("raw_payload"), *[v.alias(k) for k, v in found.items()],
        reason.alias("dlq_reason"), detail.alias("dlq_detail"),
    )


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether a record has a fault."""
    faulty = F.col("dlq_reason").isNotNull()
    return parsed.where(~faulty).drop("dlq_reason", "dlq_detail"), parsed.where(faulty)


def lateness() -> Column:
    """Whole seconds between a sample's event and its ingestion."""
    return F.unix_seconds("ingest_time") - F.unix_seconds("event_time")


def is_late(watermark_seconds: int, enabled: bool = True) -> Column:
    """Whether a sample came after the watermark's allowance; never when detection is off, as for a replay."""
    return F.coalesce(lateness() > watermark_seconds, F.lit(False)) if enabled else F.lit(False)


def split_late(accepted: DataFrame, watermark_seconds: int = 90, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(on time, too late); the late ones with ``lateness_seconds``."""
    late = is_late(watermark_seconds, enabled)
    return accepted.where(~late), accepted.where(late).withColumn("lateness_seconds", lateness())


def side_outputs(parsed: DataFrame, failed_at: Column | None = None, watermark_seconds: int = 90, version: str = "1", enabled: bool = True) -> DataFrame:
    """Rejected and late records as messages with their destination ``topic``; one pass over the source serves both."""
    failed_at = F.current_timestamp() if failed_at is None else failed_at
    late = is_late(watermark_seconds, enabled)
    topic = F.when(F.col("dlq_reason").isNotNull(), "telemetry.dlq").when(late, "telemetry.late")
    envelope = F.struct(
        F.lit("1.0").alias("schema_version"), "dlq_reason", "dlq_detail", F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), S.format_instant(failed_at).alias("failed_at"),
        F.lit(version).alias("processor_version"), S.base64_plain(F.coalesce("raw_payload", F.lit(b""))).alias("raw_payload"),
        S.base64_plain(F.col("raw_key")).alias("raw_key"),
    )
    note = F.struct(
        "machine_id", "event_id", S.format_instant(F.col("event_time")).alias("event_time"), lateness().alias("lateness_seconds"),
        F.lit(watermark_seconds).alias("watermark_seconds"), F.lit(version).alias("processor_version"),
        S.base64_plain(F.col("raw_payload")).alias("raw_payload"),
    )
    routed = parsed.withColumn("_to", topic).where(F.col("_to").isNotNull())
    value = F.when(F.col("_to") == "telemetry.dlq", S.json_encode(envelope)).otherwise(S.json_encode(note))
    return routed.select(F.col("machine_id").alias("key"), value.alias("value"), F.col("_to").alias("topic"))


def replayed(envelopes: DataFrame) -> DataFrame:
    """Dead letters (column ``value``) back as records with their original bytes and coordinates."""
    e = F.from_json("value", "source_topic string, source_partition int, source_offset long, raw_payload string, raw_key string")
    return envelopes.select(e.alias("e")).select(
        F.col("e.source_topic").alias("topic"), F.col("e.source_partition").alias("partition"), F.col("e.source_offset").alias("offset"),
        S.unbase64_tolerant(F.col("e.raw_key")).alias("key"), S.unbase64_tolerant(F.col("e.raw_payload")).alias("value"),
    )


def strict_errors(raw: DataFrame) -> DataFrame:
    """Records with the sorted paths of all fields that a strict reader refuses: wrong type, missing, or missing sensor key."""
    text = F.col("value").cast("string")
    get = lambda path: F.get_json_object(text, path)
    checks = [F.when(get(f"$.{n}").isNull(), F.lit(n)) for n in REQUIRED]
    keys = F.json_object_keys(get("$.readings"))
    for s in C.SENSORS:
        value = get(f"$.readings.{s}")
        missing = F.coalesce(~F.array_contains(keys, s), F.lit(True))
        wrong = value.isNotNull() & F.expr(f"try_cast(get_json_object(cast(value as string), '$.readings.{s}') as double)").isNull()
        checks.append(F.when(missing | wrong, F.lit(f"readings.{s}")))
    return raw.withColumn("errors", F.array_join(F.array_sort(F.array_compact(F.array(*checks))), "; "))


def first_by_event(samples: DataFrame, *order: str) -> DataFrame:
    """One row per event_id: the first in the given order."""
    rank = F.row_number().over(W.partitionBy("event_id").orderBy(*order))
    return samples.withColumn("_n", rank).where("_n = 1").drop("_n")


def manifest(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row on where a snapshot comes from: counts, duplicates, failures, span, machines, and end offsets by partition."""
    good = parsed.where(F.col("dlq_reason").isNull())
    ends = raw.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))
    return (
        parsed.agg(
            F.count(F.lit(1)).alias("records"), F.count_if(F.col("dlq_reason").isNotNull()).alias("failures"),
        )
        .crossJoin(good.agg(  # single rows
            F.count(F.lit(1)).alias("samples"), (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("duplicates"),
            F.unix_micros(F.min("event_time")).alias("first_us"), F.unix_micros(F.max("event_time")).alias("last_us"),
            F.count_distinct("machine_id").alias("machines"),
        ))
        .crossJoin(ends.agg(F.count(F.lit(1)).alias("partitions"), F.sum("end_offset").alias("end_offsets")))
    )


def snapshot(raw: DataFrame, path: str, partitions: int = 8) -> DataFrame:
    """Parse, keep the first of each event, and write samples sorted by machine and time; returns the written table."""
    accepted, _ = split_valid(parse(raw))
    rows = first_by_event(accepted, "partition", "offset").drop("raw_key", "raw_payload", "topic")
    rows.repartitionByRange(partitions, "machine_id", "event_time").sortWithinPartitions("machine_id", "event_time").write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path)


def write_routed(messages: DataFrame, path: str) -> None:
    """Batch form of the sink with a destination per row: a folder per topic."""
    messages.write.mode("append").partitionBy("topic").json(path)

"""Exact deduplication with the keyed state of a Structured Streaming query.

A feed of (digest, identifier, content locator) rows runs through a streaming
aggregation whose state is keyed by digest, kept in RocksDB on disk, and never
expires. Per digest the state retains the identifier and locator of the row to
keep and the number of rows seen. The state is read with Spark's state data
source. Rows that hit an occupied digest are then compared with the kept row's
whole text; rows whose text differs (a digest collision) are grouped by their
text instead, so the result is right for any digest.

Everything is DataFrame code: no Python runs on the executors.

Defined results: null text counts as empty; a null identifier is the smallest;
repeated rows (same identifier, same text) are one group whose single kept row is
the one with the largest locator, so exactly one of them is kept; an empty table
gives an empty result; columns other than the identifier and the text are not
read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.common import free_name, scratch, text_of, written

#: Session settings for the keyed state: on disk, without preallocated logs and with small buffers, so that many state
#: partitions stay small on disk and in memory. They also hold when the state is read, so they stay set.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
}


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def with_locator(docs: DataFrame, name: str = "_locator") -> DataFrame:
    """``docs`` with the column ``name``, the file and row of each row's content; frames that are no plain file scan are written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = written(docs, "dedup-input")
    return docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def digest_state(spark: SparkSession, feed_path: str, checkpoint: str) -> DataFrame:
    """Run what is new in the feed through the keyed state; return the state, a row per digest.

    Called again with the same checkpoint after rows were appended to the feed,
    it reads the new files only.
    """
    feed = spark.readStream.schema(spark.read.parquet(feed_path).schema).parquet(feed_path)
    keyed = feed.groupBy("digest").agg(
        F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    query = (
        keyed.writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col("value")[value[0]]["id"].alias("keep_id"),
        F.col("value")[value[0]]["locator"].alias("keep_locator"),
        F.col("value")[value[1]].alias("n"),
    )


def deduplicate(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    rows_per_salt: int = 2048,
    locator: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest, locator, text_sha256.

    The comparison of whole texts is dealt by (digest, salt): a group of n rows is
    spread over n / ``rows_per_salt`` salts, to each of which the kept text goes. ``locator``: the column of ``with_locator``, if ``docs`` has it already.
    """
    spark = docs.sparkSession
    name = locator or free_name(docs.columns, "_locator")
    located = docs if locator else with_locator(docs, name)
    rows = located.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), F.col(name).alias("locator"))
    feed_path = scratch(spark, "digest-feed")
    rows.select("id", "locator", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256")).write.parquet(feed_path)
    feed = spark.read.parquet(feed_path)
    state = digest_state(spark, feed_path, scratch(spark, "digest-state"))
    shared = state.where("n > 1")

    single = feed.join(shared.select("digest"), "digest", "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "digest", "locator", "text_sha256",
    )

    hit_path = scratch(spark, "digest-hits")
    salts = F.ceil(F.col("n") / rows_per_salt).cast("int")
    (
        rows.withColumn("digest", digest(F.col("text")))
        .join(shared, "digest")
        .withColumn("is_keeper", F.col("id").eqNullSafe(F.col("keep_id")) & F.col("locator").eqNullSafe(F.col("keep_locator")))
        .withColumn("salts", salts)
        .write.parquet(hit_path)
    )
    hits = spark.read.parquet(hit_path)
    keeper = hits.where("is_keeper").select(
        "digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("keep_text")
    ).dropDuplicates(["digest", "salt"])
    checked = (
        hits.withColumn("salt", F.pmod(F.xxhash64("id", "locator"), F.col("salts")).cast("int"))
        .join(keeper, ["digest", "salt"])
        .withColumn("same", F.col("text") == F.col("keep_text"))
        .select("id", "digest", "locator", "keep_id", "is_keeper", "n", "same", F.when(~F.col("same"), F.col("text")).alias("other_text"),
                F.sha2("text", 256).alias("text_sha256"))
    )
    checked_path = scratch(spark, "digest-checked")
    checked.write.parquet(checked_path)
    checked = spark.read.parquet(checked_path)

    differing = checked.where("not same")
    lost = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("n_other"))
    matched = checked.where("same").join(lost, "digest", "left").select(
        "id", "keep_id", (F.col("n") - F.coalesce("n_other", F.lit(0))).alias("group_size"), F.col("is_keeper").alias("kept"),
        "digest", "locator", "text_sha256",
    )
    regrouped = differing.groupBy("digest", "other_text").agg(
        F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("size")
    )
    collided = differing.join(regrouped, ["digest", "other_text"]).select(
        "id", F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep.id")) & F.col("locator").eqNullSafe(F.col("keep.locator"))).alias("kept"),
        "digest", "locator", "text_sha256",
    )
    return single.unionByName(matched).unionByName(collided)


def keep_first_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat a kept row's text; all columns stay.

    Where identifiers are unique this keeps, of equal texts, the largest identifier.
    Repeated rows with one identifier and one text shrink to one row.
    """
    name, sha, place = (free_name(docs.columns, n) for n in ("_locator", "_dropped_sha", "_dropped_locator"))
    located = with_locator(docs, name)
    dropped = deduplicate(located, id_column, text_column, locator=name).where("not kept").select(F.col("text_sha256").alias(sha), F.col("locator").alias(place))
    return located.join(dropped, (F.col(name) == F.col(place)) & (F.sha2(text_of(text_column), 256) == F.col(sha)), "left_anti").drop(name)

"""Idempotent merges into Parquet tables: one writer per table, a new version swapped in.

A merge is a full outer join on the key. The writer puts the merged rows beside
the table and the reader follows the newest complete version, so a rerun of the same input
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in the order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], update: Column | None = None) -> DataFrame:
    """Stored rows with the incoming ones merged in, and ``was_inserted`` / ``was_changed``.

    Both have the same columns, incoming at most a row per key. Where both have a key the
    incoming values win if ``update`` (a condition on the stored row, columns prefixed
    ``old_``) holds; without it they always win.
    """
    values = [c for c in stored.columns if c not in keys]
    old = stored.select(*[F.col(c).alias(f"old_{c}") for c in stored.columns], F.lit(True).alias("_old"))
    new = incoming.select(*[F.col(c).alias(f"new_{c}") for c in stored.columns], F.lit(True).alias("_new"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"old_{k}") == F.col(f"new_{k}")
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.lit(True) if update is None else F.coalesce(update, F.lit(False))))
    joined = old.join(new, on, "full_outer").withColumn("_take", take)
    changed = F.lit(False)
    for c in values:
        changed |= ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return joined.select(
        *[F.coalesce(f"new_{k}", f"old_{k}").alias(k) for k in keys],
        *[F.when(F.col("_take"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in values],
        F.col("_old").isNull().alias("was_inserted"), (F.col("_take") & F.col("_old").isNotNull() & changed).alias("was_changed"),
    ).select(*stored.columns, "was_inserted", "was_changed")


def upsert_alerts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New alerts are inserted; known ones change only while nobody has touched them (status NEW)."""
    return merge(stored, incoming, ["alert_id"], F.col("old_status") == "NEW")


def upsert_windows(stored: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """The last write of a window wins; numbers that are not finite are stored as null."""
    numbers = [c for c, kind in incoming.dtypes if kind == "double"]
    clean = incoming.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in numbers}) if numbers else incoming
    return merge(stored, latest(clean, ["machine_id", "window_start"], order).select(*stored.columns), ["machine_id", "window_start"])


def provision(machines: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows to insert for machine codes not yet in the dimension, a row each."""
    return seen.groupBy("code").agg(F.min("line_code").alias("line_code")).join(machines.select("code"), "code", "left_anti")


def enrich(machines: DataFrame, seed: DataFrame) -> DataFrame:
    """The dimension with a seed's non-null values laid over it; machines of the seed alone are added."""
    columns = [c for c in machines.columns if c != "code"]
    s = seed.select("code", *[F.col(c).alias(f"_{c}") for c in columns if c in seed.columns])
    return machines.join(s, "code", "full_outer").select(
        "code", *[F.coalesce(f"_{c}", c).alias(c) if c in seed.columns else F.col(c) for c in columns]
    )


def purge(rows: DataFrame, time: str, now: Column, hours: int = 72) -> DataFrame:
    """What stays after rows older than the horizon went."""
    return rows.where(F.col(time) >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def event_sequence(rows: DataFrame, order: list[str], previous: int = 0) -> DataFrame:
    """Rows with ``event_seq``, going on from ``previous`` in the given order.

    Two levels: rows are numbered inside range partitions, partitions are offset by the sizes of
    those before, so no single task sees all rows.
    """
    spread = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    spread = spread.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct(*order)).alias("_first"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    starts = sizes.select("_p", before.alias("_before"))
    return spread.join(F.broadcast(starts), "_p").withColumn("event_seq", F.col("_n") + F.col("_before") + previous).drop("_p", "_n", "_before")

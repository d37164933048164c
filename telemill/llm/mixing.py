"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Sizes are words. Each source has a token budget: its weight's share of all
sizes, at most ``max_epochs`` times its own size, the excess going to the other
sources by weight until none is above. A source is first taken whole as often as
its budget holds it (complete epochs); what is left is a fractional epoch, taken
in the order of exponential keys -ln(u) / quality, prefix-summed to the budget.
Documents are taken while they fit; then, of the others, the one whose size comes nearest to what is left is
taken, when that comes nearer to the budget, and again while over half a percent is left. So a long document at the boundary moves no source off its target. The
candidates for that are gathered once: a few of each size.

The prefix sum has two levels: key buckets are summed per source, then single
documents are ordered only inside the bucket that the budget crosses. A source
with a third of all rows is therefore spread over its buckets.

Defined results: null or empty texts have size 0 and are taken 0 times over the
whole epochs; a null source is a source, last in order; repeated rows count
each, and ``mix`` repeats them exactly as often as the plan does; equal keys are ordered by identifier, text hash and row; an empty table gives an
empty result; further columns are ignored (``mix`` keeps them). Documents of equal identifier, text and source are exchangeable.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.llm.common import WORD_PATTERN, free_name, scratch, text_of, unit_hash, written

WEIGHTS = (1.0, 2.0, 3.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def quality_weight(text: Column) -> Column:
    """In (0.25, 1]: falls with the share of digits and symbols among the characters."""
    junk = F.regexp_count(text, F.lit(r"[0-9#$%&*<>|=@/\\^~_]"))
    return 1.0 / (1.0 + 3.0 * junk / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size, a row per source) with rank, weight and target.

    Each round raises the level of the sources not yet at their cap and fixes those
    that reach it; only three sums per round come to the driver. There is a row per
    source name here, not per document, and the rounds are at most the sources.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.select(
        "source", "source_size", (F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        fixed, free, n = table.agg(
            F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(~capped, 1))
        ).first()
        higher = (total - (fixed or 0.0)) / free if n else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.withColumn("target", F.least(F.col("cap"), F.col("weight") * level)).drop("cap")


def take_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: float = 3.0,
    seed: int = 20240601,
    rows_per_bucket: int = 20_000,
    quality: Callable[[DataFrame, list[str]], DataFrame] | None = None,
    rounds: int = 8,
    tolerance: float = 0.005,
) -> DataFrame:
    """A row per document: id, text_hash, source, size, source_size, target, quality, key, row, epochs, copies, taken.

    ``quality`` takes the documents and names of columns, and returns these columns with ``quality``, a weight over 0; without it
    ``quality_weight`` serves.
    """
    spark = docs.sparkSession
    text = text_of(text_column)
    made = {"id": F.col(id_column), "source": F.col(source_column).cast("string"), "text_hash": F.xxhash64(text), "size": word_count(text)}
    mine = {free_name(docs.columns, f"_mix_{n}"): c for n, c in made.items()}
    sized = docs.withColumns(mine)
    sized = quality(sized, list(mine)) if quality else sized.select(*mine, quality_weight(text).alias("quality"))
    sized = sized.withColumnsRenamed(dict(zip(mine, made, strict=True)))
    path = scratch(spark, "mix-sizes")
    # rows are numbered once, as written, so that equal rows can be told apart
    sized.withColumns({"key": -F.log(unit_hash(F.col("id"), F.col("text_hash"), seed=seed)) / F.col("quality"), "row": F.monotonically_increasing_id()}).write.parquet(path)
    sized = spark.read.parquet(path)

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = source_targets(sources.drop("_rows"), weights, max_epochs)
    buckets = max(1, -(-sized.count() // rows_per_bucket)) * 4
    plan = (
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    # 1 - exp(-key) is monotone in the key and near uniform, so buckets are of like size
    sized = sized.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * buckets).cast("int"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
        .join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    )
    # starts has a row per source and bucket: rows_per_bucket / 4 times fewer than the documents
    placed = sized.join(
        starts.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "bucket_size", "before", "source_size", "target", "epochs", "rest"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")),
    ).drop("_s", "_b")
    inside = W.partitionBy("source", "bucket").orderBy("key", "id", "text_hash", "row").rowsBetween(W.unboundedPreceding, 0)
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest"))
    crossing = placed.where(cut).withColumn("_upto", F.col("before") + F.sum("size").over(inside))
    crossing = crossing.withColumn("extra", (F.col("_upto") <= F.col("rest")).cast("long")).drop("_upto")
    whole = placed.where(~cut).withColumn("extra", (F.col("before") < F.col("rest")).cast("long"))
    path = scratch(spark, "mix-first")
    whole.unionByName(crossing).write.parquet(path)
    first = spark.read.parquet(path)
    # what is left of each budget, a row per source
    gaps = written(first.groupBy("source").agg((F.first("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"), F.first("target").alias("of")), "mix-gaps").withColumnRenamed("source", "_s")
    # the documents left out that could fit it: of each size at most ``rounds``, those of the smallest keys in as many classes, so a pass with partial sums is enough
    others = first.where("extra = 0 and size > 0").join(F.broadcast(gaps) if gaps.count() <= 10_000 else gaps, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("size") < 2 * F.col("gap"))
    few = others.groupBy("source", "gap", "of", "size", F.pmod(F.xxhash64("id", "text_hash", "row"), F.lit(rounds)).alias("class")).agg(F.min(F.struct("key", "text_hash", "row")).alias("best"))
    few = few.select("source", "gap", "of", "size", "best.key", "best.text_hash", "best.row")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        """Of one source: again and again the document that comes nearest to what is left, while that is over the tolerance."""
        part = part.sort_values(["key", "text_hash", "row"], kind="stable")
        gap, most = float(part["gap"].iloc[0]), float(part["of"].iloc[0]) * tolerance
        size, row, free, taken = part["size"].to_numpy(float), part["row"].to_numpy(), np.ones(len(part), bool), []
        for turn in range(rounds):
            if turn and gap <= most:
                break
            off = np.where(free, np.abs(gap - size), np.inf)
            at = int(off.argmin())
            if off[at] >= gap:
                break
            free[at] = False
            taken.append(row[at])
            gap -= size[at]
        return pd.DataFrame({"row": np.array(taken, np.int64)})

    chosen = written(few.groupBy("source").applyInPandas(fill, "row long"), "mix-last")  # as many rows as there are sizes under twice the gap, times rounds
    return (
        first.join(chosen.withColumn("_last", F.lit(1).cast("long")), "row", "left")
        .withColumn("copies", F.col("epochs") + F.col("extra") + F.coalesce("_last", F.lit(0)))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("bucket", "before", "bucket_size", "rest", "extra", "_last")
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; the columns stay as they are."""
    plan = take_plan(docs, id_column, text_column, source_column, **options)
    mine = {n: free_name(docs.columns, n) for n in ("_id", "_text_hash", "_source", "_least", "_most", "_sum", "_rows", "_copies", "_copy")}
    c = {n: F.col(m) for n, m in mine.items()}
    copies = plan.groupBy("id", "text_hash", "source").agg(
        F.min("copies").alias("_least"), F.max("copies").alias("_most"), F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows")
    ).where("_most > 0").toDF(*[mine[n] for n in ("_id", "_text_hash", "_source", "_least", "_most", "_sum", "_rows")])
    joined = docs.join(
        copies,
        (F.xxhash64(text_of(text_column)) == c["_text_hash"]) & F.col(id_column).eqNullSafe(c["_id"]) & F.col(source_column).cast("string").eqNullSafe(c["_source"]),
    )
    # of equal rows on both sides of the boundary some are taken once more than the others
    even = joined.where(c["_least"] == c["_most"]).withColumn(mine["_copies"], c["_most"])
    nth = F.row_number().over(W.partitionBy(c["_id"], c["_text_hash"], c["_source"]).orderBy(F.lit(0)))
    uneven = joined.where(c["_least"] < c["_most"]).withColumn(mine["_copies"], c["_least"] + (nth <= c["_sum"] - c["_least"] * c["_rows"]).cast("long"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), c["_copies"]))
    return even.unionByName(uneven).where(c["_copies"] > 0).withColumn(mine["_copy"], each).select(*docs.columns)

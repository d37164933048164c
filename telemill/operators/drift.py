"""Has the world changed: distributions against a frozen reference, alert rates, scores over time.

The reference is a small table (``freeze``) that is stored with a model, so that every day is compared with the same origin. Days look back
over a moving week of the machines that have no alert open: a machine that wears out is a finding, not a change of the world.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.operators.detectors import long_form
from telemill.operators.ranking import SKETCH, finite, quantile_columns, quantiles, running, sketch, sketch_quantiles

DAY = 86_400


def psi(reference: DataFrame, current: DataFrame, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index per feature over (feature, value) rows, in bins of the reference's quantiles; an empty bin counts as ``floor``."""
    cuts = quantiles(reference, ["feature"], "value", tuple(i / bins for i in range(1, bins)))
    edges = cuts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("q")).select("feature", F.col("q.value").alias("q"))
    place = F.size(F.filter("q", lambda v: v <= F.col("value")))

    def shares(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.where(F.col("value").isNotNull()).join(edges, "feature").groupBy("feature", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn(name, F.col("n") / F.sum("n").over(W.partitionBy("feature"))).drop("n")

    both = shares(reference, "p").join(shares(current, "c"), ["feature", "bin"], "full_outer")
    p, c = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(floor)) for x in ("p", "c"))
    total = both.groupBy("feature").agg(F.sum((c - p) * F.log(c / p)).alias("psi"))
    return total.withColumn("band", band(F.col("psi")))


def freeze(windows: DataFrame, features: list[str], bins: int = 10, k: int = SKETCH) -> DataFrame:
    """(feature, edges, shares, windows): the inner edges of ``bins`` quantile bins of the reference and its share in each. A row per feature, to be stored."""
    made = windows.agg(*[sketch(finite(F.col(f)), k).alias(f) for f in features])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("sketch")) for f in features]))
    cuts = made.select(each.alias("_e")).select("_e.feature", sketch_quantiles(F.col("_e.sketch"), [i / bins for i in range(1, bins)], k).alias("edges"))
    counts = binned(windows, cuts, features).groupBy("feature").agg(*[F.count_if(F.col("bin") == i).alias(f"_{i}") for i in range(bins)], F.count(F.lit(1)).alias("windows"))
    shares = F.array(*[F.try_divide(F.col(f"_{i}"), F.col("windows")) for i in range(bins)])
    return cuts.join(counts, "feature", "left").select("feature", "edges", shares.alias("shares"), F.coalesce("windows", F.lit(0).cast("long")).alias("windows"))


def binned(windows: DataFrame, frozen: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(keep..., feature, bin) for every value that is there; the bin is the number of edges at or under it."""
    rows = windows.select(*keep, *[finite(F.col(f)).alias(f) for f in features])
    long = long_form(rows, features, *keep).where(F.col("value").isNotNull()).join(F.broadcast(frozen.select("feature", "edges")), "feature")  # a row per feature
    return long.select(*keep, "feature", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("bin"))


def band(value: F.Column) -> F.Column:
    return F.when(value < 0.1, "stable").when(value <= 0.25, "moderate").otherwise("major")


def weekly_psi(frozen: DataFrame, windows: DataFrame, active: DataFrame, days: int = 7, floor: float = 1e-4) -> DataFrame:
    """(day, feature, windows, psi, band): for each day of ``windows`` (machine_id, window_start in epoch seconds, features) the stability index of the ``days`` days
    up to it against the frozen reference, over machines without an alert open on that day.

    ``active``: (machine_id, opened, closed) in epoch seconds. Values are counted per machine and day first; only these counts are spread over the days that look back on them.
    """
    features = [r["feature"] for r in frozen.select("feature").collect()]  # a row per feature
    bins = frozen.select(F.max(F.size("shares"))).first()[0] or 0
    counts = binned(windows.withColumn("_day", F.floor(F.col("window_start") / DAY)), frozen, features, "machine_id", "_day")
    counts = counts.groupBy("machine_id", "_day", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    last = windows.agg(F.floor(F.max("window_start") / DAY).alias("_last"))
    seen = counts.withColumn("day", F.explode(F.sequence("_day", F.col("_day") + (days - 1)))).crossJoin(F.broadcast(last)).where("day <= _last")  # one row
    open_on = active.select(F.col("machine_id").alias("_who"), F.explode(F.sequence(F.floor(F.col("opened") / DAY), F.floor(F.col("closed") / DAY))).alias("_on")).distinct()
    healthy = seen.join(open_on, (F.col("machine_id") == F.col("_who")) & (F.col("day") == F.col("_on")), "left_anti")
    found = healthy.groupBy("day", "feature").agg(F.sum("n").alias("windows"), *[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).alias(f"_{i}") for i in range(bins)])
    shares = F.array(*[F.col(f"_{i}") / F.col("windows") for i in range(bins)])
    both = found.withColumn("_now", shares).join(F.broadcast(frozen.select("feature", "shares")), "feature")  # a row per feature
    least = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(floor))
    terms = F.zip_with("_now", "shares", lambda c, p: (least(c) - least(p)) * F.log(least(c) / least(p)))
    return both.select("day", "feature", "windows", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi")).withColumn("band", band(F.col("psi")))


def ks(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature, from running sums over distinct values."""
    counts = reference.select("feature", "value", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        current.select("feature", "value", F.lit(0).alias("a"), F.lit(1).alias("b"))).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    gap = F.col("upto_a") / F.col("all_a") - F.col("upto_b") / F.col("all_b")
    return running(counts, ["feature"], "value", ["a", "b"]).withColumn("gap", gap).groupBy("feature").agg(F.max(F.abs("gap")).alias("ks"))


def unusual_days(alerts: DataFrame, expected: float, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Days whose alerts are under ``low`` or over ``high`` times the expected number."""
    days = alerts.groupBy(F.date_trunc("day", "detected_at").alias("day")).agg(F.count(F.lit(1)).alias("alerts")).withColumn("ratio", F.col("alerts") / expected)
    return days.where((F.col("ratio") < low) | (F.col("ratio") > high))


def daily_scores(scored: DataFrame, time: str = "event_time") -> DataFrame:
    """Per machine and day: number, median and 95th percentile of the scores."""
    rows, keys = scored.withColumn("day", F.date_trunc("day", time)), ["machine_id", "day"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(quantile_columns(rows, keys, "score", {"median": 0.5, "p95": 0.95}), keys, "left")


def disagreement(a: DataFrame, b: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of windows on which two detectors' verdicts (``is_anomaly``) differ, over all or by some of the keys or columns of ``a``."""
    by = by or []
    both = a.select(*keys, *[c for c in by if c not in keys], F.col("is_anomaly").alias("x")).join(b.select(*keys, F.col("is_anomaly").alias("y")), keys)
    return both.groupBy(*by).agg(F.avg((F.col("x") != F.col("y")).cast("double")).alias("disagreement"), F.count(F.lit(1)).alias("windows"))

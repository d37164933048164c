"""How good a detector is: per window, per episode, and what each threshold costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.operators import ranking
from telemill.operators.alerting import runs_in_days
from telemill.operators.ranking import running
from telemill.sources.shared import kept

# The quantiles of the sweep.
QUANTILES = (0.80, 0.85, 0.90, 0.925, 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995, 0.999)


def confusion(scored: DataFrame, threshold: Column | float) -> DataFrame:
    hit, true = F.col("score") >= threshold, F.col("is_anomaly")
    hit = F.coalesce(hit, F.lit(False))
    return scored.agg(
        F.count_if(true & hit).alias("tp"), F.count_if(~true & hit).alias("fp"), F.count_if(~true & ~hit).alias("tn"), F.count_if(true & ~hit).alias("fn")
    )


def rates(tp: Column, fp: Column, fn: Column, undefined: float | None = 0.0) -> dict[str, Column]:
    """Precision, recall and F1; ``undefined`` where nothing was flagged or nothing is anomalous."""
    made = {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)}
    return {k: F.coalesce(v, F.lit(undefined).cast("double")) for k, v in made.items()}


def pr_curve(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall, tp, fp) for every distinct score, missing scores counting as 0.

    The running sums go through range partitions of the scores, so no task orders all of them.
    """
    points = scored.groupBy(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("threshold")).agg(
        F.count_if("is_anomaly").alias("p"), F.count_if(~F.col("is_anomaly")).alias("n")
    )
    full = running(points, [], "threshold", ["p", "n"], descending=True).withColumnsRenamed({"upto_p": "tp", "upto_n": "fp", "all_p": "positives"})
    return full.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "positives").alias("recall"), "tp", "fp", "p", "positives")


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall, over falling thresholds: each point's own positives are its step."""
    return pr_curve(scored).agg(F.sum(F.col("precision") * F.try_divide("p", "positives")).alias("average_precision"))


def thin(curve: DataFrame, points: int = 400) -> DataFrame:
    """At most ``points`` rows of a curve, evenly spread over rising thresholds; the last point is among them."""
    curve = kept(curve, "curve")
    n = curve.count()
    if n <= points:
        return curve
    numbered = running(curve.withColumn("_one", F.lit(1)), [], "threshold", ["_one"]).withColumn("_i", F.col("upto__one") - 1)
    chosen = F.floor(F.col("_i") * (points - 1) / (n - 1)) != F.floor((F.col("_i") - 1) * (points - 1) / (n - 1))
    return numbered.where(chosen | (F.col("_i") == 0)).select(*curve.columns)


def window_metrics(scored: DataFrame, threshold: Column | float, undefined: float | None = 0.0) -> DataFrame:
    c = confusion(scored, threshold).withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), undefined))
    return c.crossJoin(average_precision(scored))  # single rows


def episode_outcomes(scored: DataFrame, episodes: DataFrame, threshold: Column | float) -> DataFrame:
    """Per episode: its windows, the highest score, whether it was caught and after how many seconds."""
    own = scored.where(F.col("episode_id").isNotNull()).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("scorable_windows"), F.max("score").alias("max_score"),
        F.min(F.when(F.col("score") >= threshold, F.col("window_end"))).alias("_first"),
    )
    return episodes.join(own, "episode_id", "left").select(
        "episode_id", "machine_id", "anomaly_type", "duration_seconds", F.coalesce("scorable_windows", F.lit(0)).cast("long").alias("scorable_windows"),
        "max_score", F.col("_first").isNotNull().alias("detected"), (F.col("_first") - F.unix_micros("started_at") / 1e6).alias("detection_latency_seconds"),
    )


def operating_points(scored: DataFrame, episodes: DataFrame, slide_seconds: int, quantiles: tuple[float, ...] = QUANTILES, least: int = 2, undefined: float | None = 0.0) -> DataFrame:
    """What each quantile of the scores as threshold buys: one pass over the windows, spread over the dozen thresholds."""
    scored = kept(scored, "scored")
    span = scored.agg(F.max("window_start").alias("_b"), F.min("window_start").alias("_a"), F.count_distinct("machine_id").alias("_m"))
    at = F.array(*map(F.lit, quantiles))
    thresholds = ranking.quantiles(scored, [], "score", quantiles).crossJoin(span).select(  # a dozen rows and one
        F.col("value").alias("threshold"), F.greatest((F.col("_b") - F.col("_a")) / 3600.0, F.lit(1e-9)).alias("hours"), F.greatest("_m", F.lit(1)).alias("machines"),
        F.element_at(at, F.col("i") + 1).alias("quantile"),
    )
    each = scored.crossJoin(F.broadcast(thresholds))  # a dozen rows
    hit, true = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)), F.col("is_anomaly")
    windows = each.groupBy("quantile", "threshold", "hours", "machines").agg(
        F.count_if(hit).alias("alert_windows"), F.count_if(true & hit).alias("tp"), F.count_if(~true & hit).alias("fp"), F.count_if(true & ~hit).alias("fn")
    )
    over = runs_in_days(each.where(hit), ["quantile", "machine_id"], F.col("_gap") != slide_seconds)
    events = over.groupBy("quantile", "machine_id", "_run").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).groupBy("quantile").agg(F.count(F.lit(1)).alias("alert_events"))
    caught = each.where(F.col("episode_id").isNotNull()).groupBy("quantile", "episode_id").agg(F.min(F.when(hit, F.col("window_end"))).alias("_first"))
    late = caught.join(episodes.select("episode_id", "started_at"), "episode_id").withColumn("_after", F.col("_first") - F.unix_micros("started_at") / 1e6)
    outcome = late.groupBy("quantile").agg(F.count(F.lit(1)).alias("episodes_total"), F.count("_first").alias("episodes_detected"))
    outcome = outcome.join(ranking.quantile_columns(late, ["quantile"], "_after", {"median_detection_latency_seconds": 0.5}), "quantile", "left")
    zero = F.lit(0).cast("long")
    joined = windows.join(events, "quantile", "left").join(outcome, "quantile", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("alert_events", "episodes_total", "episodes_detected")}
    )
    return joined.withColumns({
        "alert_events_per_hour": F.col("alert_events") / F.col("hours"), "alert_events_per_machine_hour": F.col("alert_events") / F.col("hours") / F.col("machines"),
        **{f"window_{k}": v for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn"), undefined).items()},
        "episode_recall": F.coalesce(F.try_divide("episodes_detected", "episodes_total"), F.lit(0.0)),
    }).drop("tp", "fp", "fn", "hours", "machines")


def within_budget(points: DataFrame, per_machine_hour: float = 0.5) -> DataFrame:
    """The lowest quantile within the alert budget, else the highest of all."""
    fits = F.col("alert_events_per_machine_hour") <= per_machine_hour
    return points.orderBy(F.desc(fits), F.when(fits, F.col("quantile")).otherwise(-F.col("quantile"))).limit(1)


def false_positives(scored: DataFrame, threshold: Column | float) -> DataFrame:
    return scored.where((F.col("score") >= threshold) & ~F.col("is_anomaly"))


def false_positive_profile(scored: DataFrame, threshold: Column | float) -> DataFrame:
    """(dimension, value, n, share, median_fraction): false alarms by machine (the ten worst), by hour and by state; the row ``all`` has their share of all alarms and
    the median share of anomalous samples in their windows."""
    wrong = kept(false_positives(scored, threshold), "false-alarms")
    hour = F.lpad((F.floor(F.col("window_start") / 3600) % 24).cast("string"), 2, "0")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (
        ("all", F.lit("")), ("machine", F.col("machine_id")), ("hour", hour), ("state", F.col("machine_state")))]))
    counts = wrong.select(each.alias("e")).groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    few = counts.withColumn("_r", rank).where((F.col("dimension") != "machine") | (F.col("_r") <= 10)).drop("_r")
    alarms = scored.agg(F.count_if(F.col("score") >= threshold).alias("_alarms"))
    middle = ranking.quantile_columns(wrong, [], "anomaly_fraction", {"_median": 0.5})
    whole = F.col("dimension") == "all"
    return few.crossJoin(alarms).crossJoin(middle).select(  # single rows
        "dimension", "value", "n", F.when(whole, F.col("n") / F.greatest("_alarms", F.lit(1))).alias("share"), F.when(whole, F.col("_median")).alias("median_fraction"))


def missed_profile(outcomes: DataFrame) -> DataFrame:
    """Per anomaly type: episodes, missed and detected ones, median durations and the median highest score of the missed."""
    missed = ~F.col("detected")
    outcomes = kept(outcomes, "outcomes")
    out = outcomes.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(missed).alias("missed"), F.count_if("detected").alias("found"))
    for name, x in (
        ("median_missed_seconds", F.when(missed, F.col("duration_seconds"))), ("median_detected_seconds", F.when(F.col("detected"), F.col("duration_seconds"))),
        ("median_missed_score", F.when(missed, F.col("max_score"))),
    ):
        out = out.join(ranking.quantile_columns(outcomes, ["anomaly_type"], x, {name: 0.5}), "anomaly_type", "left")
    return out

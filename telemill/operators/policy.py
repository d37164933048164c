"""Which windows are scored, how a score is graded, and the scored message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S
from telemill.operators.features import seconds


def is_mature(tolerance_steps: float = 2.0) -> Column:
    """The gaps at both ends of the window are within some mean steps between its samples."""
    n, first, last = F.col("sample_count"), seconds(F.col("first_event")), seconds(F.col("last_event"))
    span = last - first
    gap = F.greatest(first - seconds(F.col("window_start")), seconds(F.col("window_end")) - last, F.lit(0.0))
    return F.coalesce(F.when((n >= 2) & (span > 0), gap * (n - 1) <= span * tolerance_steps), F.lit(False))


def skip_reason(min_samples: int = 30, min_running: float = 0.9, tolerance_steps: float = 2.0) -> Column:
    """Why a window is not scored, null when it is."""
    return (
        F.when(F.col("sample_count") < min_samples, "INSUFFICIENT_SAMPLES")
        .when((F.col("running_ratio") < min_running) | ~F.col("machine_state").eqNullSafe("RUNNING"), "MACHINE_NOT_RUNNING")
        .when(~is_mature(tolerance_steps), "WINDOW_NOT_MATURE")
    )


def admitted_for_training(min_samples: int = 30, min_running: float = 0.9) -> Column:
    return (F.col("sample_count") >= min_samples) & (F.col("running_ratio") >= min_running)


def severity(score: Column, threshold: Column) -> Column:
    place = (score - threshold) / F.greatest(1 - threshold, F.lit(1e-9))
    return F.when(place >= 0.7, "CRITICAL").when(place >= 0.4, "HIGH").otherwise("MEDIUM")


def top_contributors(names: Column, z: Column, limit: int = 3) -> Column:
    """The features of the largest deviations, in order of size, then of the contract; deviations that are not finite are left out."""
    pairs = F.zip_with(names, z, lambda n, v: F.struct(n.alias("feature"), v.alias("z_score")))
    numbered = F.transform(pairs, lambda p, i: F.struct((-F.abs(p["z_score"])).alias("by"), i.alias("i"), p["feature"].alias("feature"), p["z_score"].alias("z_score")))
    good = F.filter(numbered, lambda p: p["z_score"].isNotNull() & ~F.isnan(p["z_score"]) & (F.abs(p["z_score"]) < float("inf")))
    return F.transform(F.slice(F.array_sort(good), 1, limit), lambda p: F.struct(p["feature"].alias("feature"), p["z_score"].alias("z_score")))


def scored_event(windows: DataFrame, model: dict[str, str], scored_at: Column, **gate) -> DataFrame:
    """Scored messages from windows with ``raw_score``, ``score``, ``threshold`` and the z-scores ``z`` of their features."""
    reason = skip_reason(**gate)
    rows = windows.withColumn("skip_reason", F.when(reason.isNotNull(), reason).when(F.col("score").isNull(), "MODEL_UNAVAILABLE"))
    on = F.col("skip_reason").isNull()
    names = F.array(*map(F.lit, C.feature_names()))
    empty = F.array().cast(C.CONTRIBUTORS_DDL.replace(": ", ":"))
    return rows.select(
        F.lit("1.0").alias("schema_version"), "machine_id", "line_id", "window_start", "window_end", "sample_count", "running_ratio", "machine_state",
        on.alias("is_scored"), "skip_reason",
        *[F.when(on, F.col(a)).alias(b) for a, b in (("raw_score", "raw_score"), ("score", "anomaly_score"), ("threshold", "score_threshold"))],
        F.when(on, F.col("score") >= F.col("threshold")).alias("is_anomaly"),
        F.when(on, top_contributors(names, F.col("z"))).otherwise(empty).alias("top_contributors"),
        S.feature_map().alias("features"), F.struct(*[F.lit(v).alias(k) for k, v in model.items()]).alias("model"),
        scored_at.alias("scored_at"), (F.unix_millis(scored_at) - F.unix_millis("window_end")).alias("processing_delay_ms"),
    )


def encoded(events: DataFrame) -> DataFrame:
    """Scored messages as records of a topic: the machine as key, JSON with all fields as value."""
    text = [S.format_instant(F.col(c)).alias(c) if kind == "timestamp" else F.col(c) for c, kind in events.dtypes]
    return events.select(F.col("machine_id").alias("key"), S.json_encode(F.struct(*text)).alias("value"))


def window_means(features: Column) -> list[Column]:
    """Five means and the share of missing readings out of a feature map."""
    names = [*(f"{s}_mean" for s in C.SENSORS), "null_ratio"]
    return [F.try_element_at(features, F.lit(n)).alias(n) for n in names]


def anomalous(scored: DataFrame) -> DataFrame:
    """The windows that alerting reads: scored, anomalous, of a known machine, with the model's fields flat."""
    return scored.where(F.col("is_scored") & F.col("is_anomaly") & F.col("machine_id").isNotNull()).select(
        "machine_id", "line_id", "window_start", "window_end", "anomaly_score", "score_threshold",
        *[F.col(f"model.{k}").alias(f"model_{k}") for k in ("name", "version", "trained_at", "artifact_sha256")], "top_contributors",
    )

"""Fit, calibrate, choose a threshold within the alert budget, and evaluate once on what nobody has seen."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.operators import calibration, detectors, evaluation, labels
from telemill.operators.features import derived, panes, windows_of
from telemill.operators.policy import admitted_for_training
from telemill.sources.shared import kept

#: Candidates and their roles; ``secondary`` ones are reported for comparison and never chosen.
CANDIDATES = {
    "isolation_forest": "mandatory", "one_class": "mandatory", "three_sigma": "baseline", "three_sigma_all": "secondary", "mahalanobis": "exploratory",
}


@dataclass(frozen=True)
class Settings:
    window: int = 60
    slide: int = 10
    gate: int = 30
    train_hours: float = 28
    validation_hours: float = 38
    budget: float = 0.5
    least_fraction: float = 0.25
    features: tuple[str, ...] = ()


def base(windows: DataFrame, features: list[str]) -> tuple[dict, DataFrame]:
    """What every detector shares, profiles and preparation of the training windows, and the prepared rows."""
    windows = kept(windows, "training-windows")
    profiles = detectors.machine_profiles(windows, features)
    normal = kept(detectors.normalise(windows, profiles, features), "training-normal")
    prep = detectors.preparation(normal, features)
    model = {"features": list(features), "machine_profiles": profiles, "preparation": prep, "reference_profile": kept(detectors.reference_profile(windows, features), "reference")}
    return model, kept(detectors.prepared(normal, features, prep), "training-rows")


def with_detector(model: dict, rows: DataFrame, detector: str) -> dict:
    """The shared model with a detector fitted on the prepared rows and the grid of its scores there."""
    features, columns = model["features"], model["preparation"]["columns"]
    if detector == "mahalanobis":
        fit: dict = detectors.fit_mahalanobis(rows, columns)
    elif detector == "isolation_forest":
        forest = detectors.fit_isolation_forest(rows, columns)
        fit = {"columns": columns, "forest": {c: list(v) for c, v in forest.orderBy("tree", "node").toPandas().to_dict("list").items()}}  # 300 trees of at most 511 nodes
    elif detector == "one_class":
        fit = detectors.fit_one_class(rows, columns)
    elif detector in ("three_sigma", "three_sigma_all"):
        means = [f"{s}_mean" for s in C.SENSORS if f"{s}_mean" in features]
        fit = {"sigma": detectors.fit_three_sigma(rows, columns if detector == "three_sigma_all" else means or list(features))}
    else:
        raise ValueError(f"no detector {detector}")
    model = {**model, "detector": {"name": detector, **fit}}
    return {**model, "calibration": calibration.fit_ecdf(raw_scores(rows, model), "raw_score", exact=False)}


def fitted(windows: DataFrame, features: list[str], detector: str = "three_sigma") -> dict:
    """A calibrated model of training windows: profiles, preparation, detector and the grid of its training scores."""
    return with_detector(*base(windows, features), detector)


def raw_scores(rows: DataFrame, model: dict) -> DataFrame:
    d = model["detector"]
    if d["name"] == "isolation_forest":
        return detectors.forest_scores(rows, d["forest"], d["columns"])
    score = {"mahalanobis": detectors.mahalanobis, "one_class": detectors.one_class}.get(d["name"])
    return rows.withColumn("raw_score", score(d) if score else detectors.three_sigma(d["sigma"]))


def ready(windows: DataFrame, model: dict) -> DataFrame:
    """Windows as the detectors take them."""
    return detectors.prepared(detectors.normalise(windows, model["machine_profiles"], model["features"]), model["features"], model["preparation"])


def calibrated(rows: DataFrame, model: dict) -> DataFrame:
    """Prepared rows with ``raw_score`` and ``score``."""
    return raw_scores(rows, model).withColumn("score", calibration.ecdf(model["calibration"])("raw_score"))


def score(windows: DataFrame, model: dict) -> DataFrame:
    """Windows with ``raw_score`` and ``score``; their features stay as they came."""
    features = model["features"]
    keep = [c for c in windows.columns if c not in features]
    rows = windows.withColumns({f"_in_{f}": F.col(f) for f in features})
    return calibrated(ready(rows, model), model).select(*keep, *[F.col(f"_in_{f}").alias(f) for f in features], "raw_score", "score")


def splits(samples: DataFrame, truth: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Labelled, admitted windows per split: tumbling for training, sliding for the others. All come from the panes of one pass over the samples."""
    made = kept(panes(labels.temporal_split(samples, s.train_hours, s.validation_hours), s.slide, "split"), "split-panes")
    out = {}
    for name in ("train", "validation", "test"):
        slide = s.window if name == "train" else s.slide
        windows = derived(windows_of(made.where(F.col("split") == name), s.window, slide)).where(admitted_for_training(s.gate)).withColumns(
            {"window_start": F.unix_seconds("window_start"), "window_end": F.unix_seconds("window_end")})
        out[name] = kept(labels.align(truth, windows, s.window, slide, s.least_fraction), f"split-{name}")  # read by every candidate
    return out


SCORED = ("machine_id", "window_start", "window_end", "machine_state", "is_anomaly", "episode_id", "score")


def evaluate(detector: str, model: dict, rows: dict[str, DataFrame], episodes: DataFrame, s: Settings) -> DataFrame:
    """One row: the threshold chosen on validation and the metrics on validation and test. ``rows``: the prepared splits."""
    model = with_detector(model, rows["train"], detector)
    validation, test = (kept(calibrated(rows[name], model).select(*SCORED), name) for name in ("validation", "test"))
    best = evaluation.within_budget(evaluation.operating_points(validation, episodes, s.slide), s.budget).first()
    metrics = evaluation.window_metrics(test, best["threshold"]).first()
    caught = evaluation.episode_outcomes(test, episodes.join(test.select("episode_id"), "episode_id", "left_semi"), best["threshold"]).agg(F.avg(F.col("detected").cast("double"))).first()[0]
    row = (detector, best["quantile"], best["threshold"], best["window_f1"], best["episode_recall"], metrics["precision"], metrics["recall"], metrics["f1"], metrics["average_precision"], caught,
           float(model["detector"].get("condition", 1.0)), model["detector"].get("rank", 1) == len(model["detector"].get("columns", [0])) if "rank" in model["detector"] else True)
    schema = ("name string, quantile double, threshold double, validation_f1 double, validation_episode_recall double, test_precision double, test_recall double, test_f1 double,"
              " test_average_precision double, test_episode_recall double, condition double, full_rank boolean")
    return episodes.sparkSession.createDataFrame([row], schema)


def prepared_splits(parts: dict[str, DataFrame], train: DataFrame, features: list[str]) -> tuple[dict, dict[str, DataFrame]]:
    """The shared model of the training windows and all splits prepared by it, each written once for all candidates."""
    model, rows = base(train, features)
    return model, {"train": rows, **{name: kept(ready(parts[name], model), f"ready-{name}") for name in ("validation", "test")}}


def run(samples: DataFrame, truth: DataFrame, s: Settings, candidates: dict[str, str] = CANDIDATES) -> DataFrame:
    """A row per candidate (name: role), with ``selected`` for the one that validation prefers.

    Candidates are fitted and judged side by side, a thread each: their many small jobs wait for one another within a candidate only.
    """
    truth = kept(truth, "truth")
    parts, episodes = splits(samples, truth, s), kept(labels.episode_table(truth), "episodes")
    model, ready_rows = prepared_splits(parts, parts["train"], list(s.features))
    one = inheritable_thread_target(samples.sparkSession)(lambda name, role: evaluate(name, model, ready_rows, episodes, s).withColumn("role", F.lit(role)))
    with ThreadPoolExecutor(max(1, len(candidates))) as pool:
        rows = list(pool.map(one, *zip(*candidates.items(), strict=True)))
    return choose(kept(reduce(DataFrame.unionByName, rows), "candidates"))


def choose(rows: DataFrame) -> DataFrame:
    """Rows of ``evaluate`` with their ``role``, marked with ``selected``."""
    judged = rows.select(
        "name", F.col("validation_episode_recall").alias("episode_recall"), F.col("validation_f1").alias("f1"), "condition", "full_rank",
        (F.col("role") == "secondary").alias("secondary"), F.lit(False).alias("failed"),
    )
    winner = select_model(judged).select("name", F.lit(True).alias("selected"))
    return rows.join(winner, "name", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def select_model(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest episode recall, then F1, of those that may be chosen."""
    may = ~F.col("failed") & ~F.col("secondary") & F.col("full_rank") & (F.col("condition") <= 1e12)
    return candidates.where(may).orderBy(F.desc("episode_recall"), F.desc("f1"), "name").limit(1)


def clean_variant(samples: DataFrame, truth: DataFrame, s: Settings, detector: str = "three_sigma") -> DataFrame:
    """The same detector fitted on all training windows and on those without labelled anomalies, side by side."""
    truth = kept(truth, "truth")
    parts, episodes = splits(samples, truth, s), kept(labels.episode_table(truth), "episodes")
    out = None
    for variant, train in (("all", parts["train"]), ("clean", parts["train"].where(~F.col("is_anomaly")))):
        one = evaluate(detector, *prepared_splits(parts, train, list(s.features)), episodes, s).withColumn("variant", F.lit(variant))
        out = one if out is None else out.unionByName(one)
    return out


def champion(rows: DataFrame) -> DataFrame:
    """``challenger`` wins when it beats champion and baseline in (episode recall, F1) on the same test set, else ``champion`` stays."""
    key = F.max(F.when(F.col("role") != "challenger", F.struct("episode_recall", "f1"))) < F.max(F.when(F.col("role") == "challenger", F.struct("episode_recall", "f1")))
    return rows.agg(F.when(key, "challenger").otherwise("champion").alias("winner"))

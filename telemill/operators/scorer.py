"""A trained model on the workers: loaded once per process, applied to Arrow batches, the same in batch and on a stream.

What grows with the machines, their profiles, is joined by Spark. The rest of a model has a bounded size (medians, scales, a grid of quantiles, a
detector) and goes to the workers as one broadcast text; a worker parses it on first use and keeps it for all later tasks and batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators import calibration, detectors

#: Models of this process by digest.
_LOADED: dict[str, Scorer] = {}
MOST_LOADED = 4


class Scorer:
    """Preparation, detector and calibration of one model over arrays of normalised features."""

    def __init__(self, model: dict) -> None:
        features, prep, detector = model["features"], model["preparation"], model["detector"]
        self.medians = np.array([prep["medians"][f] for f in features], float)
        self.missing = [features.index(f) for f in prep["missing"]]
        columns = prep["columns"]
        self.mean, self.deviation = (np.array([prep["scale"][c][i] for c in columns], float) for i in (0, 1))
        self.grid = np.array(model["calibration"], float)
        self.name = detector["name"]
        pick = lambda names: np.array([columns.index(c) for c in names], int)
        if self.name in ("three_sigma", "three_sigma_all"):
            sigma = detector["sigma"]
            at, m, s = pick(sigma), *(np.array([sigma[c][i] for c in sigma], float) for i in (0, 1))
            self.raw = lambda z: np.abs((z[:, at] - m) / s).max(axis=1)
        elif self.name == "mahalanobis":
            at, m, p = pick(detector["columns"]), np.array(detector["mean"], float), np.array(detector["precision"], float)
            self.raw = lambda z: detectors.mahalanobis_of(z[:, at], m, p)
        elif self.name == "isolation_forest":
            at, trees = pick(detector["columns"]), detectors.trees_of(detector["forest"])
            self.raw = lambda z: detectors.forest_of(z[:, at], trees)
        elif self.name == "one_class":
            at, w, b = pick(detector["columns"]), np.array(detector["w"], float), np.array(detector["b"], float)
            weights, rho = np.array(detector["weights"], float), float(detector["rho"])
            self.raw = lambda z: rho - detectors.fourier_of(z[:, at], w, b) @ weights
        else:
            raise ValueError(f"no detector {self.name}")

    def prepared(self, x: np.ndarray) -> np.ndarray:
        """Gaps filled, columns that tell of gaps added, standardised."""
        gaps = np.isnan(x)
        filled = np.where(gaps, self.medians, x)
        return (np.hstack([filled, gaps[:, self.missing].astype(float)]) - self.mean) / self.deviation

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.raw(self.prepared(x)) if len(x) else np.zeros(0)
        return raw, calibration.ecdf_of(raw, self.grid) if len(self.grid) else np.full(len(raw), np.nan)


def loaded(digest: str, text: str) -> Scorer:
    """The model of this text, parsed on first use in this process."""
    if digest not in _LOADED:
        while len(_LOADED) >= MOST_LOADED:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[digest] = Scorer(json.loads(text))
    return _LOADED[digest]


def normalised(windows: DataFrame, profiles: DataFrame, features: list[str], name: str = "_x") -> DataFrame:
    """``windows`` with the array ``name`` of features relative to their machine's profile, to the fleet's where a machine has none.

    A left join, so ``windows`` may be a stream; the fleet's profile, a pair of numbers per feature, is put in as constants.
    """
    whole = {r["feature"]: (r["median"], r["iqr"]) for r in profiles.where(F.col("machine_id").isNull()).select("feature", "median", "iqr").collect()}  # a row per feature
    pairs = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "iqr"))))
    own = profiles.where(F.col("machine_id").isNotNull()).groupBy("machine_id").agg(pairs.alias("_p"))
    own = own.select(F.col("machine_id").alias("_who"), *[F.array(*[F.try_element_at("_p", F.lit(f))[part] for f in features]).alias(column) for part, column in (("median", "_median"), ("iqr", "_iqr"))])
    constant = lambda i: F.array(*[F.lit(whole.get(f, (None, None))[i]).cast("double") for f in features])
    joined = windows.join(own, F.col("machine_id") == F.col("_who"), "left")
    x = F.array(*[F.col(f).cast("double") for f in features])
    fleet = lambda mine, i: F.coalesce(F.zip_with(mine, constant(i), lambda a, b: F.coalesce(a, b)), constant(i))
    relative = F.zip_with(F.zip_with(x, fleet(F.col("_median"), 0), lambda a, m: a - m), fleet(F.col("_iqr"), 1), lambda a, i: a / i)
    return joined.withColumn(name, relative).drop("_who", "_median", "_iqr")


def scorer(spark, model: dict) -> Column:
    """An iterator pandas function from arrays of normalised features to (raw_score, score)."""
    text = json.dumps({k: model[k] for k in ("features", "preparation", "detector", "calibration")})
    digest, shared = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)

    @F.pandas_udf("raw_score double, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = loaded(digest, shared.value)
        for x in batches:
            raw, score = own.scores(np.array(x.tolist(), float).reshape(len(x), len(own.medians)))
            yield pd.DataFrame({"raw_score": raw, "score": score})

    return run


def score(windows: DataFrame, model: dict) -> DataFrame:
    """Windows with ``raw_score`` and ``score`` by any trained model (``training.fitted``, ``artifacts.load``); all columns stay."""
    rows = normalised(windows, model["machine_profiles"], list(model["features"]))
    rows = rows.withColumn("_s", scorer(windows.sparkSession, model)("_x"))
    return rows.withColumns({"raw_score": F.col("_s.raw_score"), "score": F.col("_s.score")}).drop("_x", "_s")

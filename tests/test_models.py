"""Models against plain computations: moments, sketches, boundaries, scores on the workers, drift."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import artifacts, detectors, drift, ranking, scorer, training


def frame(spark, x, parts=4):
    columns = [f"c{i}" for i in range(x.shape[1])]
    return columns, spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in columns)).repartition(parts)


# moments and the robust covariance


def test_merged_moments_equal_those_of_all_rows():
    x = np.random.default_rng(0).normal(size=(500, 4)) + [0, 1e6, -1e8, 3]
    m = (0, np.zeros(4), np.zeros((4, 4)))
    for part in np.array_split(x, [0, 3, 4, 100, 499]):
        m = detectors.merged_moments(m, detectors.moments_of(part))
    assert m[0] == 500 and np.allclose(m[1], x.mean(axis=0)) and np.allclose(m[2] / 499, np.cov(x.T))


@pytest.mark.parametrize("fan_in", [64, 2])
def test_moments_of_tasks(spark, fan_in):
    x = np.c_[np.random.default_rng(1).normal(size=(300, 3)) * [1, 1e-3, 1e3] + [0, 1e5, -1e7], np.full(300, 0.1)]
    columns, df = frame(spark, x, 7)
    mean, covariance, n = detectors._moments(df, columns, fan_in)
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(covariance, np.cov(x.T), rtol=1e-6, atol=1e-12)
    assert covariance[3, 3] == 0.0 and (np.diag(covariance) >= 0).all()
    assert detectors._moments(df.limit(0), columns)[2] == 0


def test_column_constant_in_the_kept_share(spark):
    """Nine tenths of the rows have one value in a column; those that leave it are the outliers."""
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(size=(400, 3)), np.full(400, 0.7)]
    x[:40, 3] = 0.7 + rng.normal(size=40)
    columns, df = frame(spark, x)
    model = detectors.fit_mahalanobis(df, columns)
    assert model["flat"] == ["c3"] and model["rank"] == 4 == len(model["columns"]) and math.isfinite(model["condition"])
    rows = df.withColumn("d", detectors.mahalanobis(model)).collect()
    least = min(r["d"] for r in rows if abs(r["c3"] - 0.7) > 0.1)
    assert least > max(r["d"] for r in rows if r["c3"] == 0.7)
    same = df.select("c0", "c1", F.lit(2.5).alias("c2"), (F.col("c0") * 2).alias("c3"))
    model = detectors.fit_mahalanobis(same, columns)
    assert model["columns"] == ["c0", "c1"] and model["dependent"] == 2 and model["flat"] == []
    assert detectors.fit_mahalanobis(df.select(*[F.lit(1.0).alias(c) for c in columns]), columns)["columns"] == []


def test_mahalanobis_of_clean_rows_equals_a_plain_concentration(spark):
    x = np.random.default_rng(3).normal(size=(300, 4)) @ np.random.default_rng(4).normal(size=(4, 4))
    columns, df = frame(spark, x)
    kept = x
    for _ in range(6):
        mean, precision = kept.mean(axis=0), np.linalg.inv(np.cov(kept.T))
        d = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
        kept = x[d <= np.sort(d)[int(np.ceil(0.75 * len(x))) - 1]]
    model = detectors.fit_mahalanobis(df, columns)
    got = sorted(r[0] for r in df.select(detectors.mahalanobis(model)).collect())
    assert np.allclose(got, sorted(d), rtol=1e-6)


def test_mahalanobis_over_all_features_of_the_larger_tables(spark):
    """The windows of the bench, where a feature is constant in the share that the first step keeps."""
    from telemill.plans import ml_queries as mq

    rows = mq.standard(spark, "/root/testdata/sf0.1")
    model = detectors.fit_mahalanobis(rows, mq.ALL)
    assert model["rank"] == len(model["columns"]) and math.isfinite(model["condition"])
    eigen = np.linalg.eigvalsh(np.array(model["precision"]))
    assert eigen.min() > 0
    x = np.array(rows.select(*model["columns"]).collect(), float)
    d = x - np.array(model["mean"])
    want = np.einsum("ij,ij->i", d @ np.array(model["precision"]), d)
    got = np.array([r[0] for r in rows.select(detectors.mahalanobis(model)).collect()])
    assert (got >= 0).all() and np.allclose(np.sort(got), np.sort(want), rtol=1e-8)


# sketches


def test_small_sketches_are_exact_and_large_ones_near(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=700)] + [("b", float(v)) for v in rng.integers(0, 5, 40)] + [("c", None), ("d", 4.0), ("e", float("nan")), ("e", 1.0)]
    rows += [("big", float(v)) for v in rng.exponential(size=60_000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    at = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    sketches = df.groupBy("k").agg(ranking.sketch(ranking.finite(F.col("x"))).alias("s"))
    got = {r["k"]: r["q"] for r in sketches.select("k", ranking.sketch_quantiles(F.col("s"), at).alias("q")).collect()}
    mine = {k: np.sort([x for key, x in rows if key == k and x is not None and x == x]) for k in got}
    for k in "abde":
        assert got[k] == pytest.approx(np.quantile(mine[k], at).tolist())
    assert got["c"] == [None] * len(at)
    ranks = np.searchsorted(mine["big"], got["big"]) / len(mine["big"])
    assert np.abs(ranks - at).max() < 2 * 2.3 / ranking.SKETCH**0.97 + 1 / ranking.SKETCH
    whole = sketches.agg(ranking.merged_sketch(F.col("s")).alias("s")).select(ranking.sketch_quantiles(F.col("s"), at).alias("q")).first()["q"]
    every = np.sort(np.concatenate(list(mine.values())))
    assert np.abs(np.searchsorted(every, whole[1:-1]) / len(every) - at[1:-1]).max() < 0.01


def test_profiles_of_sketches_equal_the_exact_ones(spark):
    rng = np.random.default_rng(6)
    rows = [("abc"[i % 3], float(rng.normal()) if i % 5 else None, 2.0 if i % 3 == 0 else float(i % 7)) for i in range(400)] + [("d", None, 1.0)]
    df = spark.createDataFrame(rows, "machine_id string, x double, y double").repartition(4)
    rows = lambda profiles: sorted((r["machine_id"] or "", r["feature"], round(r["median"], 9), round(r["iqr"], 9)) for r in profiles.collect())
    assert rows(detectors.machine_profiles(df, ["x", "y"])) == rows(detectors.exact_machine_profiles(df, ["x", "y"]))


# the one-class boundary


def test_boundary_over_all_rows_is_near_that_of_a_sample(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(size=(4000, 3)), rng.normal(size=(200, 3)) * 0.2 + 5]
    columns, df = frame(spark, x)
    whole, part = detectors.fit_one_class(df, columns), detectors.fit_one_class(detectors.subsample(df, columns, 1500), columns)
    assert np.allclose(whole["w"], whole["w"]) and abs(whole["rho"] - part["rho"]) < 0.02
    scores = {}
    for name, m in (("whole", whole), ("part", part)):
        phi = np.cos(x @ np.array(m["w"]).T + np.array(m["b"])) * math.sqrt(2 / len(m["b"]))
        scores[name] = m["rho"] - phi @ np.array(m["weights"])
    assert (scores["whole"] > 0).mean() == pytest.approx(0.05, abs=0.005)
    assert np.corrcoef(scores["whole"], scores["part"])[0, 1] > 0.9


def test_each_step_of_the_boundary_equals_numpy(spark):
    x = np.random.default_rng(8).normal(size=(600, 3))
    columns, df = frame(spark, x)
    m = detectors.fit_one_class(df, columns, nu=0.1, width=16, steps=3)
    w, b = np.array(m["w"]), np.array(m["b"])
    phi, weights = np.cos(x @ w.T + b) * math.sqrt(2 / 16), np.full(16, 0.25)
    for step in range(1, 4):
        score = phi @ weights
        order = np.argsort(score)[:60]
        weights = weights * (1 - 1 / step) + phi[order].mean(axis=0) / step
    assert np.abs(weights - np.array(m["weights"])).max() < 0.01  # a bin's rows count in proportion
    assert m["rho"] == pytest.approx(np.quantile(phi @ weights, 0.1), abs=0.01)


# scores on the workers


def machines(spark, n=300):
    rng = np.random.default_rng(9)
    rows = [(f"m{i % 3}", *(None if rng.random() < 0.1 else float(v) for v in rng.normal(i % 3, 1, 3))) for i in range(n)] + [("m0", 9.0, -9.0, 9.0), ("new", 0.0, 1.0, 2.0), ("new", None, None, None)]
    return spark.createDataFrame(rows, "machine_id string, temperature_c_mean double, power_kw_mean double, c double").withColumn("row", F.monotonically_increasing_id())


@pytest.mark.parametrize("detector", list(training.CANDIDATES))
def test_scorer_equals_the_columns(spark, tmp_path, detector):
    df, features = machines(spark), ["temperature_c_mean", "power_kw_mean", "c"]
    df = spark.createDataFrame(df.collect(), df.schema)  # the same row numbers in every use
    model = training.fitted(df.where("machine_id <> 'new'"), features, detector)
    loaded = artifacts.load(spark, artifacts.save(spark, str(tmp_path / "m"), model), features)
    want = {r["row"]: (r["raw_score"], r["score"]) for r in training.score(df, model).collect()}
    rows = scorer.score(df, loaded)
    assert rows.columns == [*df.columns, "raw_score", "score"]
    got = {r["row"]: (r["raw_score"], r["score"]) for r in rows.collect()}
    assert got.keys() == want.keys() and len(got) == df.count()
    assert all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-12) for i in got)


def test_a_model_is_loaded_once_per_process():
    import json

    model = {"features": ["a"], "preparation": {"medians": {"a": 0.0}, "missing": [], "columns": ["a"], "scale": {"a": [0.0, 1.0]}}, "detector": {"name": "three_sigma", "sigma": {"a": [0.0, 2.0]}}, "calibration": [0.0, 1.0]}
    text = json.dumps(model)
    one = scorer.loaded("x", text)
    assert scorer.loaded("x", "not read again") is one
    for i in range(scorer.MOST_LOADED):
        scorer.loaded(f"other {i}", text)
    assert scorer.loaded("x", text) is not one and len(scorer._LOADED) == scorer.MOST_LOADED
    raw, score = one.scores(np.array([[1.0], [np.nan], [-4.0]]))
    assert raw.tolist() == [0.5, 0.0, 2.0] and score.tolist() == [0.5, 0.0, 1.0]
    with pytest.raises(ValueError, match="no detector"):
        scorer.Scorer({**model, "detector": {"name": "other"}})


# drift


def test_weekly_psi_equals_counting(spark):
    rng = np.random.default_rng(10)
    rows = [(f"m{i % 4}", int(day * 86_400 + h * 3600), float(rng.normal(day / 10, 1)) if rng.random() < 0.9 else None) for i, day in enumerate(np.repeat(np.arange(30), 16)) for h in [i % 24]]
    df = spark.createDataFrame(rows, "machine_id string, window_start long, x double")
    old, new = df.where("window_start < 10 * 86400"), df.where("window_start >= 10 * 86400")
    active = [("m1", 12 * 86_400, 14 * 86_400), ("m2", 20 * 86_400 + 5, 20 * 86_400 + 5)]
    frozen = drift.freeze(old, ["x"])
    got = {r["day"]: r for r in drift.weekly_psi(frozen, new, spark.createDataFrame(active, "machine_id string, opened long, closed long")).collect()}
    values = np.array([x for m, t, x in rows if t < 864_000 and x is not None])
    edges = np.quantile(values, np.arange(1, 10) / 10)
    share = lambda v: np.maximum(np.bincount(np.searchsorted(edges, v, "right"), minlength=10) / len(v), 1e-4)
    p = share(values)
    for day in range(10, 30):
        busy = {m for m, a, b in active if a // 86_400 <= day <= b // 86_400}
        week = np.array([x for m, t, x in rows if t >= 864_000 and day - 6 <= t // 86_400 <= day and m not in busy and x is not None])
        c = share(week)
        assert got[day]["windows"] == len(week) and got[day]["psi"] == pytest.approx(((c - p) * np.log(c / p)).sum())
    assert set(got) == set(range(10, 30))

"""Rules on rows made for them: what the driver's tables do not show."""

import datetime as dt
import json
import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S
from telemill.operators import alerting, artifacts, calibration, detectors, evaluation, policy, ranking, service, training
from telemill.operators import features as X
from telemill.sources import ingest, tables
from telemill.streaming.alert_state import advance

T0 = dt.datetime(2026, 9, 6, 14, 22, 10, tzinfo=dt.UTC)


def samples(spark, rows):
    schema = "event_id string, machine_id string, line_id string, event_time timestamp, machine_state string, " + ", ".join(f"{s} double" for s in C.SENSORS)
    return spark.createDataFrame(rows, schema)


def one(i, seconds, machine="M-001", state="RUNNING", values=(20.0, 1.0, 2.0, 50.0, 1000.0)):
    return (f"e{i}", machine, "LINE-A", T0.replace(second=0) + dt.timedelta(seconds=seconds), state, *values)


def test_fifty_two_features_in_order():
    names = C.feature_names()
    assert len(names) == 52 == len(set(names))
    assert names[0] == "temperature_c_mean" and names[40] == "power_per_rpm_mean" and names[-1] == "null_ratio"


def test_alert_id_is_the_golden_one(spark):
    row = spark.range(1).select(
        S.alert_id(F.lit("M-014"), F.lit(T0), F.lit("isolation_forest"), F.lit("1.3.0")).alias("id"),
        S.alert_id(F.lit(""), F.lit(T0), F.lit("m"), F.lit("1")).alias("empty"), S.alert_id(F.lit("a|b"), F.lit(T0), F.lit("m"), F.lit("1")).alias("bar"),
    ).first()
    assert row["id"] == "2c891855-4e2f-51f1-87e0-9103b5091c7c"
    assert row["id"] == str(uuid.uuid5(uuid.UUID(C.ALERT_NAMESPACE), "M-014|2026-09-06T14:22:10.000Z|isolation_forest|1.3.0"))
    assert row["empty"] is None and row["bar"] is None


@pytest.mark.parametrize(("text", "micros"), [
    ("2026-09-06T14:22:10.123Z", 123_000), ("2026-09-06T16:22:10.123456789+02:00", 123_456), ("2026-09-06T14:22:10", None), ("soon", None), (None, None)])
def test_instants_need_a_zone(spark, text, micros):
    got = spark.createDataFrame([(text,)], "x string").select(F.unix_micros(S.parse_instant(F.col("x")))).first()[0]
    assert got == (None if micros is None else int(T0.timestamp()) * 1_000_000 + micros)


def test_features_of_single_flat_and_missing_values(spark):
    rows = [one(0, 0), one(1, 30, values=(20.0, None, 4.0, 60.0, 0.0)), one(2, 0, "M-002", values=(None,) * 5)]
    got = {r["machine_id"]: r for r in X.window_features(samples(spark, rows), 60, 60).collect()}
    a, b = got["M-001"], got["M-002"]
    assert a["temperature_c_stddev"] == 0 and a["temperature_c_zscore_last"] is None  # flat
    assert a["vibration_mm_s_stddev"] is None and a["vibration_mm_s_slope_per_second"] is None  # one value
    assert a["pressure_bar_slope_per_second"] == pytest.approx(2 / 30)
    assert a["power_per_rpm_mean"] == pytest.approx(0.05)  # a machine that hardly turns has no ratio
    assert a["corr_temperature_c__power_kw"] is None and a["corr_power_kw__rotation_rpm"] == pytest.approx(-1)
    assert b["temperature_c_mean"] is None and b["null_ratio"] == 1 and b["sample_count"] == 1


def test_windows_do_not_depend_on_arrival(spark):
    rng = np.random.default_rng(4)
    rows = [one(i, int(s), values=tuple(float(x) if rng.random() > 0.1 else None for x in rng.normal(50, 5, 5))) for i, s in enumerate(range(200))]
    a = X.window_features(samples(spark, rows), 60, 10).orderBy("window_start").toPandas()
    b = X.window_features(samples(spark, rows[::-1]).repartition(3), 60, 10).orderBy("window_start").toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


@pytest.mark.parametrize(("window", "slide"), [(60, 7), (60, 0)])
def test_bad_windows_are_refused(window, slide):
    with pytest.raises(ValueError):
        X.check_windows(window, slide)


def test_short_watermark_is_refused():
    with pytest.raises(ValueError):
        X.check_windows(60, 10, 5)


def test_maturity_needs_both_ends(spark):
    rows = [("full", 0, 59, 60), ("head missing", 30, 59, 30), ("tail missing", 0, 30, 31), ("single", 0, 0, 1)]
    df = spark.createDataFrame(rows, "name string, a long, b long, sample_count long").select(
        "name", "sample_count", F.timestamp_seconds("a").alias("first_event"), F.timestamp_seconds("b").alias("last_event"),
        F.timestamp_seconds(F.lit(0)).alias("window_start"), F.timestamp_seconds(F.lit(60)).alias("window_end"))
    assert {r["name"]: r["m"] for r in df.select("name", policy.is_mature().alias("m")).collect()} == {"full": True, "head missing": False, "tail missing": False, "single": False}


def test_contributors_skip_what_is_not_finite(spark):
    row = spark.range(1).select(policy.top_contributors(F.array(*map(F.lit, "abcd")), F.array(F.lit(1.0), F.lit(float("nan")), F.lit(-3.0), F.lit(None)), 2).alias("t")).first()
    assert [(x["feature"], x["z_score"]) for x in row["t"]] == [("c", -3.0), ("a", 1.0)]


RAW = {"schema_version": "1.0", "event_id": "e", "machine_id": "M-001", "line_id": "LINE-A", "event_time": "2026-09-06T14:22:10.000Z", "ingest_time": "2026-09-06T14:22:11.000Z",
       "machine_state": "RUNNING", "readings": {s: 1.0 for s in C.SENSORS}}


def record(spark, *values):
    rows = [("t", 0, i, bytearray(b"k"), None if v is None else bytearray(v.encode())) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset long, key binary, value binary")


def test_rejections_and_replay(spark):
    bad = [json.dumps(RAW), json.dumps(RAW)[:50], json.dumps(RAW | {"schema_version": "9.0"}), json.dumps({k: v for k, v in RAW.items() if k != "line_id"}),
           json.dumps(RAW | {"event_time": "then"}), None, json.dumps(RAW | {"readings": RAW["readings"] | {"power_kw": "high"}})]
    raw = record(spark, *bad)
    got = {r["offset"]: r for r in ingest.parse(raw).collect()}
    assert [got[i]["dlq_reason"] for i in range(7)] == [
        None, "MALFORMED_JSON", "UNSUPPORTED_SCHEMA_VERSION", "SCHEMA_VALIDATION_FAILED", "SCHEMA_VALIDATION_FAILED", "MALFORMED_JSON", "MALFORMED_JSON"]
    assert got[3]["dlq_detail"] == "line_id" and got[4]["dlq_detail"] == "event_time; event_time was then"
    back = {r["offset"]: bytes(r["value"]) for r in ingest.replayed(ingest.side_outputs(ingest.parse(raw)).where("topic = 'telemetry.dlq'")).collect()}
    assert back[1] == bad[1].encode() and back[5] == b""


def test_lateness_can_be_switched_off(spark):
    late = json.dumps(RAW | {"ingest_time": "2026-09-06T14:27:10.000Z"})
    good, _ = ingest.split_valid(ingest.parse(record(spark, json.dumps(RAW), late)))
    assert [x.count() for x in ingest.split_late(good)] == [1, 1]
    assert [x.count() for x in ingest.split_late(good, enabled=False)] == [2, 0]


def test_strict_reader_names_fields(spark):
    raw = record(spark, json.dumps(RAW), json.dumps(RAW | {"readings": {"power_kw": "high"}}))
    got = {r["offset"]: r["errors"] for r in ingest.strict_errors(raw).collect()}
    assert got[0] == "" and got[1] == "; ".join(sorted(f"readings.{s}" for s in C.SENSORS))


def frame(*rows):
    return pd.DataFrame(rows, columns=["window_start", "anomaly_score"])


def test_alert_state_machine():
    state, opened = advance(None, frame((0, 0.9)), 2, 120)
    assert opened == [] and state == (0, 1, 0)
    state, opened = advance(state, frame((0, 0.99), (10, 0.8), (10, 0.95)), 2, 120)  # an update of a window seen counts once
    assert opened == [(10, 0.95, 2)] and state == (1, 2, 10)
    state, opened = advance(state, frame((20, 0.9), (30, 0.9)), 2, 120)
    assert opened == []  # one alert an episode
    state, opened = advance(state, frame((200, 0.9), (210, 0.9)), 2, 120)
    assert opened == [(210, 0.9, 2)]  # silence over the gap starts a new one


def test_online_and_offline_rules_differ(spark):
    rows = spark.createDataFrame([("m", 0, 0.9), ("m", 20, 0.9), ("m", 30, 0.9)], "machine_id string, window_start long, score double")
    assert [r["first_window"] for r in alerting.alert_events(rows, 0.5, 10).collect()] == [20]
    assert [r["window_start"] for r in alerting.episode_alerts(rows, 120).collect()] == [20]


def test_merge_is_idempotent_and_spares_acknowledged(spark):
    schema = "alert_id string, status string, score double"
    stored = spark.createDataFrame([("a", "NEW", 0.1), ("b", "ACKNOWLEDGED", 0.2)], schema)
    new = spark.createDataFrame([("a", "NEW", 0.5), ("b", "NEW", 0.6), ("c", "NEW", 0.7)], schema)
    merged = tables.upsert_alerts(stored, new)
    got = {r["alert_id"]: (r["status"], r["score"], r["was_inserted"], r["was_changed"]) for r in merged.collect()}
    assert got == {"a": ("NEW", 0.5, False, True), "b": ("ACKNOWLEDGED", 0.2, False, False), "c": ("NEW", 0.7, True, False)}
    again = tables.upsert_alerts(merged.drop("was_inserted", "was_changed"), new)
    assert again.where("was_inserted or was_changed").count() == 0


def test_ecdf_repeats_and_ends(spark):
    grid = [0.0, 1.0, 1.0, 2.0]
    df = spark.createDataFrame([(-1.0,), (0.5,), (1.0,), (3.0,), (float("nan"),)], "x double")
    for column in (calibration.ecdf(grid)("x"), calibration.ecdf_native(F.col("x"), grid)):
        got = [r[0] for r in df.select(column).collect()]
        assert got[:4] == pytest.approx([0.0, 1 / 6, 2 / 3, 1.0]) and (got[4] is None or math.isnan(got[4]))


def test_pr_curve_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    score, true = rng.random(300).round(2), rng.random(300) < 0.2
    got = evaluation.pr_curve(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(score, true)], "score double, is_anomaly boolean")).toPandas().sort_values("threshold", ascending=False)
    cuts = sorted(set(score), reverse=True)
    assert got["threshold"].tolist() == pytest.approx(cuts)
    assert got["precision"].tolist() == pytest.approx([true[score >= c].mean() for c in cuts])
    assert got["recall"].tolist() == pytest.approx([true[score >= c].sum() / true.sum() for c in cuts])


def test_budget_falls_back_to_the_strictest(spark):
    df = spark.createDataFrame([(0.9, 0.4), (0.95, 0.2), (0.99, 0.1)], "quantile double, alert_events_per_machine_hour double")
    assert evaluation.within_budget(df, 0.25).first()["quantile"] == 0.95
    assert evaluation.within_budget(df, 0.01).first()["quantile"] == 0.99


def test_sort_key_and_granularity_are_checked(spark):
    with pytest.raises(ValueError):
        service.page(spark.range(1), sort="drop table")
    with pytest.raises(ValueError):
        service.count_over_time(spark.range(1), "second")


def blob(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(f"m{i % 3}", *map(float, rng.normal(0, 1, 3))) for i in range(n)] + [("m0", 9.0, -9.0, 9.0)]
    return spark.createDataFrame(rows, "machine_id string, a double, b double, c double")


def test_detectors_find_the_outlier(spark):
    df, columns = blob(spark), ["a", "b", "c"]
    forest = detectors.fit_isolation_forest(df, columns, trees=40, subsample=128)
    found = [
        df.withColumn("raw_score", detectors.three_sigma(detectors.fit_three_sigma(df, columns))),
        df.withColumn("raw_score", detectors.mahalanobis(detectors.fit_mahalanobis(df, columns))),
        df.withColumn("raw_score", detectors.one_class(detectors.fit_one_class(df, columns))),
        detectors.isolation_scores(df, forest, columns, 128),
    ]
    for scored in found:
        scores = scored.orderBy(F.desc("raw_score")).limit(20).toPandas()
        assert 9.0 in scores["a"].tolist()


def test_independent_columns():
    x = np.random.default_rng(0).normal(size=(200, 3))
    x = np.c_[x, x[:, 0] + x[:, 1], np.ones(200)]
    assert detectors.independent_columns(np.cov(x.T), list("abcde")) == ["a", "b", "c"]


def test_artifact_refuses_what_changed(spark, tmp_path):
    df = blob(spark).withColumnsRenamed({"a": "a_mean", "b": "b_mean"})
    path = artifacts.save(spark, str(tmp_path / "m"), training.fitted(df, ["a_mean", "b_mean"]))
    assert artifacts.load(spark, path, ["a_mean", "b_mean"])["detector"]["name"] == "three_sigma"
    with pytest.raises(ValueError, match="order"):
        artifacts.load(spark, path, ["b_mean", "a_mean"])
    spark.createDataFrame([("{}",)], "json string").write.mode("overwrite").parquet(f"{path}/detector")
    with pytest.raises(ValueError, match="changed"):
        artifacts.load(spark, path, ["a_mean", "b_mean"])


def test_sequence_goes_on(spark):
    rows = tables.event_sequence(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k")), ["k"], 5).toPandas().sort_values("k")
    assert rows["event_seq"].tolist() == list(range(6, 1006))


# models against plain computations


def wide(spark, n=300, k=6):
    x = np.random.default_rng(7).normal(size=(n, k)) @ np.random.default_rng(8).normal(size=(k, k))
    columns = [f"c{i}" for i in range(k)]
    return x, columns, spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in columns))


def test_mahalanobis_equals_numpy(spark):
    x, columns, df = wide(spark)
    mean, covariance, n = detectors._moments(df, columns)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(covariance, np.cov(x.T))
    model = detectors.fit_mahalanobis(df, columns, steps=0)
    want = np.einsum("ij,jk,ik->i", x - x.mean(axis=0), np.linalg.inv(np.cov(x.T)), x - x.mean(axis=0))
    assert np.allclose(sorted(r[0] for r in df.select(detectors.mahalanobis(model)).collect()), sorted(want))


def test_forest_scores_equal_a_walk_through_each_tree(spark):
    x, columns, df = wide(spark)
    forest = detectors.fit_isolation_forest(df, columns, trees=20, subsample=64).orderBy("tree", "node").collect()
    assert {r["tree"] for r in forest} == set(range(20)) and max(r["size"] for r in forest) <= 64
    nodes = {(r["tree"], r["node"]): r for r in forest}
    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    want = []
    for row in x:
        length = 0.0
        for tree in range(20):
            at = nodes[tree, 0]
            while at["feature"] >= 0:
                at = nodes[tree, at["left"] if row[at["feature"]] <= at["split"] else at["right"]]
            length += at["depth"] + c(at["size"])
        want.append(2 ** (-length / 20 / c(64)))
    got = detectors.isolation_scores(df, spark.createDataFrame(forest), columns, 64)
    assert np.allclose(sorted(r["raw_score"] for r in got.collect()), sorted(want))


def test_one_class_equals_numpy(spark):
    x, columns, df = wide(spark)
    m = detectors.fit_one_class(df, columns, nu=0.1)
    phi = np.cos(x @ np.array(m["w"]).T + np.array(m["b"])) * math.sqrt(2 / len(m["b"]))
    want = m["rho"] - phi @ np.array(m["weights"])
    assert np.allclose(sorted(r[0] for r in df.select(detectors.one_class(m)).collect()), sorted(want))
    assert (want > 0).mean() == pytest.approx(0.1, abs=0.01)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = [(k, None if rng.random() < 0.1 else float(v)) for k, v in zip(rng.choice(list("abc"), 700), np.r_[rng.normal(size=350), rng.integers(0, 4, 350)])] + [("d", 2.5), ("e", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(values, "k string, x double").repartition(5)
    probabilities = (0.0, 0.05, 0.5, 0.731, 1.0)
    got = {(r["k"], r["i"]): r["value"] for r in ranking.quantiles(df, ["k"], "x", probabilities).collect()}
    for k in {k for k, _ in values} - {"e"}:
        mine = [v for key, v in values if key == k and v is not None]
        assert [got[k, i] for i in range(5)] == pytest.approx(np.quantile(mine, probabilities).tolist())
    assert not any(k == "e" for k, _ in got)
    mine = [v for _, v in values if v is not None]
    for size in (2, 21, 1001):
        assert calibration.fit_ecdf(df, "x", size) == pytest.approx(np.quantile(mine, np.linspace(0, 1, size)).tolist())
    assert calibration.fit_ecdf(df.where("k = 'd'"), "x", 5) == [2.5] * 5 and calibration.fit_ecdf(df.where("k = 'e'"), "x", 5) == []


def test_runs_across_spans_are_those_of_one_window(spark):
    rng = np.random.default_rng(2)
    rows = [(m, int(t)) for m in "ab" for t in np.unique(rng.integers(0, 400, 150)) * 10]
    df = spark.createDataFrame(rows, "machine_id string, window_start long")
    one = {(r["machine_id"], r["window_start"]): r["_run"] for r in alerting.runs_in_days(df, ["machine_id"], F.col("_gap") != 10, span=10**9).collect()}
    for span in (50, 333, 1000):
        got = {(r["machine_id"], r["window_start"]): r["_run"] for r in alerting.runs_in_days(df, ["machine_id"], F.col("_gap") != 10, span=span).collect()}
        assert got == one and max(got.values()) > 10


def candidates(spark, *rows):
    return spark.createDataFrame(rows, "name string, role string, validation_episode_recall double, validation_f1 double, condition double, full_rank boolean")


def test_selection_leaves_out_what_may_not_be_chosen(spark):
    rows = candidates(
        spark, ("isolation_forest", "mandatory", 0.7, 0.9, 1.0, True), ("one_class", "mandatory", 0.8, 0.5, 1.0, True), ("three_sigma", "baseline", 0.8, 0.4, 1.0, True),
        ("three_sigma_all", "secondary", 0.99, 0.9, 1.0, True), ("mahalanobis", "exploratory", 0.95, 0.9, 1e13, True), ("singular", "exploratory", 0.95, 0.9, 1.0, False))
    assert {r["name"] for r in training.choose(rows).where("selected").collect()} == {"one_class"}
    assert training.choose(rows).count() == 6
    assert set(training.CANDIDATES) == {"isolation_forest", "one_class", "three_sigma", "three_sigma_all", "mahalanobis"} and training.CANDIDATES["three_sigma_all"] == "secondary"


def test_calibrated_scores_are_the_share_of_training_scores_below(spark):
    df = blob(spark).withColumnsRenamed({"a": "temperature_c_mean", "b": "power_kw_mean"})
    model = training.fitted(df, ["temperature_c_mean", "power_kw_mean", "c"])
    got = training.score(df, model).select("raw_score", "score").toPandas()
    raw = np.sort(got["raw_score"].to_numpy())
    share = np.searchsorted(raw, got["raw_score"], "right") / len(raw)
    assert np.abs(share - got["score"]).max() < 0.01
    assert set(model["detector"]["sigma"]) == {"temperature_c_mean", "power_kw_mean"}  # raw means only


def test_every_detector_can_be_trained(spark):
    df = blob(spark).withColumnsRenamed({"a": "temperature_c_mean", "b": "power_kw_mean"})
    shared = training.base(df, ["temperature_c_mean", "power_kw_mean", "c"])
    for name in training.CANDIDATES:
        scored = training.score(df, training.with_detector(*shared, name))
        top = scored.orderBy(F.desc("raw_score")).limit(20).toPandas()
        assert 9.0 in top["temperature_c_mean"].tolist(), name
        assert scored.where("score not between 0 and 1").count() == 0

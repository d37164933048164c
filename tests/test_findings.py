"""Queries against their SQL on tables on which they once failed or differed."""

import datetime as dt
import math

import oracle
import pytest

from telemill.sources import ingest
import __spark_entry__ as entry


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """A day of samples of two machines, a few minutes apart and all quiet: no window lacks a feature, has enough anomalous samples or a high score."""
    d = str(tmp_path_factory.mktemp("dense"))
    start = dt.datetime(2024, 1, 2)
    rows = [(i, start + dt.timedelta(minutes=3 * i, milliseconds=i), i % 2, ("view", "error")[i % 3 == 0], 120.0 if i == 7 else 40.0 + i * 7 % 23, f'{{"k": {i * 13 % 90}}}') for i in range(480)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/parts")
    next((tmp_path_factory.getbasetemp()).glob(f"{d.rsplit('/', 1)[1]}/parts/*.parquet")).rename(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["ml_impute_indicator", "ev_operating_points", "ev_window_metrics", "ev_report_tables"])
def test_dense_and_quiet(spark, dense, name):
    assert oracle.difference(entry.queries()[name](spark, dense), oracle.connect(dense), entry.oracle_sql()[name]) == ""


def test_a_filter_on_parsed_records_reads_messages_once(spark):
    raw = spark.createDataFrame([("t", 0, 1, b"k", b"{}")], "topic string, partition int, offset long, key binary, value binary")
    good, _ = ingest.split_valid(ingest.parse(raw))
    assert good.select("offset", "power_kw", "event_time")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_topics_are_files_of_bounded_size(spark, monkeypatch):
    from pathlib import Path

    from telemill.plans import tables as t

    monkeypatch.setattr(t, "FILE_ROWS", {"maxRecordsPerFile": "100"})
    assert len(list(Path(t.topic(spark, "/root/testdata/sf0.001")).glob("*.parquet"))) >= 10


def test_training_and_stream_read_the_same_samples(spark, monkeypatch):
    from telemill.operators import training
    from telemill.plans import streaming_queries

    seen = []

    def stop(windows, *_):
        seen.extend(windows.inputFiles())
        raise InterruptedError

    monkeypatch.setattr(training, "fitted", stop)
    with pytest.raises(InterruptedError):
        streaming_queries.scored_messages(spark, "/root/testdata/sf0.001", "three_sigma")
    assert seen and all("/samples-topic-" in path for path in seen)


def test_grid_of_a_sketch_is_that_of_its_quantiles(spark):
    import numpy as np

    from telemill.operators import ranking
    from pyspark.sql import functions as F

    steps = np.linspace(0.0, 1.0, 101)
    for n in (0, 1, 50, 5000):
        made = spark.createDataFrame(spark.range(n).agg(ranking.sketch(F.sqrt(F.col("id")), 64).alias("s")).collect(), "s binary")  # thinned at random: once
        want = made.select(ranking.sketch_quantiles(F.col("s"), steps.tolist(), 64).alias("q")).first()["q"]
        assert ranking.sketch_grid(made, "s", steps, 64) == ([] if n == 0 else pytest.approx(want, abs=1e-12))


def test_splits_come_from_one_pass_over_the_samples(spark, monkeypatch):
    from pyspark.sql import functions as F

    from telemill.functions import contracts as C
    from telemill.operators import features, labels, policy, training
    from telemill.plans import tables as t

    d, passes = "/root/testdata/sf0.001", []
    s = training.Settings(window=t.WINDOW, slide=t.SLIDE, gate=2, train_hours=240, validation_hours=480, features=tuple(C.feature_names()))
    monkeypatch.setattr(training, "panes", lambda *a: passes.append(a) or features.panes(*a))
    got = training.splits(t.samples(spark, d), t.labels(spark, d), s)
    assert len(passes) == 1
    parted = labels.temporal_split(t.samples(spark, d), s.train_hours, s.validation_hours)
    for name, slide in (("train", s.window), ("validation", s.slide), ("test", s.slide)):
        direct = features.derived(features.sliding(parted.where(F.col("split") == name), s.window, slide)).where(policy.admitted_for_training(s.gate))
        key = lambda r: (r["machine_id"], r["window_start"])
        want = {key(r): r for r in direct.withColumn("window_start", F.unix_seconds("window_start")).collect()}
        rows = {key(r): r for r in got[name].collect()}
        assert rows.keys() == want.keys() and want
        for k, r in rows.items():
            mine, other = ([math.nan if x[f] is None else x[f] for f in s.features] for x in (r, want[k]))
            assert mine == pytest.approx(other, rel=1e-9, abs=1e-9, nan_ok=True)
            assert (r["machine_state"], r["line_id"]) == (want[k]["machine_state"], want[k]["line_id"])


def test_a_step_of_the_one_class_fit_builds_its_sums_at_once(spark, monkeypatch):
    import numpy as np

    from telemill.operators import detectors

    x, calls, plain = np.random.default_rng(1).uniform(-0.2, 0.2, (200, 16)), [], detectors.F.sum
    phi, weights = spark.createDataFrame([(v,) for v in x.tolist()], "phi array<double>"), np.full(16, 0.25)
    monkeypatch.setattr(detectors.F, "sum", lambda c: calls.append(c) or plain(c))
    counts, sums, edges = detectors._outside(phi, weights)
    assert len(calls) <= 1
    assert counts.tolist() == np.histogram(x @ weights, edges)[0].tolist()
    assert sums.sum(axis=0) == pytest.approx(x.sum(axis=0))

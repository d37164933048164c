"""Detectors fitted and applied as Spark jobs over windows of features.

Order of preparation: divide out each machine, impute, standardise, detect,
calibrate. Only vectors as wide as the features and grids of a fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.operators.ranking import SKETCH, finite, merged_sketch, quantile_columns, sketch, sketch_quantiles
from telemill.sources.shared import kept

QUARTILES = (0.25, 0.5, 0.75)


def long_form(windows: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(keep..., feature, value), a row per window and feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return windows.select(*keep, F.explode(pairs).alias("_e")).select(*keep, "_e.feature", "_e.value")


PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def reference_profile(windows: DataFrame, features: list[str], k: int = SKETCH) -> DataFrame:
    """Per feature: count, mean, deviation, range and percentiles, in one pass over the wide rows. Percentiles are those of sketches of size ``k``
    (``ranking.sketch``: interpolated and exact up to ``k`` windows, beyond that with a bounded rank error)."""
    at = {f"p{q:02d}": q / 100 for q in PERCENTS}
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    values = {f: finite(F.col(f)) for f in features}
    row = windows.agg(*[g(x).alias(f"{name}__{f}") for f, x in values.items() for name, g in moments.items()], *[sketch(x, k).alias(f"sketch__{f}") for f, x in values.items()])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{name}__{f}").alias(name) for name in (*moments, "sketch")]) for f in features]))
    long = row.select(each.alias("_e")).select("_e.*")  # a row per feature
    got = long.withColumn("_q", sketch_quantiles(F.col("sketch"), list(at.values()), k))
    return got.select("feature", *moments, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(at)])


def machine_profiles(windows: DataFrame, features: list[str], k: int = SKETCH) -> DataFrame:
    """(machine_id, feature, median, iqr); the row with a null machine is the fleet's. No spread takes the fleet's, then 1.

    A sketch per machine and feature in one pass over the wide rows; the fleet's are merged from these, so rows are read once and only sketches move. Windows of no machine count for the fleet only.
    """
    pick = [sketch(finite(F.col(f)), k).alias(f) for f in features]
    own = kept(windows.groupBy("machine_id").agg(*pick), "profile-sketches")
    fleet = own.agg(*[merged_sketch(F.col(f), k).alias(f) for f in features]).select(F.lit(None).cast(own.schema["machine_id"].dataType).alias("machine_id"), *features)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("sketch")) for f in features]))
    long = own.where(F.col("machine_id").isNotNull()).unionByName(fleet).select("machine_id", each.alias("_e")).select("machine_id", "_e.feature", "_e.sketch")
    q = long.withColumn("_q", sketch_quantiles(F.col("sketch"), list(QUARTILES), k))
    q = kept(q.select("machine_id", "feature", F.get("_q", F.lit(1)).alias("median"), (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("iqr")), "profile-quartiles")
    one = F.lit(1.0)
    whole = q.where(F.col("machine_id").isNull()).select("feature", F.coalesce("median", F.lit(0.0)).alias("_m"), F.when(F.col("iqr") > 1e-9, F.col("iqr")).otherwise(one).alias("_i"))
    spread = F.when(F.col("iqr") > 1e-9, F.col("iqr")).otherwise(F.col("_i"))
    return kept(q.join(F.broadcast(whole), "feature").select("machine_id", "feature", F.coalesce("median", "_m").alias("median"), spread.alias("iqr")), "profiles")  # a row per feature


def exact_machine_profiles(windows: DataFrame, features: list[str]) -> DataFrame:
    """``machine_profiles`` without sketches: values are counted and ranked exactly, in several shuffles of a row per window and feature."""
    rows = long_form(windows, features, "machine_id")
    whose = F.explode(F.array(F.struct(F.lit(False).alias("fleet"), F.col("machine_id").alias("who")), F.struct(F.lit(True).alias("fleet"), F.lit(None).cast("string").alias("who"))))
    rows = kept(rows.select(whose.alias("w"), "feature", "value").select("w.fleet", F.col("w.who").alias("machine_id"), "feature", "value"), "profile-values")
    named = dict(zip(("_q1", "_q2", "_q3"), QUARTILES, strict=True))
    keys, one = ["fleet", "machine_id", "feature"], F.lit(1.0)
    found = quantile_columns(rows, keys, "value", named).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = (F.col("fleet") == F.col("_fleet")) & F.col("machine_id").eqNullSafe(F.col("_machine_id")) & (F.col("feature") == F.col("_feature"))
    # machines without a value of a feature take the fleet's
    q = kept(rows.select(*keys).distinct().join(found, same, "left").select(*keys, F.col("_q2").alias("median"), (F.col("_q3") - F.col("_q1")).alias("iqr")), "profile-quartiles")
    fleet = q.where("fleet").select("feature", F.coalesce("median", F.lit(0.0)).alias("_m"), F.when(F.col("iqr") > 1e-9, F.col("iqr")).otherwise(one).alias("_i"))
    spread = F.when(F.col("iqr") > 1e-9, F.col("iqr")).otherwise(F.col("_i"))
    return kept(q.join(fleet, "feature").select("machine_id", "feature", F.coalesce("median", "_m").alias("median"), spread.alias("iqr")), "profiles")


def normalise(windows: DataFrame, profiles: DataFrame, features: list[str]) -> DataFrame:
    """Features as (x - median) / iqr of their machine, of the fleet for machines without a profile; null stays null."""
    pairs = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "iqr"))))
    wide = profiles.groupBy("machine_id").agg(pairs.alias("_own"))
    own = wide.where(F.col("machine_id").isNotNull())
    fleet = F.broadcast(wide.where(F.col("machine_id").isNull()).select(F.col("_own").alias("_fleet")))  # one row
    joined = windows.join(own, "machine_id", "left").crossJoin(fleet)
    p = lambda f: F.coalesce(F.try_element_at("_own", F.lit(f)), F.try_element_at("_fleet", F.lit(f)))
    return joined.withColumns({f: (F.col(f) - p(f)["median"]) / p(f)["iqr"] for f in features}).drop("_own", "_fleet")


def unknown_machines(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    return windows.select("machine_id").distinct().join(profiles.where(F.col("machine_id").isNotNull()).select("machine_id").distinct(), "machine_id", "left_anti")


def preparation(windows: DataFrame, features: list[str], k: int = SKETCH) -> dict:
    """Medians (of sketches of size ``k``), which features lack values in training, and mean and deviation (of the whole) after imputation. Two passes over the wide rows."""
    windows = kept(windows.select(*features), "preparation")
    row = windows.agg(*[F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in features], *[sketch(finite(F.col(f)), k).alias(f"q_{f}") for f in features])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"q_{f}").alias("sketch")) for f in features]))
    found = {r["feature"]: r for r in row.select(each.alias("_e")).select("_e.feature", "_e.n", F.get(sketch_quantiles(F.col("_e.sketch"), [0.5], k), F.lit(0)).alias("median")).collect()}  # a row per feature
    medians = {f: float(found[f]["median"] or 0.0) for f in features}
    missing = [f for f in features if found[f]["n"]]
    filled = impute(windows, features, medians, missing)
    columns = [*features, *(f"missing_{f}" for f in missing)]
    row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scale = {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in columns}
    return {"medians": medians, "missing": missing, "columns": columns, "scale": scale}


def impute(windows: DataFrame, features: list[str], medians: dict[str, float], missing: list[str]) -> DataFrame:
    """Gaps filled with medians; a column per feature that had gaps in training tells where they were."""
    marks = {f"missing_{f}": F.col(f).isNull().cast("double") for f in missing}
    return windows.withColumns(marks).withColumns({f: F.coalesce(F.col(f), F.lit(medians[f])) for f in features})


def standardise(rows: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def prepared(windows: DataFrame, features: list[str], prep: dict) -> DataFrame:
    return standardise(impute(windows, features, prep["medians"], prep["missing"]), prep["scale"])


# three sigma


def fit_three_sigma(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    spread = lambda s: float(s) if s is not None and s > 1e-12 else 1.0
    return {c: (float(row[f"m_{c}"] or 0.0), spread(row[f"s_{c}"])) for c in columns}


def three_sigma(model: dict[str, tuple[float, float]]) -> Column:
    """The largest distance from a mean in standard deviations."""
    z = [F.abs((F.col(c) - m) / s) for c, (m, s) in model.items()]
    return F.greatest(*z) if len(z) > 1 else z[0]


# Mahalanobis


Moments = tuple[int, np.ndarray, np.ndarray]  # how many rows, their mean, their centred cross products


def merged_moments(a: Moments, b: Moments) -> Moments:
    """The moments of two sets of rows together: a product of two differences of means is all that joins them, so nothing cancels."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def moments_of(x: np.ndarray) -> Moments:
    """Rows are taken relative to the first, so a constant column has no spread at all."""
    if not len(x):
        return 0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
    y = x - x[0]
    mean = y.mean(axis=0)
    y -= mean
    return len(x), x[0] + mean, y.T @ y


MOMENTS = "part long, n long, mean array<double>, products array<double>"


def _moments(rows: DataFrame, columns: list[str], fan_in: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance. Tasks merge the moments of their batches, then groups of ``fan_in`` tasks merge theirs until so few
    rows as wide as the covariance are left that the driver merges them, in order of the tasks."""
    k, names = len(columns), [f.split()[0] for f in MOMENTS.split(", ")]

    def row(part: int, m: Moments) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([m[0]]), pa.array([m[1].tolist()], pa.list_(pa.float64())), pa.array([m[2].ravel().tolist()], pa.list_(pa.float64()))], names=names)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Moments = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            m = merged_moments(m, moments_of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)))
        if m[0]:
            yield row(TaskContext.get().partitionId(), m)

    def of_rows(found: list) -> Moments:
        m: Moments = (0, np.zeros(k), np.zeros((k, k)))
        for n, mean, products in found:
            m = merged_moments(m, (n, np.array(mean, float), np.array(products, float).reshape(k, k)))
        return m

    def of_group(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("part")
        return pa.Table.from_batches([row(key[0].as_py(), of_rows(list(zip(*(part.column(c).to_pylist() for c in names[1:]), strict=True))))])

    parts = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(of_task, MOMENTS)
    width = rows.rdd.getNumPartitions()
    while width > fan_in:
        parts, width = parts.withColumn("up", F.floor(F.col("part") / fan_in)).groupBy("up").applyInArrow(of_group, MOMENTS), -(-width // fan_in)
    found = parts.orderBy("part").collect()  # fan_in rows at most
    n, mean, products = of_rows([(r["n"], r["mean"], r["products"]) for r in found])
    return mean, products / max(1, n - 1), n


def independent_columns(covariance: np.ndarray, columns: list[str], least_variance: float = 1e-12, tolerance: float = 1e-6) -> list[str]:
    """Columns that are no combination of those before them, by pivot-free Cholesky steps on the correlations."""
    kept: list[int] = []
    d = np.sqrt(np.clip(np.diag(covariance), 0, None))
    for j in range(len(columns)):
        if d[j] ** 2 <= least_variance:
            continue
        c = covariance[np.ix_([*kept, j], [*kept, j])] / np.outer(d[[*kept, j]], d[[*kept, j]])
        rest = 1.0 - (c[-1, :-1] @ np.linalg.pinv(c[:-1, :-1]) @ c[:-1, -1] if kept else 0.0)
        if rest > tolerance:
            kept.append(j)
    return [columns[j] for j in kept]


FLAT = 0.01  # of its deviation over all rows, for a column that is constant in the kept share


def _precision(covariance: np.ndarray, columns: list[str], spread: np.ndarray) -> tuple[list[int], np.ndarray, dict]:
    """The columns that count, the inverse of their covariance, and its diagnostics.

    Independent columns are those of this covariance. One without spread here that has some over all rows (``spread``, deviations) counts by itself with
    ``FLAT`` of that: a row that leaves the constant is far away.
    """
    independent = [columns.index(c) for c in independent_columns(covariance, columns)]
    d = np.sqrt(np.clip(np.diag(covariance), 0, None))
    flat = [i for i in range(len(columns)) if d[i] ** 2 <= 1e-12 < spread[i] ** 2]
    if independent:
        scale = np.outer(d[independent], d[independent])
        correlation = covariance[np.ix_(independent, independent)] / scale
        values, inverse = np.linalg.eigvalsh(correlation), np.linalg.inv(correlation) / scale
    else:
        values, inverse = np.zeros(0), np.zeros((0, 0))
    used = independent + flat
    out = np.zeros((len(used), len(used)))
    out[: len(independent), : len(independent)] = inverse
    for at, i in enumerate(flat, len(independent)):
        out[at, at] = 1 / (FLAT * spread[i]) ** 2
    condition = float(values[-1] / values[0]) if len(values) and values[0] > 0 else float("inf")
    return used, out, {"rank": int((values > 1e-10).sum()) + len(flat), "condition": condition, "flat": [columns[i] for i in flat], "dependent": len(columns) - len(used)}


def fit_mahalanobis(rows: DataFrame, columns: list[str], support: float = 0.75, steps: int = 5) -> dict:
    """Robust centre and covariance: concentration steps that keep the ``support`` share of nearest rows.

    Ranges are left out. In each step, columns that others determine in the rows kept are left out of the distance. ``rank`` and ``condition`` (of the
    correlations), ``flat`` and ``dependent`` describe the last one.
    """
    columns = [c for c in columns if not c.endswith("_range")]
    rows = kept(rows.select(*columns), "mahalanobis")
    mean, covariance, n = _moments(rows, columns)
    spread = np.sqrt(np.clip(np.diag(covariance), 0, None))
    used, precision, about = _precision(covariance, columns, spread)
    model = lambda: {"columns": [columns[i] for i in used], "mean": mean[used].tolist(), "precision": precision.tolist(), **about}
    for _ in range(steps if used else 0):
        if n <= 2 * len(used):
            break
        distance = mahalanobis(model())
        cut = rows.agg(F.percentile_approx(distance, support, 10_000)).first()[0]  # the share kept is off by a ten thousandth at most
        mean, covariance, n = _moments(rows.where(distance <= cut), columns)
        used, precision, about = _precision(covariance, columns, spread)
    return model()


def mahalanobis(model: dict) -> Column:
    """Squared distance from the centre. A product of matrices per Arrow batch: as a column it would have a term per pair of features."""
    mean, precision = np.array(model["mean"]), np.array(model["precision"])

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        return pd.Series(mahalanobis_of(np.array(x.tolist(), float).reshape(len(x), max(1, len(mean))), mean, precision))

    return distance(F.array(*[F.col(c).cast("double") for c in model["columns"]]) if model["columns"] else F.array(F.lit(0.0)))


def mahalanobis_of(x: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    if not len(mean):
        return np.zeros(len(x))
    d = x - mean
    return np.einsum("ij,ij->i", d @ precision, d)


# isolation forest

TREE = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][3 if side == "left" else 4] = me
        spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(x.shape[1])
        if len(rows) <= 1 or depth >= limit or not (spread > 0).any():
            continue
        f = int(rng.choice(np.flatnonzero(spread > 0)))
        low, high = x[rows, f].min(), x[rows, f].max()
        split = float(rng.uniform(low, high))
        left = x[rows, f] <= split
        if left.all() or not left.any():
            continue
        nodes[me][1:3] = [f, split]
        stack += [(rows[~left], depth + 1, me, "right"), (rows[left], depth + 1, me, "left")]
    return nodes


def fit_isolation_forest(rows: DataFrame, columns: list[str], trees: int = 300, subsample: int = 256, seed: int = 0) -> DataFrame:
    """The forest as a table (``TREE``): every tree is grown in its own group from its own subsample of about ``subsample`` rows.

    A row draws the trees it goes to from its own hash, so the rows made are those that the trees take.
    """
    n = max(1, rows.count())
    share = min(1.0, 1.5 * subsample / n)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tree, u = [], [], []
            for row, h in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                rng = np.random.default_rng([h & (1 << 64) - 1, seed])
                own = rng.choice(trees, rng.binomial(trees, share), replace=False)
                at += [row] * len(own)
                tree += own.tolist()
                u += rng.integers(0, 1 << 62, len(own)).tolist()
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(tree, pa.int32()), pa.array(u, pa.int64())], names=[*columns, "tree", "_u"])

    values = rows.select(*[F.col(c).cast("double") for c in columns])
    drawn = values.withColumn("_h", F.xxhash64(*columns)).mapInArrow(draw, ", ".join(f"`{c}` double" for c in columns) + ", tree int, _u long")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_u").head(subsample)
        tree = int(part["tree"].iloc[0])
        nodes = _grow(part[columns].to_numpy(float), np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(2, subsample)))))
        return pd.DataFrame([(tree, *x) for x in nodes], columns=["tree", "node", "feature", "split", "left", "right", "size", "depth"])

    return drawn.repartition(min(trees, 64), "tree").groupBy("tree").applyInPandas(grow, TREE)  # a few trees a task


def _path_correction(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(rows: DataFrame, forest: DataFrame, columns: list[str], subsample: int = 256) -> DataFrame:
    """Rows with ``raw_score``: 2 to the minus mean path length over the expected one. The forest has a fixed size, at most 2 * subsample * trees nodes."""
    return forest_scores(rows, forest.orderBy("tree", "node").toPandas().to_dict("list"), columns, subsample)


def trees_of(forest: dict[str, list]) -> list[dict[str, np.ndarray]]:
    """The trees of a forest given as lists per column of ``TREE``, in order of tree and node."""
    nodes = {k: np.array(v) for k, v in forest.items()}
    if not len(nodes["tree"]):
        return []
    cuts = np.flatnonzero(np.diff(nodes["tree"])) + 1
    return [dict(zip(nodes, parts, strict=True)) for parts in zip(*(np.split(v, cuts) for v in nodes.values()), strict=True)]


def forest_of(x: np.ndarray, trees: list[dict[str, np.ndarray]], subsample: int = 256) -> np.ndarray:
    """2 to the minus mean path length over the expected one."""
    length = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), int)
        for _ in range(int(t["depth"].max()) + 1):
            inner = t["feature"][at] >= 0
            go_left = x[np.arange(len(x)), np.maximum(t["feature"][at], 0)] <= t["split"][at]
            at = np.where(inner, np.where(go_left, t["left"][at], t["right"][at]), at)
        length += t["depth"][at] + _path_correction(t["size"][at])
    return 2.0 ** (-length / max(1, len(trees)) / max(1e-9, float(_path_correction(np.array([subsample]))[0])))


def forest_scores(rows: DataFrame, forest: dict[str, list], columns: list[str], subsample: int = 256) -> DataFrame:
    """``isolation_scores`` with the forest as lists per column of ``TREE``, in order of tree and node."""
    model = rows.sparkSession.sparkContext.broadcast(trees_of(forest))
    schema = T.StructType([*rows.schema.fields, T.StructField("raw_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw_score=forest_of(batch[columns].to_numpy(float), model.value, subsample))

    return rows.mapInPandas(run, schema)


# one-class boundary on random Fourier features


BINS = 1024  # of scores, in each step


def fit_one_class(rows: DataFrame, columns: list[str], nu: float = 0.05, width: int = 64, steps: int = 25, seed: int = 0) -> dict:
    """A linear one-class boundary on random Fourier features of an RBF kernel (an approximation), fitted on all rows.

    Kernel width as 1 / (features * variance). Each step pulls the boundary towards the rows outside it, the ``nu`` share of lowest scores. Scores lie
    within the length of the weights times the square root of two, so one pass counts them in ``BINS`` even bins and sums the Fourier features of each; the boundary
    and the pull follow from these sums, the bin that the boundary crosses taken in proportion. A task sends a row per bin.
    """
    x = rows.select(*[F.col(c).cast("double") for c in columns])
    mean, products, n = _moments(x, columns)
    # the variance of all entries together, of every row and column
    variance = float((np.trace(products) * max(1, n - 1) / max(1, n) + ((mean - mean.mean()) ** 2).sum()) / len(columns)) if n else 0.0
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((width, len(columns))) * np.sqrt(2.0 / (len(columns) * (variance or 1.0)))
    b = rng.uniform(0, 2 * np.pi, width)
    model = {"columns": columns, "w": w.tolist(), "b": b.tolist()}
    if not n:
        return {**model, "weights": [1.0 / np.sqrt(width)] * width, "rho": 0.0}
    phi = kept(x.select(fourier(model).alias("phi")), "fourier")
    weights, rho = np.full(width, 1.0 / np.sqrt(width)), 0.0
    for step in range(1, steps + 2):
        counts, sums, edges = _outside(phi, weights)
        upto = np.cumsum(counts)
        target = nu * n
        at = int(np.searchsorted(upto, target))
        before = upto[at - 1] if at else 0
        part = (target - before) / max(1, counts[at])
        rho = float(edges[at] + part * (edges[at + 1] - edges[at]))
        if step > steps:  # the boundary of the last weights
            break
        pull = (sums[:at].sum(axis=0) + part * sums[at]) / target
        weights = weights * (1 - 1 / step) + pull / step
    return {**model, "weights": weights.tolist(), "rho": rho}


def _outside(phi: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many rows have their score in each bin, the sums of their features, and the bins' edges."""
    width = len(weights)
    most = float(np.linalg.norm(weights) * np.sqrt(2.0)) + 1e-12
    edges = np.linspace(-most, most, BINS + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(BINS, np.int64), np.zeros((BINS, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bin_ = np.clip(((x @ weights + most) * (BINS / (2 * most))).astype(int), 0, BINS - 1)
            counts += np.bincount(bin_, minlength=BINS)
            np.add.at(sums, bin_, x)
        used = np.flatnonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), flat], names=["bin", "n", "s"])

    total = F.expr(f"array({', '.join(f'sum(s[{i}])' for i in range(width))})")  # one text: a call to the driver per feature and step would cost more than the step
    found = phi.mapInArrow(add, "bin int, n long, s array<double>").groupBy("bin").agg(F.sum("n").alias("n"), total.alias("s")).collect()  # BINS rows
    counts, sums = np.zeros(BINS, np.int64), np.zeros((BINS, width))
    for r in found:
        counts[r["bin"]], sums[r["bin"]] = r["n"], r["s"]
    return counts, sums, edges


def fourier(model: dict) -> Column:
    """Random Fourier features, a product of matrices per Arrow batch."""
    w, b = np.array(model["w"]), np.array(model["b"])

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        return pd.Series(list(fourier_of(np.array(x.tolist(), float).reshape(len(x), w.shape[1]), w, b)))

    return features(F.array(*[F.col(c).cast("double") for c in model["columns"]]))


def fourier_of(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.cos(x @ w.T + b) * np.sqrt(2.0 / len(b))


def _sum(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)


def _dot(array: Column, weights: list[float]) -> Column:
    return _sum([array[i] * float(w) for i, w in enumerate(weights)])


def one_class(model: dict) -> Column:
    """Distance outside the boundary; positive is outside."""
    return F.lit(model["rho"]) - _dot(fourier(model), model["weights"])


def subsample(rows: DataFrame, keys: list[str], most: int = 8000, seed: int = 0) -> DataFrame:
    """The ``most`` rows of the smallest hashes: the same on every run."""
    return rows.orderBy(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), *keys).limit(most)


def contributions(features: list[str], profile: DataFrame) -> Column:
    """Signed distances of all features from the reference profile in its deviations; a missing feature is 0."""
    rows = {r["feature"]: r for r in profile.select("feature", "mean", "std").collect()}  # a row per feature
    z = []
    for f in features:
        mean, std = (rows[f]["mean"], rows[f]["std"]) if f in rows else (0.0, 1.0)
        std = std if std is not None and std > 1e-12 else 1.0
        z.append(F.coalesce((F.col(f) - F.lit(float(mean or 0.0))) / std, F.lit(0.0)))
    return F.array(*z)

"""Windows and the 52 features: one definition for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import contracts as C
from telemill.functions import scalars as S

SIGNALS = (*C.SENSORS, *C.RATIOS)


def check_windows(window_seconds: int, slide_seconds: int, watermark_seconds: int | None = None) -> None:
    if slide_seconds <= 0 or window_seconds % slide_seconds:
        raise ValueError("the window's width must be a multiple of its slide")
    if watermark_seconds is not None and watermark_seconds < slide_seconds:
        raise ValueError("the watermark must not be shorter than the slide")


def prepare(samples: DataFrame) -> DataFrame:
    """Samples with the ratios to speed, the number of missing readings and whether the machine runs."""
    return samples.withColumns({
        **{r: S.ratio_to_speed(F.col(s), F.col("rotation_rpm")) for r, s in C.RATIOS.items()},
        "_nulls": S.null_count(), "_running": (F.col("machine_state") == "RUNNING").cast("double"),
    })


def aggregates() -> list[Column]:
    """Every aggregate that the features need, over prepared samples of one window and machine."""
    out = []
    t = F.col("event_time")
    for s in SIGNALS:
        x = F.col(s)
        at = F.when(x.isNotNull(), t)  # readings that are missing have no time, so first and last are reported ones
        out += [F.avg(x).alias(f"{s}_mean"), deviation(x).alias(f"{s}_stddev"), F.min_by(x, at).alias(f"_{s}_first"),
                F.max_by(x, at).alias(f"_{s}_last"), F.min(at).alias(f"_{s}_from"), F.max(at).alias(f"_{s}_to")]
        if s in C.SENSORS:
            out += [F.min(x).alias(f"{s}_min"), F.max(x).alias(f"{s}_max")]
    out += [correlation(F.col(a), F.col(b)).alias(f"corr_{a}__{b}") for a, b in C.CORRELATED]
    return [
        *out, F.count(F.lit(1)).alias("sample_count"), F.sum("_nulls").alias("_nulls"), F.avg("_running").alias("running_ratio"),
        F.min(t).alias("first_event"), F.max(t).alias("last_event"), F.max_by("machine_state", t).alias("machine_state"),
        F.max_by("line_id", t).alias("line_id"),
    ]


def deviation(x: Column) -> Column:
    """Sample deviation; of equal values 0, whatever the last bits of partial means say."""
    return F.when(F.min(x) == F.max(x), F.when(F.count(x) > 1, 0.0)).otherwise(F.stddev_samp(x))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient over complete pairs, within [-1, 1]; null when a side is flat or pairs are fewer than two."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(~flat & (F.count(a) >= 2), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / 1_000_000.0


def derived(aggregated: DataFrame) -> DataFrame:
    """The features from their aggregates, in contract order, with the window's key and coverage."""
    made: dict[str, Column] = {}
    for s in SIGNALS:
        first, last, mean, sd = F.col(f"_{s}_first"), F.col(f"_{s}_last"), F.col(f"{s}_mean"), F.col(f"{s}_stddev")
        elapsed = (F.unix_micros(f"_{s}_to") - F.unix_micros(f"_{s}_from")) / 1_000_000.0
        made[f"{s}_slope_per_second"] = F.when(elapsed > 0, (last - first) / elapsed)
        if s in C.SENSORS:
            made[f"{s}_range"] = F.col(f"{s}_max") - F.col(f"{s}_min")
            made[f"{s}_deviation_from_mean"] = last - mean
            made[f"{s}_zscore_last"] = F.when(sd > 0, (last - mean) / sd)
    made["null_ratio"] = F.col("_nulls") / (F.col("sample_count") * float(len(C.SENSORS)))
    key = [c for c in ("machine_id", "window_start", "window_end") if c in aggregated.columns]
    features = [made.get(n, F.col(n)).alias(n) for n in C.feature_names()]
    return aggregated.select(*key, "line_id", "running_ratio", "machine_state", "first_event", "last_event", *features)


def sliding(samples: DataFrame, window_seconds: int = 60, slide_seconds: int = 10, watermark_seconds: int | None = None) -> DataFrame:
    """Aggregates per machine and epoch-aligned window; equal width and slide make tumbling windows."""
    check_windows(window_seconds, slide_seconds, watermark_seconds)
    rows = prepare(samples)
    if watermark_seconds is not None:
        rows = rows.withWatermark("event_time", f"{watermark_seconds} seconds")
    span = F.window("event_time", f"{window_seconds} seconds", f"{slide_seconds} seconds")
    return rows.groupBy(span.alias("_w"), "machine_id").agg(*aggregates()).withColumns(
        {"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}
    ).drop("_w")


def window_features(samples: DataFrame, window_seconds: int = 60, slide_seconds: int = 10, watermark_seconds: int | None = None) -> DataFrame:
    """The 52 features of every window; overlapping windows of a table are put together from panes, those of a stream (with a watermark) are aggregated directly."""
    check_windows(window_seconds, slide_seconds, watermark_seconds)
    if watermark_seconds is None and window_seconds > slide_seconds and not samples.isStreaming:
        return derived(from_panes(samples, window_seconds, slide_seconds))
    return derived(sliding(samples, window_seconds, slide_seconds, watermark_seconds))


def assign_windows(rows: DataFrame, window_seconds: int, slide_seconds: int, time: str = "event_time") -> DataFrame:
    """A row per covering window, with ``window_start`` in epoch seconds."""
    check_windows(window_seconds, slide_seconds)
    last = S.epoch_floor(F.floor(F.unix_micros(time) / 1_000_000), slide_seconds)
    steps = F.sequence(F.lit(0), F.lit(window_seconds // slide_seconds - 1))
    return rows.withColumn("window_start", F.explode(F.transform(steps, lambda i: (last - i * slide_seconds).cast("long"))))


# panes: what a slide's worth of samples tells about any window that covers it

SUMS = ("n", "sum", "mean", "square", "least", "most", "first", "last", "since", "until")  # of a signal
CROSS = ("n", "x", "y", "xx", "yy", "xy", "low_x", "high_x", "low_y", "high_y")  # of a pair of signals, over complete pairs


def panes(samples: DataFrame, slide_seconds: int, *keys: str) -> DataFrame:
    """One aggregation of the samples: a row per machine, pane and ``keys`` with mergeable summaries of every signal and pair (moments about the mean, ends in time and value)."""
    rows = prepare(samples).withColumn("pane", S.epoch_floor(F.floor(F.unix_micros("event_time") / 1_000_000), slide_seconds).cast("long"))
    t, out = F.col("event_time"), []
    for s in SIGNALS:
        x = F.col(s)
        at = F.when(x.isNotNull(), t)
        made = (F.count(x), F.sum(x), F.avg(x), F.var_pop(x) * F.count(x), F.min(x), F.max(x), F.min_by(x, at), F.max_by(x, at), F.min(at), F.max(at))
        out.append(F.struct(*[c.alias(name) for name, c in zip(SUMS, made, strict=True)]).alias(s))
    for a, b in C.CORRELATED:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        n = F.count(x)
        made = (n, F.avg(x), F.avg(y), F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n, F.min(x), F.max(x), F.min(y), F.max(y))
        out.append(F.struct(*[c.alias(name) for name, c in zip(CROSS, made, strict=True)]).alias(f"{a}__{b}"))
    return rows.groupBy("machine_id", "pane", *keys).agg(
        *out, F.count(F.lit(1)).alias("samples"), F.sum("_nulls").alias("nulls"), F.sum("_running").alias("running"), F.min(t).alias("since"), F.max(t).alias("until"),
        F.max_by("machine_state", t).alias("machine_state"), F.max_by("line_id", t).alias("line_id"),
    )


def merged_cross(pairs: Column) -> Column:
    """Counts, means, squares and products about the means, and plain sums, of an array of ``n, x, y, xx, yy, xy, sum`` put together pair by pair (nothing cancels)."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).cast("long").alias("n"), *[zero.alias(c) for c in ("x", "y", "xx", "yy", "xy", "sum")])

    def put(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dx, dy, share = b["x"] - a["x"], b["y"] - a["y"], b["n"] / n
        weight = a["n"] * share
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["x"] + dx * share).alias("x"), (a["y"] + dy * share).alias("y"), (a["xx"] + b["xx"] + dx * dx * weight).alias("xx"),
            (a["yy"] + b["yy"] + dy * dy * weight).alias("yy"), (a["xy"] + b["xy"] + dx * dy * weight).alias("xy"), (a["sum"] + b["sum"]).alias("sum")))

    return F.aggregate(pairs, start, put)


def from_panes(samples: DataFrame, window_seconds: int, slide_seconds: int) -> DataFrame:
    """What ``sliding`` gives, but for the last bits of sums: each sample is aggregated once, then the few panes of a window (its width over its slide) are put together."""
    check_windows(window_seconds, slide_seconds)
    return windows_of(panes(samples, slide_seconds), window_seconds, slide_seconds)


def windows_of(made: DataFrame, window_seconds: int, slide_seconds: int) -> DataFrame:
    """Windows put together from ``panes`` whose width divides the slide."""
    check_windows(window_seconds, slide_seconds)
    steps = F.sequence(F.lit(0), F.lit(window_seconds // slide_seconds - 1))
    last = S.epoch_floor(F.col("pane"), slide_seconds)
    spread = made.withColumn("_at", F.explode(F.transform(steps, lambda i: (last - i * slide_seconds).cast("long"))))
    out: list[Column] = []
    for s in SIGNALS:
        x = F.col(s)
        had = x["n"] > 0
        # of one signal: as a pair with itself
        alone = F.struct("pane", x["n"].alias("n"), F.coalesce(x["mean"], F.lit(0.0)).alias("x"), F.lit(0.0).alias("y"), F.coalesce(x["square"], F.lit(0.0)).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy"), F.coalesce(x["sum"], F.lit(0.0)).alias("sum"))
        out += [F.collect_list(alone).alias(f"_{s}"), F.min(x["least"]).alias(f"{s}_min"), F.max(x["most"]).alias(f"{s}_max"), F.min_by(x["first"], F.when(had, x["since"])).alias(f"_{s}_first"),
                F.max_by(x["last"], F.when(had, x["until"])).alias(f"_{s}_last"), F.min(x["since"]).alias(f"_{s}_from"), F.max(x["until"]).alias(f"_{s}_to")]
    for a, b in C.CORRELATED:
        x = F.col(f"{a}__{b}")
        pair = F.struct("pane", x["n"].alias("n"), *[F.coalesce(x[c], F.lit(0.0)).alias(c) for c in ("x", "y", "xx", "yy", "xy")], F.lit(0.0).alias("sum"))
        flat = (F.min(x["low_x"]) == F.max(x["high_x"])) | (F.min(x["low_y"]) == F.max(x["high_y"]))
        out += [F.collect_list(pair).alias(f"_{a}__{b}"), flat.alias(f"_flat_{a}__{b}")]
    whole = spread.groupBy("machine_id", "_at").agg(
        *out, F.sum("samples").alias("sample_count"), F.sum("nulls").alias("_nulls"), F.sum("running").alias("_running"), F.min("since").alias("first_event"), F.max("until").alias("last_event"),
        F.max_by("machine_state", "until").alias("machine_state"), F.max_by("line_id", "until").alias("line_id"),
    )
    # in order of time, so that windows of the same samples have the same last bits
    whole = whole.withColumns({f"_{n}": merged_cross(F.array_sort(f"_{n}")) for n in (*SIGNALS, *(f"{a}__{b}" for a, b in C.CORRELATED))})
    made = {"window_start": F.timestamp_seconds("_at"), "window_end": F.timestamp_seconds(F.col("_at") + window_seconds), "running_ratio": F.col("_running") / F.col("sample_count")}
    for s in SIGNALS:
        m = F.col(f"_{s}")
        made[f"{s}_mean"] = F.when(m["n"] > 0, m["sum"] / m["n"])  # as a plain mean rounds, so that equal means stay equal
        # equal values have no spread, whatever the last bits of the panes' means say
        made[f"{s}_stddev"] = F.when(m["n"] > 1, F.when(F.col(f"{s}_min") == F.col(f"{s}_max"), 0.0).otherwise(F.sqrt(m["xx"] / (m["n"] - 1))))
    for a, b in C.CORRELATED:
        m = F.col(f"_{a}__{b}")
        r = F.try_divide(m["xy"], F.sqrt(m["xx"]) * F.sqrt(m["yy"]))
        made[f"corr_{a}__{b}"] = F.when(~F.col(f"_flat_{a}__{b}") & (m["n"] >= 2), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return whole.withColumns(made)


def pane_features(samples: DataFrame, window_seconds: int, slide_seconds: int) -> DataFrame:
    """The 52 features from panes, with ``window_start`` and ``window_end`` in epoch seconds."""
    return derived(from_panes(samples, window_seconds, slide_seconds)).withColumns({c: F.unix_seconds(c) for c in ("window_start", "window_end")})

"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence: a logistic regression on text shape, fitted on at most about
``max_labelled`` labelled rows (chosen by hash; a documented bound on training
only), giving each document a log-likelihood ratio of good against bad. Site
evidence: every document's posterior under the global prior is summed per path
and per host. Sparse hosts are shrunk toward the global rate, sparse paths toward
their host's, by beta priors whose strengths come from the spread of the site means
(method of moments). A document's own share is left out of its site's rates. The
final log-odds are the path's log-odds plus the document's evidence.

Defined results: null text counts as empty and has features of an empty text; null sites are one site;
a site with one document has its parent's rate; without labels of both kinds every document's evidence is 0
and the rate 0.5; repeated rows count each; an empty table gives an empty result;
``keep_good`` keeps all columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.common import free_name, text_of, unit_hash, written

LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:?\"'()-"
SYMBOLS = b"#$%&*|@~^<>={}[]\\/_+!"
N_SHAPE = 14


def shape(text: bytes) -> np.ndarray:
    """Shares of kinds of characters, words and lines; all of the text is used."""
    n, words = max(1, len(text)), text.split()
    share = [len(text) - len(text.translate(None, kind)) for kind in (LETTERS, UPPER, DIGITS, STOPS, SYMBOLS)]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    k = max(1, len(words))
    lines = text.split(b"\n")
    return np.array([
        *(x / n for x in share), math.log1p(len(words)), len(counts) / k, math.sqrt(max(counts.values(), default=0) / k),
        sum(map(len, words)) / k / 10, len(set(lines)) / len(lines), len(lines) / k,
        sum(c for w, c in counts.items() if not w[-1:].isalpha() and w[-1] < 128) / k, sum(c for w, c in counts.items() if len(w) == 1) / k,
        sum(c for w, c in counts.items() if w.isupper()) / k,
    ])


def expand(x: np.ndarray) -> np.ndarray:
    """The features, their squares and their products with the length."""
    return np.concatenate([x, x * x, x * x[:, 5:6] / 8], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last) by Newton's method with a ridge penalty."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    ridge = np.r_[np.full(z.shape[1] - 1, penalty), 1e-9]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T * (p * (1 - p)) @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def shaped(docs: DataFrame, keep: list[str], text_column: str) -> DataFrame:
    """The columns ``keep`` and ``x``, the text's shape."""
    schema = docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shape(t.as_py()).tolist() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, text_of(text_column).cast("binary").alias("_text")).mapInArrow(run, schema)


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", text_column: str = "text",
    max_labelled: int = 20_000, seed: int = 11,
):
    """(mean, scale, coefficients, share of good rows), or None without rows of both labels.

    At most about ``max_labelled`` identifiers are used. They are chosen in ``labels`` first, so
    only their texts move.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column), F.col(label_column).cast("int").alias("y")).groupBy(id_column).agg(F.min("y").alias("y"))  # the worse of labels that disagree
    n = known.count()
    chosen = known.where(unit_hash(F.col(id_column), seed=seed) < min(1.0, max_labelled / max(1, n)))
    sample = docs.select(id_column, F.col(text_column).alias("text")).join(F.broadcast(chosen), id_column)  # max_labelled rows, about
    rows = shaped(sample, ["y"], "text").collect()  # max_labelled short rows, about
    y = np.array([r["y"] for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    x = expand(np.array([r["x"] for r in rows]))
    return *fit_logistic(x, y), float(y.mean())


def evidence(docs: DataFrame, model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` and ``llr``, the log-likelihood ratio of good against bad from the document alone."""
    schema = docs.select(*keep).schema.add("llr", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shape(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, N_SHAPE)
            if model is None:
                llr = np.zeros(len(x))
            else:
                mean, scale, beta, good = model
                z = np.clip((expand(x) - mean) / scale, -8, 8)
                llr = np.clip(z @ beta[:-1] + beta[-1] - math.log(good / (1 - good)), -20, 20)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(llr)], names=[*keep, "llr"])

    return docs.select(*keep, text_of(text_column).cast("binary").alias("_text")).mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column, floor: float = 2.0, ceiling: float = 1e4) -> float:
    """Strength of the beta prior of the groups (n, s) around ``prior``: the spread of their rates beyond what their sizes explain."""
    within = prior * (1 - prior)
    spread, noise, mean, n = groups.where("n > 1").agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - prior) ** 2), F.sum(within), F.sum(F.col("n") * within), F.sum("n")
    ).first()
    between = max(0.0, spread - noise) / n if n else 0.0
    return float(min(ceiling, max(floor, mean / n / between - 1))) if between > 1e-12 else ceiling


def posteriors(
    docs: DataFrame, model, keep: list[str], host: Column, path: Column, text_column: str = "text"
) -> DataFrame:
    """The columns ``keep`` with llr, host_rate, path_rate and p_good for every row."""
    # only what is needed goes on, under names of its own: the caller's columns may have any
    mine = [f"_keep_{i}" for i in range(len(keep))]
    base = docs.select(
        *[F.col(c).alias(m) for c, m in zip(keep, mine, strict=True)], text_of(text_column).alias("_whole"),
        F.coalesce(host.cast("string"), F.lit("\0")).alias("_host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("_path"),
    )
    scored = written(evidence(base, model, [*mine, "_host", "_path"], "_whole"), "quality-evidence")
    good = model[3] if model else 0.5
    scored = scored.withColumn("_p", 1 / (1 + F.exp(-(F.col("llr") + math.log(good / (1 - good))))))
    paths = written(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    rate = total[0] / total[1] if total[1] else 0.5
    host_m = _strength(hosts, F.lit(rate))
    hosts = hosts.select("_host", F.col("n").alias("_hn"), F.col("s").alias("_hs"), ((F.col("s") + host_m * rate) / (F.col("n") + host_m)).alias("_hrate"))
    sites = paths.join(hosts, "_host")
    path_m = _strength(sites, F.col("_hrate"))
    joined = scored.join(sites.select("_host", "_path", F.col("n").alias("_n"), F.col("s").alias("_s"), "_hn", "_hs"), ["_host", "_path"])
    host_rate = (F.col("_hs") - F.col("_p") + host_m * rate) / (F.col("_hn") - 1 + host_m)
    joined = joined.withColumn("host_rate", host_rate)
    path_rate = (F.col("_s") - F.col("_p") + path_m * F.col("host_rate")) / (F.col("_n") - 1 + path_m)
    return joined.withColumn("path_rate", path_rate).withColumn(
        "p_good", 1 / (1 + F.exp(-(_logit(F.col("path_rate")) + F.col("llr"))))
    ).select(*[F.col(m).alias(c) for c, m in zip(keep, mine, strict=True)], "llr", "host_rate", "path_rate", "p_good")


def keep_good(docs: DataFrame, model, host: Column, path: Column, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose posterior is under ``least``; all columns stay."""
    key, bad_id, bad_key = (free_name(docs.columns, n) for n in ("_row_key", "_bad_id", "_bad_key"))
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_column), text_of(text_column)))
    bad = posteriors(keyed, model, [id_column, key], host, path, text_column).where(F.col("p_good") < least).select(F.col(id_column).alias(bad_id), F.col(key).alias(bad_key))
    return keyed.join(bad, F.col(id_column).eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)

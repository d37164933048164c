"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Largest inner product becomes nearest distance by one more dimension,
sqrt(M^2 - |x|^2), M the largest norm. Vectors are rotated at random and kept in
column blocks. Lists come from k-means. In a probed list, distances grow block by
block; a candidate is abandoned as soon as its distance estimated from the dimensions seen so far
exceeds the query's radius by more than a hypothesis test allows. The radius starts at the
query's k-th distance within the fitting sample and shrinks to that within the list;
the nearest lists that together hold k + 1 rows are scanned without abandoning.
What survives is scored exactly, in double precision, on the original vectors.

Rotation, lists, probes and starting radii are fitted on a sample of at most about
``fit_rows`` rows (chosen by hash; documented bound). The number of probes is the
least that finds ``aim`` of the sample's own neighbours. Every row is indexed.

Equal vectors are one candidate with its k + 1 smallest identifiers (further ones cannot
be among the k nearest) and one query. Lists are searched in tiles of
bounded size: chunks of a list against blocks of the queries that probe it, so a candidate goes only where it is asked for.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have
another dimension than most, take no part; ties go to the smaller identifier;
repeated identifiers count as rows, a query leaves out all rows of its identifier;
fewer candidates than k give them all; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemill.llm.common import unit_hash, written


@dataclass
class Index:
    """What is fitted: rotation and centroids of the lengthened vectors, the largest norm, the sample and the probes."""

    rotation: np.ndarray
    centroids: np.ndarray
    norm: float
    sample: np.ndarray
    share: float

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return np.hstack([x, last[:, None]]) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation

    def order(self, rotated: np.ndarray) -> np.ndarray:
        """Lists by distance, nearest first, a row per vector."""
        return np.argsort((self.centroids**2).sum(axis=1) - 2 * rotated @ self.centroids.T, axis=1, kind="stable")


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def fit(rows: DataFrame, k: int, fit_rows: int = 12_000, aim: float = 0.965, seed: int = 3) -> Index | None:
    n, norm2 = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return None
    chosen = rows.where(unit_hash(F.col("vec_id"), seed=seed) < min(1.0, fit_rows / n)).select("v").distinct()
    x = np.array([r["v"] for r in chosen.collect()])  # fit_rows rows, about
    if not len(x):
        x = np.array([rows.first()["v"]])
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T[::-1])]  # whatever order the rows came in
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1] + 1, x.shape[1] + 1)))[0]
    lists = int(max(1, min(4096, round(n**0.5 / 2), len(x) // 4)))
    index = Index(rotation, np.zeros((1, 1)), float(norm2**0.5) * (1 + 1e-12), x, 1.0)
    y = index.lengthened(x)
    centroids = y[rng.choice(len(y), lists, replace=False)]
    for _ in range(10):
        home = ((centroids**2).sum(axis=1) - 2 * y @ centroids.T).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, y)
        size = np.bincount(home, minlength=lists)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    index.centroids = centroids
    home = ((centroids**2).sum(axis=1) - 2 * y @ centroids.T).argmin(axis=1)
    ask = rng.choice(len(x), min(len(x), 256), replace=False)
    scores = x[ask] @ x.T
    scores[np.arange(len(ask)), ask] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(x) - 1))]
    order = index.order(index.asked(x[ask]))
    rank = np.argsort(order, axis=1)[np.arange(len(ask))[:, None], home[near]]
    needed = int(np.quantile(rank, aim)) + 2
    index.share = min(1.0, needed / lists)
    return index


def scan(
    queries: np.ndarray, q_rot: np.ndarray, radius: np.ndarray, rows: np.ndarray, r_rot: np.ndarray, k: int, block: int = 16, slack: float = 2.1
) -> tuple[np.ndarray, np.ndarray]:
    """(query index, row index) of the candidates that no test abandoned; k kept per query at least where there are as many.

    ``radius``: squared distance that a query's k-th neighbour has at most; where it is infinite, nothing is abandoned early.
    """
    d = q_rot.shape[1]
    k = min(k, len(rows))
    # the k-th distance to the first rows of the list bounds the list's k-th distance
    head = rows[: 4 * k]
    first = (q_rot**2).sum(axis=1)[:, None] + (r_rot[: len(head)] ** 2).sum(axis=1) - 2 * q_rot @ r_rot[: len(head)].T
    limit = np.minimum(radius, np.partition(first, k - 1, axis=1)[:, k - 1]) * (1 + 1e-9) + 1e-12
    open_ended = np.isinf(radius)
    part = (q_rot[:, :block] ** 2).sum(axis=1)[:, None] + (r_rot[:, :block] ** 2).sum(axis=1) - 2 * q_rot[:, :block] @ r_rot[:, :block].T
    qi, ri = np.nonzero((part * (d / block) <= (1 + slack / block**0.5) ** 2 * limit[:, None]) | open_ended[:, None])
    seen = part[qi, ri]
    for at in range(block, d, block):
        to = min(at + block, d)
        diff = q_rot[qi, at:to] - r_rot[ri, at:to]
        seen = seen + np.einsum("ij,ij->i", diff, diff)
        test = (1 + slack / to**0.5) ** 2 if to < d else 1.0
        keep = (seen * (d / to) <= test * limit[qi]) | (open_ended[qi] if to < d else False)
        qi, ri, seen = qi[keep], ri[keep], seen[keep]
    return qi, ri


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    tile_rows: int = 4096, tile_queries: int = 2048, **fit_options,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row for which ``is_query`` (a condition on ``vec_id``) holds."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_column, vector_column), "ann-rows")
    result = "query_id long, rank int, vec_id long, score double"
    index = fit(rows, k, **fit_options)
    if index is None:
        return spark.createDataFrame([], result)
    shared = spark.sparkContext.broadcast(index)  # the sample, the centroids and the rotation: bounded by fit_rows and 4096 lists

    # one candidate per vector and identifier, k + 1 identifiers a vector; one query per vector
    least = W.partitionBy("v").orderBy("vec_id")
    candidates = rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1).drop("_n")
    asked = rows.where(is_query)
    distinct = asked.groupBy("v").agg(F.min("vec_id").alias("rep"))
    members = written(asked.join(distinct, "v").select("vec_id", "rep"), "ann-query-members")

    def to_lists(batches):
        index = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, index.sample.shape[1])
            home = index.order(index.lengthened(x))[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=["vec_id", "v", "list"])

    placed = written(candidates.select("vec_id", "v").mapInArrow(to_lists, "vec_id long, v array<double>, list int"), "ann-lists")
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per list
    chunks = np.array([-(-sizes.get(i, 0) // tile_rows) for i in range(len(index.centroids))])
    filled = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    def to_probes(batches):
        index = shared.value
        probes = max(1, int(np.ceil(index.share * len(index.centroids))))
        kth = min(k + 1, len(index.sample)) - 1
        for batch in batches:
            reps = batch.column(0).to_numpy()
            q = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, index.sample.shape[1])
            scores = -np.partition(-(q @ index.sample.T), kth, axis=1)[:, kth]
            radius = (q * q).sum(axis=1) + index.norm**2 - 2 * scores if len(index.sample) > k else np.full(len(q), np.inf)
            at, found, bound = [], [], []
            for i, lists in enumerate(index.order(index.asked(q))):
                enough = int(np.searchsorted(np.cumsum(filled[lists]), k + 1)) + 1  # lists that hold k + 1 rows
                asked_lists = lists[: max(probes, enough)]
                at.append(np.full(len(asked_lists), i))
                found.append(asked_lists)
                # the nearest lists that hold k + 1 rows are scanned with no bound from outside, so no query ends with fewer
                bound.append(np.where(np.arange(len(asked_lists)) < enough, np.inf, radius[i]))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[np.concatenate(at)]), pa.array(np.concatenate(found).astype(np.int32)), pa.array(np.concatenate(bound))], names=["rep", "list", "radius"]
                )

    probes_ = written(distinct.select("rep", "v").mapInArrow(to_probes, "rep long, list int, radius double"), "ann-probes")
    asking = {r["list"]: r["n"] for r in probes_.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per list
    tiles_of = [(i, int(chunks[i]), -(-asking[i] // tile_queries)) for i in range(len(chunks)) if chunks[i] and i in asking]
    table = F.broadcast(spark.createDataFrame(tiles_of, "list int, chunks int, blocks int"))  # 4096 rows at most
    # a query goes to every chunk of a list it probes, a candidate to every block of the queries that probe its list
    probing = probes_.join(table, "list").join(distinct.select("rep", "v"), "rep").withColumns({
        "block": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    tiles = placed.join(table, "list").withColumns({
        "chunk": F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})

    def tile(asked_: pa.Table, rows_: pa.Table) -> pa.Table:
        names = ["rep", "vec_id", "score"]
        index, found = shared.value, []
        if asked_.num_rows and rows_.num_rows:
            width = index.sample.shape[1]
            reps, ids = asked_.column("rep").to_numpy(), rows_.column("vec_id").to_numpy()
            radius = asked_.column("radius").to_numpy()
            q = np.array(asked_.column("v").to_pylist(), float).reshape(len(reps), width)
            x = np.array(rows_.column("v").to_pylist(), float).reshape(len(ids), width)
            x_rot = index.lengthened(x)
            for at in range(0, len(reps), 128):
                part = slice(at, at + 128)
                qi, ri = scan(q[part], index.asked(q[part]), radius[part], x, x_rot, k + 1)
                score = (q[part][qi] * x[ri]).sum(axis=1)
                order = np.lexsort((ids[ri], -score, qi))
                qi, ri, score = qi[order], ri[order], score[order]
                starts = np.searchsorted(qi, np.arange(len(q[part])))
                keep = np.arange(len(qi)) - starts[qi] < k + 1
                found.append((reps[part][qi[keep]], ids[ri[keep]], score[keep]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=names)

    key = ["list", "chunk", "block"]
    hits = probing.select(*key, "rep", "v", "radius").groupBy(*key).cogroup(tiles.select(*key, "vec_id", "v").groupBy(*key)).applyInArrow(tile, "rep long, vec_id long, score double")
    nearest = W.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1).drop("_n")
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.select(F.col("vec_id").alias("query_id"), "rep").join(hits, "rep").where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )

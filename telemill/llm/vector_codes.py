"""Vector code compression: product codes from an active-entry Lloyd iteration, in whole numbers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook that starts as that
part of the vectors with the smallest identifiers. A round assigns every part to its nearest entry and then moves every entry to
the floor of its parts' mean. Each part keeps its entry and the exact squared distance to it between rounds. If that
entry has stayed fixed, the other fixed entries cannot have come nearer, so only the moved ones are compared with the
stored distance; a part whose entry has moved scans the whole codebook. At equal distance the lower index wins,
in both cases. All sums and distances are integers, so results do not depend on order or partitioning.

The state (vector, codes, distances) is a table that each round reads and writes anew: a lost executor costs its tasks only.
What reaches the driver is a codebook, parts x entries rows.

Defined results: vectors that are null, empty, or hold a null or non-finite component, or have another dimension than most, take no part; a dimension
that is no multiple of the parts is filled up with zeros; components beyond 2^27 after scaling count as 2^27, so that distances
fit into 64 bits; rows of equal identifier count each and are ordered by their vector, a null identifier is last; fewer vectors than entries make shorter
codebooks; labels that are null form one group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import finite_vectors, shared_dir, written

LARGEST = 1 << 27


def as_parts(x: pa.Array, rows: int, parts: int) -> np.ndarray:
    """(rows, parts, width) integers of a list column, filled up with zeros."""
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)
    return np.pad(flat, ((0, 0), (0, -flat.shape[1] % parts))).reshape(rows, parts, -1)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries of one part."""
    d = x[:, None, :] - entries[None]
    return np.einsum("nkw,nkw->nk", d, d)


def assign(x: np.ndarray, books: np.ndarray, code: np.ndarray | None = None, far: np.ndarray | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of every part; with the codes and distances before the entries ``moved``, only what can have changed is compared."""
    n, parts, _ = x.shape
    code = np.zeros((n, parts), np.int64) if code is None else code.copy()
    far = np.zeros((n, parts), np.int64) if far is None else far.copy()
    for p in range(parts):
        active = np.flatnonzero(moved[p]) if moved is not None else None
        fixed = np.zeros(n, bool) if moved is None else ~moved[p][code[:, p]]
        if fixed.any() and len(active):
            at = np.flatnonzero(fixed)
            d = distances(x[at, p], books[p][active])
            best = d.argmin(axis=1)
            near, entry = d[np.arange(len(at)), best], active[best]
            better = (near < far[at, p]) | ((near == far[at, p]) & (entry < code[at, p]))
            far[at[better], p], code[at[better], p] = near[better], entry[better]
        at = np.flatnonzero(~fixed)
        if len(at):
            d = distances(x[at, p], books[p])
            code[at, p] = d.argmin(axis=1)
            far[at, p] = d[np.arange(len(at)), code[at, p]]
    return code, far


def moved_books(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round; ``sums``: (part, entry, n, s, the sums of the components) per entry in use."""
    new = books.copy()
    for r in sums.collect():  # parts x entries rows at most
        new[r["part"], r["entry"]] = [s // r["n"] for s in r["s"]]  # floors go down
    return new


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """A row per vector (id, label, x, code binary, a byte per part, far binary, a long per part), and the codebooks (parts, entries, width)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte per part")
    spark = vectors.sparkSession
    shared_dir(spark)
    rows, width = finite_vectors(vectors, vector_column, {"id": F.col(id_column), "label": F.col(label_column)})
    whole = F.transform("v", lambda c: F.least(F.greatest(F.floor(scale * c), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    state = written(rows.select("id", "label", whole.alias("x")), "codes-vectors")
    first = state.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()
    part_width = -(-width // parts)
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), width)
    books = np.pad(books, ((0, 0), (0, parts * part_width - width))).reshape(len(first), parts, part_width).transpose(1, 0, 2)
    moved = None
    schema = [(c, state.schema[c].dataType.simpleString()) for c in ("id", "label")]
    schema_ddl = ", ".join(f"{c} {kind}" for c, kind in schema) + ", x array<int>, code binary, far binary"
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast((books, moved))  # parts x entries x width integers

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books_, moved_ = shared.value
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                before = (None, None)
                if moved_ is not None:
                    before = (np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64), np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int64).reshape(n, parts))
                code, far = assign(as_parts(batch.column(2), n, parts), books_, *before, moved_)
                out = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (code.astype(np.uint8), far)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *out], names=["id", "label", "x", "code", "far"])

        def totals(batches: Iterator[pa.RecordBatch], shape=books.shape) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = as_parts(batch.column(0), batch.num_rows, parts)
                    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                    for p in range(parts):
                        n[p] += np.bincount(code[:, p], minlength=shape[1])
                        np.add.at(s[p], code[:, p], x[:, p])
            p, e = np.nonzero(n)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * shape[2], pa.int32()), pa.array(s[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), flat], names=["part", "entry", "n", "s"])

        state = written(state.mapInArrow(nearest, schema_ddl), f"codes-{turn}")
        if turn < rounds and len(first):
            # a task sends a row per entry at most
            sums = state.select("x", "code").mapInArrow(totals, "part int, entry int, n long, s array<long>").groupBy("part", "entry").agg(
                F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(part_width)]).alias("s"))
            new = moved_books(sums, books)
            moved, books = (new != books).any(axis=2), new
    return state, books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, parts: int = 16, **options) -> DataFrame:
    """A row per vector: id, label, code (two hex digits a part), error (long), label_error (over equal labels), codebooks_sha256."""
    state, books = compress(vectors, parts, **options)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(batch.num_rows, parts)
            code = [c.hex() for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(far.sum(axis=1))], names=["id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    rows = state.select("id", "label", "code", "far").mapInArrow(summed, f"{kinds}, code string, error long")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").withColumn("codebooks_sha256", F.lit(fingerprint(books)))

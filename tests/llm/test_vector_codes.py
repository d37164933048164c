import numpy as np
import pytest

from telemill.llm import vector_codes as V


def lloyd(x, parts, entries, rounds):
    """Full scans in whole numbers."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)], 1)
        code, far = d.argmin(-1), d.min(-1)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return code, far, books


def vectors(spark, n=300, d=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * 0.3
    x[40:80] = np.round(x[40:80], 1)  # ties
    x[100:130] = x[min(n - 1, 100)]  # copies
    rows = [(i, x[i].tolist(), [None, "a", "b"][i % 3]) for i in range(n)]
    bad = [(n, None, "a"), (n + 1, [*x[0][:-1].tolist(), float("nan")], "a"), (n + 2, [None, *x[0][1:].tolist()], "b"), (n + 3, [float("-inf")] * d, "b"), (n + 4, [1.0], "b"), (n + 5, [], "b")]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, label string").repartition(4)
    return df.withColumns({c: V.F.lit("x") for c in ("id", "x", "code", "far", "v")}), x


@pytest.mark.parametrize(("n", "d", "entries"), [(300, 32, 64), (300, 30, 64), (20, 32, 64), (300, 32, 7)])
def test_codes_equal_full_scans(spark, n, d, entries):
    df, x = vectors(spark, n, d)
    code, far, books = lloyd(np.floor(256 * x).astype(np.int64), 16, entries, 2)
    rows = {r["id"]: r for r in V.codes(df, parts=16, entries=entries).collect()}
    assert sorted(rows) == list(range(n))
    by_label = {}
    for i in range(n):
        by_label[i % 3] = by_label.get(i % 3, 0) + int(far[i].sum())
    for i, r in rows.items():
        assert r["code"] == "".join(f"{c:02x}" for c in code[i])
        assert r["error"] == far[i].sum()
        assert r["label_error"] == by_label[i % 3]
        assert r["codebooks_sha256"] == V.fingerprint(books)


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, before = rng.integers(-4, 5, (60, 3, 2)), rng.integers(-4, 5, (3, 9, 2))
        code, far = V.assign(x, before)
        after = before.copy()
        moved = rng.random((3, 9)) < rng.choice([0.0, 0.2, 0.9])
        after[moved] = rng.integers(-4, 5, (int(moved.sum()), 2))
        moved = (after != before).any(axis=2)
        fast, full = V.assign(x, after, code, far, moved), V.assign(x, after)
        assert (fast[0] == full[0]).all() and (fast[1] == full[1]).all()


def test_fixed_parts_compare_moved_entries_only(monkeypatch):
    seen = []
    whole = V.distances
    monkeypatch.setattr(V, "distances", lambda x, e: seen.append((len(x), len(e))) or whole(x, e))
    x = np.arange(40).reshape(20, 1, 2)
    books = x[:10].transpose(1, 0, 2).copy()
    code, far = V.assign(x, books)
    seen.clear()
    moved = np.zeros((1, 10), bool)
    moved[0, 3] = True
    books[0, 3] += 1
    V.assign(x, books, code, far, moved)
    n = int((code[:, 0] == 3).sum())
    assert seen == [(20 - n, 1), (n, 10)]


def test_no_vectors(spark):
    df, _ = vectors(spark)
    assert V.codes(df.limit(0)).count() == 0
    assert V.codes(df.where("vec_id >= 300 and vec_id < 304")).count() == 0

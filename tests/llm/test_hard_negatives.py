"""Hard negatives against brute force: windows, ties, odd vectors, hot cells."""
import numpy as np
import pytest

from bidframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, dim int"


def brute(rows, every=10, positives=5, negatives=10, least=30, most=90):
    seen = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        q = tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in vec)
        if max(map(abs, q), default=0) <= hn.LARGEST:
            key = (label, np.array(q, np.int32).tobytes())
            if vec_id not in seen or key < seen[vec_id][0]:
                seen[vec_id] = (key, label, q)
    out = set()
    for a, (_, label, q) in seen.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, _, v) in seen.items() if len(v) == len(q) and i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if seen[i][1] == label][:positives]:
            fit = [i for i in order if seen[i][1] != label and least * score[p] <= 100 * score[i] <= most * score[p]]
            out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fit[:negatives], 1)}
    return out


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {tuple(r) for r in hn.mine(df, lambda i: i % 10 == 0, **how).collect()}


def clustered(n, dim=8, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dim))
    x = middles[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.2
    return [(i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


def test_windows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "FIRST_ROWS", 40)
    rows = clustered(600)
    assert mined(spark, rows, sample_rows=200) == brute(rows)


def test_other_limits_and_empty_windows(spark):
    rows = clustered(120, dim=5, seed=2)
    got = mined(spark, rows, positives=2, negatives=3, least=-50, most=100)
    assert got == brute(rows, positives=2, negatives=3, least=-50, most=100) and got


def test_ties_repeated_rows_and_odd_vectors(spark):
    rows = clustered(60, dim=4)
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(30)]
    rows += [(100, [0.5, 0.5, 0.5, 0.5], 1), (110, [0.5, 0.5, 0.5, 0.5], 0), (110, [0.1, 0.5, 0.5, 0.5], 0)]
    rows += [(200, None, 1), (210, [1.0, None, 0.0, 0.0], 1), (220, [float("nan"), 0.0, 0.0, 0.0], 1),
             (230, [float("inf"), 0.0, 0.0, 0.0], 1), (240, [0.1, 0.2, 0.3, 0.4], None), (None, [0.1] * 4, 1),
             (250, [1e30, 0.0, 0.0, 0.0], 1), (260, [0.0] * 4, 1), (270, [], 0), (271, [], 0), (272, [], 1)]
    rows += [(300 + i, [0.1 * i, 1.0], i % 3) for i in range(25)]
    assert mined(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 30_000).tolist(), int(i % 2)) for i in range(40)]
    assert mined(spark, rows) == brute(rows)


def test_hot_cell_in_blocks_and_parts(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("MET_ANCHORS", 4), ("FIRST_ROWS", 10)):
        monkeypatch.setattr(hn, name, value)
    rows = [(i, [0.3, 0.4, 0.1 * (i % 3), 0.2], i % 2) for i in range(200)] + clustered(100, dim=4)[:0]
    rows += [(1_000 + i, v, label) for i, v, label in clustered(100, dim=4)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert mined(spark, []) == set()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_come_by_falling_bounds_that_hold(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 6)) * 100
    index = hn.Index(tuple(hn._centres(h, 5) for h in hn._halves(x)))
    cells, far1, far2 = index.place(x)
    index.rows = dict(zip(*np.unique(cells, return_counts=True)))
    index.radii = tuple(np.array([far[code == c].max(initial=0) for c in range(len(book))]) for far, code, book in (
        (far1, cells // len(index.books[1]), index.books[0]), (far2, cells % len(index.books[1]), index.books[1])))
    q = rng.normal(size=6) * 100
    seen = list(index.visit(q))
    assert sorted(c for c, _, _ in seen) == sorted(index.rows)
    assert all(a[2] >= b[2] - 1e-3 for a, b in zip(seen, seen[1:]))
    for cell, least, most in seen:
        assert ((x[cells == cell] @ q >= least) & (x[cells == cell] @ q <= most)).all()

"""Hard-negative mining against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import hard_negatives as hn


def brute(rows, every=50, n_pos=5, n_neg=3):
    ok = []
    for row, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) <= 1 << 56:
            ok.append((row, i, q, label))
    out = Counter()
    for row, i, q, label in ok:
        if i % every:
            continue
        seen = sorted(((-sum(a * b for a, b in zip(q, p)), j, other, r) for r, j, p, other in ok if r != row))
        for s, j in [(-s, j) for s, j, other, _ in seen if other == label][:n_pos]:
            fit = [(-t, k) for t, k, other, _ in seen if other != label and 50 * s <= -100 * t <= 95 * s]
            for rank, (t, k) in enumerate(fit[:n_neg], 1):
                out[i, j, rank, k, s, t] += 1
    return out


def some_rows(seed=1, n=700):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8))
    rows = []
    for i in range(n):
        label = int(r.integers(6))
        v = centres[label if r.random() < 0.7 else int(r.integers(6))] + r.normal(size=8) * 0.4
        rows.append((i, (v / np.linalg.norm(v)).tolist(), label))
    common = rows[3][1]
    rows += [(n + k, common, 3 if k % 3 else 1) for k in range(150)]  # one vector that many rows hold
    rows += [rows[0], rows[50], (50, rows[7][1], 2)]  # repeated rows and a repeated id
    rows += [(None, common, 1), (1000, None, 1), (1050, common, None), (1100, [float("nan")] * 8, 1), (1150, [1.0, None], 1), (1200, [float("inf")] * 8, 1), (1250, [], 2), (1300, [0.5, 0.25], 1), (1350, [0.0] * 8, 4), (1400, [1e30] * 8, 1), (1450, [3.0] * 8, 9), (-50, [0.1] * 8, 0)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk": 60, "group": 5, "sample": 40, "cell": 30}])
def test_mined_negatives(spark, sizes):
    rows = some_rows()
    made = [(*x, 1, "y", 2, 3) for x in rows]
    vectors = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int, cell int, group string, uid int, score int").repartition(5)
    got = Counter(tuple(r) for r in hn.mine_negatives(vectors, **sizes).collect())
    assert got == brute(rows) and len(got) > 100


def test_tables_without_rows_or_anchors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(None, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(50, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        assert Counter(tuple(r) for r in hn.mine_negatives(spark.createDataFrame(rows, schema)).collect()) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6))
def test_bounds_hold(seed, n, number):
    r = np.random.default_rng(seed)
    x, q = np.floor(r.normal(size=(n, 5)) * 256), np.floor(r.normal(size=(9, 5)) * 400)
    longest = int((x**2).sum(1).max())
    cells = hn.Cells(x, longest, number)
    d = cells.of_rows(x)
    own = d.argmin(1)
    near, far = np.full(len(cells.at), np.inf), np.zeros(len(cells.at))
    np.minimum.at(near, own, np.sqrt(d[np.arange(n), own]))
    np.maximum.at(far, own, np.sqrt(d[np.arange(n), own]))
    low, high = cells.bounds(q, near, far)
    s = q @ x.T
    assert (s <= high[:, own]).all() and (s >= low[:, own]).all()


def test_groups_hold_no_more_than_their_size():
    cells = hn.Cells(np.random.default_rng(5).normal(size=(60, 4)), 50.0, 12)
    anchors = np.array([3, 0, 10, 1, 25, 4, 4, 9, 0, 2, 7, 1][: len(cells.at)])
    first, number = cells.groups(anchors, 10)
    load = Counter()
    for f, k, n in zip(first, number, anchors):
        for g in range(f, f + k):
            load[g] += n / k
    assert max(load.values()) <= 10 and sum(load.values()) == anchors.sum()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 60))
def test_best_is_a_sort(seed, k, width):
    r = random.Random(seed)
    score = np.array([[r.randint(0, 4) for _ in range(width)] for _ in range(3)])
    fits = np.array([[r.random() < 0.9 for _ in range(width)] for _ in range(3)])
    want = [(i, j, int(score[i, j])) for i in range(3) for j in sorted(np.flatnonzero(fits[i]), key=lambda j: (-score[i, j], j))[:k]]
    assert [tuple(map(int, x)) for x in zip(*hn.best(score, fits, k))] == want

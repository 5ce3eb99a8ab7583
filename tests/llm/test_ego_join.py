import math

import numpy as np
import pytest

from loomstone.llm.ego_join import join_intervals, near_vectors, unit


def brute(rows, threshold=0.95):
    fine = []
    for i, (key, v) in enumerate(rows):
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine.append(i)
    u = {i: unit(np.array([np.float32(rows[i][1])], float))[0] for i in fine}
    parent = {i: i for i in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    for a, i in enumerate(fine):
        for j in fine[:a]:
            if len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), rows[i][0])
    comp = [least.get(root(i)) if rows[i][0] is not None else None for i in range(len(rows))]
    return sorted((str(k), n[i], str(comp[i]), None if k is None else k == comp[i]) for i, (k, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, label int")
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors(df).collect())


def clustered(n, d=16, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), d))
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d))
    return [(int(i), v[k].astype(np.float32).tolist()) for k, i in enumerate(rng.permutation(n))]


def test_edge_rows(spark):
    rows = clustered(60) + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [float("inf")] * 16), (505, [None] + [1.0] * 15)]
    rows += [(None, [1.0] * 16), (None, None), (600, [1.0, 0.0]), (601, [1.0, 0.01]), (602, [1e-30] * 16), (603, [1e30] * 16), (604, [-1.0] * 16), (700, [2.0]), (701, [-3.0]), (700, [2.0])]
    assert run(spark, rows) == brute(rows)


def test_copies_and_many_blocks(spark, monkeypatch):
    from loomstone.llm import ego_join

    monkeypatch.setattr(ego_join, "BLOCK", 40)
    monkeypatch.setattr(ego_join, "LEAF", 16)
    rows = clustered(500, spread=0.12)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_intervals_lose_nothing():
    rng = np.random.default_rng(3)
    for same in (True, False):
        a = unit(np.repeat(rng.normal(size=(40, 8)), 10, axis=0) + 0.1 * rng.normal(size=(400, 8)))
        b = a if same else unit(a[::-1] + 0.05 * rng.normal(size=(400, 8)))
        order_a, order_b = np.argsort(a[:, 0]), np.argsort(b[:, 0])
        a, b = a[order_a], a[order_a] if same else b[order_b]
        got = np.zeros((400, 400), int)
        for s, t, hit in join_intervals(a, a[:, :3], b, b[:, :3], same, 0.95, math.sqrt(0.1) + 1e-9):
            got[s : s + hit.shape[0], t : t + hit.shape[1]] += hit
        want = a @ b.T >= 0.95
        assert (got == (np.triu(want, 1) if same else want)).all()


def test_empty_and_bad(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == brute([(1, None)])
    with pytest.raises(ValueError):
        near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), threshold=0.0)


def test_most_blocks_are_skipped_where_there_are_clusters():
    """Vectors around 20 centres, sorted and cut into blocks as the join does."""
    from loomstone.llm.ego_join import GRID, LEADING, _gap, _position, coordinates, near_blocks

    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(20, 64))[rng.integers(0, 20, 12_000)] + 0.05 * rng.normal(size=(12_000, 64)))
    eps = math.sqrt(2 - 2 * 0.95)
    _, axes = np.linalg.eigh(np.cov(x.T))
    c = coordinates(x, axes[:, ::-1][:, :LEADING])
    c = c[np.argsort(_position(c[:, :GRID], eps))]
    for rows, least in ((512, 0.5), (64, 0.9)):
        boxes = [c[i : i + rows] for i in range(0, len(c), rows)]
        lo, hi = np.array([b.min(axis=0) for b in boxes]), np.array([b.max(axis=0) for b in boxes])
        met = sum(len(near_blocks(lo, hi, k, eps)) for k in range(len(boxes)))
        assert met < (1 - least) * len(boxes) ** 2, (rows, met / len(boxes) ** 2)
    a, b = c[:500], c[-500:]
    assert np.allclose(_gap(a, a, b, b), np.linalg.norm(a - b, axis=1))  # of boxes that are points


def test_coordinates_are_never_farther_apart():
    from loomstone.llm.ego_join import coordinates

    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(300, 12)))
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0][:, :4]
    c = coordinates(x, axes)
    far = lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)
    assert (far(c) <= far(x) + 1e-9).all()
    assert np.allclose(np.linalg.norm(c, axis=1), 1)


def test_spread_vectors_and_rounding(spark, monkeypatch):
    """Vectors without clusters, some pairs right at the threshold."""
    from loomstone.llm import ego_join

    monkeypatch.setattr(ego_join, "BLOCK", 100)
    rng = np.random.default_rng(12)
    x = unit(rng.normal(size=(300, 64)))
    side = rng.normal(size=(300, 64))
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    angle = np.arccos(0.95) + rng.normal(size=(300, 1)) * 1e-5
    y = np.cos(angle) * x + np.sin(angle) * side
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.r_[x, y])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert 100 < sum(r[1] for r in got) < 500

"""Assignment by pricing against the dense kernel."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackspark.operators import assign, pricing, spatial

POINT = "dataset string, t bigint, node_id bigint, zu double, yu double, xu double"


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000))
def test_sparse_kernel_is_optimal_and_its_prices_prove_it(seed):
    rng = np.random.default_rng(seed)
    n, m, limit = int(rng.integers(1, 9)), int(rng.integers(1, 9)), float(rng.choice([2, 5, 30]))
    known = rng.random((n, m)) < 0.6
    known[0, 0] = True
    cost = rng.integers(0, 12, (n, m)).astype(float)
    rows, cols = np.nonzero(known)
    rows, cols = np.unique(rows, return_inverse=True)[1], np.unique(cols, return_inverse=True)[1]
    n, m, w = rows.max() + 1, cols.max() + 1, cost[known]
    found, u, v = pricing.sparse_assignment(rows, cols, w, limit)
    table = np.full((n, m), np.inf)
    table[rows, cols] = w
    taken = found[found >= 0]
    assert len(set(taken)) == len(taken)
    total = sum(table[r, c] if c >= 0 else limit for r, c in enumerate(found))
    # dense form: each row has a column of its own at the limit
    wide = np.hstack([np.where(np.isinf(table), 1e6, table), np.where(np.eye(n) > 0, limit, 1e6)])
    r, c = assign.cheapest_assignment(wide)
    assert total == pytest.approx(wide[r, c].sum())
    assert (u[rows] + v[cols] <= w + 1e-9).all() and (u <= limit + 1e-9).all() and (v <= 1e-9).all()
    assert total == pytest.approx(u.sum() + v.sum())
    assert np.allclose(v[np.setdiff1d(np.arange(m), taken)], 0)


def test_sparse_kernel_on_real_costs():
    for seed in range(100):
        rng = np.random.default_rng(seed)
        n, m = rng.integers(1, 25, 2)
        cost = rng.random((n, m)) * 40
        rows, cols = np.indices((n, m))
        found, u, v = pricing.sparse_assignment(rows.ravel(), cols.ravel(), cost.ravel(), 7.0)
        wide = np.hstack([cost, np.where(np.eye(n) > 0, 7.0, 1e6)])
        best = wide[assign.cheapest_assignment(wide)].sum()
        assert sum(cost[r, c] if c >= 0 else 7.0 for r, c in enumerate(found)) == pytest.approx(best)
        assert u.sum() + v.sum() == pytest.approx(best)


def test_a_frame_of_twenty_thousand(spark):
    """Moved by less than half of the least spacing: every node's own successor is the optimum."""
    side = np.arange(28)
    grid = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)[:20_000] * 10.0
    moved = grid + np.random.default_rng(0).random(grid.shape) * 2
    rows = [("a", t, i + 20_000 * t, *map(float, p)) for t, pts in enumerate((grid, moved)) for i, p in enumerate(pts)]
    links = pricing.link_priced(spark.createDataFrame(rows, POINT), 4.0).toPandas()
    assert len(links) == 20_000 and (links.target_id - links.source_id == 20_000).all()


def frames(spark, sizes, seed, spread=40.0, names=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for name in names:
        number = 0
        for t, size in enumerate(sizes):
            for p in rng.random((size, 3)) * spread:
                rows.append((name, t, number, *map(float, p)))
                number += 1
    return rows, spark.createDataFrame(rows, POINT)


def totals(rows, links, sizes, names=("a", "b")):
    """(cost of the links, least cost of a dense assignment) per frame pair."""
    spot = {(r[0], r[2]): np.array(r[3:]) for r in rows}
    out = []
    for name in names:
        for t in range(len(sizes) - 1):
            p, q = ([np.array(r[3:]) for r in rows if r[0] == name and r[1] == k] for k in (t, t + 1))
            mine = [l for l in links if l.dataset == name and l.t == t]
            if not p or not q:
                assert not mine
                continue
            cost = np.sqrt(((np.array(p)[:, None] - np.array(q)[None]) ** 2).sum(-1))
            r, c = assign.cheapest_assignment(cost)
            assert len(mine) == len({l.source_id for l in mine}) == len({l.target_id for l in mine}) == len(r)
            assert all(l.d == pytest.approx(np.linalg.norm(spot[name, l.source_id] - spot[name, l.target_id])) for l in mine)
            out.append((sum(l.d for l in mine), cost[r, c].sum()))
    return out


@pytest.mark.parametrize("task_pairs", [pricing.TASK_PAIRS, 50])
def test_links_cost_as_little_as_the_dense_assignment(spark, monkeypatch, task_pairs):
    monkeypatch.setattr(pricing, "TASK_PAIRS", task_pairs)
    monkeypatch.setattr(pricing, "GAIN", 3)
    sizes = [30, 45, 20, 20, 1, 0, 5]
    rows, df = frames(spark, sizes, 1, names=("a",))
    links = pricing.link_priced(df, 80.0).collect()        # wider than the box: nothing is dropped after
    for mine, best in totals(rows, links, sizes, ("a",)):
        assert mine == pytest.approx(best)


def test_far_pairs_count_before_they_are_dropped(spark):
    rows, df = frames(spark, [25, 18, 25], 5, names=("a",))
    dense = assign.link_optimal(df, 9.0, "full").collect()
    priced = pricing.link_priced(df, 9.0).collect()
    key = lambda found: sorted((l.dataset, l.t, l.source_id, l.target_id, round(l.d, 6)) for l in found)
    assert key(dense) == key(priced) and len(priced) > 0


def test_copies_missing_positions_and_empty_tables(spark):
    rows = [("a", 0, 0, 1.0, 1.0, 1.0), ("a", 0, 1, 1.0, 1.0, 1.0), ("a", 0, 2, None, 1.0, 1.0),
            ("a", 1, 3, 1.0, 1.0, 1.0), ("a", 1, 4, 1.0, 1.0, 2.0), ("a", 1, 5, float("nan"), 0.0, 0.0),
            ("b", 0, 0, 0.0, 0.0, 0.0), ("b", 2, 1, 0.0, 0.0, 0.0)]
    links = pricing.link_priced(spark.createDataFrame(rows, POINT), 3.0).collect()
    assert {l.target_id for l in links} == {3, 4} and {l.source_id for l in links} == {0, 1}
    assert sorted(l.d for l in links) == [0.0, 1.0]
    assert pricing.link_priced(spark.createDataFrame([], POINT), 3.0).collect() == []


def test_each_point_has_its_own_radius(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((60, 3)) * 20, rng.random((80, 3)) * 20
    reach = rng.choice([0.0, 0.3, 1.0, 2.0, 7.5, 50.0], 60)
    left = spark.createDataFrame([("a", 0, i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(a, reach))],
                                 "dataset string, t bigint, i bigint, zu double, yu double, xu double, r double")
    right = spark.createDataFrame([("a", 0, j, *map(float, p)) for j, p in enumerate(b)],
                                  "dataset string, t bigint, j bigint, zu double, yu double, xu double")
    got = sorted((x.i, x.j) for x in spatial.ball_join(left, right, "r", ["dataset", "t"], 1.0).collect())
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert got == sorted((int(i), int(j)) for i, j in zip(*np.nonzero((d <= reach[:, None]) & (reach[:, None] > 0))))

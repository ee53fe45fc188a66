"""Assignment kernels and their distribution against exhaustive search."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators import assign


def best_full(cost):
    n, m = cost.shape
    if n > m:
        return best_full(cost.T)
    return min(sum(cost[i, c[i]] for i in range(n)) for c in itertools.permutations(range(m), n))


def all_matchings(pairs):
    out = [()]
    for k, (l, r) in enumerate(pairs):
        out += [m + (k,) for m in out if all(pairs[j][0] != l and pairs[j][1] != r for j in m)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10_000))
def test_full_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    rows, cols = assign.cheapest_assignment(cost)
    assert len(rows) == min(n, m) == len(set(rows)) == len(set(cols))
    assert cost[rows, cols].sum() == pytest.approx(best_full(cost))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_optional_and_fullest_matching(seed):
    rng = np.random.default_rng(seed)
    pairs = [(l, r) for l in range(4) for r in range(4) if rng.random() < 0.45]
    if not pairs:
        return
    left, right = map(np.array, zip(*pairs))
    weight = rng.random(len(pairs)) + 0.05
    options = all_matchings(pairs)
    got = assign.heaviest_matching(left, right, weight)
    assert weight[got].sum() == pytest.approx(max(weight[list(m)].sum() for m in options))
    size = max(len(m) for m in options)
    full = assign.fullest_matching(left, right, weight)
    assert len(full) == size
    assert weight[full].sum() == pytest.approx(
        max(weight[list(m)].sum() for m in options if len(m) == size))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_pair_components(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 40))
    left, right = rng.integers(0, 25, n), rng.integers(0, 25, n)
    got = assign.pair_components(left, right)
    ends = {}

    def root(x):
        while ends.setdefault(x, x) != x:
            x = ends[x]
        return x

    for a, b in zip(left, right):
        ends[root(("l", a))] = root(("r", b))
    want = [root(("l", a)) for a in left]
    assert [[x == y for y in got] for x in got] == [[x == y for y in want] for x in want]


def test_matching_of_a_large_sparse_frame():
    """50,000 sources with a few candidates each never meet in one matrix."""
    n = 50_000
    rng = np.random.default_rng(0)
    left = np.repeat(np.arange(n), 2)
    right = left + np.tile([0, 1], n) * (left % 3 < 2)
    left, right = np.unique(np.stack([left, right]), axis=1)
    weight = rng.random(len(left)) + 0.1
    got = assign.heaviest_matching(left, right, weight)
    assert len(set(left[got])) == len(got) == len(set(right[got]))
    for block in range(0, 300, 3):
        own = np.flatnonzero((left >= block) & (left < block + 3))
        options = all_matchings(list(zip(left[own], right[own])))
        assert weight[np.intersect1d(own, got)].sum() == pytest.approx(max(weight[own[list(m)]].sum() for m in options))


def random_pairs(spark, seed, frames=3, side=5, share=0.4):
    rng = np.random.default_rng(seed)
    rows = [("a", t, l, 100 + r, float(rng.random() + 0.1))
            for t in range(frames) for l in range(side) for r in range(side) if rng.random() < share]
    return rows, spark.createDataFrame(rows, "dataset string, t bigint, l bigint, r bigint, w double")


@pytest.mark.parametrize("cells", [4_000_000, 9, 1])
def test_matching_by_frame_component_and_auction(spark, monkeypatch, cells):
    monkeypatch.setattr(assign, "TASK_CELLS", cells)
    monkeypatch.setattr(assign, "RESOLUTION", 2.0 ** -12)      # fewer phases, well within the tolerance below
    rows, df = random_pairs(spark, 3, frames=2, side=4)
    got = assign.max_weight_matching(df, ["dataset", "t"], "l", "r", "w").collect()
    for t in range(2):
        mine = [r for r in got if r.t == t]
        assert len({r.l for r in mine}) == len(mine) == len({r.r for r in mine})
        frame = [r for r in rows if r[1] == t]
        best = max(sum(frame[k][4] for k in m) for m in all_matchings([(r[2], r[3]) for r in frame]))
        assert sum(r.w for r in mine) == pytest.approx(best, abs=2e-3)


def brute_match(gt, pred, radius=7.0):
    scale = np.array(assign.DEFAULT_SCALE)
    d = np.sqrt((((gt[:, None] - pred[None]) * scale) ** 2).sum(-1))
    pairs = [(i, j) for i in range(len(gt)) for j in range(len(pred)) if d[i, j] <= radius]
    if not pairs:
        return 0, 0.0
    w = {p: float(np.float32(1 / (1 + d[p]))) for p in pairs}
    cover = min(max(p[0] for p in pairs), max(p[1] for p in pairs)) + 1
    options = [[pairs[k] for k in m] for m in all_matchings(pairs)]
    full = [m for m in options if len(m) == cover]
    if full:
        best = max(sum(w[p] for p in m) for m in full)
        return cover, best
    best = max(options, key=lambda m: sum(w[p] + 1 for p in m))
    return len(best), sum(w[p] for p in best)


@pytest.mark.parametrize("cells", [4_000_000, 2])
def test_node_matching_regimes(spark, graph, monkeypatch, cells):
    monkeypatch.setattr(assign, "TASK_CELLS", cells)
    monkeypatch.setattr(assign, "RESOLUTION", 2.0 ** -12)      # fewer phases, well within the tolerance below
    rng = np.random.default_rng(5)
    truth, guess = [], []
    for t in range(4):
        g = np.column_stack([np.full(4, t), rng.uniform(0, 6, (4, 1)), rng.uniform(0, 30, (4, 2))])
        p = np.column_stack([np.full(5, t), rng.uniform(0, 6, (5, 1)), rng.uniform(0, 30, (5, 2))])
        truth += g.tolist()
        guess += p.tolist()
    gt, _ = graph(truth)
    pred, _ = graph(guess)
    got = assign.match_nodes(pred, gt).collect()
    for t in range(4):
        mine = [r for r in got if r.t == t]
        n, total = brute_match(np.array([p[1:] for p in truth if p[0] == t]),
                               np.array([p[1:] for p in guess if p[0] == t]))
        assert len(mine) == n
        assert sum(1 / (1 + r.d) for r in mine) == pytest.approx(total, abs=2e-3)


def test_far_pairs_influence_the_dense_link(graph):
    # The nearest pairs alone would strand the second source beyond the radius.
    nodes, _ = graph([(0, 0, 0, 0), (0, 0, 10, 0), (1, 0, 9, 0), (1, 0, 60, 0)])
    links = assign.link_optimal(with_um(nodes), 9.0).collect()
    total = {(r.source_id, r.target_id) for r in links}
    assert total == {(0, 2)} or total == {(1, 2)}
    d = np.array([[9, 60], [1, 50]]) * 0.40625
    assert min(d[0, 0] + d[1, 1], d[0, 1] + d[1, 0]) == pytest.approx(d[0, 0] + d[1, 1])


@pytest.mark.parametrize("mode", ["full", "gated"])
def test_modes_agree_when_coverable(spark, mode):
    rng = np.random.default_rng(1)
    base = rng.uniform(0, 200, (12, 3))
    rows = [("a", 100 * t + k, t, *(base[k] + rng.normal(0, 1, 3)).tolist()) for t in range(3) for k in range(12)]
    nodes = with_um(spark.createDataFrame(rows, "dataset string, node_id bigint, t bigint, z double, y double, x double"))
    links = assign.link_optimal(nodes, 9.0, mode)
    assert {(r.source_id % 100, r.target_id % 100) for r in links.collect()} == {(k, k) for k in range(12)}
    assert links.count() == 24


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_gated_links_are_as_many_as_possible_then_short(graph, monkeypatch, cells):
    monkeypatch.setattr(assign, "TASK_CELLS", cells)
    monkeypatch.setattr(assign, "RESOLUTION", 2.0 ** -12)      # fewer phases, well within the tolerance below
    nodes, _ = graph([(0, 0, 0, 0), (0, 0, 500, 0), (1, 0, 1, 0), (1, 0, 2, 0), (2, 0, 9, 0)])
    links = assign.link_optimal(with_um(nodes), 9.0, "gated").collect()
    assert {(r.source_id, r.target_id) for r in links} == {(0, 2), (3, 4)}


@pytest.mark.parametrize("fullest", [False, True])
def test_auction_settles_ties_in_few_rounds(spark, monkeypatch, fullest):
    """One left too many for equal rights, where a fixed step would climb forever."""
    turns = []
    empty = assign.is_empty
    monkeypatch.setattr(assign, "is_empty", lambda df: turns.append(1) or empty(df))
    rows = [("a", 0, l, 10 + r, 1.0) for l in range(4) for r in range(3)]
    rows += [("b", 0, 1, 1, 0.3), ("b", 0, 1, 2, 0.9), ("b", 0, 2, 2, 0.5)]
    df = spark.createDataFrame(rows, "dataset string, t bigint, l bigint, r bigint, w double")
    got = assign.auction(df, ["dataset", "t"], "l", "r", "w", fullest, resolution=0.01).collect()
    a = [r for r in got if r.dataset == "a"]
    assert len(a) == len({r.l for r in a}) == len({r.r for r in a}) == 3
    want = {(1, 1), (2, 2)} if fullest else {(1, 2)}
    assert {(r.l, r.r) for r in got if r.dataset == "b"} == want
    assert len(turns) < 100


def test_recall_counts_each_truth_once(graph):
    gt, _ = graph([(0, 0, 0, 0), (0, 0, 100, 0)])
    pred, _ = graph([(0, 0, 1, 0), (0, 0, 2, 0)])
    assert assign.recall_at_budget(pred, gt).select(F.round("recall", 3)).first()[0] == 0.5


def test_undisputed_components_are_not_solved(monkeypatch):
    """Components where every end has a best partner of its own need no cost matrix; ties and conflicts do."""
    solved, kernel = [], assign._heaviest
    monkeypatch.setattr(assign, "_heaviest", lambda l, r, w: solved.append(set(l.tolist())) or kernel(l, r, w))
    left = np.array([0, 0, 1, 1, 10, 10, 11, 20, 20, 30, 31, 31])
    right = np.array([0, 1, 0, 1, 10, 11, 11, 20, 21, 30, 30, 31])
    weight = np.array([5.0, 1, 2, 4, 5, 4, 3, 2, 2, 1, 3, 1])
    pick = assign.heaviest_matching(left, right, weight)
    assert {(left[i], right[i]) for i in pick if left[i] != 20} == {(0, 0), (1, 1), (10, 10), (11, 11), (31, 30)}
    assert sum(left[pick] == 20) == 1
    assert {20} in solved and {0, 1} not in solved
    r = np.random.default_rng(8)
    for _ in range(200):
        n = r.integers(2, 9)
        both = np.unique(r.integers(0, 5, (n, 2)), axis=0)
        w = r.permutation(50)[:len(both)].astype(float) - 5
        fast = assign.heaviest_matching(both[:, 0], both[:, 1], w)
        slow = kernel(both[:, 0], both[:, 1], w)
        assert w[fast].sum() == w[slow[w[slow] > 0]].sum()
        assert len(set(both[fast, 0])) == len(set(both[fast, 1])) == len(fast)

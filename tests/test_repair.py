"""Repair steps against straightforward sequential walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import extras, graph as G, repair
from trackspark.functions.geometry import with_um
from trackspark.schema import DEFAULT_SCALE

SCALE = np.array(DEFAULT_SCALE)


def um(p, q):
    return float(np.linalg.norm((np.array(p) - np.array(q)) * SCALE))


def test_gap_closes_with_one_midpoint(graph):
    nodes, edges = graph([(0, 10, 50, 50), (2, 10, 52, 52)])
    more, links = repair.close_gaps(nodes, edges)
    assert [(r.t, r.z, r.y, r.x) for r in more.collect()] == [(1, 10.0, 51.0, 51.0)]
    assert {(r.source_id, r.target_id) for r in links.collect()} == {(0, 2), (2, 1)}


def test_far_gap_stays_open(graph):
    nodes, edges = graph([(0, 10, 50, 50), (2, 10, 200, 200)])
    assert repair.close_gaps(nodes, edges)[0].count() == 0


def test_gap_share_limits_insertions(graph):
    points = [p for k in range(40) for p in ((0, 10, 100 * k, 50), (2, 10, 100 * k + 2, 52))]
    nodes, edges = graph(points)
    more, _ = repair.close_gaps(nodes, edges, max_share=0.045)
    assert more.count() == int(np.ceil(0.045 * 80))


def test_prune_and_reindex(graph):
    nodes, edges = graph([(0, 0, 0, 0), (0, 0, 50, 50), (1, 0, 1, 1)], [(0, 2)])
    kept, links = G.densify(G.prune_isolated(nodes, edges), edges)
    assert sorted(r.node_id for r in kept.collect()) == [0, 1]
    assert [(r.source_id, r.target_id) for r in links.collect()] == [(0, 1)]


def sequential_reuse(gaps, choices):
    """Gaps as (t, end, start), choices {(t, end): {iso: d}}, in (t, end) order."""
    used, sources_used, out = set(), set(), {}
    for t, end, start in sorted(gaps):
        if end in sources_used:
            continue
        free = sorted((d, iso) for iso, d in choices.get((t, end), {}).items() if iso not in used)
        pick = free[0][1] if free else None
        if pick is not None:
            used.add(pick)
            sources_used.add(pick)
        out[(t, end)] = pick
    return out


@pytest.mark.parametrize("seed", range(4))
def test_reuse_follows_the_sequential_order(spark, seed):
    rng = np.random.default_rng(seed)
    # Isolated nodes 500+t*10+k exist in every frame; some gaps start from them.
    gaps, choices = [], {}
    for t in range(5):
        ends = [100 * t + k for k in range(3)] + [500 + t * 10 + k for k in range(3) if rng.random() < 0.7]
        for end in ends:
            gaps.append((t, end, 10_000 + 100 * t + end % 100))
            near = {500 + (t + 1) * 10 + k: float(rng.random()) for k in range(3) if rng.random() < 0.5}
            if near:
                choices[(t, end)] = near
    g = spark.createDataFrame([("a", *r) for r in gaps], "dataset string, t bigint, end_id bigint, start_id bigint")
    c = spark.createDataFrame([("a", t, e, iso, d) for (t, e), near in choices.items() for iso, d in near.items()],
                              "dataset string, t bigint, end_id bigint, iso_id bigint, d_iso double")
    got = {(r.t, r.end_id): r.iso_id for r in repair.settle_reuse(g, c).collect()}
    assert got == sequential_reuse(gaps, choices)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_pairs_equal_the_sorted_walk(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("a", 0, int(e), int(s), float(rng.integers(1, 8))) for e in range(8) for s in range(8) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "dataset string, t bigint, end_id bigint, start_id bigint, score double")
    ends, starts, want = set(), set(), set()
    for _, _, e, s, score in sorted(rows, key=lambda r: (r[4], r[2], r[3])):
        if e not in ends and s not in starts:
            want.add((e, s))
            ends.add(e)
            starts.add(s)
    assert {(r.end_id, r.start_id) for r in repair.greedy_pairs(df).collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_merged_detections_equal_the_sorted_walk(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("a", k, 0, *rng.integers(0, 12, 3).astype(float).tolist(), float(rng.integers(1, 5))) for k in range(40)]
    df = spark.createDataFrame(rows, "dataset string, node_id bigint, t bigint, z double, y double, x double, score double")
    want = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(um(r[3:6], k[3:6]) > 3.0 for k in want):
            want.append(r)
    got = extras.merge_detections(with_um(df), 3.0)
    assert {r.node_id for r in got.collect()} == {r[1] for r in want}


def random_movie(rng, frames=9, cells=6):
    base = rng.uniform(0, 40, (cells, 3)) * [0.3, 1, 1]
    speed = rng.normal(0, 2, (cells, 3)) * [0.3, 1, 1]
    return [(t, *(base[k] + speed[k] * t + rng.normal(0, .5, 3)).tolist()) for t in range(frames) for k in range(cells)
            if rng.random() < 0.9]


def test_motion_links_do_not_depend_on_the_window(graph):
    nodes, edges = graph(random_movie(np.random.default_rng(1)))
    edges = edges.withColumn("edge_prob", F.lit(None).cast("double"))
    want = None
    for window in (32, 3, 1):
        got = {(r.source_id, r.target_id, round(r.motion_um, 6), r.tight)
               for r in repair.motion_links(nodes, edges, window=window).collect()}
        want = want or got
        assert got == want and got


def test_motion_follows_the_predicted_position(graph):
    # Cell 0 moves steadily; at t=2 the nearer candidate lies behind it, the other ahead.
    nodes, edges = graph([(0, 0, 0, 0), (1, 0, 8, 0), (2, 0, 16, 0), (2, 0, 3, 0)])
    edges = edges.withColumn("edge_prob", F.lit(None).cast("double"))
    got = {(r.source_id, r.target_id) for r in repair.motion_links(nodes, edges).collect()}
    assert got == {(0, 1), (1, 2)}


def test_two_frame_recovery_inserts_thirds(graph):
    points = [(0, 0, 0, 0), (1, 0, 3, 0), (4, 0, 12, 0), (5, 0, 15, 0)]
    nodes, edges = graph(points, [(0, 1), (2, 3)])
    more, links = repair.recover_two_frame_gaps(nodes, edges)
    assert sorted((r.t, round(r.y, 6)) for r in more.collect()) == [(2, 6.0), (3, 9.0)]
    assert {(r.source_id, r.target_id) for r in links.collect()} == {(1, 4), (4, 5), (5, 2)}


def test_division_recovery_adds_the_near_orphan(graph):
    nodes, edges = graph([(0, 0, 0, 0), (1, 0, 4, 0), (1, 0, -4, 0)], [(0, 1)])
    got = repair.recover_divisions(nodes, edges).collect()
    assert [(r.source_id, r.target_id) for r in got] == [(0, 2)]


def test_components_of_a_long_path_and_a_hub(spark):
    n = 200
    nodes = spark.createDataFrame([("a", k) for k in range(2 * n)], "dataset string, node_id bigint")
    path = [("a", k, k + 1) for k in range(n - 1)]
    hub = [("a", n, n + k) for k in range(1, n)]
    edges = spark.createDataFrame(path + hub, "dataset string, source_id bigint, target_id bigint")
    got = {r.node_id: r.component for r in G.connected_components(nodes, edges).collect()}
    assert {got[k] for k in range(n)} == {0} and {got[k] for k in range(n, 2 * n)} == {n}


def test_short_tracks_go_unless_everything_would(spark, graph):
    points = [(t, 0, 0, 0) for t in range(5)] + [(0, 0, 50, 0), (1, 0, 50, 0)]
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (5, 6)]
    nodes, links = G.long_tracks(*graph(points, edges))
    assert sorted(r.node_id for r in nodes.collect()) == [0, 1, 2, 3, 4] and links.count() == 4
    nodes, links = G.long_tracks(*graph(points[5:], [(0, 1)]))
    assert nodes.count() == 2 and links.count() == 1


def test_whole_chain_keeps_a_valid_graph(graph):
    nodes, edges = graph(random_movie(np.random.default_rng(3), 12, 8))
    edges = edges.withColumn("edge_prob", F.lit(None).cast("double"))
    out_nodes, out_edges, counts = repair.repair_graph(nodes, edges)
    out_edges = out_edges.select("dataset", "edge_id", "source_id", "target_id")
    bad = {r.code for r in G.check_graph(*G.densify(out_nodes, out_edges), allow_divisions=True).collect()}
    assert bad <= set()
    assert {r.stage for r in counts.select("stage").distinct().collect()} >= {"raw", "final"}

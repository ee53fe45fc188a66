"""All arms of a grid in one plan, against one plan per arm."""

import random

import pytest

from trackspark.functions.geometry import with_um
from trackspark.operators import assign, spatial
from trackspark.plans import sweep
from trackspark.plans.predict import evaluate

SCALE = (1.0, 1.0, 1.0)


@pytest.fixture(scope="module")
def scene(spark):
    """Two recordings of drifting points with false, missing and unscored detections."""
    r = random.Random(5)
    nodes, truth, edges = [], [], []
    for name, tracks in (("a", 14), ("b", 5)):
        k = 0
        for track in range(tracks):
            z, y, x = (r.uniform(0, 18) for _ in range(3))
            for t in range(5):
                z, y, x = (v + r.gauss(0, 1.2) for v in (z, y, x))
                truth.append((name, track * 5 + t, t, z, y, x))
                if t:
                    edges.append((name, track * 5 + t, track * 5 + t - 1, track * 5 + t))
                for _ in range(r.choice((0, 1, 1, 2))):
                    strength = r.choice((0.1, 0.4, 0.4, 0.9, None, float("nan")))
                    nodes.append((name, k, t, z + r.gauss(0, 1), y + r.gauss(0, 1), x + r.gauss(0, 1), strength))
                    k += 1
    point = "dataset string, node_id bigint, t bigint, z double, y double, x double"
    return (nodes, spark.createDataFrame(nodes, point + ", score double"), spark.createDataFrame(truth, point),
            spark.createDataFrame(edges, "dataset string, edge_id bigint, source_id bigint, target_id bigint"),
            spark.createDataFrame([("a", 80.0), ("b", 20.0)], "dataset string, est_total double"))


def visible(nodes, floor, sep):
    """Node keys of one view, pair by pair."""
    worth = {n[:2]: n[6] if n[6] is not None and n[6] == n[6] else float("-inf") for n in nodes}
    kept = set()
    for n in nodes:
        own = (worth[n[:2]], -n[1])
        hidden = any(m[0] == n[0] and m[2] == n[2] and (worth[m[:2]], -m[1]) > own
                     and sum((p - q) ** 2 for p, q in zip(m[3:6], n[3:6])) ** 0.5 <= sep for m in nodes)
        if not hidden and own[0] >= floor:
            kept.add(n[:2])
    return kept


@pytest.mark.parametrize("mode", ["nearest", "gated"])
def test_grid_gives_the_rows_of_single_plans(spark, scene, mode):
    raw, nodes, gt, gt_edges, budgets = scene
    arms = sweep.grid_arms(budgets, sep=[0.0, 2.5], radius=[3.0, 6.0], floor=[float("-inf"), 0.4])
    rows = sweep.evaluate_grid(nodes, gt, gt_edges, budgets, arms, SCALE, mode).collect()
    assert len(rows) == 16
    got = {(r.dataset, r.floor, r.sep, r.radius): r for r in rows}
    for floor, sep, radius in ((float("-inf"), 0.0, 6.0), (0.4, 2.5, 3.0), (float("-inf"), 2.5, 6.0)):
        keep = visible(raw, floor, sep)
        alone = spark.createDataFrame([n[:6] for n in raw if n[:2] in keep], nodes.drop("score").schema)
        placed = with_um(alone, SCALE)
        links = (spatial.nearest_links(placed, radius) if mode == "nearest"
                 else assign.link_optimal(placed, radius, "gated"))
        edges = links.selectExpr("dataset", "source_id AS edge_id", "source_id", "target_id")
        for want in evaluate(alone, edges, gt, gt_edges, budgets, "x", SCALE).collect():
            row = got[want.dataset, floor, sep, radius]
            for c in ("edge_tp", "edge_fp", "edge_fn", "num_pred_nodes", "node_recall", "adj_edge_jaccard"):
                assert row[c] == want[c], (c, row, want)


def test_stored_arms_are_left_out_and_arms_may_differ_by_dataset(spark, scene):
    _, nodes, gt, gt_edges, budgets = scene
    arms = sweep.grid_arms(budgets, sep=[2.5], radius=[3.0, 6.0]).where("dataset = 'a' OR radius = 3")
    stored = arms.where("dataset = 'a' AND radius = 3").select("arm", "dataset")
    rows = sweep.resume_grid(nodes, gt, gt_edges, budgets, arms, stored, SCALE).collect()
    assert sorted((r.dataset, r.radius) for r in rows) == [("a", 6.0), ("b", 3.0)]
    whole = arms.select("arm", "dataset")
    assert sweep.resume_grid(nodes, gt, gt_edges, budgets, arms, whole, SCALE).collect() == []


def test_without_detections_all_true_links_are_missed(spark, scene):
    _, nodes, gt, gt_edges, budgets = scene
    arms = sweep.grid_arms(budgets, sep=[2.5], radius=[3.0])
    rows = sweep.evaluate_grid(nodes.limit(0), gt, gt_edges, budgets, arms, SCALE).collect()
    assert sorted((r.dataset, r.edge_tp, r.edge_fp, r.edge_fn) for r in rows) == [("a", 0, 0, 56), ("b", 0, 0, 20)]


def test_settings_are_tested(spark, scene):
    _, nodes, gt, gt_edges, budgets = scene
    schema = "dataset string, arm string, floor double, sep double, radius double"
    for bad in ([("a", "x", 0.0, None, 1.0)], [("a", "x", 0.0, 1.0, 1.0), ("a", "x", 0.0, 1.0, 2.0)]):
        with pytest.raises(ValueError):
            sweep.evaluate_grid(nodes, gt, gt_edges, budgets, spark.createDataFrame(bad, schema), SCALE)

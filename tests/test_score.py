"""Golden graphs of the edge metric, the gate, and the validators."""

import pytest
from pyspark.sql import functions as F

from trackspark.operators import assign, gate, graph as G, score
from trackspark.plans import predict as P

FRAMES = 6


def tracks(n, step=100.0):
    """n straight tracks of six frames, far apart: points and edges by position."""
    points = [(t, 5, 10 + step * k, 10 + t) for k in range(n) for t in range(FRAMES)]
    edges = [(k * FRAMES + t, k * FRAMES + t + 1) for k in range(n) for t in range(FRAMES - 1)]
    return points, edges


def counts(graph, points, edges, gt_points, gt_edges):
    nodes, links = graph(points, edges)
    truth, truth_links = graph(gt_points, gt_edges)
    r = score.edge_counts(nodes, links, assign.match_nodes(nodes, truth), truth, truth_links).first()
    return r.edge_tp, r.edge_fp, r.edge_fn


def test_perfect(graph):
    p, e = tracks(3)
    assert counts(graph, p, e, p, e) == (15, 0, 0)


def test_unannotated_tracks_are_free(graph):
    p, e = tracks(30)
    assert counts(graph, p, e, *tracks(3)) == (15, 0, 0)


def test_missing_wrong_and_extra_links(graph):
    p = [(t, 5, 10, 10 + t) for t in range(4)]
    e = [(0, 1), (1, 2), (2, 3)]
    q = p + [(3, 5, 60, 13)]
    assert counts(graph, p, e[:2], p, e) == (2, 0, 1)
    assert counts(graph, q, e[:2] + [(2, 4)], p, e) == (2, 1, 1)
    assert counts(graph, q, e + [(2, 4)], p, e) == (3, 1, 0)


def test_bridge_over_a_frame_counts_as_nothing(graph):
    p = [(t, 5, 10, 10 + t) for t in range(4)]
    e = [(0, 1), (1, 2), (2, 3)]
    assert counts(graph, p, [(0, 1), (1, 3)], p, e) == (1, 0, 2)
    assert counts(graph, p, [(0, 1)], p, e) == (1, 0, 2)


def test_late_division(graph):
    gt = [(0, 5, 10, 10), (1, 5, 10, 11), (2, 5, 10, 12), (1, 5, 40, 11), (2, 5, 40, 12), (3, 5, 10, 13)]
    true = [(0, 1), (0, 3), (1, 2), (3, 4), (2, 5)]
    guess = [(0, 1), (1, 2), (1, 4), (2, 5)]
    assert counts(graph, gt, guess, gt, true) == (3, 1, 2)


@pytest.mark.parametrize("ratio, want", [(1.0, 0.9), (-0.5, 1.05), (-0.802, 1.0802), (11.0, 0.0)])
def test_budget_multiplier(spark, ratio, want):
    from trackspark.functions.scalars import budget_multiplier
    assert spark.range(1).select(budget_multiplier(F.lit(ratio))).first()[0] == pytest.approx(want)


def metric_row(arm, name, tp, fp, fn):
    j = tp / (tp + fp + fn)
    return (arm, name, tp, fp, fn, 0, 0, 0, 10, 1.0, 0.0, j, j)


def rows(spark, data):
    from trackspark.schema import METRIC_ROWS
    return spark.createDataFrame([metric_row(*r) for r in data], METRIC_ROWS)


def folds(spark, names):
    return spark.createDataFrame([(n, k % 2) for k, n in enumerate(names)], "dataset string, fold bigint")


def test_gate_rejects_a_fold_regression_and_promotes_a_clean_gain(spark):
    base = [("base", n, 50, 25, 25) for n in "abcd"]
    mixed = [("mixed", "a", 45, 30, 25), ("mixed", "b", 65, 20, 15), ("mixed", "c", 45, 30, 25), ("mixed", "d", 65, 20, 15)]
    clean = [("clean", n, 60, 20, 20) for n in "abcd"]
    same = [("same", n, 50, 25, 25) for n in "abcd"]
    df = rows(spark, base + mixed + clean + same)
    got = {r.candidate: r for r in gate.gate(df, folds(spark, "abcd"), [
        ("base", "mixed"), ("base", "clean"), ("base", "same")]).collect()}
    assert got["mixed"].pooled_delta > 0 and not got["mixed"].promote
    assert got["mixed"].fold_deltas[0] < 0 < got["mixed"].fold_deltas[1]
    assert got["clean"].promote and "no fold loses" in got["clean"].reasons
    assert not got["same"].promote


def test_gate_compares_shared_datasets_only(spark):
    df = rows(spark, [("base", n, 50, 25, 25) for n in "abcd"] + [("few", n, 60, 20, 20) for n in "ab"])
    got = gate.gate(df, folds(spark, "abcd"), [("base", "few")]).first()
    assert got.n_shared == 2 and got.reasons[0].startswith("compared on 2")


def test_champion_moves_only_on_promotion(spark):
    verdicts = spark.createDataFrame(
        [("a", "b", False), ("a", "c", True), ("b", "c", True), ("c", "d", False), ("a", "d", True)],
        "baseline string, candidate string, promote boolean")
    steps = gate.champion_chain(verdicts, ["a", "b", "c", "d"]).collect()
    assert [(s.gated_against, s.champion) for s in steps] == [("a", "a"), ("a", "c"), ("c", "c")]


def test_check_graph_names_each_defect(spark, graph):
    nodes, edges = graph([(0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 9, 0), (0, 0, 9, 0), (2, 0, 0, 0)],
                         [(0, 4), (0, 0), (0, 1), (0, 1), (3, 1), (0, 2)])
    got = {r.code: r.n for r in G.check_graph(nodes, edges).collect()}
    assert got == {"not_one_frame": 2, "self_loop": 1, "duplicate_edge": 1, "merge": 1, "out_degree": 1}
    _, outside = graph([(0, 0, 0, 0)], [(0, 7)])
    assert [r.code for r in G.check_graph(graph([(0, 0, 0, 0)])[0], outside).collect()] == ["endpoint_outside"]
    broken = nodes.withColumn("z", F.when(F.col("node_id") == 1, float("nan")).otherwise(F.col("z")))
    assert "non_finite" in {r.code for r in G.check_graph(broken, edges).collect()}


def test_evaluate_scores_only_what_is_missing(spark, graph):
    p, e = tracks(2)
    nodes, edges = graph(p, e)
    budgets = spark.createDataFrame([("a", 12.0)], "dataset string, est_total double")
    asked = []

    def build(todo):
        asked.append(todo.count())
        return nodes.join(todo, "dataset", "left_semi"), edges.join(todo, "dataset", "left_semi")

    first = P.evaluate_missing({"x": build}, nodes, edges, budgets, None)
    r = first.first()
    assert (r.edge_tp, r.edge_jaccard, r.adj_edge_jaccard, r.division_exact) == (10, 1.0, 1.0, True)
    again = P.evaluate_missing({"x": build}, nodes, edges, budgets, first)
    assert asked == [1, 0] and again.count() == 0


def test_forked_predictions_are_flagged(spark, graph):
    nodes, edges = graph([(0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 9, 0)], [(0, 1), (0, 2)])
    budgets = spark.createDataFrame([("a", 3.0)], "dataset string, est_total double")
    assert not P.evaluate(nodes, edges, nodes, edges, budgets, "x").first().division_exact


def test_recordings_of_different_scale_share_a_plan(spark, graph):
    """The same voxel steps are links in a fine recording and too long in a coarse one."""
    points, edges = tracks(2)
    parts = [graph(points, edges, name) for name in ("fine", "coarse", "bad", "none")]
    nodes, links = parts[0]
    for n, e in parts[1:]:
        nodes, links = nodes.unionByName(n), links.unionByName(e)
    scales = spark.createDataFrame(
        [("fine", [1.0, 0.5, 0.5]), ("coarse", [20.0, 20.0, 20.0]), ("bad", [0.0, 1.0, 1.0]), ("bad", None),
         ("other", [1.0, 1.0, 1.0])], "dataset string, scale array<double>")
    budgets = nodes.groupBy("dataset").agg(F.count(F.lit(1)).cast("double").alias("est_total"))
    arm = P.Arm(join=P.Linker(mode="nearest", radius_um=9.0))
    made, joined = P.link(nodes, scales, arm)
    got = {r.dataset: (r.edge_tp, r.edge_fn)
           for r in P.evaluate(made, joined, nodes, links, budgets, "x", scales).collect()}
    assert got == {"fine": (10, 0), "coarse": (0, 10), "bad": (10, 0), "none": (10, 0)}


def test_a_radius_in_micrometres_holds_at_every_scale(spark, graph):
    """A prediction 12 voxels off is matched at half a micrometre a voxel, not at one."""
    parts = [(graph([(0, 0, 0, 0)], (), n)[0], graph([(0, 0, 12, 0)], (), n)[0]) for n in ("half", "one")]
    truth, pred = (parts[0][k].unionByName(parts[1][k]) for k in (0, 1))
    scales = spark.createDataFrame([("half", [1.0, 0.5, 0.5]), ("one", [1.0, 1.0, 1.0])],
                                   "dataset string, scale array<double>")
    found = assign.match_nodes(pred, truth, scale=scales).collect()
    assert [(r.dataset, r.d) for r in found] == [("half", 6.0)]

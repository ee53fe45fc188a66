"""Neighbours inside a frame are found in its task, without a table of pairs."""

import random
from statistics import median

from trackspark.operators import extras, spatial


def refuse(*_, **__):
    raise AssertionError("pairs were joined")


def moving(graph):
    rng = random.Random(3)
    points = [p for _ in range(40) for z, y, x in [[rng.randrange(30) for _ in range(3)]]
              for p in ((0, z, y, x), (1, z + rng.randrange(3), y + rng.random(), x - rng.random()))]
    return points, *graph(points, [(k, k + 1) for k in range(0, 80, 2)])


def test_medians_of_small_frames_need_no_pair_table(graph, monkeypatch):
    points, nodes, edges = moving(graph)
    scale = (1.625, 0.40625, 0.40625)
    expected = {}
    for k in range(0, 80, 2):
        near = [j for j in range(0, 80, 2) if j != k and sum(
            ((points[k][a + 1] - points[j][a + 1]) * scale[a]) ** 2 for a in range(3)) ** 0.5 <= 9]
        if near:
            middle = [median(points[j + 1][a] - points[j][a] for j in near) for a in (1, 2, 3)]
            expected[k // 2] = sum(((points[k + 1][a + 1] - points[k][a + 1] - middle[a]) * scale[a]) ** 2 for a in range(3)) ** 0.5

    def got():
        return {r.edge_id: round(r.residual, 9) for r in extras.motion_residuals(nodes, edges, 9.0).collect()}

    expected = {k: round(v, 9) for k, v in expected.items()}
    assert 10 < len(expected)
    with monkeypatch.context() as m:
        m.setattr(extras, "TASK_CELLS", 10)
        assert got() == expected
    monkeypatch.setattr(extras, "range_join", refuse)
    assert got() == expected


def test_spacing_of_small_frames_needs_no_pair_table(graph, monkeypatch):
    nodes, _ = graph([(0, 0, 0, 0), (0, 0, 3, 4), (0, 0, 3, 4), (0, 9, 0, 0), (1, 5, 5, 5)])
    nodes = nodes.withColumns({f"{a}u": nodes[a] for a in "zyx"})

    def got():
        return {r.node_id: r.d for r in spatial.spacing(nodes).collect()}

    expected = {0: 5.0, 1: 0.0, 2: 0.0, 3: 9.0}
    with monkeypatch.context() as m:
        m.setattr(spatial, "TASK_CELLS", 3)
        assert got() == expected
    monkeypatch.setattr(spatial, "range_join", refuse)
    assert got() == expected

"""Gaps over two frames: what is known of a pair's ends comes to them before they are paired."""

from trackspark.operators import repair


def test_pairs_are_not_joined_again(graph):
    points = [(0, 0, 0, 0), (1, 0, 0, 2), (4, 0, 0, 8), (5, 0, 0, 10), (4, 0, 9, 8)]
    nodes, edges = graph(points, [(0, 1), (2, 3)])
    found = repair.two_frame_proposals(nodes, edges)
    assert {(r.end_id, r.start_id) for r in found.collect()} == {(1, 2), (1, 4)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    # the tests of a pair's motion stay out of the condition that runs for every candidate
    condition = next(line for line in plan.splitlines() if "Join " in line)
    assert "CASE" not in condition and condition.count("SQRT") <= 3

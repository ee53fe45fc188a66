"""Motion links from the points of a frame: no table of pairs, and the same links as from one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import repair

FIRST = 2 ** 60


@pytest.fixture(scope="module")
def movie(spark):
    """Two recordings, one with twice the points a frame, and links of which some are likely; one without any link."""
    r = np.random.default_rng(3)
    nodes, edges = [], []
    for name, cells in (("few", 5), ("many", 12)):
        at = r.uniform(0, 30, (cells, 3)) * [0.3, 1, 1]
        for t in range(-2, 9):
            at = at + r.normal(0, 3, at.shape) * [0.3, 1, 1]
            nodes += [(name, FIRST + 100 * t + k, t, *map(float, at[k])) for k in range(cells) if r.random() < 0.9]
            edges += [(name, FIRST + 100 * t + k, FIRST + 100 * (t + 1) + int(r.integers(cells)), float(p))
                      for k, p in enumerate(r.choice([0.0, 0.9, 1.7, float("nan")], cells))]
    nodes += [("few", FIRST + 999, 3, float("nan"), 0.0, 0.0), ("none", 1, 0, 0.0, 0.0, 0.0), ("none", 2, 1, 0.0, 900.0, 0.0)]
    return (spark.createDataFrame(nodes, "dataset string, node_id bigint, t bigint, z double, y double, x double").localCheckpoint(),
            spark.createDataFrame(edges, "dataset string, source_id bigint, target_id bigint, edge_prob double").localCheckpoint())


def links(movie, **how):
    return sorted(map(tuple, repair.motion_links(*movie, with_origin=True, **how).collect()))


def test_small_frames_need_no_pair_table(movie, monkeypatch):
    want = links(movie)

    def refuse(*_, **__):
        raise AssertionError("pairs were joined")

    monkeypatch.setattr(repair, "range_join", refuse)
    assert links(movie) == want and len(want) > 80
    assert any(row[4] > 0 for row in want) and any(not row[7] for row in want)


@pytest.mark.parametrize("window", [32, 3])
def test_same_links_from_points_and_from_pairs(movie, monkeypatch, window):
    want = links(movie, window=window)
    joined, real = [], repair.range_join
    monkeypatch.setattr(repair, "range_join", lambda *a, **k: joined.append(1) or real(*a, **k))
    for cells in (60, 1):
        monkeypatch.setattr(repair, "TASK_CELLS", cells)
        assert links(movie, window=window) == want
    assert len(joined) == 2


def test_what_is_carried_reaches_both_kinds_of_recordings(movie, monkeypatch):
    nodes, edges = movie
    whole = links(movie)
    for cells in (4_000_000, 60):
        monkeypatch.setattr(repair, "TASK_CELLS", cells)
        early = repair.motion_links(nodes.where("t <= 3"), edges, with_origin=True)
        late = repair.motion_links(nodes.where("t >= 3"), edges, with_origin=True, carried=early.where(F.col("t") == 2))
        assert sorted(map(tuple, early.unionByName(late).collect())) == whole
    assert repair.motion_links(nodes.where("t > 99"), edges).count() == 0

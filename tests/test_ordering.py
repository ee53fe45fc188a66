"""Ranks, percentiles and spatial joins against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators import ordering, spatial


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.integers(4)}", k, float(rng.integers(0, 40)))
            for k in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, id bigint, v double").repartition(6)


def test_rank_of_a_hot_group(skewed):
    rows, df = skewed
    got = {r.id: r["rank"] for r in ordering.rank_rows(df, ["g"], ["-v", "id"]).collect()}
    for group in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_percentiles_with_many_copies(skewed):
    rows, df = skewed
    qs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.g: r for r in ordering.exact_percentiles(df, ["g"], "v", qs).collect()}
    for group in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == group]
        for name, q in qs.items():
            assert got[group][name] == pytest.approx(np.percentile(values, 100 * q))


def cloud(spark, rng, n, frames=2, copies=0):
    rows = [("a", k, k % frames, *rng.uniform(0, 60, 3).tolist()) for k in range(n)]
    rows += [("a", n + k, 0, 5.0, 5.0, 5.0) for k in range(copies)]
    return rows, with_um(spark.createDataFrame(
        rows, "dataset string, node_id bigint, t bigint, z double, y double, x double"), (1, 1, 1))


@pytest.mark.parametrize("crowded", [4096, 2])
def test_nearest_links(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED_BUCKET", crowded)
    rows, nodes = cloud(spark, np.random.default_rng(2), 80, copies=6)
    got = {r.source_id: r.target_id for r in spatial.nearest_links(nodes, 12.0).collect()}
    for _, i, t, *p in rows:
        near = sorted((float(np.linalg.norm(np.subtract(p, q))), j) for _, j, u, *q in rows if u == t + 1)
        near = [n for n in near if n[0] < 12.0]
        assert got.get(i) == (near[0][1] if near else None)


@pytest.mark.parametrize("crowded", [4096, 3])
def test_spacing_reaches_lone_points(spark, monkeypatch, crowded):
    monkeypatch.setattr(spatial, "CROWDED_BUCKET", crowded)
    rows, _ = cloud(spark, np.random.default_rng(3), 60, copies=4)
    rows.append(("a", 999, 0, 5000.0, 0.0, 0.0))
    nodes = with_um(spark.createDataFrame(
        rows, "dataset string, node_id bigint, t bigint, z double, y double, x double"), (1, 1, 1))
    got = {r.node_id: r.d for r in spatial.spacing(nodes).collect()}
    for _, i, t, *p in rows:
        near = min(float(np.linalg.norm(np.subtract(p, q))) for _, j, u, *q in rows if u == t and j != i)
        assert got[i] == pytest.approx(near)


def test_nearest_k_ranks(spark):
    rows, nodes = cloud(spark, np.random.default_rng(4), 40)
    left = spatial.as_sources(nodes)
    got = spatial.nearest_k(left, spatial.next_frame(nodes), 5, ["dataset", "t"], "source_id", "target_id")
    found = {}
    for r in got.collect():
        found.setdefault(r.source_id, {})[r["rank"]] = r.target_id
    for _, i, t, *p in rows:
        near = sorted((float(np.linalg.norm(np.subtract(p, q))), j) for _, j, u, *q in rows if u == t + 1)[:5]
        assert found.get(i, {}) == {k + 1: j for k, (_, j) in enumerate(near)}


def test_range_join_has_no_repeats(spark):
    rows, nodes = cloud(spark, np.random.default_rng(5), 70)
    got = spatial.link_candidates(nodes, 15.0)
    pairs = [(r.source_id, r.target_id) for r in got.select("source_id", "target_id").collect()]
    want = {(i, j) for _, i, t, *p in rows for _, j, u, *q in rows
            if u == t + 1 and np.linalg.norm(np.subtract(p, q)) <= 15.0}
    assert len(pairs) == len(want) and set(pairs) == want
    assert got.where(F.col("d") > 15).count() == 0

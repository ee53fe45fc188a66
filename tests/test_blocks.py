"""Slabs with halos against direct NumPy computation, for every cut of the frame."""

import numpy as np
import pyarrow as pa
import pytest

from trackspark.operators import blocks as B
from trackspark.operators import volume as V

UM = (1.625, 0.8, 0.5)


def table(spark, volumes):
    rows = [(d, t, *map(int, p), float(v[tuple(p)])) for (d, t), v in volumes.items() for p in np.argwhere(np.ones(v.shape, bool))]
    return spark.createDataFrame(rows, "dataset string, t bigint, z int, y int, x int, v double").repartition(3)


@pytest.fixture(scope="module")
def volumes():
    r = np.random.default_rng(5)
    return {("a", 0): r.normal(size=(7, 5, 6)), ("a", 1): np.round(r.normal(size=(7, 5, 6))), ("b", 4): np.full((2, 3, 4), 2.5)}


def arrays(blocks, name, volumes):
    out = {k: np.full(v.shape, np.nan) for k, v in volumes.items()}
    for r in B.to_voxels(blocks).collect():
        out[(r.dataset, r.t)][r.z, r.y, r.x] = r[name]
    return out


def smooth(v, sigma):
    for axis, s in enumerate(sigma):
        if s > 0:
            w = V.gaussian_weights(s)
            r = len(w) // 2
            p = np.pad(v, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="symmetric")
            v = sum(wk * np.take(p, range(k, k + v.shape[axis]), axis) for k, wk in enumerate(w))
    return v


def maximum(v, inside):
    at = np.argwhere(np.ones(v.shape, bool))
    return np.array([max(v[tuple(q)] for q in at if inside(*(q - p))) for p in at]).reshape(v.shape)


def ball(radius):
    return lambda *d: sum((k * u) ** 2 for k, u in zip(d, UM)) <= radius ** 2 and all(
        abs(k) <= V.steps(radius, u) for k, u in zip(d, UM))


@pytest.mark.parametrize("depth", [1, 3, None])
def test_gaussians_and_maxima(spark, volumes, depth):
    cut = B.to_slabs(table(spark, volumes), depth)
    made = B.gaussian(cut, {"s": (0.9, 0.0, 1.3), "w": (3.0, 2.0, 0.0)})
    for name, sigma in (("s", (0.9, 0.0, 1.3)), ("w", (3.0, 2.0, 0.0))):
        for key, got in arrays(made, name, volumes).items():
            assert np.allclose(got, smooth(volumes[key], sigma))
    for key, got in arrays(B.box_max(cut, (2, 1, 0)), "peak", volumes).items():
        assert np.array_equal(got, maximum(volumes[key], lambda z, y, x: abs(z) <= 2 and abs(y) <= 1 and x == 0))
    for radius in (0.4, 1.7, 3.4):
        for key, got in arrays(B.ball_max(cut, radius, UM), "peak", volumes).items():
            assert np.array_equal(got, maximum(volumes[key], ball(radius)))


@pytest.mark.parametrize("depth", [2, None])
def test_normalised_frames(spark, volumes, depth):
    made = B.normalised(B.to_slabs(table(spark, volumes), depth), 0.1, 0.9, 0.3)
    floors = {(r.dataset, r.t): r.floor for r in made.df.collect()}
    for key, got in arrays(made, "v", volumes).items():
        lo, hi = np.quantile(volumes[key], (0.1, 0.9))
        want = np.maximum((volumes[key] - lo) / ((hi if hi > lo else lo + 1) - lo), 0)
        assert np.allclose(got, want)
        assert floors[key] == pytest.approx(np.quantile(want, 0.3))


def test_ranks_by_counted_bits(spark):
    r = np.random.default_rng(1)
    special = [-0.0, 0.0, 1e-300, -1e300, 1e300, 5e-324, -5e-324, 1.0, 1.0 + 2 ** -52, 1.0 + 2 ** -51]
    volumes = {("a", 0): np.concatenate([r.choice(special, 50), r.normal(size=22)]).reshape(6, 3, 4),
               ("a", 1): 1 + r.integers(0, 9, (6, 3, 4)) * 2.0 ** -52, ("c", 0): r.integers(0, 3, (6, 3, 4)).astype(float)}
    shares = {"p0": 0.0, "p3": 0.33, "p9": 0.997, "p1": 1.0}
    got = B.frame_ranks(B.to_slabs(table(spark, volumes), 2), shares).collect()
    assert len(got) == 3
    for row in got:
        v = np.sort(volumes[(row.dataset, row.t)], axis=None)
        for name, share in shares.items():
            place = share * (len(v) - 1)
            at = int(place)
            assert (row[f"{name}_a"], row[f"{name}_b"]) == (v[at], v[min(at + 1, len(v) - 1)])
            assert row[f"{name}_f"] == pytest.approx(place - at)


@pytest.mark.parametrize("depth", [2, None])
def test_peaks_and_centres_equal_the_row_form(spark, depth):
    g = np.random.default_rng(3).random((7, 8, 9))
    voxels = table(spark, {("a", 0): smooth(g, (0.5, 0.8, 0.8))})
    norm = V.normalise_frames(voxels)
    want_table = V.cut_lineage(V.dog_response(norm, UM, ((0.6, 1.5),)), "dog")
    want = V.detect_dog(want_table, UM, 1.7)
    found = B.detect_dog(B.to_slabs(voxels, depth), UM, 1.7, ((0.6, 1.5),), refine_um=1.0).collect()
    assert len(found) > 3
    assert {(r.z, r.y, r.x) for r in found} == {(r.z, r.y, r.x) for r in want.collect()}
    centres = {(round(r.z, 6), round(r.y, 6), round(r.x, 6)) for r in V.refine_centroids(want, want_table, UM, 1.0).collect()}
    assert {(round(r.rz, 6), round(r.ry, 6), round(r.rx, 6)) for r in found} == centres


def test_frames_must_be_dense(spark, volumes):
    rows = table(spark, volumes)
    for broken in (rows.where("not (z = 3 and y = 2 and x = 1)"), rows.unionByName(rows.where("z = 1 and y = 1 and x = 1"))):
        with pytest.raises(Exception, match="not dense"):
            B.to_slabs(broken, 2).df.collect()
    assert B.to_slabs(rows.where("false"), 2).df.count() == 0


def test_slabs_are_packed_once_and_taken_in_pieces(spark):
    rows = [("d", t, z, y, x, float(t + z * y + x)) for t in range(2) for z in range(4) for y in range(2) for x in range(2)]
    voxels = spark.createDataFrame(rows, "dataset string, t bigint, z int, y int, x int, v double")
    plan = B.normalised(B.to_slabs(voxels, 2)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
    batch = pa.record_batch({"a": list(range(B.STEP_ROWS + 5))})
    assert [p.num_rows for p in B._pieces(iter([batch]))] == [B.STEP_ROWS, 5]

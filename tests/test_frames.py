"""Frames as a data source: round trip, pushed filters, missing and broken files."""

import numpy as np
import pytest

from trackspark.sources import frames

SHAPE = (2, 3, 4)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("movies"))
    rows = [(name, t, [float(1000 * k + 24 * t + p) for p in range(24)])
            for k, (name, n) in enumerate((("a", 40), ("b", 3))) for t in range(n) if t != 5]
    table = spark.createDataFrame(rows, "dataset string, t bigint, values array<double>").repartition(4)
    frames.write_frames(table, path, SHAPE)
    return path


def test_round_trip(spark, folder):
    got = frames.read_frames(spark, folder, SHAPE)
    assert got.count() == 42 * 24
    for r in got.where("dataset = 'b' AND t = 2").collect():
        assert r.v == 1000 + 48 + 12 * r.z + 4 * r.y + r.x
    assert sorted(r.t for r in got.where("dataset = 'a'").select("t").distinct().collect()) == [t for t in range(40) if t != 5]


def test_only_the_asked_frames_are_opened(spark, folder):
    for name, t in (("a", 30), ("b", 1)):
        with open(f"{folder}/{name}/0/c/{t}/0/0/0", "ab") as f:
            f.write(b"xx")
    try:
        got = frames.read_frames(spark, folder, SHAPE)
        assert got.where("dataset = 'a' AND t >= 3 AND t < 30").count() == 26 * 24
        assert got.where("dataset IN ('a', 'none') AND t = 7").count() == 24
        assert got.where("dataset = 'b' AND t > 1").count() == 24
        with pytest.raises(Exception, match="frame 30: 25 voxels"):
            got.where("dataset = 'a'").count()
    finally:
        for name, t in (("a", 30), ("b", 1)):
            path = f"{folder}/{name}/0/c/{t}/0/0/0"
            np.fromfile(path, dtype="uint16")[:24].tofile(path)


def test_nothing_to_read(spark, folder):
    got = frames.read_frames(spark, folder, SHAPE)
    assert got.where("dataset = 'none'").count() == 0
    assert got.where("t > 99").count() == 0

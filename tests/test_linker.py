"""The stateful linker against the batch join, with frames split over the batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators.spatial import nearest_links
from trackspark.streaming import linker as L

START = 1_700_000_000
FIELDS = "dataset string, node_id bigint, t bigint, z double, y double, x double, ts timestamp"


def test_nearest_equals_brute_force(monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(L, "STEP_CELLS", 30)
    for _ in range(50):
        s, t = (tuple([list(r.permutation(n)), *[r.integers(0, 6, n).astype(float).tolist() for _ in range(3)]])
                for n in r.integers(0, 12, 2))
        got = {(int(a), int(b), round(float(d), 9)) for a, b, d in zip(*L.nearest(s, t, 3.0))}
        want = set()
        for i, *p in zip(*s):
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q)))), j) for j, *q in zip(*t))
            if near and near[0][0] < 3.0:
                want.add((int(i), int(near[0][1]), round(near[0][0], 9)))
        assert got == want


@pytest.mark.parametrize("block_radii", [3.0])
def test_split_frames_and_late_rows(spark, tmp_path, block_radii):
    r = np.random.default_rng(7)
    rows = [(f"d{k % 2}", k, int(t), *map(float, r.integers(-30, 30, 3)), None) for k, t in enumerate(np.repeat(np.arange(8), 12))]
    nodes = spark.createDataFrame(rows, FIELDS).withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("t"))).cache()
    source = str(tmp_path / "in")
    # each file holds two frames, one node in three comes with the next file
    files = nodes.withColumn("f", F.floor((F.col("t") + F.when(F.col("node_id") % 3 == 0, 1).otherwise(0)) / 2))
    end = nodes.limit(1).withColumns({"dataset": F.lit("~"), "t": F.lit(-2).cast("bigint"), "ts": F.timestamp_seconds(F.lit(START + 9999))})
    late = nodes.where("t = 0").withColumn("node_id", F.col("node_id") + 1000)
    for part in [files.where(F.col("f") == k).drop("f") for k in range(5)] + [end, late, end]:
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(nodes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches = L.run_stateful(L.online_links(stream, 7.0, START * 1000, block_radii=block_radii), str(tmp_path / "out"))
    assert batches >= 7
    got = spark.read.parquet(str(tmp_path / "out" / "batch=*"))
    keys = ["dataset", "t", "source_id", "target_id"]
    want = sorted(map(tuple, nearest_links(with_um(nodes), 7.0).select(*keys).collect()))
    assert sorted(map(tuple, got.select(*keys).collect())) == want and len(want) > 5

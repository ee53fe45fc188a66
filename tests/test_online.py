"""Online links as one windowed aggregation: uneven clocks, split frames, and how much state they keep."""

import numpy as np
from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators.spatial import nearest_links
from trackspark.streaming.linker import nearest
from trackspark.streaming.online import online_nearest_links

FIELDS = "dataset string, node_id bigint, t bigint, z double, y double, x double, ms bigint"


def test_uneven_clock_split_frames_and_state(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(f"d{k % 2}", k, int(t), *map(float, r.integers(-40, 40, 3)), int(t * 1000 + r.integers(0, 900)))
            for k, t in enumerate(np.repeat(np.arange(6), 400))]
    nodes = spark.createDataFrame(rows, FIELDS).withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000)).drop("ms").cache()
    end = nodes.limit(1).withColumns({"dataset": F.lit("~"), "t": F.lit(-2).cast("bigint"), "ts": F.col("ts") + F.expr("INTERVAL 1 DAY")})
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # every other node of a frame comes with the next file, within the delay
    for part in [nodes.where(F.floor((F.col("t") + F.col("node_id") % 2) / 2) == k) for k in range(4)] + [end]:
        part.coalesce(1).write.mode("append").parquet(source)

    def read():
        return spark.readStream.schema(nodes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = (online_nearest_links(read(), read(), 9.0, delay="5 seconds").writeStream
           .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"))
           .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start())
    run.awaitTermination()
    keys = ["dataset", "t", "source_id", "target_id"]
    got = sorted(map(tuple, spark.read.parquet(f"{out}/batch=*").select(*keys).collect()))
    want = sorted(map(tuple, nearest_links(with_um(nodes), 9.0).select(*keys).collect()))
    assert got == want and len(want) > 20
    # one state, of a value per cube and window: fewer than there are detections
    states = [p.stateOperators for p in run.recentProgress]
    assert max(len(s) for s in states) == 1
    assert 0 < max(s[0].numRowsTotal for s in states if s) < len(rows)


def test_targets_out_of_time_or_place_are_not_nearest():
    source = ([1], [0.0], [0.0], [0.0])
    targets = ([4, 5, 6, 7], [0.0, float("nan"), 1.0, 2.0], [0.0] * 4, [0.0] * 4)
    times = (np.array([10]), np.array([9, 11, 31, 30]), 20)
    assert [x.tolist() for x in nearest(source, targets, 5.0, times)] == [[1], [7], [2.0]]

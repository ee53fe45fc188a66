"""One-to-one gaps from the points of a frame: no table of pairs, and the same choice as from one."""

import random

from pyspark.sql import functions as F

from trackspark.operators import assign, repair
from trackspark.operators.spatial import range_join

KEYS = ["dataset", "t"]


def sides(spark):
    rng = random.Random(5)
    points = [("d", t, 100 * t + k, *[float(rng.randrange(40)) / 2 for _ in range(3)], side)
              for t in range(3) for k in range(30) for side in (0, 1)]
    df = spark.createDataFrame(points, "dataset string, t bigint, id bigint, zu double, yu double, xu double, side int").localCheckpoint()
    return [df.where(F.col("side") == side).drop("side").withColumnRenamed("id", name) for side, name in enumerate(("end_id", "start_id"))]


def rows(df):
    return sorted(tuple(r) for r in df.select(*KEYS, "end_id", "start_id", "d").collect())


def test_same_pairs_as_from_the_join(spark, monkeypatch):
    def big(top):
        return top * 10 + 1

    ends, starts = sides(spark)
    pairs = range_join(ends, starts, 5.0, KEYS).select(*KEYS, "end_id", "start_id", "d")
    tops = pairs.groupBy(*KEYS).agg(F.max("d").alias("top"))
    expected = rows(assign.max_weight_matching(
        pairs.join(tops, KEYS).withColumn("w", big(F.col("top")) - F.col("d")), KEYS, "end_id", "start_id", "w"))
    assert len(expected) > 30
    assert rows(assign.match_near(ends, starts, 5.0, KEYS, "end_id", "start_id", big)) == expected
    few = ends.where("t <> 1 OR end_id < 110")
    some = rows(assign.match_near(few, starts, 5.0, KEYS, "end_id", "start_id", big))
    monkeypatch.setattr(assign, "TASK_CELLS", 500)
    assert sum(r[1] == 1 for r in some) < 11
    assert rows(assign.match_near(few, starts, 5.0, KEYS, "end_id", "start_id", big)) == some


def test_gaps_of_small_frames_need_no_pair_table(spark, monkeypatch):
    nodes = spark.createDataFrame([("d", k, t, 0.0, 10.0 * k, 0.0) for k, t in ((0, 0), (1, 2), (9, 0), (10, 2))],
                                  "dataset string, node_id bigint, t bigint, z double, y double, x double")
    edges = spark.createDataFrame([], "dataset string, source_id bigint, target_id bigint")

    def refuse(*_, **__):
        raise AssertionError("pairs were joined")

    for module in (repair, assign):
        monkeypatch.setattr(module, "range_join", refuse)
    added, links = repair.close_gaps(nodes, edges)
    assert sorted((r.t, r.y) for r in added.collect()) == [(1, 5.0), (1, 95.0)]
    assert links.count() == 4

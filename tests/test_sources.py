"""Readers, writers and streams on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import submission as S
from trackspark.operators import extras
from trackspark.sources import metadata, results, tables


def test_submission_round_trip(spark, graph, tmp_path):
    nodes, edges = graph([(0, 0.5, 1.5, 2.4), (1, 2.5, -0.5, 3)], [(0, 1)])
    rows = S.build_submission(nodes, edges)
    path = str(tmp_path / "sub")
    tables.write_submission(rows, path)
    back = tables.read_submission(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in back] == [
        (0, "a", "node", 0, 0, 0, 2, 2, -1, -1), (1, "a", "node", 1, 1, 2, 0, 3, -1, -1),
        (2, "a", "edge", -1, -1, -1, -1, -1, 0, 1)]
    names = spark.createDataFrame([("a",), ("b",)], "dataset string")
    assert tables.check_submission(spark, path, 3, names.where("dataset = 'a'")) == []
    assert tables.check_submission(spark, path, 4, names) == ["3 rows, expected 4", "1 datasets missing"]


def test_validator_reports(spark, graph):
    nodes, edges = graph([(0, 0, 0, 0), (2, 0, 0, 0)], [(0, 1), (0, 9)])
    only_nodes = graph([(0, 0, 0, 0)], [], "n")[0]
    rows = S.build_submission(nodes.unionByName(only_nodes), edges)
    got = {(r.dataset, r.code): r.n for r in S.validate(rows).collect()}
    assert got[("a", "dangling_edge")] == 1 and got[("a", "not_one_frame")] == 1
    assert ("n", "no_edge_rows") in got and S.missing_columns(rows.drop("x")) == ["x"]


def test_raw_frames(spark, tmp_path):
    shape = (2, 3, 4)
    for t in range(2):
        folder = tmp_path / "a.zarr" / "0" / "c" / str(t) / "0" / "0"
        folder.mkdir(parents=True)
        (folder / "0").write_bytes((np.arange(24, dtype="uint16") + 100 * t).tobytes())
    v = tables.read_raw_frames(spark, str(tmp_path), shape)
    assert v.count() == 48
    r = v.where("t = 1 AND z = 1 AND y = 2 AND x = 3").first()
    assert (r.dataset, r.v) == ("a", 123.0)
    assert [r.dataset for r in tables.list_names(spark, str(tmp_path), ".zarr").collect()] == ["a"]


def test_graph_reader_fills_depth_and_ids(spark, tmp_path):
    spark.createDataFrame([("a", 7, 0, None, 1.0, 2.0), ("a", 9, 1, 3.0, 1.0, 2.0)],
                          tables.NODES).write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([("a", 0, 7, 9)], tables.EDGES).write.parquet(str(tmp_path / "e"))
    nodes, edges = tables.read_graph(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert sorted((r.node_id, r.z) for r in nodes.collect()) == [(0, 0.0), (1, 3.0)]
    assert [(r.source_id, r.target_id) for r in edges.collect()] == [(0, 1)]


def test_splits_file(spark, tmp_path):
    from trackspark.operators.sampling import split_folds
    (tmp_path / "s.json").write_text('[{"split":0,"train":["b"],"test":["a"]},{"split":1,"train":["a"],"test":["b","c"]}]')
    got = split_folds(tables.read_splits(spark, str(tmp_path / "s.json"))).collect()
    assert {(r.dataset, r.fold) for r in got} == {("a", 0), ("b", 1), ("c", 1)}


def test_thread_archive_flattens_depth_first(spark, tmp_path):
    from trackspark.operators.threads import flatten_nested
    (tmp_path / "t.json").write_text(
        '{"topic": 5, "comments": [{"id": 1, "replies": [{"id": 2, "replies": [{"id": 3}]}, {"id": 4}]}, {"id": 6}]}')
    leaf = "struct<id:bigint>"
    mid = f"struct<id:bigint,replies:array<{leaf}>>"
    top = f"struct<id:bigint,replies:array<{mid}>>"
    docs = tables.read_threads(spark, str(tmp_path), f"topic bigint, comments array<{top}>")
    rows = flatten_nested(docs).orderBy("path").collect()
    assert [(r.id, r.depth) for r in rows] == [(1, 0), (2, 1), (3, 2), (4, 1), (6, 0)]


@pytest.mark.parametrize("doc, want", [
    ('{"a":{"estimated_number_of_nodes":1},"estimated_number_of_nodes":2}', 2.0),
    ('{"a":[{"b":0},{"estimated_number_of_nodes":3}],"c":{"estimated_number_of_nodes":4}}', 3.0),
    ('{"a":{"estimated_number_of_nodes":null},"b":{"estimated_number_of_nodes":5}}', 5.0),
    ('{"a":1}', None)])
def test_budget_is_the_first_depth_first(spark, doc, want):
    docs = spark.createDataFrame([("a", doc)], "dataset string, j string")
    assert metadata.node_budget(docs, ["j"]).first().est_total == want


def test_budget_falls_back_over_sources(spark):
    docs = spark.createDataFrame([("a", "{}", '{"estimated_number_of_nodes": 8}')], "dataset string, p string, q string")
    assert metadata.node_budget(docs, ["p", "q"]).first().est_total == 8.0


def test_report_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), 1.0)], "k string, x double, y double")
    results.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"k":"a","y":1.0}'


def test_frozen_frames(spark):
    rows = [("a", t, 0, 0, x, float(x if t < 2 else x + t)) for t in range(4) for x in range(3)]
    df = spark.createDataFrame(rows, "dataset string, t bigint, z int, y int, x int, v double")
    r = extras.frozen_frames(df).first()
    assert (r.frozen, r.frames) == (1, 4)


def test_motion_linker_over_batches(spark, tmp_path):
    from trackspark.operators.repair import motion_links
    from trackspark.streaming.online import MotionLinker
    rows = [("a", 10 * t + k, t, 0.0, 20.0 * k + 3 * t, 2.0 * t) for t in range(6) for k in range(3)]
    nodes = spark.createDataFrame(rows, "dataset string, node_id bigint, t bigint, z double, y double, x double")
    linker = MotionLinker(str(tmp_path / "out"), str(tmp_path / "state"))
    for batch, (a, b) in enumerate([(0, 2), (2, 4), (4, 6)]):
        linker(nodes.where((F.col("t") >= a) & (F.col("t") < b)), batch)
    got = spark.read.parquet(str(tmp_path / "out")).select("source_id", "target_id")
    none = spark.createDataFrame([], "dataset string, source_id bigint, target_id bigint, edge_prob double")
    want = motion_links(nodes, none).select("source_id", "target_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    from trackspark.streaming.online import run_available, windowed_counts
    src = tmp_path / "in"
    # Late rows are judged by the watermark that stood one batch earlier.
    for k, times in enumerate((["00:00:01", "00:00:02"], ["00:05:00"], ["00:06:00"], ["00:00:03", "00:09:00"])):
        (spark.createDataFrame([(f"2024-01-01 {s}",) for s in times], "s string")
         .select(F.to_timestamp("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(src / f"p{k}")))
    stream = (spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    run_available(windowed_counts(stream, "ts", [], "1 minute", "30 seconds"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r.n for r in rows if r.start.minute == 0) == 2

"""Releases appear only after a clean audit of what was read back."""

import pytest
from pyspark.sql import functions as F

from trackspark.operators import publish as P
from trackspark.operators.graph import check_graph
from trackspark.operators.submission import build_submission


@pytest.fixture
def good(graph):
    nodes, edges = graph([(0, 1, 2, 3), (1, 1, 2, 4), (2, 1, 2, 5)], [(0, 1), (1, 2)])
    return build_submission(nodes, edges)


def codes(release):
    return {r.code for r in release.findings.where("severity <> 'note'").collect()}


def test_releases_count_up_and_bad_ones_stay_out(spark, good, tmp_path):
    path = str(tmp_path)
    assert P.read_published(spark, path) is None
    first = P.publish(good, path, good)
    assert first.number == 1 and codes(first) == set()
    assert P.read_published(spark, path).count() == 5
    more = good.unionByName(good.withColumns({"dataset": F.lit("b"), "id": F.col("id") + 5}))
    wanted = good.unionByName(good.withColumn("dataset", F.lit("c")))
    refused = P.publish(more, path, wanted)
    assert not refused.published and codes(refused) == {"missing_dataset", "unexpected_dataset"}
    assert P.read_published(spark, path).count() == 5
    loose = good.withColumn("target_id", F.when(F.col("row_type") == "edge", 9).otherwise(F.col("target_id")).cast("bigint"))
    assert not P.publish(loose, path, blocking=("fatal", "problem")).published
    assert P.publish(more, path).number == 2
    assert P.read_published(spark, path).count() == 10
    assert sorted((r.release, r.dataset, r.node_rows, r.edge_rows) for r in P.releases(spark, path).collect()) == [
        (1, "a", 3, 2), (2, "a", 3, 2), (2, "b", 3, 2)]
    assert codes(P.publish(good.drop("t"), path)) == {"no column t"}


def test_audit_names_what_differs(spark, good):
    base = P.manifest(good)
    assert P.audit(base, base).count() == 0
    fewer = P.manifest(good.where("id < 4"))
    moved = P.manifest(good.withColumn("x", F.col("x") + (F.col("id") == 1).cast("int")))
    other = P.manifest(good.withColumn("dataset", F.lit("z")))
    assert [(r.code, r.n) for r in P.audit(base, fewer).collect()] == [("row_count", 1)]
    assert [r.code for r in P.audit(base, moved).collect()] == ["content"]
    assert {(r.dataset, r.code) for r in P.audit(base, other).collect()} == {("a", "lost_dataset"), ("z", "strange_dataset")}


def test_infinite_coordinates_of_opposite_sign_are_found(graph):
    nodes, edges = graph([(0, float("inf"), float("-inf"), 1), (1, 1, 1, 1), (2, float("nan"), 1, 1)], [(0, 1), (1, 2)])
    found = {(r.code, r.n) for r in check_graph(nodes, edges).collect()}
    assert ("non_finite", 2) in found

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from trackspark.session import local_session
    session = local_session("tests", cpus=8)
    session.conf.set("spark.sql.shuffle.partitions", "8")
    return session


NODE = "dataset string, node_id bigint, t bigint, z double, y double, x double"
EDGE = "dataset string, edge_id bigint, source_id bigint, target_id bigint"


@pytest.fixture
def graph(spark):
    """graph(points, edges): one dataset 'a'; points are (t, z, y, x), ids their positions."""
    def make(points, edges=(), name="a"):
        nodes = spark.createDataFrame(
            [(name, i, int(t), float(z), float(y), float(x)) for i, (t, z, y, x) in enumerate(points)], NODE)
        links = spark.createDataFrame(
            [(name, i, int(s), int(d)) for i, (s, d) in enumerate(edges)], EDGE)
        return nodes, links
    return make

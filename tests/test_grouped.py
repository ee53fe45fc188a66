"""Groups cut from sorted batches, and matchings that don't pay for a data frame per group."""

import numpy as np
import pyarrow as pa
import pytest

from trackspark.functions.geometry import with_um
from trackspark.operators import assign
from trackspark.operators.grouped import whole_groups


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_stay_whole_over_batches(size):
    rows = sorted([(d, t) for d, n in (("a", 1), ("b", 5), ("c", 9)) for t in range(2) for _ in range(n + t)]) + [(None, 0)] * 3
    table = pa.table({"d": pa.array([r[0] for r in rows], pa.string()), "t": [r[1] for r in rows], "i": list(range(len(rows)))})
    found = []
    for part, at in whole_groups(iter(table.to_batches(max_chunksize=size)), ["d", "t"]):
        i = part.column("i").to_numpy()
        found += [tuple(i[a:b]) for a, b in zip(at[:-1], at[1:])]
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(r, []).append(i)
    assert found == [tuple(v) for v in want.values()]
    assert not list(whole_groups(iter([]), ["d"]))


def test_small_groups_share_a_call_and_all_cores(graph, spark):
    rng = np.random.default_rng(5)
    nodes, _ = graph([(t, *p) for t in range(30) for p in rng.uniform(0, 9, (3, 3))])
    links = assign.link_optimal(with_um(nodes), 9.0)
    plan = links._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan
    assert links.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert links.count() == sum(1 for r in links.collect() if r.d <= 9.0)
    matches = assign.match_nodes(nodes, nodes)
    assert "FlatMapGroupsInPandas" not in matches._jdf.queryExecution().sparkPlan().toString()
    assert {(r.pred_id, r.gt_id) for r in matches.collect()} == {(k, k) for k in range(90)}

"""A stream in steps of several files, and what a batch of many frames costs a cube of state."""

import numpy as np
import pandas as pd

from trackspark.plans import plan_queries as P
from trackspark.plans.fixtures import Inputs
from trackspark.streaming import linker as L


class Store:
    """A list state and a handle that count what is asked of them."""

    def __init__(self):
        self.pieces, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def appendValue(self, value):
        self.calls += 1
        self.pieces.append(value)

    def get(self):
        self.calls += 1
        return iter(list(self.pieces))

    def put(self, pieces):
        self.calls += 1
        self.pieces = list(pieces)

    def clear(self):
        self.calls += 1
        self.pieces = []

    def registerTimer(self, due):
        self.calls += 1
        self.timers.append(due)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_batch_costs_one_append_and_one_timer():
    frames = [(side, t, 10 * t + k + (10 if side == "target" else 0), 0.0, 20.0 * k, float(t))
              for t in range(8) for k in range(3) for side in ("source", "target")]
    part = pd.DataFrame(frames, columns=["side", "t", "node_id", "zu", "yu", "xu"])
    part["due"] = 1000 + (part["t"] + 1) * 100
    store = Store()
    cube = L.BlockLinker(5.0, 1000, 100)
    cube.init(store)
    assert list(cube.handleInputRows(("d",), iter([part]), None)) == []
    assert (store.calls, store.timers) == (2, [1100])
    # one timer closes all five frames that the watermark has passed, and the rest stay open
    out = pd.concat(cube.handleExpiredTimer(("d",), Watermark(1500), None))
    assert sorted(zip(out["t"], out["source_id"], out["target_id"])) == [(t, 10 * t + k, 10 * t + k + 10) for t in range(5) for k in range(3)]
    assert (store.calls, store.timers) == (5, [1100, 1600])
    again = pd.concat(cube.handleExpiredTimer(("d",), Watermark(9999), None))
    assert sorted(set(again["t"])) == [5, 6, 7] and np.all(again["d"] == 0.0)
    assert store.pieces == [] and list(cube.handleExpiredTimer(("d",), Watermark(9999), None)) == []


def test_steps_of_several_files_give_the_same_links(spark, monkeypatch):
    i = Inputs(spark, "/root/testdata/sf0.001")
    assert i.events.count() >= 200
    keys = ["dataset", "t", "source_id", "target_id"]
    _, links, batches = P._linked_in_batches(i, "plain")
    want = sorted(map(tuple, links.select(*keys).collect()))
    monkeypatch.setattr(P, "_FILE_EVENTS", i.events.count() // 3)
    source, _, files = P._split_files(i, "several")
    assert files == 3 and len(spark.read.parquet(source).inputFiles()) == 5 * files + 1
    _, links, more = P._linked_in_batches(i, "dealt")
    assert sorted(map(tuple, links.select(*keys).collect())) == want and want
    assert more == batches

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import topk as K


def brute(rows, every, k, scale=256.0):
    usable = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(scale * float(np.float32(x))) for x in v]
        usable[i] = min(usable.get(i, w), w)
    out = []
    for q, v in usable.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(512, 4096), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(K, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(K, "CANDIDATE_BLOCK", blocks[1])
    monkeypatch.setattr(K, "SAMPLE", 40)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(float).tolist(), 1) for i in range(150)]
    rows += [(150 + i, rows[i % 3][1], 1) for i in range(20)]                       # ties
    rows += [(170, None, 1), (171, [1.0, None], 1), (172, [float("nan")] * 8, 1), (None, [1.0] * 8, 1),
             (173, [float("inf")] * 8, 1), (174, [], 1), (175, [0.5, -0.5], 1), (0, [9.0] * 8, 1), (180, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    got = [tuple(r) for r in K.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()]
    assert sorted(got) == brute(rows, 10, 5)


def test_few_rows_and_large_values(spark):
    rows = [(0, [1e6, -3e6], 1), (1, [3e6, 2e6], 1), (2, [2e6, 2000001.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int")
    assert sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 2 == 0).collect()) == brute(rows, 2, 5)
    one = df.filter("vec_id = 0")
    assert K.top_k(one, F.col("vec_id") % 2 == 0).count() == 0
    assert K.top_k(df.filter("vec_id > 9"), F.col("vec_id") % 2 == 0).count() == 0


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16)) * 400
    rows = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(1200, 16)))
    pivots = K.choose_pivots(rows[:300], 12)
    far, norms, ids = K.distances(rows, pivots), np.sqrt((rows ** 2).sum(1)), np.arange(1200)
    for q in (0, 500, 1199):
        bounds = K.upper_bounds(norms[q], far[q], norms, far)
        assert (bounds >= rows @ rows[q]).all()
        _, tried = K.eliminate(q, rows[q], norms[q], far[q], ids, rows, norms, far, 5, -np.inf)
        assert tried < 1200

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import sharding as S


@pytest.mark.parametrize("rows,shards,block", [(1000, 24, 1_000_000), (1003, 7, 50), (5, 24, 10), (0, 3, 10)])
def test_exact_sizes_and_gapless_slots(spark, rows, shards, block):
    docs = spark.range(rows).repartition(5).withColumnRenamed("id", "doc_id").withColumn("slot", F.lit("clash"))
    got = S.shuffle_into_shards(docs, shards, seed=3, block_rows=block).collect()
    assert sorted(r.doc_id for r in got) == list(range(rows))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = sorted((len(v) for v in by.values()), reverse=True) + [0] * (shards - len(by))
    assert sum(sizes) == rows and sizes[0] - sizes[-1] <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_matrix_has_the_given_sums():
    sizes, columns = [7, 0, 100, 31, 62], [50, 50, 60, 40]
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    matrix = np.array([S.matrix_row(prefix, columns, k, 5) for k in range(len(sizes))])
    assert matrix.sum(1).tolist() == sizes and matrix.sum(0).tolist() == columns and matrix.min() >= 0


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = [S.hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    assert abs(np.mean(draws) - 6) < 0.05
    assert abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3
    big = S.hypergeometric(rng, 4 * 10 ** 9, 96 * 10 ** 9, 5 * 10 ** 10)
    assert abs(big - 2 * 10 ** 9) < 10 ** 6


def test_places_are_uniform(spark):
    """Over many seeds, every row lands in every shard about equally often."""
    docs = spark.range(12).coalesce(1)
    counts = collections.Counter()
    for seed in range(40):
        for r in S.shuffle_into_shards(docs, 3, seed=seed).collect():
            counts[(r.id, r.shard)] += 1
    expected = 40 / 3
    assert sum((counts[(i, s)] - expected) ** 2 / expected for i in range(12) for s in range(3)) < 60


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (1, None), (2, "b")], "doc_id long, text string")
    S.write_shards(docs, str(tmp_path / "out"), shards=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3

"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniformly random permutation, seen from blocks of its input and blocks of its output, is
a matrix of counts with fixed row and column sums (multivariate hypergeometric), a random
choice of which rows go where, and a random order inside each output block. All three are
drawn here in that order:

1. rows are numbered inside bounded source blocks (a written, slim table fixes the numbers,
   so that a lost executor draws the same again);
2. each source block works out its own row of the matrix. The matrix is defined by a binary
   tree over the source blocks: each node splits its column counts between its two halves by
   hypergeometric draws seeded with the node. A task walks from the root to its own leaf, so
   the matrix exists nowhere as a whole and nothing but the block sizes is shared;
3. a block permutes its rows, deals them out by its counts, the rows are exchanged, and each
   output block, at most ``block_rows`` long, is permuted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.common import settled


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` of ``good + bad``, by inversion around the mode."""
    least, most = max(0, draws - bad), min(draws, good)
    if least == most:
        return least
    n = good + bad
    mode = (draws + 1) * (good + 1) // (n + 2)
    spread = sqrt(draws / n * good * (bad / n) * max(n - draws, 1) / max(n - 1, 1))
    reach = int(12 * spread) + 40
    k = np.arange(max(least, mode - reach), min(most, mode + reach) + 1, dtype=np.float64)
    steps = (np.log(good - k[:-1]) + np.log(draws - k[:-1])
             - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(weights - weights.max()))
    return int(k[min(np.searchsorted(total, rng.random() * total[-1], side="right"), len(k) - 1)])


def split_counts(rng: np.random.Generator, columns: list[int], draws: int) -> list[int]:
    """Multivariate hypergeometric: how many of ``draws`` come from each column."""
    rest, out = sum(columns), []
    for c in columns:
        rest -= c
        x = hypergeometric(rng, c, rest, draws)
        out.append(x)
        draws -= x
    return out


def matrix_row(prefix: np.ndarray, columns: list[int], k: int, seed: int) -> list[int]:
    """Row ``k`` of the communication matrix; ``prefix`` are running sums of the row sums."""
    lo, hi = 0, len(prefix) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = split_counts(rng, columns, int(prefix[mid] - prefix[lo]))
        if k < mid:
            columns, hi = left, mid
        else:
            columns, lo = [a - b for a, b in zip(columns, left)], mid
    return columns


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 20240229,
                        block_rows: int = 1_000_000) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by at most one row. Null and repeated rows are rows like any other;
    an empty table gives an empty result; fewer rows than shards leave the last shards empty.
    Columns named ``shard`` or ``slot`` in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    index = F.col("_row").bitwiseAND((1 << 33) - 1)
    rows = settled(
        docs.withColumn("_row", F.monotonically_increasing_id()).withColumns({
            # source block: partition and a run of block_rows rows in it
            "_source": F.shiftright("_row", 33) * (1 << 20) + (index / block_rows).cast("long"),
            "_index": (index % block_rows).cast("long"),
        }).drop("_row"), "shards")
    sizes = sorted((r["_source"], r["count"]) for r in rows.groupBy("_source").count().collect())
    sources = np.array([s for s, _ in sizes], np.int64)
    prefix = np.concatenate([[0], np.cumsum([c for _, c in sizes], dtype=np.int64)]).astype(np.int64)
    n = int(prefix[-1])

    plan: list[tuple[int, int, int]] = []            # (shard, first slot, rows) of each output block
    for s in range(shards):
        size = n // shards + (s < n % shards)
        plan += [(s, at, min(block_rows, size - at)) for at in range(0, size, block_rows)]
    columns = [size for _, _, size in plan]

    @F.pandas_udf("block int, draw long")
    def deal(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=2)
        def dealt(source: int) -> tuple[np.ndarray, np.ndarray]:
            k = int(np.searchsorted(sources, source))
            rng = np.random.default_rng([seed, 1, k])
            blocks = np.repeat(np.arange(len(plan), dtype=np.int32), matrix_row(prefix, columns, k, seed))
            return rng.permutation(blocks), rng.integers(0, 1 << 62, len(blocks))

        for source, at in parts:
            block, draw = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for s in source.unique():
                mine = (source == s).to_numpy()
                b, d = dealt(int(s))
                block[mine], draw[mine] = b[at[mine]], d[at[mine]]
            yield pd.DataFrame({"block": block, "draw": draw})

    blocks = spark.createDataFrame([(i, s, at) for i, (s, at, _) in enumerate(plan)],
                                   "_block int, shard int, _first long")
    dealt = rows.withColumn("_to", deal("_source", "_index"))
    order = Window.partitionBy("_block").orderBy("_draw", "_source", "_index")
    return (
        dealt.withColumns({"_block": F.col("_to.block"), "_draw": F.col("_to.draw")})
        .withColumn("_rank", F.row_number().over(order))
        .join(F.broadcast(blocks) if len(plan) <= 100_000 else blocks, "_block")
        .withColumn("slot", F.col("_first") + F.col("_rank") - 1)
        .select(*docs.columns, "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 20240229) -> None:
    """The shuffled rows as Parquet, one folder per shard, in slot order inside each file."""
    (shuffle_into_shards(docs, shards, seed).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))

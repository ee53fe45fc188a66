"""Exact top-k by inner product with pivot-table elimination.

Every vector keeps its distances to ``PIVOTS`` fixed vectors. By the triangle inequality the
largest difference of two vectors' pivot distances is a lower bound of their distance, and
so an upper bound of their inner product: (|q|^2 + |c|^2 - bound^2) / 2. Candidates are
evaluated in the order of their bounds until no bound can reach the k-th best score.

Queries and candidates are packed into blocks of bounded size. A first score to beat comes
from a bounded sample of candidates; in a pair of blocks only those queries go on whose
bound against the whole block (from its range of pivot distances and its largest norm) can
reach it. Arithmetic is on integers held in doubles: exact while
|q| * |c| < 2**53, beyond that in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.common import settled

PIVOTS = 32
#: Rows (of least hash) that pivots and first scores are taken from.
SAMPLE = 2048
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
EXACT = 2.0 ** 53


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector.

    Not usable: null ids and vectors, vectors with null or non-finite components (or ones that
    are not finite once scaled). Rows that share an id count once, with the smallest vector.
    """
    x = F.transform(F.col(vector_col), lambda e: e.cast("double") * scale)
    whole = (vectors.select(F.col(id_col).alias("vec_id"), x.alias("v"))
             .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
             .filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))))
    return (whole.groupBy("vec_id").agg(F.min("v").alias("v"))
            .withColumn("v", F.transform("v", lambda e: F.floor(e).cast("double"))))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows, each the farthest from those before it."""
    if not len(sample):
        return sample
    picked = [int(np.argmax((sample ** 2).sum(1)))]
    far = np.full(len(sample), np.inf)
    while len(picked) < n:
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
        if not far.max() > 0:
            break
        picked.append(int(np.argmax(far)))
    return sample[picked]


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((a - p) ** 2).sum(1))
    return out


def upper_bounds(q_norm, q_far, norms, far) -> np.ndarray:
    """Upper bounds of the inner products of one query, with slack for rounding."""
    gap = np.abs(far - q_far).max(1) if far.shape[1] else np.zeros(len(far))
    bound = (q_norm ** 2 + norms ** 2 - gap ** 2) / 2
    return bound + 1 + 1e-9 * (q_norm ** 2 + norms ** 2)


def inner(q: np.ndarray, rows: np.ndarray, large: bool) -> list[int] | np.ndarray:
    if large:
        return np.array([sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows], object)
    return rows @ q


def eliminate(q_id: int, q: np.ndarray, q_norm: float, q_far: np.ndarray, ids: np.ndarray, rows: np.ndarray,
              norms: np.ndarray, far: np.ndarray, k: int, least: float) -> tuple[list[tuple[int, int]], int]:
    """([(score, id)] of the best ``k`` in a block that reach ``least``, rows evaluated)."""
    bounds = upper_bounds(q_norm, q_far, norms, far)
    order = np.argsort(-bounds, kind="stable")
    order = order[ids[order] != q_id]
    large = q_norm * (norms.max() if len(norms) else 0) >= EXACT
    best: list[tuple[int, int]] = []
    at, step = 0, 64
    while at < len(order):
        floor = max(least, -best[k - 1][0]) if len(best) >= k else least
        take = order[at:at + step]
        take = take[bounds[take] >= floor]
        if not len(take):
            break
        scores = inner(q, rows[take], large)
        best = sorted(best + [(-int(s), int(i)) for s, i in zip(scores, ids[take]) if s >= floor])[:k]
        at, step = at + step, step * 2
    return [(-s, i) for s, i in best], at


PACKED = "vec_id binary, v binary, norm binary, far binary, low binary, high binary, most double, rows int"


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows other than itself.

    ``is_query`` is a condition on ``vec_id``. Vectors of different length are compared as if
    the shorter ended in zeros. Ties go to the smaller id; with fewer than ``k`` other rows all
    are returned; scores beyond 64 bits are held at the limit. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = settled(integer_vectors(vectors, scale, id_col, vector_col), "vectors")
    sized = rows.agg(F.max(F.size("v")).alias("w"), F.count(F.when(is_query, 1)).alias("q")).first()
    width, n_queries = sized["w"] or 0, sized["q"] or 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample_ids = np.array([r["vec_id"] for r in sample], np.int64)
    sample_rows = _matrix([r["v"] for r in sample], width)
    pivots = choose_pivots(sample_rows[:SAMPLE // 2], PIVOTS)
    model = spark.sparkContext.broadcast((sample_ids, sample_rows, np.sqrt((sample_rows ** 2).sum(1)), pivots))
    blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def packed(ids, m, norms, far):
        return (ids.tobytes(), m.tobytes(), norms.tobytes(), far.tobytes(), far.min(0).tobytes(),
                far.max(0).tobytes(), float(norms.max()), len(ids))

    def pack(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = model.value[3]
            ids, held = [], []

            def out(ids, held):
                m = _matrix(held, width)
                far = distances(m, pivots)
                # rows near the same pivot stay together, so that blocks have narrow ranges
                order = np.argsort(far.argmin(1), kind="stable")
                ids, m, far = np.array(ids, np.int64)[order], m[order], far[order]
                norms = np.sqrt((m ** 2).sum(1))
                cells = [packed(ids[a:a + most], m[a:a + most], norms[a:a + most], far[a:a + most])
                         for a in range(0, len(ids), most)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*cells), [pa.binary()] * 6 + [pa.float64(), pa.int32()])],
                    ["vec_id", "v", "norm", "far", "low", "high", "most", "rows"])

            for batch in batches:
                ids += batch.column(0).to_pylist()
                held += batch.column(1).to_pylist()
                if len(ids) >= 8 * most:
                    yield out(ids, held)
                    ids, held = [], []
            if ids:
                yield out(ids, held)
        return run

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_ids, s_rows, s_norms, pivots = model.value
        s_far = distances(s_rows, pivots)
        for batch in batches:
            for r in batch.to_pylist():
                ids, m, norms, far = unpacked(r)
                least = []
                for i in range(len(ids)):
                    found, _ = eliminate(int(ids[i]), m[i], norms[i], far[i], s_ids, s_rows, s_norms, s_far, k, -np.inf)
                    # rounded down, so that no tie of a large score is lost
                    least.append(np.nextafter(float(found[k - 1][0]), -np.inf) if len(found) == k else -np.inf)
                yield pa.RecordBatch.from_pydict({
                    **{c: [r[c]] for c in ("vec_id", "v", "norm", "far")}, "least": [np.array(least).tobytes()]})

    def unpacked(r) -> tuple[np.ndarray, ...]:
        ids = np.frombuffer(r["vec_id"], np.int64)
        return (ids, np.frombuffer(r["v"]).reshape(len(ids), -1), np.frombuffer(r["norm"]),
                np.frombuffer(r["far"]).reshape(len(ids), -1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_rows, q_norms, q_far = unpacked({c: r[f"q_{c}"] for c in ("vec_id", "v", "norm", "far")})
                least = np.frombuffer(r["least"])
                low, high = np.frombuffer(r["low"]), np.frombuffer(r["high"])
                gap = np.maximum(np.maximum(low - q_far, q_far - high), 0).max(1) if len(low) else np.zeros(len(q_ids))
                reach = (q_norms ** 2 + r["most"] ** 2 - gap ** 2) / 2 + 1 + 1e-9 * (q_norms ** 2 + r["most"] ** 2)
                ids, m, norms, far = unpacked(r)
                out: list[tuple[int, int, int, int]] = []
                for i in np.flatnonzero(reach >= least):
                    found, tried = eliminate(int(q_ids[i]), q_rows[i], q_norms[i], q_far[i], ids, m, norms, far, k, least[i])
                    out += [(int(q_ids[i]), c, min(max(s, -2 ** 63), 2 ** 63 - 1), tried) for s, c in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 4,
                                                 ["query_id", "vec_id", "score", "tried"])

    queries = (rows.filter(is_query).repartition(blocks).mapInArrow(pack(QUERY_BLOCK), PACKED)
               .mapInArrow(first_scores, "vec_id binary, v binary, norm binary, far binary, least binary"))
    queries = settled(queries.withColumn("block", F.spark_partition_id())
                      .withColumnsRenamed({c: f"q_{c}" for c in ("vec_id", "v", "norm", "far")}), "query-blocks")
    candidates = rows.mapInArrow(pack(CANDIDATE_BLOCK), PACKED)
    # the stated queries against all rows, block by block: every candidate block meets every query block
    pairs = (candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .join(queries, "block").drop("block"))
    found = pairs.mapInArrow(compare, "query_id long, vec_id long, score long, tried long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

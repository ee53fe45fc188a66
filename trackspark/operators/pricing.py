"""Full assignment of frames of any size: candidates are added only where prices call for them.

The smaller side of a frame pair is assigned as a whole at least total distance, though only
near pairs are ever looked at. Each round solves the assignment over the candidates known so
far; a member of the smaller side may also stay out at the price of a limit. The solution's
dual prices say which other pairs could improve it: those closer than the sum of both ends'
prices. A join within each point's own price finds the worst of them, they become candidates,
and the frame is solved again. Without such a pair the solution is the optimum over all pairs
up to the limit, and if nobody stayed out it is the optimum over all pairs whatsoever: every
full assignment could have been chosen at its own cost. Otherwise the limit doubles; beyond the
extent of a frame nobody stays out while a partner is free.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators.graph import connected_components
from trackspark.operators.spatial import as_sources, ball_join, next_frame
from trackspark.session import cut_lineage, discard, is_empty

#: Candidates a point gains a round at most; what is left over is found by the next round.
GAIN = 8
#: A frame with more candidates is solved by the connected components of its candidates.
TASK_PAIRS = 4_000_000
#: Pairs must improve on the prices by more than this, in micrometres.
SLACK = 1e-9

_FRAME = ["dataset", "t"]
_SOLVED = "dataset string, t bigint, side int, id bigint, partner bigint, price double"


def sparse_assignment(row: np.ndarray, col: np.ndarray, cost: np.ndarray,
                      limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row or -1, row prices, column prices) of least total cost.

    Rows and columns are numbered from 0 without gaps; a row may stay out at the cost of ``limit``.
    Memory is that of the candidates: shortest augmenting paths over lists, not over a matrix.
    Prices satisfy u + v <= cost on every candidate, with equality on chosen ones, u <= limit,
    v <= 0, and v = 0 for columns left over.
    """
    n = int(row.max()) + 1 if len(row) else 0
    m = int(col.max()) + 1 if len(col) else 0
    order = np.lexsort((col, cost, row))
    order = order[cost[order] < limit]
    ends, costs = col[order].tolist(), cost[order].tolist()
    first = np.searchsorted(row[order], np.arange(n + 1)).tolist()
    u = [min(costs[first[r]], limit) if first[r] < first[r + 1] else limit for r in range(n)]
    v = [0.0] * m
    # the place to stay out is a column of the row's own, m + row
    col_of, row_of = [-1] * n, [-1] * m
    for r in range(n):
        if first[r] == first[r + 1]:
            col_of[r] = m + r
        elif row_of[ends[first[r]]] < 0:
            col_of[r], row_of[ends[first[r]]] = ends[first[r]], r
    for start in range(n):
        if col_of[start] >= 0:
            continue
        reach, via, settled, heap = {}, {}, set(), []
        r, at = start, 0.0
        while True:
            lift = at - u[r]
            for k in range(first[r], first[r + 1]):
                c = ends[k]
                to = lift + costs[k] - v[c]
                if c not in settled and to < reach.get(c, np.inf):
                    reach[c], via[c] = to, r
                    heapq.heappush(heap, (to, c))
            own = m + r
            reach[own], via[own] = lift + limit, r
            heapq.heappush(heap, (reach[own], own))
            at, c = heapq.heappop(heap)
            while at > reach[c]:
                at, c = heapq.heappop(heap)
            if c >= m or row_of[c] < 0:
                break
            settled.add(c)
            r = row_of[c]
        for s in settled:
            v[s] -= at - reach[s]
            u[row_of[s]] += at - reach[s]
        u[start] += at
        while True:
            r = via[c]
            before = col_of[r]
            col_of[r] = c
            if c < m:
                row_of[c] = r
            if r == start:
                break
            c = before
    found = np.array([c if c < m else -1 for c in col_of], dtype=np.int64)
    return found, np.array(u), np.array(v)


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    rows, row = np.unique(pdf["row_id"].to_numpy(), return_inverse=True)
    cols, col = np.unique(pdf["col_id"].to_numpy(), return_inverse=True)
    found, u, v = sparse_assignment(row, col, pdf["d"].to_numpy(float), float(pdf["limit"].iloc[0]))
    taken = np.flatnonzero(found >= 0)
    partner = pd.array(np.full(len(rows) + len(cols), None), dtype="Int64")
    partner[taken] = cols[found[taken]]
    return pd.DataFrame({
        "dataset": pdf["dataset"].iloc[0], "t": pdf["t"].iloc[0],
        "side": np.repeat([0, 1], [len(rows), len(cols)]), "id": np.concatenate([rows, cols]),
        "partner": partner, "price": np.concatenate([u, v])})


def _solved(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows of ``_SOLVED`` for all ends of the candidates of ``frames``."""
    pairs = pairs.join(frames.select(*_FRAME, "limit"), _FRAME)
    large = (pairs.groupBy(*_FRAME).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TASK_PAIRS)
             .select(*_FRAME))
    if is_empty(large):
        return pairs.groupBy(*_FRAME).applyInPandas(_solve, _SOLVED)
    large = cut_lineage(large, "large")
    small = pairs.join(large, _FRAME, "left_anti").groupBy(*_FRAME).applyInPandas(_solve, _SOLVED)
    big = cut_lineage(pairs.join(large, _FRAME, "left_semi"), "large")
    links = big.select(*_FRAME, (F.col("row_id") * 2).alias("_a"), (F.col("col_id") * 2 + 1).alias("_b"))
    ends = links.select(*_FRAME, F.explode(F.array("_a", "_b")).alias("_e")).distinct()
    parts = connected_components(ends, links, _FRAME, "_e", "_a", "_b")
    tagged = big.withColumn("_e", F.col("row_id") * 2).join(parts, [*_FRAME, "_e"]).drop("_e")
    return small.unionByName(tagged.groupBy(*_FRAME, "component").applyInPandas(_solve, _SOLVED))


def _violated(rows: DataFrame, cols: DataFrame, solved: DataFrame | None, frames: DataFrame,
              base: float) -> DataFrame:
    """Pairs closer than the prices of both ends, the worst ``GAIN`` of every row."""
    rows, cols = rows.join(frames.select(*_FRAME, "limit"), _FRAME), cols.join(frames.select(*_FRAME), _FRAME, "left_semi")
    if solved is None:
        rows, cols = rows.withColumn("u", F.col("limit")), cols.withColumn("v", F.lit(0.0))
    else:
        price = {side: solved.where(F.col("side") == side).select(
            *_FRAME, F.col("id").alias(name), F.col("price").alias(p))
            for side, name, p in ((0, "row_id", "u"), (1, "col_id", "v"))}
        # a row without candidates stays out at the limit, an unseen column costs nothing
        rows = rows.join(price[0], [*_FRAME, "row_id"], "left").withColumn("u", F.coalesce("u", "limit"))
        cols = cols.join(price[1], [*_FRAME, "col_id"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    near = (ball_join(rows.drop("limit"), cols, "u", _FRAME, base)
            .withColumn("_gain", F.col("u") + F.col("v") - F.col("d")).where(F.col("_gain") > SLACK))
    worst = Window.partitionBy(*_FRAME, "row_id").orderBy(F.col("_gain").desc(), "col_id")
    return (near.withColumn("_r", F.row_number().over(worst)).where(F.col("_r") <= GAIN)
            .select(*_FRAME, "row_id", "col_id", "d"))


def _sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members of the smaller side, of the larger side, frame pairs with ``swapped``)."""
    placed = nodes
    for c in "zyx":
        placed = placed.where(F.coalesce(F.abs(F.col(f"{c}u")) < float("inf"), F.lit(False)))
    a = as_sources(placed).select(*_FRAME, F.col("source_id").alias("id"), "zu", "yu", "xu")
    b = next_frame(placed).select(*_FRAME, F.col("target_id").alias("id"), "zu", "yu", "xu")
    na, nb = (s.groupBy(*_FRAME).agg(F.count(F.lit(1)).alias(n)) for s, n in ((a, "na"), (b, "nb")))
    frames = na.join(nb, _FRAME).select(*_FRAME, (F.col("na") > F.col("nb")).alias("swapped"))
    both = (a.withColumn("later", F.lit(False)).unionByName(b.withColumn("later", F.lit(True)))
            .join(frames, _FRAME))
    small, large = both.where("later = swapped"), both.where("later <> swapped")
    keep = [*_FRAME, "id", "zu", "yu", "xu"]
    return (small.select(*keep).withColumnRenamed("id", "row_id"),
            large.select(*keep).withColumnRenamed("id", "col_id"), frames)


def link_priced(nodes: DataFrame, radius: float) -> DataFrame:
    """Optimal links of consecutive frames: dataset, t, source_id, target_id, d.

    The smaller frame is assigned as a whole at least total distance, far pairs included, and
    links longer than ``radius`` are dropped afterwards: the result of ``link_optimal(mode="full")``
    at a memory that grows with the candidates instead of with the product of both frames. Of
    several optima any may come. ``nodes`` carries ``dataset, t, node_id, zu, yu, xu``; points
    without a finite position take no part, empty tables give an empty result.
    """
    start = float(radius)
    if not 0 < start < float("inf"):
        raise ValueError(f"radius {radius!r}: a positive length")
    rows, cols, frames = (cut_lineage(x, "sides") for x in _sides(nodes))
    swapped = frames
    frames = frames.select(*_FRAME, F.lit(start).alias("limit"))
    pairs = cut_lineage(_violated(rows, cols, None, frames, start / 4), "candidates")
    finished: list[DataFrame] = []
    while not is_empty(frames):
        solved = cut_lineage(_solved(pairs, frames), "solved")
        more = cut_lineage(_violated(rows, cols, solved, frames, start / 4), "violated")
        out = (rows.join(solved.where("side = 0 AND partner IS NOT NULL").select(*_FRAME, F.col("id").alias("row_id")),
                         [*_FRAME, "row_id"], "left_anti").select(*_FRAME).distinct().withColumn("_out", F.lit(True)))
        state = cut_lineage(
            frames.join(more.select(*_FRAME).distinct().withColumn("_more", F.lit(True)), _FRAME, "left")
            .join(out, _FRAME, "left").na.fill(False, ["_more", "_out"]), "state")
        done = state.where("NOT _more AND NOT _out").select(*_FRAME)
        finished.append(cut_lineage(
            solved.where("side = 0").join(done, _FRAME, "left_semi")
            .select(*_FRAME, F.col("id").alias("row_id"), F.col("partner").alias("col_id")), "finished"))
        after = cut_lineage(state.where("_more OR _out").select(
            *_FRAME, F.when(F.col("_more"), F.col("limit")).otherwise(F.col("limit") * 2).alias("limit")), "frames")
        left = cut_lineage(pairs.unionByName(more).join(after.select(*_FRAME), _FRAME, "left_semi"), "candidates")
        discard(solved, more, state, pairs, frames)
        pairs, frames = left, after
    schema = "dataset string, t bigint, row_id bigint, col_id bigint"
    links = nodes.sparkSession.createDataFrame([], schema)
    for part in finished:
        links = links.unionByName(part)
    ends = links.join(swapped, _FRAME).select(
        *_FRAME, F.when(F.col("swapped"), F.col("col_id")).otherwise(F.col("row_id")).alias("source_id"),
        F.when(F.col("swapped"), F.col("row_id")).otherwise(F.col("col_id")).alias("target_id"))
    return _measured(ends, nodes).where(F.col("d") <= F.lit(start))


def _measured(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the distance of their ends."""
    spot = {side: nodes.select("dataset", F.col("node_id").alias(f"{side}_id"),
                               *[F.col(f"{c}u").alias(f"_{side[0]}{c}") for c in "zyx"])
            for side in ("source", "target")}
    gap = [F.col(f"_s{c}") - F.col(f"_t{c}") for c in "zyx"]
    return (ends.join(spot["source"], ["dataset", "source_id"]).join(spot["target"], ["dataset", "target_id"])
            .select(*_FRAME, "source_id", "target_id", F.sqrt(sum((g * g for g in gap), F.lit(0.0))).alias("d")))

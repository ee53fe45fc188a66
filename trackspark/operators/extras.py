"""Checks described alongside the pipeline: frozen frames, merged detectors, motion residuals."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import norm3, with_um
from trackspark.operators.edges import with_endpoints
from trackspark.operators.grouped import STEP_CELLS, TASK_CELLS, crowded, distances, within
from trackspark.operators.ordering import exact_percentiles, rank_rows
from trackspark.operators.spatial import range_join
from trackspark.schema import DEFAULT_SCALE
from trackspark.session import cut_lineage, is_empty

PAIR = ["dataset", "t"]


def leaderboard_summary(scores: DataFrame, column: str, threshold: float) -> DataFrame:
    """Scored teams, top and median score, and how many reach ``threshold``."""
    parsed = scores.select(F.col(column).try_cast("double").alias("s")).where("s IS NOT NULL")
    basics = parsed.agg(F.count("s").alias("teams"), F.max("s").alias("top"),
                        F.count_if(F.col("s") >= threshold).alias("above"))
    median = exact_percentiles(parsed, [], "s", {"median": 0.5}).scalar()
    return basics.withColumn("median", median)


def frozen_frames(voxels: DataFrame, by: str = "dataset") -> DataFrame:
    """Frames identical to the one before them, per ``by``.

    Frames are compared by an order-free digest of (position, value) hashes, so a frame
    is reduced by partial sums and never gathered. Two independent hashes and the
    voxel count must agree.
    """
    cell = ["z", "y", "x", "v"]
    digest = voxels.groupBy(by, "t").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.xxhash64(*cell) % 2_147_483_647).alias("_a"),
        F.sum(F.xxhash64(F.lit(7), *cell) % 2_147_483_629).alias("_b"))
    numbered = cut_lineage(rank_rows(digest, [by], ["t"], "_k"), "frames")
    before = numbered.select(by, (F.col("_k") + 1).alias("_k"), F.struct("_n", "_a", "_b").alias("_before"))
    same = F.struct("_n", "_a", "_b") == F.col("_before")
    return (numbered.join(before, [by, "_k"], "left").groupBy(by)
            .agg(F.count_if(F.coalesce(same, F.lit(False))).alias("frozen"), F.count(F.lit(1)).alias("frames")))


def merge_detections(detections: DataFrame, radius_um: float) -> DataFrame:
    """Union of detections with weaker ones within ``radius_um`` of a kept stronger one removed.

    Rounds keep every detection that beats all its remaining neighbours and drop what it
    covers, which equals going through all of them by falling score.
    """
    rows = detections.select("dataset", "t", "node_id", "score", "zu", "yu", "xu")
    other = rows.select("dataset", "t", F.col("node_id").alias("other_id"), F.col("score").alias("other"),
                        "zu", "yu", "xu")
    pairs = cut_lineage(
        range_join(rows, other, radius_um, ["dataset", "t"]).where(F.col("node_id") != F.col("other_id"))
        .select("dataset", "node_id", "other_id",
                ((F.col("other") > F.col("score")) | ((F.col("other") == F.col("score"))
                 & (F.col("other_id") < F.col("node_id")))).alias("loses")), "near")
    live = cut_lineage(rows.select("dataset", "node_id"), "live")
    kept = None
    while True:
        beaten = pairs.where("loses").select("dataset", "node_id").distinct()
        now = cut_lineage(live.join(beaten, ["dataset", "node_id"], "left_anti"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        covered = pairs.join(now.withColumnsRenamed({"node_id": "other_id"}), ["dataset", "other_id"], "left_semi")
        gone = cut_lineage(now.unionByName(covered.select("dataset", "node_id")).distinct(), "gone")
        live = cut_lineage(live.join(gone, ["dataset", "node_id"], "left_anti"), "live")
        if is_empty(live):
            return detections.join(kept, ["dataset", "node_id"], "left_semi")
        pairs = cut_lineage(
            pairs.join(gone, ["dataset", "node_id"], "left_anti")
            .join(gone.withColumnsRenamed({"node_id": "other_id"}), ["dataset", "other_id"], "left_anti"), "near")


def _steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = with_endpoints(edges, nodes, ("t", "z", "y", "x"))
    return ends.select("dataset", "edge_id", F.col("s_t").alias("t"),
                       *[F.col(f"s_{a}").alias(a) for a in "zyx"],
                       *[(F.col(f"d_{a}") - F.col(f"s_{a}")).alias(f"d{a}") for a in "zyx"])


def bulk_motion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Median step per frame and axis (voxels)."""
    steps = cut_lineage(_steps(nodes, edges), "steps")
    out = None
    for a in "zyx":
        part = exact_percentiles(steps, ["dataset", "t"], f"d{a}", {f"m{a}": 0.5})
        out = part if out is None else out.join(part, ["dataset", "t"])
    return out


def without_bulk_motion(nodes: DataFrame, motion: DataFrame) -> DataFrame:
    """Nodes moved by their frame's median step, ready to be linked to the next frame."""
    return nodes.join(motion, ["dataset", "t"], "left").select(
        *[(F.col(c) + F.coalesce(f"m{c}", F.lit(0.0))).alias(c) if c in "zyx" else F.col(c)
          for c in nodes.columns])


def motion_residuals(nodes: DataFrame, edges: DataFrame, radius_um: float) -> DataFrame:
    """How far each step differs from the median step of the steps starting nearby (µm).

    A frame whose distances fit a task has its medians taken there, from its steps; only larger
    frames go through a table of pairs.
    """
    steps = cut_lineage(with_um(_steps(nodes, edges)), "steps")
    placed = steps.where("zu IS NOT NULL AND yu IS NOT NULL AND xu IS NOT NULL")
    large = crowded(placed, placed, PAIR, TASK_CELLS)
    small = placed if large is None else placed.join(large, PAIR, "left_anti")
    columns = ["dataset", "edge_id", "dz", "dy", "dx", "mz", "my", "mx"]
    out = within(small, PAIR, ["edge_id", "zu", "yu", "xu", "dz", "dy", "dx"],
                 f"edge_id {dict(steps.dtypes)['edge_id']}, " + ", ".join(f"{c} double" for c in columns[2:]),
                 partial(_nearby_medians, radius_um)).select(*columns)
    if large is not None:
        out = out.unionByName(_joined_medians(placed.join(large, PAIR, "left_semi"), radius_um).select(*columns))
    return out.withColumn("residual", norm3(*[
        (F.col(f"d{a}") - F.col(f"m{a}")) * F.lit(s) for a, s in zip("zyx", DEFAULT_SCALE)]))


def _nearby_medians(radius_um: float, ids: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Steps that have others nearby, with the medians of those: edge_id, dz, dy, dx, mz, my, mx."""
    places, moves, parts = columns[:3], columns[3:], []
    step = max(1, STEP_CELLS // len(ids))
    for k in range(0, len(ids), step):
        near = distances([p[k:k + step] for p in places], places) <= radius_um
        near &= ids[k:k + step, None] != ids[None, :]
        medians = []
        for move in moves:
            # a step without this value is nobody's neighbour along this axis
            known = near & ~np.isnan(move)
            values = np.sort(np.where(known, move, np.inf), axis=1)
            n = known.sum(1)
            place = 0.5 * np.maximum(n - 1, 0)
            low, high = (values[np.arange(len(n)), end(place).astype(np.int64)] for end in (np.floor, np.ceil))
            low, high = np.where(n > 0, [low, high], np.nan)
            medians.append(low + (high - low) * (place - np.floor(place)))
        kept = ~np.isnan(medians).any(0)
        parts.append([x[kept] for x in (ids[k:k + step], *[m[k:k + step] for m in moves], *medians)])
    return [np.concatenate(x) for x in zip(*parts)]


def _joined_medians(placed: DataFrame, radius_um: float) -> DataFrame:
    left = placed.select("dataset", "t", "edge_id", "zu", "yu", "xu")
    right = placed.select("dataset", "t", F.col("edge_id").alias("other_id"), "zu", "yu", "xu", "dz", "dy", "dx")
    near = cut_lineage(range_join(left, right, radius_um, ["dataset", "t"])
                       .where(F.col("edge_id") != F.col("other_id"))
                       .select("dataset", "edge_id", "dz", "dy", "dx"), "near")
    out = placed.select("dataset", "edge_id", "dz", "dy", "dx")
    for a in "zyx":
        out = out.join(exact_percentiles(near, ["dataset", "edge_id"], f"d{a}", {f"m{a}": 0.5}), ["dataset", "edge_id"])
    return out

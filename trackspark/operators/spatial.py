"""Range and nearest-neighbour joins on a bucketed grid.

Spark has no range join, so a distance predicate alone would plan a nested loop. Each
left point is hashed to one cell of side ``2 r``; each right point is replicated to the
(about eight) cells its ball touches. The join is then an equi-join on the cell and
every qualifying pair meets in exactly one cell, so no de-duplication follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.geometry import norm3
from trackspark.operators.grouped import STEP_CELLS, TASK_CELLS, crowded, distances, within
from trackspark.session import cut_lineage, discard, is_empty

# A bucket with more distinct points than this is searched on a finer grid first.
CROWDED_BUCKET = 4096
_CELL = ["_cz", "_cy", "_cx"]


def _cells(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({
        f"_c{a}": F.floor(F.col(f"{a}u") / F.lit(side)) for a in "zyx"})


def _spread(df: DataFrame, radius: float, side: float) -> DataFrame:
    for a in "zyx":
        low = F.floor((F.col(f"{a}u") - F.lit(radius)) / F.lit(side))
        high = F.floor((F.col(f"{a}u") + F.lit(radius)) / F.lit(side))
        df = df.withColumn(f"_c{a}", F.explode(F.sequence(low, high)))
    return df


def range_join(left: DataFrame, right: DataFrame, radius: float, on: list[str],
               strict: bool = False) -> DataFrame:
    """All pairs within ``radius`` µm that share the ``on`` columns.

    Both sides carry ``on`` and ``zu, yu, xu``; other columns must not clash. The
    output keeps the other columns of both sides and adds ``d``; the point columns come
    back prefixed ``l_`` and ``r_``.
    """
    side = 2.0 * radius
    rename_l = {f"{a}u": f"l_{a}u" for a in "zyx"}
    rename_r = {f"{a}u": f"r_{a}u" for a in "zyx"}
    a = _cells(left, side).withColumnsRenamed(rename_l)
    b = _spread(right, radius, side).withColumnsRenamed(rename_r)
    d = norm3(*[F.col(f"l_{c}u") - F.col(f"r_{c}u") for c in "zyx"])
    # Size estimates do not see the replication, so a broadcast here would be a guess;
    # a sort-merge join spills, splits hot cells under AQE, and runs on every core.
    pairs = a.hint("merge").join(b.hint("merge"), [*on, *_CELL]).withColumn("d", d).drop(*_CELL)
    return pairs.where(F.col("d") < radius if strict else F.col("d") <= radius)


def ball_join(left: DataFrame, right: DataFrame, reach: str, on: list[str], base: float) -> DataFrame:
    """All pairs that share ``on`` and lie within the left point's own radius, column ``reach``.

    A left point belongs to the least of the radii ``base``, 2 ``base``, 4 ``base``, ... that holds
    its own, and that radius is part of the join key with the cell. A right point is spread once for
    every such radius that occurs in its group, so points with small balls keep small cells however
    large the balls of others are. Left points without a positive finite radius pair with nothing.
    """
    step = F.greatest(F.lit(0.0), F.ceil(F.log2(F.col(reach) / F.lit(base))).cast("double"))
    a = (left.where((F.col(reach) > 0) & (F.col(reach) < float("inf")))
         .withColumn("_ball", F.lit(base) * F.pow(F.lit(2.0), step)))
    b = right.join(a.select(*on, "_ball").distinct(), on)
    for c in "zyx":
        edge = F.col("_ball") * 2.0
        a = a.withColumn(f"_c{c}", F.floor(F.col(f"{c}u") / edge))
        b = b.withColumn(f"_c{c}", F.explode(F.sequence(
            F.floor((F.col(f"{c}u") - F.col("_ball")) / edge),
            F.floor((F.col(f"{c}u") + F.col("_ball")) / edge))))
    a = a.withColumnsRenamed({f"{c}u": f"l_{c}u" for c in "zyx"})
    b = b.withColumnsRenamed({f"{c}u": f"r_{c}u" for c in "zyx"})
    d = norm3(*[F.col(f"l_{c}u") - F.col(f"r_{c}u") for c in "zyx"])
    return (a.hint("merge").join(b.hint("merge"), [*on, "_ball", *_CELL]).withColumn("d", d)
            .where(F.col("d") <= F.col(reach)).drop("_ball", *_CELL))


def _crowding(points: DataFrame, side: float, on: list[str]) -> int:
    row = (_cells(points, side).groupBy(*on, *_CELL).count()
           .agg(F.max("count").alias("m")).first())
    return row["m"] or 0


def nearest_join(left: DataFrame, right: DataFrame, radius: float, on: list[str],
                 left_id: str, right_id: str, strict: bool = True) -> DataFrame:
    """The nearest right point within ``radius`` of each left point: on, left_id, right_id, d.

    Ties go to the lowest ``right_id``. Copies at one position are collapsed on both
    sides before the join, so they cost one row each. Where a bucket is still crowded
    the search starts on finer grids: a neighbour found within a smaller ball is final,
    and only points without one move on to the next size.
    """
    spot = ["zu", "yu", "xu"]
    targets = right.groupBy(*on, *spot).agg(F.min(right_id).alias(right_id))
    queries = left.select(*on, *spot).distinct()

    radii = [radius]
    crowd = _crowding(right, 2 * radius, on)
    if crowd > CROWDED_BUCKET:
        crowd = _crowding(targets, 2 * radius, on)
    while crowd > CROWDED_BUCKET and len(radii) < 12:
        radii.insert(0, radii[0] / 2)
        crowd = _crowding(targets, 2 * radii[0], on)

    found, waiting = None, queries
    for step, r in enumerate(radii):
        last = step == len(radii) - 1
        pairs = range_join(waiting, targets, r, on, strict=strict if last else False)
        best = (pairs.withColumnsRenamed({f"l_{a}u": f"{a}u" for a in "zyx"})
                .groupBy(*on, *spot)
                .agg(F.min(F.struct("d", right_id)).alias("_best")))
        if not last:
            best = cut_lineage(best, "nearest")
            waiting = waiting.join(best, [*on, *spot], "left_anti")
        found = best if found is None else found.unionByName(best)
    return (left.select(*on, left_id, *spot).join(found, [*on, *spot])
            .select(*on, left_id, F.col(f"_best.{right_id}").alias(right_id),
                    F.col("_best.d").alias("d")))


def _typical_spacing(points: DataFrame, on: list[str]) -> tuple[float, float]:
    """(edge length of the mean volume per point, largest bounding-box diagonal)."""
    boxes = points.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.max(f"{a}u") - F.min(f"{a}u")).alias(f"w{a}") for a in "zyx"])
    volume = F.greatest("wz", F.lit(1.0)) * F.greatest("wy", F.lit(1.0)) * F.greatest("wx", F.lit(1.0))
    row = boxes.agg(
        F.pow(F.sum(volume) / F.sum("n"), F.lit(1.0 / 3.0)).alias("spacing"),
        F.max(norm3(F.col("wz"), F.col("wy"), F.col("wx"))).alias("extent")).first()
    return (row["spacing"] or 1.0, row["extent"] or 0.0)


def nearest_k(left: DataFrame, right: DataFrame, k: int, on: list[str], left_id: str,
              right_id: str, skip_self: bool = False) -> DataFrame:
    """The ``k`` nearest right points of each left point, at any distance.

    Output: on, left_id, right_id, d, rank. The search radius starts near the typical
    spacing and doubles; a point is settled once its ball holds ``k`` neighbours, and
    the last radius covers every frame, so nothing is left out.
    """
    spacing, extent_r = _typical_spacing(right, on)
    _, extent = _typical_spacing(
        right.select(*on, "zu", "yu", "xu").unionByName(left.select(*on, "zu", "yu", "xu")), on)
    reach = max(extent, extent_r) * 1.0001 + 1e-6
    radius = max(spacing * 1.5 * k ** (1.0 / 3.0), reach / 4096)
    # Tighten for uneven frames: start where no bucket is crowded.
    while _crowding(right, 2 * radius, on) > CROWDED_BUCKET and radius > reach / 4096:
        radius /= 2

    targets = right.select(*on, right_id, "zu", "yu", "xu")
    waiting = cut_lineage(left.select(*on, left_id, "zu", "yu", "xu"), "queries")
    nearest = Window.partitionBy(*on, left_id).orderBy("d", right_id)
    parts = []
    while True:
        pairs = range_join(waiting, targets, min(radius, reach), on)
        if skip_self:
            pairs = pairs.where(F.col(left_id) != F.col(right_id))
        ranked = (pairs.select(*on, left_id, right_id, "d")
                  .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k))
        if radius >= reach:
            parts.append(ranked)
            break
        ranked = cut_lineage(ranked, "nearest")
        settled = ranked.where(F.col("rank") == k).select(*on, left_id)
        parts.append(ranked.join(settled, [*on, left_id], "left_semi"))
        rest = cut_lineage(waiting.join(settled, [*on, left_id], "left_anti"), "queries")
        discard(waiting)
        waiting = rest
        if is_empty(waiting):
            break
        radius *= 2
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def next_frame(nodes: DataFrame, delta: int = 1, prefix: str = "target") -> DataFrame:
    """Nodes re-keyed to the frame ``delta`` earlier, so frame pairs become an equi-join."""
    return nodes.select(
        "dataset", (F.col("t") - delta).alias("t"),
        F.col("node_id").alias(f"{prefix}_id"), "zu", "yu", "xu")


def as_sources(nodes: DataFrame, prefix: str = "source") -> DataFrame:
    return nodes.select("dataset", "t", F.col("node_id").alias(f"{prefix}_id"), "zu", "yu", "xu")


def link_candidates(nodes: DataFrame, radius: float, delta: int = 1) -> DataFrame:
    """Pairs of frame t and t+delta within ``radius``: dataset, t, source_id, target_id, d."""
    return (range_join(as_sources(nodes), next_frame(nodes, delta), radius, ["dataset", "t"])
            .select("dataset", "t", "source_id", "target_id", "d"))


def nearest_links(nodes: DataFrame, radius: float) -> DataFrame:
    """Greedy link of every node to its nearest node of the next frame, nearer than ``radius``."""
    return nearest_join(as_sources(nodes), next_frame(nodes), radius, ["dataset", "t"],
                        "source_id", "target_id", strict=True)


def spacing(nodes: DataFrame) -> DataFrame:
    """Distance of every node to its nearest neighbour in the same frame.

    Positions are collapsed first: a position held by two or more nodes has spacing 0. A frame whose
    distances fit a task is searched there; larger ones by balls that grow (:func:`nearest_k`).
    """
    spot = ["dataset", "t", "zu", "yu", "xu"]
    places = nodes.groupBy(*spot).agg(F.min("node_id").alias("place_id"),
                                      F.count(F.lit(1)).alias("copies"))
    places = cut_lineage(places, "places")
    frame = ["dataset", "t"]
    large = crowded(places, places, frame, TASK_CELLS)
    small = places if large is None else places.join(large, frame, "left_anti")
    kind = dict(places.dtypes)["place_id"]
    near = within(small.where("zu IS NOT NULL AND yu IS NOT NULL AND xu IS NOT NULL"), frame,
                  ["place_id", "zu", "yu", "xu", "copies"], f"place_id {kind}, d double", _nearest_other)
    if large is not None:
        rest = cut_lineage(places.join(large, frame, "left_semi"), "places")
        others = rest.select(*frame, F.col("place_id").alias("other_id"), "zu", "yu", "xu")
        near = near.unionByName(nearest_k(rest.where("copies = 1"), others, 1, frame, "place_id", "other_id",
                                          skip_self=True).select(*frame, "place_id", "d"))
    alone = near.select("dataset", "t", F.col("place_id").alias("node_id"), "d")
    shared = (nodes.join(places.where("copies > 1").select(*spot), spot, "left_semi")
              .select("dataset", "t", "node_id", F.lit(0.0).alias("d")))
    return alone.unionByName(shared)


def _nearest_other(ids: np.ndarray, z: np.ndarray, y: np.ndarray, x: np.ndarray,
                   copies: np.ndarray) -> list[np.ndarray] | None:
    """Places held once, with the distance to the nearest other place of the frame."""
    places, best = [z, y, x], []
    if len(ids) < 2:
        return None
    step = max(1, STEP_CELLS // len(ids))
    for k in range(0, len(ids), step):
        d = distances([p[k:k + step] for p in places], places)
        d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
        best.append(d.min(1))
    once = copies == 1
    return [ids[once], np.concatenate(best)[once]]


def successor_rank(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Rank of the true successor among the ``k`` nearest of the next frame (null: beyond k).

    One row per node that has a successor in the next frame; if it has several, the one
    of the highest edge id counts.
    """
    where = nodes.select("dataset", "node_id", "t")
    spans = (edges.groupBy("dataset", "source_id")
             .agg(F.max_by("target_id", "edge_id").alias("true_id"))
             .join(where.select("dataset", F.col("node_id").alias("source_id"), "t"),
                   ["dataset", "source_id"])
             .join(where.select("dataset", F.col("node_id").alias("true_id"),
                                F.col("t").alias("t_next")), ["dataset", "true_id"])
             .where(F.col("t_next") == F.col("t") + 1)
             .select("dataset", "t", "source_id", "true_id"))
    asked = as_sources(nodes).join(spans.select("dataset", "source_id"),
                                   ["dataset", "source_id"], "left_semi")
    near = nearest_k(asked, next_frame(nodes), k, ["dataset", "t"], "source_id", "target_id")
    hits = near.select("dataset", "t", "source_id", F.col("target_id").alias("true_id"), "rank")
    return spans.join(hits, ["dataset", "t", "source_id", "true_id"], "left")

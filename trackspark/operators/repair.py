"""Track repair: motion links, gap closing, division recovery, and the whole chain.

Every step is set-oriented over all datasets. Caps are applied as ranks after the fact
where the order of picking allows it, and conflicts are settled in rounds of mutual
best choices, so no step gathers a dataset in one task. The one sequential step,
linking with motion, walks over windows of frames and carries positions forward.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import cosine, lerp, norm3, with_um
from trackspark.functions.scalars import sanitise_probability
from trackspark.operators.assign import TASK_CELLS, heaviest_matching, match_near, max_weight_matching
from trackspark.operators.edges import (
    best_edge, degrees, drop_long, edge_length, only_neighbour, open_ends, with_endpoints)
from trackspark.operators.graph import (
    append_nodes, filter_divisions, long_tracks, prune_isolated, smooth_tracks)
from trackspark.operators.grouped import crowded, distances
from trackspark.operators.ordering import rank_rows
from trackspark.operators.spatial import range_join
from trackspark.schema import DEFAULT_SCALE
from trackspark.session import cut_lineage, discard, is_empty

PAIR = ["dataset", "t"]
MOTION_WINDOW = 32


def _capped(ranked: DataFrame, counts: DataFrame, keys: list[str], share: float | None,
            most: int | None = None, whole=F.rint) -> DataFrame:
    """Rows whose ``_rank`` is within a share of the counts ``_n`` and within ``most``.

    At least one row may stay. Both limits are the caller's; without them every row stays.
    """
    if share is None and most is None:
        return ranked.drop("_rank")
    limits = [F.lit(most).cast("bigint")] if most is not None else []
    if share is not None:
        limits.append(F.greatest(F.lit(1), whole(F.col("_n") * F.lit(share)).cast("bigint")))
    cap = F.least(*limits) if len(limits) > 1 else limits[0]
    return ranked.join(counts, keys).where(F.col("_rank") <= cap).drop("_rank", "_n")


def _per(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


# -- gap proposals ---------------------------------------------------------------

def gap_pairs(nodes: DataFrame, edges: DataFrame, delta: int, radius: float,
              scale=DEFAULT_SCALE) -> DataFrame:
    """Track ends at t with track starts at t+delta within ``radius``: end_id, start_id, d."""
    ends, starts = _gap_sides(nodes, edges, delta, scale)
    return range_join(ends, starts, radius, PAIR).select(*PAIR, "end_id", "start_id", "d")


def _gap_sides(nodes: DataFrame, edges: DataFrame, delta: int, scale=DEFAULT_SCALE) -> tuple[DataFrame, DataFrame]:
    """Track ends, and track starts re-keyed to the frame ``delta`` earlier, both with ``zu, yu, xu``."""
    marked = cut_lineage(with_um(open_ends(nodes, edges), scale).where("is_end OR is_start")
                         .select(*PAIR, "node_id", "zu", "yu", "xu", "is_end", "is_start"), "open")
    ends = marked.where("is_end").select(*PAIR, F.col("node_id").alias("end_id"), "zu", "yu", "xu")
    starts = marked.where("is_start").select(
        "dataset", (F.col("t") - delta).alias("t"), F.col("node_id").alias("start_id"), "zu", "yu", "xu")
    return ends, starts


def assigned_gaps(nodes: DataFrame, edges: DataFrame, delta: int, radius: float, big, scale=DEFAULT_SCALE) -> DataFrame:
    """One-to-one gaps per frame of least total distance.

    A gap left open costs ``big``, a function of the longest one that the frame could close.
    """
    ends, starts = _gap_sides(nodes, edges, delta, scale)
    return match_near(ends, starts, radius, PAIR, "end_id", "start_id", big)


def _points(nodes: DataFrame, name: str, prefix: str) -> DataFrame:
    return nodes.select("dataset", F.col("node_id").alias(name),
                        *[F.col(a).alias(f"{prefix}{a}") for a in "zyx"])


def midpoints(gaps: DataFrame, nodes: DataFrame) -> DataFrame:
    """gaps plus the point halfway between their ends (``z, y, x``)."""
    return (gaps.join(_points(nodes, "end_id", "e"), ["dataset", "end_id"])
            .join(_points(nodes, "start_id", "s"), ["dataset", "start_id"])
            .select(*gaps.columns, *[(F.lit(0.5) * (F.col(f"e{a}") + F.col(f"s{a}"))).alias(a)
                                     for a in "zyx"]))


def close_gaps(nodes: DataFrame, edges: DataFrame, link_radius: float = 9.0, slack: float = 1.0,
               max_share: float | None = None, scale=DEFAULT_SCALE) -> tuple[DataFrame, DataFrame]:
    """Bridge one missing frame by inserting the midpoint and two edges.

    Gaps are chosen by optimal assignment per frame; with ``max_share``, at most ceil(share of
    nodes) nodes are added per dataset, earliest frames first. Returns only the added ones.
    """
    chosen = cut_lineage(assigned_gaps(nodes, edges, 2, 2.0 * link_radius * slack, lambda top: top * 10 + 1, scale), "gaps")
    ranked = rank_rows(chosen, ["dataset"], ["t", "end_id"], "_rank")
    kept = _capped(ranked, _per(nodes, ["dataset"]), ["dataset"], max_share, whole=F.ceil)
    placed = midpoints(kept, nodes).withColumn("t", F.col("t") + 1)
    added = cut_lineage(append_nodes(nodes, placed, ["t", "end_id"]), "inserted")
    return added.select("dataset", "node_id", "t", "z", "y", "x"), _bridge(added)


def _refined(points: DataFrame, refine) -> DataFrame:
    """Inserted points moved by a hook that takes and returns (dataset, t, point_id, z, y, x)."""
    moved = refine(points.withColumnRenamed("node_id", "point_id"))
    return moved.select("dataset", F.col("point_id").alias("node_id"), "t", "z", "y", "x")


def _bridge(added: DataFrame) -> DataFrame:
    """The two edges through each inserted (or reused) middle node."""
    return added.select("dataset", F.explode(F.array(
        F.struct(F.col("end_id").alias("source_id"), F.col("node_id").alias("target_id")),
        F.struct(F.col("node_id").alias("source_id"), F.col("start_id").alias("target_id")))).alias("_e")) \
        .select("dataset", "_e.source_id", "_e.target_id")


# -- gap closing with reuse of isolated detections ---------------------------------

def gap_choices(gaps: DataFrame, nodes: DataFrame, edges: DataFrame, reuse_um: float) -> DataFrame:
    """Isolated nodes within ``reuse_um`` of each gap's midpoint: gap key, iso_id, d_iso."""
    iso = with_um(open_ends(nodes, edges).where("is_isolated")).select(
        "dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("iso_id"), "zu", "yu", "xu")
    mids = with_um(gaps).select(*PAIR, "end_id", "zu", "yu", "xu")
    return range_join(mids, iso, reuse_um, PAIR).select(
        *PAIR, "end_id", "iso_id", F.col("d").alias("d_iso"))


def settle_reuse(gaps: DataFrame, choices: DataFrame) -> DataFrame:
    """Decide, in (t, end_id) order, which gap is dropped and which isolated node it reuses.

    A gap takes the nearest isolated node no earlier gap took. A gap whose end was itself
    reused by a gap one frame earlier is dropped. A decision depends only on earlier gaps
    that share a candidate or offer the end, so each round settles every gap with no such
    gap still open; chains are a few gaps long, and the rest of the table needs no round.
    Result: gaps with ``iso_id`` (null: a new node is needed), dropped gaps removed.
    """
    gaps = cut_lineage(gaps.select(*PAIR, "end_id", "start_id"), "gaps")
    open_choices = cut_lineage(choices, "choices")
    waiting = gaps
    taken = None
    settled = None
    key = [*PAIR, "end_id"]
    while True:
        # The end of a gap may be an isolated node offered to gaps of the frame before.
        offered = open_choices.select("dataset", (F.col("t") + 1).alias("t"),
                                      F.col("iso_id").alias("end_id")).distinct()
        first = open_choices.groupBy("dataset", "iso_id").agg(F.min("end_id").alias("_first"))
        behind = (open_choices.join(first, ["dataset", "iso_id"])
                  .where(F.col("end_id") > F.col("_first")).select(*key).distinct())
        ready = cut_lineage(waiting.join(offered, key, "left_anti").join(behind, key, "left_anti"), "ready")
        best = (open_choices.join(ready, key, "left_semi").groupBy(*key)
                .agg(F.min(F.struct("d_iso", "iso_id")).alias("_b"))
                .select(*key, F.col("_b.iso_id").alias("iso_id")))
        now = cut_lineage(ready.join(best, key, "left"), "settled")
        settled = now if settled is None else settled.unionByName(now)
        used = now.where("iso_id IS NOT NULL").select("dataset", "t", "iso_id")
        taken = used if taken is None else taken.unionByName(used)
        # Gaps that start from a node just reused are out, and so are their claims.
        out = used.select("dataset", (F.col("t") + 1).alias("t"), F.col("iso_id").alias("end_id"))
        later = cut_lineage(waiting.join(ready, key, "left_anti").join(out, key, "left_anti"), "waiting")
        discard(waiting, ready)
        waiting = later
        if is_empty(waiting):
            return settled
        fewer = cut_lineage(
            open_choices.join(waiting, key, "left_semi")
            .join(used.select("dataset", "iso_id"), ["dataset", "iso_id"], "left_anti"), "choices")
        discard(open_choices)
        open_choices = fewer


def close_gaps_reusing(nodes: DataFrame, edges: DataFrame, gap_um: float = 5.9, reuse_um: float = 3.1,
                       max_share: float | None = None, most: int | None = None,
                       refine=None) -> tuple[DataFrame, DataFrame]:
    """Bridge one-frame gaps, preferring an isolated detection near the midpoint.

    New nodes may be limited per dataset, earliest gaps first; reused ones are not.
    ``refine`` may move the inserted points (dataset, t, point_id, z, y, x) -> the same.
    """
    limit = 2.0 * gap_um
    chosen = assigned_gaps(nodes, edges, 2, limit, lambda top: limit * 1000.0 + 1.0)
    gaps = cut_lineage(midpoints(chosen, nodes), "gaps")
    settled = cut_lineage(settle_reuse(gaps, gap_choices(gaps, nodes, edges, reuse_um)), "settled")
    reused = settled.where("iso_id IS NOT NULL").withColumn("node_id", F.col("iso_id"))
    fresh = rank_rows(settled.where("iso_id IS NULL"), ["dataset"], ["t", "end_id"], "_rank")
    fresh = _capped(fresh, _per(nodes, ["dataset"]), ["dataset"], max_share, most).drop("iso_id")
    fresh = fresh.join(gaps.select(*PAIR, "end_id", "z", "y", "x"), [*PAIR, "end_id"])
    fresh = fresh.withColumn("t", F.col("t") + 1)
    added = cut_lineage(append_nodes(nodes, fresh, ["t", "end_id"]), "inserted")
    points = added.select("dataset", "node_id", "t", "z", "y", "x")
    if refine is not None:
        points = _refined(points, refine)
    links = _bridge(added.select("dataset", "end_id", "start_id", "node_id").unionByName(
        reused.select("dataset", "end_id", "start_id", "node_id")))
    return points, links


# -- two-frame gaps ------------------------------------------------------------------

def two_frame_proposals(nodes: DataFrame, edges: DataFrame, total_um: float = 9.5, step_um: float = 4.0,
                        need_context: bool = True) -> DataFrame:
    """Ends at t with starts at t+3 that continue the motion on at least one side.

    Columns: dataset, t, end_id, start_id, d, score (distance plus a penalty for turning).
    """
    radius = min(total_um, 3.0 * step_um)
    close = (F.col("d") <= total_um) & (F.col("d") / 3.0 <= step_um)
    if not need_context:
        return gap_pairs(nodes, edges, 3, radius).where(close).withColumn("score", F.col("d"))
    spots = with_um(nodes)

    def beside(side, name, own, other, found, prefix):
        """The side with the only neighbour of its points: joined here, so no pair is moved for it."""
        known = only_neighbour(edges, own, other, found).withColumnsRenamed({"node_id": name})
        at = spots.select("dataset", F.col("node_id").alias(found), *[F.col(f"{a}u").alias(f"{prefix}{a}") for a in "zyx"])
        return side.join(known, ["dataset", name], "left").join(at, ["dataset", found], "left")

    ends, starts = _gap_sides(nodes, edges, 3)
    ends = cut_lineage(beside(ends, "end_id", "target_id", "source_id", "prev_id", "b"), "ends")
    starts = cut_lineage(beside(starts, "start_id", "source_id", "target_id", "next_id", "n"), "starts")
    # A generated row keeps the tests below out of the join's own condition, which runs for every
    # candidate of a cell and is no longer compiled if it grows that long.
    moves = F.explode(F.array(F.struct(
        *[((F.col(f"r_{a}u") - F.col(f"l_{a}u")) / 3.0).alias(f"step{a}") for a in "zyx"],
        *[(F.col(f"l_{a}u") - F.col(f"b{a}")).alias(f"back{a}") for a in "zyx"],
        *[(F.col(f"n{a}") - F.col(f"r_{a}u")).alias(f"fore{a}") for a in "zyx"])))
    rows = (range_join(ends, starts, radius, PAIR).where(close)
            .select(*PAIR, "end_id", "start_id", "d", "prev_id", "next_id", moves.alias("_m")).select("*", "_m.*"))

    def length(p):
        return norm3(*[F.col(f"{p}{a}") for a in "zyx"])

    good, penalty = F.lit(False), F.lit(0.0)
    for side, known in (("back", F.col("prev_id").isNotNull()), ("fore", F.col("next_id").isNotNull())):
        still = (length(side) <= 0.01) | (length("step") <= 0.01)
        turn = cosine(side, "step")
        smooth = (turn > -0.25) & (norm3(*[F.col(f"{side}{a}") - F.col(f"step{a}") for a in "zyx"]) <= 6.0)
        good = good | F.coalesce(known & (still | smooth), F.lit(False))
        penalty = penalty + F.when(known & ~still, F.greatest(F.lit(0.0), F.lit(0.25) - turn)).otherwise(0.0)
    return rows.where(good).select(*PAIR, "end_id", "start_id", "d",
                                   (F.col("d") + 2.0 * penalty).alias("score"))


def greedy_pairs(proposals: DataFrame) -> DataFrame:
    """Take proposals in (score, end, start) order, each end and start once.

    A proposal that is the best of both its ends is taken whatever happens elsewhere, so
    rounds of mutual-best picks give exactly the greedy result.
    """
    live = cut_lineage(proposals, "proposals")
    chosen = None
    order = F.struct("score", "end_id", "start_id")
    while True:
        by_end = live.groupBy("dataset", "end_id").agg(F.min(order).alias("_e"))
        by_start = live.groupBy("dataset", "start_id").agg(F.min(order).alias("_s"))
        picks = cut_lineage(
            live.join(by_end, ["dataset", "end_id"]).join(by_start, ["dataset", "start_id"])
            .where((F.col("_e") == order) & (F.col("_s") == order)).select(*proposals.columns), "picks")
        chosen = picks if chosen is None else chosen.unionByName(picks)
        rest = cut_lineage(
            live.join(picks.select("dataset", "end_id"), ["dataset", "end_id"], "left_anti")
            .join(picks.select("dataset", "start_id"), ["dataset", "start_id"], "left_anti"), "proposals")
        discard(live)
        live = rest
        if is_empty(live):
            return chosen


def recover_two_frame_gaps(nodes: DataFrame, edges: DataFrame, max_share: float | None = None,
                           most: int | None = None, frame_share: float | None = None, refine=None, **limits) -> tuple[DataFrame, DataFrame]:
    """Bridge two missing frames at thirds of the way: two nodes and three edges per gap."""
    proposals = two_frame_proposals(nodes, edges, **limits)
    picks = cut_lineage(greedy_pairs(proposals), "picks")
    ends = _per(open_ends(nodes, edges).where("is_end"), PAIR)
    order = ["score", "end_id", "start_id"]
    in_frame = _capped(rank_rows(picks, PAIR, order, "_rank"), ends, PAIR, frame_share)
    turns = rank_rows(in_frame, ["dataset"], ["score", "t", "end_id", "start_id"], "_rank").withColumn("turn", F.col("_rank"))
    kept = _capped(turns, _per(edges, ["dataset"]), ["dataset"], max_share, most)
    spans = (kept.join(_points(nodes, "end_id", "e"), ["dataset", "end_id"])
             .join(_points(nodes, "start_id", "s"), ["dataset", "start_id"]))
    steps = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col("t") + k).alias("t"),
                 *[lerp(F.col(f"e{a}"), F.col(f"s{a}"), k / 3.0).alias(a) for a in "zyx"]) for k in (1, 2)]))
    placed = spans.select("dataset", "end_id", "start_id", "turn", steps.alias("_p")).select(
        "dataset", "end_id", "start_id", "turn", "_p.*")
    added = cut_lineage(append_nodes(nodes, placed, ["turn", "k"]), "inserted")
    points = added.select("dataset", "node_id", "t", "z", "y", "x")
    if refine is not None:
        points = _refined(points, refine)
    first = added.where("k = 1").select("dataset", "end_id", "start_id", F.col("node_id").alias("_a"))
    second = added.where("k = 2").select("dataset", "end_id", F.col("node_id").alias("_b"))
    links = first.join(second, ["dataset", "end_id"]).select("dataset", F.explode(F.array(
        F.struct(F.col("end_id").alias("source_id"), F.col("_a").alias("target_id")),
        F.struct(F.col("_a").alias("source_id"), F.col("_b").alias("target_id")),
        F.struct(F.col("_b").alias("source_id"), F.col("start_id").alias("target_id")))).alias("_e")) \
        .select("dataset", "_e.*")
    return points, links


# -- divisions ---------------------------------------------------------------------

def division_proposals(nodes: DataFrame, edges: DataFrame, parent_um: float = 4.6, sister_um: float = 6.9,
                       child_um: float = 7.4) -> DataFrame:
    """Parents with one child and a parentless node nearby: dataset, t, source_id, target_id, score."""
    marked = with_um(degrees(nodes, edges))
    child = (edges.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("_n"), F.min("target_id").alias("child_id"))
             .where("_n = 1").drop("_n"))
    at_child = marked.select("dataset", F.col("node_id").alias("child_id"), F.col("t").alias("_ct"),
                             *[F.col(f"{a}u").alias(f"c{a}") for a in "zyx"])
    parents = (marked.select(*PAIR, F.col("node_id").alias("source_id"), "zu", "yu", "xu")
               .join(child, ["dataset", "source_id"]).join(at_child, ["dataset", "child_id"])
               .where(F.col("_ct") == F.col("t") + 1)
               .where(norm3(*[F.col(f"{a}u") - F.col(f"c{a}") for a in "zyx"]) <= child_um)
               .drop("_ct", "child_id"))
    orphans = marked.where("in_degree = 0").select(
        "dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("target_id"), "zu", "yu", "xu")
    near = range_join(parents, orphans, parent_um, PAIR)
    sister = norm3(*[F.col(f"c{a}") - F.col(f"r_{a}u") for a in "zyx"])
    return (near.withColumn("sister", sister).where(F.col("sister") <= sister_um)
            .select(*PAIR, "source_id", "target_id", (F.col("d") + 0.15 * F.col("sister")).alias("score")))


def recover_divisions(nodes: DataFrame, edges: DataFrame, frame_share: float | None = None,
                      global_share: float | None = None, **limits) -> DataFrame:
    """Second-child edges: the best proposal per child, if asked capped per frame, then per dataset."""
    proposals = division_proposals(nodes, edges, **limits)
    best = (proposals.groupBy(*PAIR, "target_id").agg(F.min(F.struct("score", "source_id")).alias("_b"))
            .select(*PAIR, "target_id", "_b.*"))
    single = _per(degrees(nodes, edges).where("out_degree = 1"), PAIR)
    in_frame = _capped(rank_rows(best, PAIR, ["score", "source_id", "target_id"], "_rank"), single, PAIR, frame_share)
    ranked = rank_rows(in_frame, ["dataset"], ["t", "score", "source_id", "target_id"], "_rank")
    return (_capped(ranked, _per(edges, ["dataset"]), ["dataset"], global_share)
            .select("dataset", "source_id", "target_id"))


# -- motion links ------------------------------------------------------------------

def motion_links(nodes: DataFrame, edges: DataFrame, tight_um: float = 5.95, relaxed_um: float = 10.0,
                 velocity: float = 0.5, bonus: float = 0.76, window: int = MOTION_WINDOW,
                 carried: DataFrame | None = None, with_origin: bool = False) -> DataFrame:
    """Re-link every frame pair with predicted positions: tight gate first, then relaxed.

    The cost of a link is the distance to the predicted position, plus 5 % of the raw
    distance, minus ``bonus`` times the learned probability. A task holds the points of one
    window of frames and forms the candidates of a frame there; they are never written or
    exchanged. The window shrinks where frames hold many points. Only recordings with a frame
    whose distances do not fit a task get their candidates from the grid join. Output:
    dataset, source_id, target_id, edge_prob, distance_um, motion_um, tight.

    ``carried`` (dataset, target_id, pz, py, px) says where nodes of the first frame came from;
    ``with_origin`` adds t and the source's position pz, py, px, which is the same for what follows.
    """
    usable = cut_lineage(with_um(nodes).where("dataset IS NOT NULL AND t IS NOT NULL")
                         .select(*PAIR, "node_id", "zu", "yu", "xu"), "usable")
    learned = (edges.where("edge_prob IS NOT NULL").where(F.abs("edge_prob") < float("inf"))
               .groupBy("dataset", "source_id", "target_id").agg(F.max("edge_prob").alias("_p"))
               .select("dataset", "source_id", "target_id", sanitise_probability(F.col("_p")).alias("prob")))
    a = usable.select(*PAIR, F.col("node_id").alias("source_id"), "zu", "yu", "xu")
    b = usable.select("dataset", (F.col("t") - 1).alias("t"), F.col("node_id").alias("target_id"), "zu", "yu", "xu")
    schema = ("dataset string, t bigint, source_id bigint, target_id bigint, edge_prob double, "
              "distance_um double, motion_um double, tight boolean, pz double, py double, px double")
    names = [c.split()[0] for c in schema.split(", ")]
    if carried is not None:
        carried = cut_lineage(carried.select(*[
            F.col(c).alias(c) if c in carried.columns else F.lit(None).cast(k).alias(c)
            for c, k in (f.split() for f in schema.split(", "))]), "carried")

    def none():
        # an empty column of floats is no text to Arrow
        return pd.DataFrame({c: [] for c in names}, dtype=object)

    def linked(name, frames, came_from):
        """The links of a recording's frames (t, ids, targets, places of both, distances, probabilities), in order."""
        parts = []
        for t, ids, targets, src, dst, raw, prob in frames:
            past = np.array([came_from.get(s, p) for s, p in zip(ids, src)]).reshape(-1, 3)
            motion = np.sqrt(((dst - (src + velocity * (src - past))) ** 2).sum(axis=1))
            cost = motion + 0.05 * raw - bonus * prob
            free = np.ones(len(ids), bool)
            for gate, tight in ((tight_um, True), (relaxed_um, False)):
                idx = np.flatnonzero(free & (raw <= gate))
                if not len(idx):
                    continue
                pick = idx[heaviest_matching(ids[idx], targets[idx], gate * 1000.0 + 1.0 - cost[idx])]
                free &= ~np.isin(ids, ids[pick]) & ~np.isin(targets, targets[pick])
                parts.append(pd.DataFrame({
                    "dataset": name, "t": t, "source_id": ids[pick], "target_id": targets[pick], "edge_prob": prob[pick],
                    "distance_um": raw[pick], "motion_um": motion[pick], "tight": tight,
                    "pz": src[pick, 0], "py": src[pick, 1], "px": src[pick, 2]}))
                came_from.update(zip(targets[pick], src[pick]))
        return pd.concat(parts) if parts else none()

    def by_window(rows, window, first, last, frames_of):
        """``linked`` over windows of frames, each with the origins that the one before leaves."""
        def walk(part: pd.DataFrame, origins: pd.DataFrame) -> pd.DataFrame:
            if not len(part):
                return none()
            came_from = {n: p for n, *p in origins[["target_id", "pz", "py", "px"]].itertuples(index=False)}
            return linked(part["dataset"].iloc[0], frames_of(part, window), came_from)

        if first < last:
            rows = cut_lineage(rows, "motion")
        done, origins = None, carried
        for w in range(first, last + 1):
            if origins is None:
                origins = nodes.sparkSession.createDataFrame([], schema)
            found = cut_lineage(rows.where(F.col("w") == w).groupBy("dataset").cogroup(origins.groupBy("dataset"))
                                .applyInPandas(walk, schema), "walked")
            done = found if done is None else done.unionByName(found)
            origins = found.where(F.col("t") == (w + 1) * window - 1)
        return done

    def windows(counted, window):
        """The frames a window may have, and the first and last window, by the rows of every frame."""
        top, low, high = counted.agg(F.max("count"), F.min("t"), F.max("t")).first()
        if top is None:
            return None
        window = max(1, min(window, TASK_CELLS // top))
        return window, low // window, high // window

    def from_points(rows, window):
        w, (points, known) = rows["w"].iloc[0], (rows[rows["kind"] == k] for k in (0, 1))
        frames = {t: [part[c].to_numpy() for c in ("a", "zu", "yu", "xu")]
                  for t, part in points.sort_values(["t", "a"]).groupby("t")}
        chances = {t: [part[c].to_numpy() for c in ("a", "b", "zu")] for t, part in known.groupby("t")}
        for t, left in frames.items():
            if t // window != w or t + 1 not in frames:
                continue
            right = frames[t + 1]
            d = distances(left[1:], right[1:])
            l, r = np.nonzero(d <= relaxed_um)
            if not len(l):
                continue
            prob = np.zeros(len(l))
            if t in chances:
                own, other, p = chances[t]
                (lu, li), (ru, ri) = (np.unique(side[0], return_inverse=True) for side in (left, right))
                at, to = (np.minimum(np.searchsorted(u, x), len(u) - 1) for u, x in ((lu, own), (ru, other)))
                met = (lu[at] == own) & (ru[to] == other)
                table = np.zeros((len(lu), len(ru)))
                table[at[met], to[met]] = p[met]
                prob = table[li[l], ri[r]]
            src, dst = (np.stack(side[1:], 1)[k] for side, k in ((left, l), (right, r)))
            yield t, left[0][l], right[0][r], src, dst, d[l, r], prob

    def from_pairs(rows, window):
        for t, frame in rows.sort_values(["t", "source_id", "target_id"]).groupby("t"):
            yield (t, *[frame[c].to_numpy() for c in ("source_id", "target_id")],
                   *[frame[[f"{side}_{c}u" for c in "zyx"]].to_numpy() for side in "lr"],
                   *[frame[c].to_numpy() for c in ("d", "prob")])

    parts = []
    large = crowded(a, b, PAIR, TASK_CELLS)
    if large is not None:
        large = large.select("dataset").distinct()
        cands = cut_lineage(range_join(*[s.join(large, "dataset", "left_semi") for s in (a, b)], relaxed_um, PAIR)
                            .join(learned, ["dataset", "source_id", "target_id"], "left").fillna(0.0, ["prob"]), "motion")
        if found := windows(cands.groupBy(*PAIR).count(), window):
            parts.append(by_window(cands.withColumn("w", F.floor(F.col("t") / found[0])), *found, from_pairs))
        usable = usable.join(large, "dataset", "left_anti")
    if found := windows(usable.groupBy(*PAIR).count(), window):
        own = F.floor(F.col("t") / found[0])
        # the first frame of a window also ends the links of the window before
        of = F.when(F.col("t") % found[0] == 0, F.array(own - 1, own)).otherwise(F.array(own))
        zero = F.lit(0).cast("bigint")
        points = usable.select(*PAIR, F.explode(of).alias("w"), F.lit(0).alias("kind"), F.col("node_id").alias("a"),
                               zero.alias("b"), "zu", "yu", "xu")
        known = (usable.select(*PAIR, F.col("node_id").alias("source_id")).join(learned, ["dataset", "source_id"])
                 .select(*PAIR, own.alias("w"), F.lit(1).alias("kind"), F.col("source_id").alias("a"),
                         F.col("target_id").alias("b"), F.col("prob").alias("zu"), F.lit(0.0).alias("yu"), F.lit(0.0).alias("xu")))
        parts.append(by_window(points.unionByName(known), *found, from_points))
    done = parts[0] if parts else nodes.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        done = done.unionByName(part)
    return done if with_origin else done.drop("t", "pz", "py", "px")


# -- the whole chain -----------------------------------------------------------------

def repair_graph(nodes: DataFrame, raw_edges: DataFrame, edge_max_um: float = 14.2, relink: bool = True,
                 single_child: bool = False, divisions_by_geometry: bool = False,
                 drop_short: bool = False, smooth: bool = True, refine=None, limits: dict | None = None):
    """Filter, re-link, close gaps, recover divisions, prune and smooth.

    ``limits`` may give the steps ``gaps``, ``wide_gaps`` and ``divisions`` insertion limits, as
    keyword arguments of their functions. Returns (nodes, edges, counts): ``counts`` has one
    row per dataset and stage.
    """
    limits = limits or {}
    nodes = cut_lineage(nodes.select("dataset", "node_id", "t", "z", "y", "x"), "nodes")
    stages = []

    def note(name, current_nodes, current_edges):
        for kind, df in (("nodes", current_nodes), ("edges", current_edges)):
            stages.append(df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
                          .select("dataset", F.lit(name).alias("stage"), F.lit(kind).alias("kind"), "n"))

    note("raw", nodes, raw_edges)
    edges = cut_lineage(drop_long(raw_edges, nodes, edge_max_um), "edges")
    note("valid", nodes, edges)
    columns = ["dataset", "source_id", "target_id", "edge_prob", "distance_um", "edge_id"]
    if relink:
        moved = cut_lineage(motion_links(nodes, edges), "relinked")
        fresh = moved.withColumn("edge_id", F.col("source_id"))
        stay = edges.join(moved.select("dataset").distinct(), "dataset", "left_anti")
        edges = fresh.select(*columns).unionByName(stay.select(*columns))
    edges = best_edge(edges.select(*columns), "target_id")
    if single_child:
        edges = best_edge(edges, "source_id")
    edges = cut_lineage(edges, "edges")
    note("linked", nodes, edges)

    def extend(new_nodes, new_edges):
        all_nodes = nodes if new_nodes is None else nodes.unionByName(new_nodes)
        all_nodes = cut_lineage(all_nodes, "nodes")
        measured = (with_endpoints(new_edges, all_nodes, ("t", "z", "y", "x"))
                    .select("dataset", "source_id", "target_id", F.lit(None).cast("double").alias("edge_prob"),
                            edge_length(DEFAULT_SCALE).alias("distance_um"),
                            F.col("source_id").alias("edge_id")))
        return all_nodes, cut_lineage(edges.unionByName(measured.select(*columns)), "edges")

    nodes, edges = extend(*close_gaps_reusing(nodes, edges, refine=refine, **limits.get("gaps", {})))
    note("gaps", nodes, edges)
    nodes, edges = extend(*recover_two_frame_gaps(nodes, edges, refine=refine, **limits.get("wide_gaps", {})))
    note("gaps2", nodes, edges)
    nodes, edges = extend(None, recover_divisions(nodes, edges, **limits.get("divisions", {})))
    note("divisions", nodes, edges)
    if divisions_by_geometry:
        edges = cut_lineage(filter_divisions(edges, nodes), "edges")
    # A dataset without any edge keeps its nodes.
    bare = nodes.join(edges.select("dataset").distinct(), "dataset", "left_anti")
    nodes = cut_lineage(prune_isolated(nodes, edges).unionByName(bare), "nodes")
    if drop_short:
        nodes, edges = long_tracks(nodes, edges)
    if smooth:
        nodes = smooth_tracks(nodes, edges)
    note("final", nodes, edges)
    counts = stages[0]
    for s in stages[1:]:
        counts = counts.unionByName(s)
    return nodes, edges, counts


__all__ = ["repair_graph", "motion_links", "close_gaps", "close_gaps_reusing"]

"""End-to-end plans: predict from voxels, evaluate arms, build a submission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import to_original_voxels, with_um
from trackspark.functions.scalars import sampled_frames
from trackspark.operators import assign, budget, graph, score, spatial, submission
from trackspark.operators import volume as V
from trackspark.operators.ordering import rank_rows
from trackspark.operators.repair import close_gaps
from trackspark.schema import DEFAULT_SCALE
from trackspark.session import cut_lineage, is_empty
from trackspark.sources.results import missing_results


@dataclass(frozen=True)
class Finder:
    """How detections are found: ``method`` peaks (of intensity) or bands (of band-pass response)."""

    method: str = "peaks"
    stride: tuple = (1, 4, 4)
    spacing_um: float = 6.0
    shape: str = "box"                     # neighbourhood of a peak, or "ball"
    floor: float | None = None             # least score; by default the method's own
    bands: tuple = ((1.5, 4.0),)


@dataclass(frozen=True)
class Room:
    """How many detections a frame may keep; without a field there is no limit."""

    fill: float | None = None              # share of the recording's node budget
    most: int | None = None
    aim: float | None = None               # adapt the spacing to this share of the budget


@dataclass(frozen=True)
class Linker:
    """How detections become tracks: ``mode`` full, priced, gated or nearest."""

    mode: str = "full"
    radius_um: float = 9.0
    bridge: bool = False                   # close one-frame gaps
    bridge_share: float | None = None
    drop_lone: bool = False


@dataclass(frozen=True)
class Arm:
    """One way to get from voxels to tracks."""

    find: Finder = Finder()
    room: Room = Room()
    join: Linker = Linker()


def _caps(meta: DataFrame, room: Room) -> DataFrame | None:
    """caps(dataset, cap) for the limits of ``room``; null where a recording has no budget."""
    limits = []
    if room.fill is not None:
        per_frame = room.fill * F.col("est_total") / F.greatest(F.col("n_t"), F.lit(1))
        limits.append(F.when(F.col("est_total") > 0, F.greatest(F.lit(1), F.floor(per_frame))).cast("bigint"))
    if room.most is not None:
        limits.append(F.lit(room.most).cast("bigint"))
    if not limits:
        return None
    return meta.select("dataset", (F.least(*limits) if len(limits) > 1 else limits[0]).alias("cap"))


def detect(voxels: DataFrame, meta: DataFrame, scale, arm: Arm) -> DataFrame:
    """Detections in original voxel coordinates: dataset, node_id, t, z, y, x, score.

    ``meta`` has dataset, q_lo, q_hi, n_t, est_total (null where unknown). Recordings without
    usable quantiles get those of their own voxels.
    """
    find = arm.find
    voxel_um = tuple(a * b for a, b in zip(scale, find.stride))
    usable = F.coalesce(F.col("q_hi") > F.col("q_lo"), F.lit(False))
    if not is_empty(meta.where(~usable)):
        meta = cut_lineage(V.quantile_fallback(voxels, meta), "meta")
    frames = cut_lineage(V.load_frames(voxels, meta, find.stride), "frames")
    caps = _caps(meta, arm.room)
    if find.method == "bands":
        table = V.dog_table(frames, voxel_um, find.bands)
        least = 0.02 if find.floor is None else find.floor
        spacing = find.spacing_um
        if arm.room.aim is not None:
            middle = meta.select("dataset", F.floor(F.col("n_t") / 2).alias("t"))
            wanted = arm.room.aim * F.col("est_total") / F.greatest(F.col("n_t"), F.lit(1))
            targets = meta.where("est_total > 0").select("dataset", F.greatest(F.lit(1.0), wanted).alias("target"))
            fitted = V.adaptive_separation(table.join(middle, ["dataset", "t"], "left_semi"), targets, voxel_um,
                                           find.spacing_um, rel_threshold=least)
            table = table.join(fitted, "dataset", "left").fillna(find.spacing_um, ["sep"])
            spacing = F.col("sep")
        peaks = V.detect_dog(table, voxel_um, spacing, least, caps=caps)
    else:
        least = 0.15 if find.floor is None else find.floor
        peaks = V.detect_intensity(frames, voxel_um, find.spacing_um, least, find.shape, caps)
    centred = to_original_voxels(V.refine_centroids(peaks, frames, voxel_um), find.stride)
    numbered = rank_rows(centred, ["dataset"], ["t", "z", "y", "x", "-score"], "node_id")
    return cut_lineage(numbered.withColumn("node_id", F.col("node_id") - 1), "detections")


def link(nodes: DataFrame, scale, arm: Arm) -> tuple[DataFrame, DataFrame]:
    """Linked, gap-closed and pruned graph: (nodes, edges). ``scale`` as in ``with_um``."""
    how = arm.join
    placed = with_um(nodes, scale)
    links = (spatial.nearest_links(placed, how.radius_um) if how.mode == "nearest"
             else assign.link_optimal(placed, how.radius_um, how.mode))
    edges = cut_lineage(links.select("dataset", "source_id", "target_id"), "links")
    nodes = nodes.select("dataset", "node_id", "t", "z", "y", "x")
    if how.bridge:
        more_nodes, more_edges = close_gaps(nodes, edges, how.radius_um, max_share=how.bridge_share, scale=scale)
        nodes = cut_lineage(nodes.unionByName(more_nodes), "nodes")
        edges = cut_lineage(edges.unionByName(more_edges), "edges")
    edges = rank_rows(edges, ["dataset"], ["source_id", "target_id"], "edge_id")
    if how.drop_lone:
        return graph.densify(graph.prune_isolated(nodes, edges), edges)
    return nodes, edges


def predict(voxels: DataFrame, meta: DataFrame, scale, arm: Arm) -> tuple[DataFrame, DataFrame]:
    return link(detect(voxels, meta, scale, arm), scale, arm)


def evaluate(nodes: DataFrame, edges: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame,
             budgets: DataFrame, arm: str, scale=DEFAULT_SCALE) -> DataFrame:
    """Metric rows of one arm; ``division_exact`` is false where the prediction forks.

    ``scale`` as in ``with_um``: one voxel size, or a table with that of each recording.
    """
    matches = cut_lineage(assign.match_nodes(nodes, gt_nodes, scale=scale), "matches")
    rows = score.metric_rows(score.edge_counts(nodes, edges, matches, gt_nodes, gt_edges), budgets)
    forks = (edges.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("dataset").agg(F.bool_or(F.col("_n") > 1).alias("_fork")))
    return (rows.join(forks, "dataset", "left")
            .select(F.lit(arm).alias("arm"), *rows.columns,
                    (~F.coalesce("_fork", F.lit(False))).alias("division_exact")))


def evaluate_missing(arms: dict, gt_nodes: DataFrame, gt_edges: DataFrame, budgets: DataFrame,
                     stored: DataFrame | None, scale=DEFAULT_SCALE) -> DataFrame | None:
    """Metric rows of the (arm, dataset) pairs not stored yet.

    ``arms`` maps arm name -> function(datasets) -> (nodes, edges) for those datasets.
    """
    out = None
    names = gt_nodes.select("dataset").distinct()
    for arm, build in arms.items():
        wanted = names.withColumn("arm", F.lit(arm))
        todo = cut_lineage(missing_results(wanted, stored) if stored is not None else wanted, "todo")
        todo = todo.select("dataset")
        nodes, edges = build(todo)
        rows = evaluate(nodes, edges, gt_nodes.join(todo, "dataset", "left_semi"),
                        gt_edges.join(todo, "dataset", "left_semi"), budgets, arm, scale)
        out = rows if out is None else out.unionByName(rows)
    return out


def predicted_budgets(train: DataFrame, test: DataFrame) -> DataFrame:
    """Node budgets of ``test`` recordings from the regression fitted on ``train`` features."""
    beta = budget.fit(budget.log_design(train), hold_out=False)
    design = budget.log_design(test.withColumn("est_total", F.col("t_frames")))
    frames = test.select("dataset", "t_frames")
    return (budget.predict(design, beta).join(frames, "dataset")
            .select("dataset", (F.exp("yhat") * F.col("t_frames")).alias("est_total")))


def sampled_volume(voxels: DataFrame, meta: DataFrame, fractions=(0.25, 0.5, 0.75)) -> DataFrame:
    """Voxels of the frames at the given fractions of each movie."""
    picks = meta.select("dataset", F.explode(sampled_frames(F.col("n_t"), fractions)).alias("t"))
    return voxels.join(picks, ["dataset", "t"], "left_semi")


def projected_seconds(names: DataFrame, fits: int, detections: int, per_detection: float = 1.3,
                      per_dataset: float = 45.0) -> DataFrame:
    """Projected run time of a submission over ``names`` (feature pass plus prediction)."""
    n = F.count(F.lit(1))
    return names.agg(((fits + n) * detections * per_detection + n * per_dataset).alias("seconds"))


def submit(voxels: DataFrame, meta: DataFrame, scale, arm: Arm) -> tuple[DataFrame, DataFrame]:
    """(submission rows, defects of the graphs behind them)."""
    nodes, edges = graph.densify(*predict(voxels, meta, scale, arm))
    return submission.build_submission(nodes, edges), graph.check_graph(nodes, edges)

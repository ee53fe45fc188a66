"""Descriptive statistics of ground truth: inventory, motion, density, ceilings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import near_face, norm3
from trackspark.operators.edges import degrees, with_endpoints
from trackspark.operators.ordering import exact_percentiles
from trackspark.schema import DEFAULT_SCALE, MATCH_RADIUS_UM


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """Counts per rank of the true successor, ``>5`` beyond the searched ranks."""
    label = F.coalesce(F.col("rank").cast("string"), F.lit(">5"))
    return ranks.groupBy(label.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def identity_counts(links: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame) -> DataFrame:
    """Edge TP/FP/FN when predicted nodes are the true nodes (matching is the identity).

    ``links(dataset, source_id, target_id[, mode])`` already span one frame.
    """
    mode = [c for c in ("mode",) if c in links.columns]
    truth = (gt_edges.select("dataset", "source_id", "target_id").distinct()
             .withColumn("_tp", F.lit(True)))
    outs = gt_edges.select("dataset", "source_id").distinct().withColumn("_out", F.lit(True))
    ins = gt_edges.select("dataset", "target_id").distinct().withColumn("_in", F.lit(True))
    marked = (links.select(*mode, "dataset", "source_id", "target_id").distinct()
              .join(truth, ["dataset", "source_id", "target_id"], "left")
              .join(outs, ["dataset", "source_id"], "left")
              .join(ins, ["dataset", "target_id"], "left"))
    tp = F.coalesce("_tp", F.lit(False))
    seen = F.coalesce("_out", F.lit(False)) | F.coalesce("_in", F.lit(False))
    hits = marked.groupBy(*mode, "dataset").agg(
        F.count_if(tp).alias("edge_tp"), F.count_if(seen & ~tp).alias("edge_fp"))
    totals = gt_nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("_nodes")).join(
        truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("_edges")), "dataset", "left")
    return (totals.join(hits, "dataset", "left")
            .fillna(0, ["edge_tp", "edge_fp", "_edges"])
            .select(*mode, "dataset", "edge_tp", "edge_fp",
                    (F.col("_edges") - F.col("edge_tp")).alias("edge_fn")))


def linking_ceiling(links: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame,
                    budgets: DataFrame) -> DataFrame:
    """Pooled and budget-adjusted Jaccard of linking perfect detections, per ``mode``."""
    counts = identity_counts(links, gt_nodes, gt_edges)
    sizes = gt_nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("_nodes"))
    ratio = (F.col("_nodes") - F.col("est_total")) / F.col("est_total")
    weight = F.col("edge_tp") + F.col("edge_fp") + F.col("edge_fn")
    jaccard = F.col("edge_tp") / F.greatest(weight, F.lit(1))
    usable = F.col("est_total") > 0
    per = (counts.join(sizes, "dataset").join(budgets, "dataset", "left")
           .withColumn("_w", weight)
           .withColumn("_a", F.when(usable, F.greatest(F.lit(0.0), jaccard * (1 - 0.1 * ratio)))))
    return per.groupBy("mode").agg(
        F.sum("edge_tp").alias("edge_tp"), F.sum("edge_fp").alias("edge_fp"),
        F.sum("edge_fn").alias("edge_fn"),
        F.round(F.sum("edge_tp") / F.greatest(F.sum("_w"), F.lit(1)), 6).alias("edge_jaccard"),
        F.round(F.try_divide(F.sum(F.col("_a") * F.col("_w")), F.sum(F.when(usable, F.col("_w")))), 6)
        .alias("adj_edge_jaccard"))


def inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, divisions and frame range per dataset with a total row (null dataset)."""
    d = degrees(nodes, edges)
    return d.rollup("dataset").agg(
        F.count(F.lit(1)).alias("gt_nodes"), F.sum("out_degree").alias("gt_edges"),
        F.count_if(F.col("out_degree") == 2).alias("divisions"),
        F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def annotated_fraction(nodes: DataFrame, budgets: DataFrame, n_t: int) -> DataFrame:
    """Annotated share of the budget and per-frame rates, per dataset."""
    return (nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("gt_nodes"))
            .join(budgets, "dataset", "left")
            .select("dataset", "gt_nodes",
                    F.when(F.col("est_total") > 0, F.col("gt_nodes") / F.col("est_total"))
                    .alias("annotated_fraction"),
                    (F.col("gt_nodes") / n_t).alias("gt_per_frame"),
                    (F.col("est_total") / n_t).alias("est_per_frame")))


def displacements(nodes: DataFrame, edges: DataFrame, scale=DEFAULT_SCALE) -> DataFrame:
    """Per edge: dt, total displacement and its depth and in-plane parts, in µm."""
    spatial = with_endpoints(edges, nodes, ("t", "z", "y", "x"))
    dz, dy, dx = [(F.col(f"d_{a}") - F.col(f"s_{a}")) * F.lit(float(s))
                  for a, s in zip("zyx", scale)]
    return spatial.select(
        "dataset", "edge_id", (F.col("d_t") - F.col("s_t")).alias("dt"),
        norm3(dz, dy, dx).alias("d"), F.abs(dz).alias("dz"),
        F.sqrt(dy * dy + dx * dx).alias("dxy"))


def displacement_summary(moves: DataFrame, group: list[str]) -> DataFrame:
    """Percentiles of displacement, share beyond the match radius, edges with dt <> 1."""
    keys = group or ["_all"]
    data = moves if group else moves.withColumn("_all", F.lit(0))
    levels = exact_percentiles(data, keys, "d", {
        "p50": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99, "p999": .999})
    basics = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_edges"), F.max("d").alias("max_um"),
        F.avg((F.col("d") > MATCH_RADIUS_UM).cast("double")).alias("share_beyond"),
        F.count_if(F.col("dt") != 1).alias("bad_dt"))
    return levels.join(basics, keys).drop("_all")


def frame_interval(median_um: DataFrame, speeds: dict[str, float]) -> DataFrame:
    """Seconds per frame implied by the median displacement at each reference speed (µm/min)."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("stage"), F.lit(float(v)).alias("speed"))
        for name, v in speeds.items()]))
    return (median_um.withColumn("_s", rows)
            .select("*", "_s.stage", "_s.speed").drop("_s")
            .withColumn("interval_s", F.lit(60.0) * F.col("median_um") / F.col("speed")))


def depth_profile(nodes: DataFrame, depth: int, bins: int = 10) -> DataFrame:
    """Share of nodes per depth bin over [0, depth]; the last bin is closed."""
    inside = nodes.where((F.col("z") >= 0) & (F.col("z") <= depth))
    slot = F.least(F.floor(F.col("z") * bins / F.lit(float(depth))), F.lit(bins - 1))
    counts = [F.count_if(slot == b).alias(f"b{b}") for b in range(bins)]
    sized = inside.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"), *counts)
    return sized.select("dataset", *[(F.col(f"b{b}") / F.col("_n")).alias(f"b{b}")
                                     for b in range(bins)])


def division_rate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dividing nodes, nodes with a successor, edges and both rates; null dataset = pooled."""
    d = degrees(nodes, edges)
    return (d.rollup("dataset").agg(
        F.count_if(F.col("out_degree") == 2).alias("divisions"),
        F.count_if(F.col("out_degree") > 0).alias("with_successor"),
        F.sum("out_degree").alias("n_edges"))
        .withColumns({
            "division_rate": F.col("divisions") / F.greatest(F.col("with_successor"), F.lit(1)),
            "per_1000_edges": F.lit(1000.0) * F.col("divisions")
            / F.greatest(F.col("n_edges"), F.lit(1))}))


def interior_ends(nodes: DataFrame, edges: DataFrame, dims) -> DataFrame:
    """nodes with ``near_face`` and whether they start or end a track strictly inside the movie."""
    span = nodes.groupBy("dataset").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    d = degrees(nodes, edges).join(span, "dataset")
    inside = (F.col("t") > F.col("_lo")) & (F.col("t") < F.col("_hi"))
    return d.select("dataset", "node_id", "t", near_face(dims).alias("near_face"),
                    (inside & (F.col("in_degree") == 0)).alias("is_start"),
                    (inside & (F.col("out_degree") == 0)).alias("is_end"))


def border_rates(marked: DataFrame) -> DataFrame:
    near = F.col("near_face").cast("double")
    return marked.groupBy("dataset").agg(
        F.count_if("is_start").alias("starts"), F.count_if("is_end").alias("ends"),
        F.coalesce(F.avg(F.when(F.col("is_start"), near)), F.lit(0.0)).alias("start_share"),
        F.coalesce(F.avg(F.when(F.col("is_end"), near)), F.lit(0.0)).alias("end_share"))


def clumping(observed: DataFrame, null: DataFrame) -> DataFrame:
    """Median observed spacing against a null field, with a verdict per dataset."""
    o = exact_percentiles(observed, ["dataset"], "d", {"observed_um": 0.5})
    n = exact_percentiles(null, ["dataset"], "d", {"null_um": 0.5})
    ratio = F.col("observed_um") / F.greatest(F.col("null_um"), F.lit(1e-9))
    return (o.join(n, "dataset").withColumn("ratio", ratio)
            .withColumn("verdict", F.when(F.col("ratio") < 0.85, "CLUMPED")
                        .when(F.col("ratio") > 1.15, "dispersed").otherwise("~uniform")))


def uniform_null(nodes: DataFrame) -> DataFrame:
    """The same number of points per frame, placed uniformly in the frame's bounding box.

    Positions come from a hash of the node id, so the field is the same in every run.
    """
    box = nodes.groupBy("dataset", "t").agg(
        *[F.min(f"{a}u").alias(f"lo{a}") for a in "zyx"],
        *[F.max(f"{a}u").alias(f"hi{a}") for a in "zyx"])
    grain = 1_000_003
    step = {"z": 7919, "y": 104729, "x": 15485863}
    return nodes.join(box, ["dataset", "t"]).select(
        "dataset", "t", "node_id", *[
            (F.col(f"lo{a}") + (F.col(f"hi{a}") - F.col(f"lo{a}"))
             * ((F.col("node_id") * step[a] + 17) % grain) / F.lit(float(grain))).alias(f"{a}u")
            for a in "zyx"])


def crowded_frames(nodes: DataFrame, least: int = 10) -> DataFrame:
    """Nodes of frames holding at least ``least`` nodes."""
    big = (nodes.groupBy("dataset", "t").count().where(F.col("count") >= least)
           .select("dataset", "t"))
    return nodes.join(big, ["dataset", "t"], "left_semi")

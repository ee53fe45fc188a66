"""Assignment-based queries: optimal links, ground-truth matching, end-to-end scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators import assign, recon, score, spatial
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6
from trackspark.plans.predict import Arm, Linker, evaluate, link
from trackspark.plans.spatial_queries import _CEILING, _D, nearest_sql
from trackspark.session import cut_lineage


@query("j4_optimal_links", "J4")
def optimal_links(i: Inputs):
    return assign.link_optimal(with_um(i.pred), 9.0)


@query("j4_priced_links", "J4", ctes("gt") + f""",
near AS (SELECT a.dataset, a.t, a.node_id AS source_id, min({{'d': {_D}, 'id': b.node_id}}) AS best
  FROM gt a JOIN gt b ON a.dataset = b.dataset AND b.t = a.t + 1 WHERE {_D} < 9 GROUP BY ALL),
sizes AS (SELECT dataset, t, count(*) AS n FROM gt GROUP BY ALL)
SELECT k.dataset, k.t, count(*) AS n_links, round(sum(k.best.d), 6) AS total_um
FROM near k JOIN sizes s ON s.dataset = k.dataset AND s.t = k.t
JOIN sizes u ON u.dataset = k.dataset AND u.t = k.t + 1 AND s.n <= u.n
GROUP BY k.dataset, k.t, s.n HAVING count(*) = s.n AND count(DISTINCT k.best.id) = s.n""")
def priced_links(i: Inputs):
    """Length of the optimal links of the frames whose nearest choices are one-to-one.

    There the optimum is the sum of the nearest distances, so that SQL can state it; all frames
    are solved by pricing before those are looked up.
    """
    placed = cut_lineage(with_um(i.gt), "placed")
    links = assign.link_optimal(placed, 9.0, "priced")
    sizes = placed.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"))
    following = sizes.select("dataset", (F.col("t") - 1).alias("t"), F.col("n").alias("n_next"))
    lone = (spatial.nearest_links(placed, 9.0).groupBy("dataset", "t")
            .agg(F.count(F.lit(1)).alias("near"), F.count_distinct("target_id").alias("chosen"))
            .join(sizes, ["dataset", "t"]).join(following, ["dataset", "t"])
            .where("near = n AND chosen = n AND n <= n_next").select("dataset", "t"))
    return (links.join(lone, ["dataset", "t"], "left_semi").groupBy("dataset", "t")
            .agg(F.count(F.lit(1)).alias("n_links"), F.sum("d").alias("total_um"))
            .select("dataset", "t", "n_links", r6("total_um")))


@query("j5_sparse_links", "J5")
def sparse_links(i: Inputs):
    """Every frame pair taken through the path for frames too large to assign in full."""
    return assign.link_optimal(with_um(i.gt), 9.0, mode="gated")


@query("j6_matched_nodes", "J6 J7")
def matched_nodes(i: Inputs):
    return assign.match_nodes(i.pred, i.gt)


@query("j6_match_candidates", "J6 J7", ctes("pred", "gt") + f"""
SELECT a.dataset, a.t, a.node_id AS gt_id, b.node_id AS pred_id, round({_D}, 6) AS d
FROM gt a JOIN pred b ON a.dataset=b.dataset AND a.t=b.t WHERE {_D} <= 7""")
def match_candidates(i: Inputs):
    return assign.match_candidates(i.pred, i.gt).select("dataset", "t", "gt_id", "pred_id", r6("d"))


@query("j6_lone_pair_matches", "J6", ctes("pred", "gt") + f""",
c AS (SELECT a.dataset, a.t, a.node_id AS gt_id, b.node_id AS pred_id FROM gt a
  JOIN pred b ON a.dataset=b.dataset AND a.t=b.t WHERE {_D} <= 7),
k AS (SELECT *, count(*) OVER (PARTITION BY dataset, gt_id) AS ng, count(*) OVER (PARTITION BY dataset, pred_id) AS np FROM c)
SELECT dataset, gt_id, pred_id FROM k WHERE ng = 1 AND np = 1""")
def lone_pair_matches(i: Inputs):
    """Pairs with no competitor are matched in every regime: those of the full matching."""
    found = assign.match_nodes(i.pred, i.gt)
    pairs = assign.match_candidates(i.pred, i.gt)
    only_g = pairs.groupBy("dataset", "gt_id").count().where("count = 1").drop("count")
    only_p = pairs.groupBy("dataset", "pred_id").count().where("count = 1").drop("count")
    return (found.join(only_g, ["dataset", "gt_id"], "left_semi")
            .join(only_p, ["dataset", "pred_id"], "left_semi")
            .select("dataset", "gt_id", "pred_id"))


@query("a18_linking_ceiling_optimal", "A18")
def linking_ceiling_optimal(i: Inputs):
    links = assign.link_optimal(with_um(i.gt), 25.0).withColumn("mode", F.lit("optimal"))
    return recon.linking_ceiling(links, i.gt, i.gt_edges, i.budgets)


@query("a21_recall_at_budget", "A21")
def recall_at_budget(i: Inputs):
    return assign.recall_at_budget(i.pred, i.gt)


@query("g15_scored_prediction", "G15 X1")
def scored_prediction(i: Inputs):
    nodes = cut_lineage(i.pred, "nodes")
    links = assign.link_optimal(with_um(nodes), 9.0)
    edges = cut_lineage(links.select("dataset", F.col("source_id").alias("edge_id"),
                                     "source_id", "target_id"), "edges")
    matches = cut_lineage(assign.match_nodes(nodes, i.gt), "matches")
    return score.metric_rows(
        score.edge_counts(nodes, edges, matches, i.gt, i.gt_edges), i.budgets)


# Recordings of three microscopes: two sizes of their own, and one whose entry is no size.
_SIZES = {0: (2.0, 0.5, 0.5), 1: (1.0, 0.25, 0.25)}
_SCALED = "CASE CAST(split_part(dataset, '_', 2) AS INT) % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"


def _mixed_sql() -> str:
    axes = {"sz": (2.0, 1.0, 1.625), "sy": (0.5, 0.25, 0.40625), "sx": (0.5, 0.25, 0.40625)}
    sizes = ", ".join(f"CAST({_SCALED.format(*v)} AS DOUBLE) AS {name}" for name, v in axes.items())
    near = nearest_sql("placed", 9).replace("1.625", "a.sz").replace("0.40625", "a.sy")
    ceiling = _CEILING.replace(nearest_sql("gt", 25), near)
    return ceiling.replace(",\nlinks AS", f",\nplaced AS (SELECT *, {sizes} FROM gt),\nlinks AS", 1)


@query("x1_mixed_scales", "X1 S3 P1 J2", _mixed_sql() + """
SELECT dataset, CAST(tp AS BIGINT) AS edge_tp, CAST(fp AS BIGINT) AS edge_fp, CAST(fn AS BIGINT) AS edge_fn,
       round(CAST(tp AS DOUBLE) / w, 6) AS edge_jaccard, round(a, 6) AS adj_edge_jaccard FROM adj""")
def mixed_scales(i: Inputs):
    """Perfect detections of recordings of different scale, linked, matched and scored in one plan."""
    kind = F.split("dataset", "_")[1].cast("int") % 3
    size = F.when(kind == 0, F.array(*map(F.lit, _SIZES[0]))).when(kind == 1, F.array(*map(F.lit, _SIZES[1])))
    scales = cut_lineage(i.gt.select("dataset").distinct().select(
        "dataset", F.coalesce(size, F.array(F.lit(1.0))).alias("scale")), "scales")
    nodes, edges = link(i.gt, scales, Arm(join=Linker(mode="nearest", radius_um=9.0)))
    rows = evaluate(nodes, cut_lineage(edges, "edges"), i.gt, i.gt_edges, i.budgets, "mixed", scales)
    return rows.select("dataset", "edge_tp", "edge_fp", "edge_fn", r6("edge_jaccard"), r6("adj_edge_jaccard"))

"""Edge scoring against sparse ground truth, metric rows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scalars import budget_multiplier
from trackspark.operators import edges as E
from trackspark.schema import BUDGET_ALPHA, DIVISION_WEIGHT


def classify_edges(pred_nodes: DataFrame, pred_edges: DataFrame, matches: DataFrame,
                   gt_edges: DataFrame) -> DataFrame:
    """Surviving predicted edges with ``is_tp`` and ``is_visible``.

    Duplicates, edges not spanning one frame, merges and out-degree above two are
    repaired away first. An edge is visible to the metric only if its source matched a
    node with an out-edge or its target matched a node with an in-edge.
    """
    survivors = E.consecutive(E.first_of_duplicates(pred_edges), pred_nodes)
    survivors = E.cap_out_degree(E.collapse_merges(E.relabel(survivors, matches)))
    pairs = (gt_edges.select("dataset", F.col("source_id").alias("matched_source"),
                             F.col("target_id").alias("matched_target"))
             .distinct().withColumn("_tp", F.lit(True)))
    outs = (gt_edges.select("dataset", F.col("source_id").alias("matched_source"))
            .distinct().withColumn("_out", F.lit(True)))
    ins = (gt_edges.select("dataset", F.col("target_id").alias("matched_target"))
           .distinct().withColumn("_in", F.lit(True)))
    return (survivors.join(pairs, ["dataset", "matched_source", "matched_target"], "left")
            .join(outs, ["dataset", "matched_source"], "left")
            .join(ins, ["dataset", "matched_target"], "left")
            .select("dataset", "edge_id", "source_id", "target_id",
                    "matched_source", "matched_target",
                    F.coalesce("_tp", F.lit(False)).alias("is_tp"),
                    (F.coalesce("_out", F.lit(False)) | F.coalesce("_in", F.lit(False)))
                    .alias("is_visible")))


def edge_counts(pred_nodes: DataFrame, pred_edges: DataFrame, matches: DataFrame,
                gt_nodes: DataFrame, gt_edges: DataFrame) -> DataFrame:
    """Per dataset: edge TP/FP/FN, node totals, matched nodes, divisions.

    False negatives use the raw ground-truth edge count, repeats included.
    """
    marked = classify_edges(pred_nodes, pred_edges, matches, gt_edges)
    hits = marked.groupBy("dataset").agg(
        F.count_if("is_tp").alias("edge_tp"),
        F.count_if(F.col("is_visible") & ~F.col("is_tp")).alias("edge_fp"))
    pred = pred_nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("num_pred_nodes"))
    matched = matches.groupBy("dataset").agg(F.count(F.lit(1)).alias("num_matched_nodes"))
    gt = gt_nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("num_gt_nodes"))
    out = gt_edges.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("_deg"))
    truth = out.groupBy("dataset").agg(
        F.sum("_deg").alias("_edges"), F.count_if(F.col("_deg") > 1).alias("division_fn"))
    return (gt.join(truth, "dataset", "left").join(pred, "dataset", "left")
            .join(matched, "dataset", "left").join(hits, "dataset", "left").fillna(0)
            .select("dataset", "edge_tp", "edge_fp",
                    (F.col("_edges") - F.col("edge_tp")).alias("edge_fn"),
                    "division_fn", "num_pred_nodes", "num_matched_nodes", "num_gt_nodes"))


def metric_rows(counts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per-dataset metric row. ``budgets(dataset, est_total)``; missing values stay null."""
    total = F.col("edge_tp") + F.col("edge_fp") + F.col("edge_fn")
    jaccard = F.when(total > 0, F.col("edge_tp") / total)
    ratio = F.when(F.col("est_total") > 0,
                   (F.col("num_pred_nodes") - F.col("est_total")) / F.col("est_total"))
    return (counts.join(budgets, "dataset", "left")
            .withColumns({
                "division_tp": F.lit(0).cast("bigint"), "division_fp": F.lit(0).cast("bigint"),
                "node_recall": F.when(F.col("num_gt_nodes") > 0,
                                      F.col("num_matched_nodes") / F.col("num_gt_nodes")),
                "total_node_ratio": ratio, "edge_jaccard": jaccard})
            .withColumn("adj_edge_jaccard", F.when(
                jaccard.isNotNull() & ratio.isNotNull(),
                F.greatest(F.lit(0.0), F.col("edge_jaccard")
                           * (1 - F.lit(BUDGET_ALPHA) * F.col("total_node_ratio")))))
            .select(*[c for c in ("arm",) if c in counts.columns], "dataset",
                    "edge_tp", "edge_fp", "edge_fn", "division_tp", "division_fp", "division_fn",
                    "num_pred_nodes", "node_recall", "total_node_ratio", "edge_jaccard",
                    "adj_edge_jaccard"))


def _summary_columns():
    weight = F.col("edge_tp") + F.col("edge_fp") + F.col("edge_fn")
    adjusted = F.col("adj_edge_jaccard")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("edge_tp").alias("_tp"), F.sum(weight).alias("_w"),
        F.sum("division_tp").alias("_dtp"),
        F.sum(F.col("division_tp") + F.col("division_fp") + F.col("division_fn")).alias("_dw"),
        F.avg("node_recall").alias("node_recall"),
        F.count(adjusted).alias("n_adj"),
        F.sum(adjusted * weight).alias("_aw"),
        F.sum(F.when(adjusted.isNotNull(), weight)).alias("_aden"),
        F.sum("num_pred_nodes").alias("num_pred_nodes"),
        F.avg("total_node_ratio").alias("mean_node_ratio"),
    ]


def _finish_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    adj = F.when(F.col("_aden") > 0, F.col("_aw") / F.col("_aden"))
    division = F.when(F.col("_dw") > 0, F.col("_dtp") / F.col("_dw"))
    return df.select(
        *keys, "n",
        F.when(F.col("_w") > 0, F.col("_tp") / F.col("_w")).alias("edge_jaccard"),
        division.alias("division_jaccard"), "node_recall",
        adj.alias("adj_edge_jaccard"), "n_adj",
        F.when(F.col("_dw") > 0, adj + F.lit(DIVISION_WEIGHT) * division).otherwise(adj)
        .alias("score"),
        "num_pred_nodes", "mean_node_ratio")


def summarise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled scores per ``keys``.

    Edge and division Jaccard pool the counts; the adjusted Jaccard is a mean of the
    per-dataset values weighted by TP+FP+FN; the division term counts only where some
    division exists.
    """
    return _finish_summary(rows.groupBy(*keys).agg(*_summary_columns()), keys)


def summarise_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Per (arm, fold) and pooled per arm (fold null) in one aggregation."""
    joined = rows.join(folds, "dataset", "left").fillna(0, ["fold"])
    grouped = joined.groupingSets(
        [[F.col("arm"), F.col("fold")], [F.col("arm")]], F.col("arm"), F.col("fold"))
    return _finish_summary(grouped.agg(*_summary_columns()), ["arm", "fold"])


def arm_spread(rows: DataFrame) -> DataFrame:
    """Mean node ratio, effective budget multiplier and node total per arm."""
    s = summarise(rows, ["arm"])
    return s.select("arm", "mean_node_ratio",
                    F.when(F.col("edge_jaccard") > 0,
                           F.col("adj_edge_jaccard") / F.col("edge_jaccard")).alias("multiplier"),
                    "num_pred_nodes")


def multiplier_of(df: DataFrame, ratio: str = "total_node_ratio") -> DataFrame:
    return df.withColumn("multiplier", budget_multiplier(F.col(ratio)))

"""Assignments and repairs on cells that stay apart, where SQL can state the one optimum."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators import assign, recon, repair
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.predict import evaluate
from trackspark.plans.registry import query, r6
from trackspark.plans.repair_queries import GAP_SHARE, LIMITS
from trackspark.plans.spatial_queries import _D
from trackspark.session import cut_lineage


def _own(table: str) -> str:
    """Steps of one cell to the next frame; ids of a cell follow each other."""
    return (f"SELECT a.dataset, a.t, a.node_id AS source_id, b.node_id AS target_id, {_D} AS d FROM {table} a "
            f"JOIN {table} b ON b.dataset = a.dataset AND b.node_id = a.node_id + 1 AND b.t = a.t + 1")


@query("j4_unique_links", "J4", ctes("apart") + f"""
SELECT dataset, t, source_id, target_id, round(d, 6) AS d FROM ({_own('apart')}) o WHERE d <= 2""")
def unique_links(i: Inputs):
    """Every frame assigned in full: the least total joins each cell to itself, and steps over 2 µm go."""
    return assign.link_optimal(with_um(i.apart), 2.0).select("dataset", "t", "source_id", "target_id", r6("d"))


@query("j5_unique_links", "J5", ctes("apart_some") + f"""
SELECT dataset, t, source_id, target_id, round(d, 6) AS d FROM ({_own('apart_some')}) o""")
def unique_gated_links(i: Inputs):
    links = assign.link_optimal(with_um(i.apart_some), 9.0, mode="gated")
    return links.select("dataset", "t", "source_id", "target_id", r6("d"))


_NEAREST = ctes("apart_twins", "apart_gt") + f""",
c AS (SELECT a.dataset, a.t, a.node_id AS gt_id, b.node_id AS pred_id, {_D} AS d
  FROM apart_gt a JOIN apart_twins b ON a.dataset = b.dataset AND a.t = b.t WHERE {_D} <= 7),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, gt_id ORDER BY d) AS rn FROM c) q WHERE rn = 1)"""


@query("j6_unique_matches", "J6 J7", _NEAREST + """
SELECT dataset, t, gt_id, pred_id, round(d, 6) AS d FROM m""")
def unique_matches(i: Inputs):
    """True points that compete for no detection: each gets the nearer of one or two."""
    return assign.match_nodes(i.apart_twins, i.apart_gt).select("dataset", "t", "gt_id", "pred_id", r6("d"))


@query("a21_unique_recall", "A21", _NEAREST + """
SELECT g.dataset, round(CAST(count(m.gt_id) AS DOUBLE) / count(*), 6) AS recall
FROM apart_gt g LEFT JOIN m ON m.dataset = g.dataset AND m.gt_id = g.node_id GROUP BY g.dataset""")
def unique_recall(i: Inputs):
    return assign.recall_at_budget(i.apart_twins, i.apart_gt).select("dataset", r6("recall"))


_SCORED = ctes("apart", "gt_edges", "budgets") + f""",
own AS ({_own('apart')}),
hit AS (SELECT e.dataset, count(*) FILTER (WHERE o.d <= 2) AS tp, count(*) AS n FROM gt_edges e
  JOIN own o ON o.dataset = e.dataset AND o.source_id = e.source_id AND o.target_id = e.target_id GROUP BY e.dataset)"""


@query("g15_unique_score", "G15 X1", _SCORED + """,
size AS (SELECT dataset, count(*) AS nodes FROM apart GROUP BY dataset)
SELECT h.dataset, tp AS edge_tp, CAST(0 AS BIGINT) AS edge_fp, n - tp AS edge_fn, nodes AS num_pred_nodes, CAST(1 AS DOUBLE) AS node_recall,
  round(greatest(CAST(0 AS DOUBLE), CAST(tp AS DOUBLE) / n * (1 - 0.1 * (nodes - est_total) / est_total)), 6) AS adj_edge_jaccard
FROM hit h JOIN size s ON s.dataset = h.dataset JOIN budgets b ON b.dataset = h.dataset""")
def unique_score(i: Inputs):
    """Linked in full, matched and scored."""
    nodes = cut_lineage(i.apart.drop("cell"), "nodes")
    links = assign.link_optimal(with_um(nodes), 2.0)
    edges = cut_lineage(links.select("dataset", F.col("source_id").alias("edge_id"), "source_id", "target_id"), "edges")
    rows = evaluate(nodes, edges, i.apart_gt, i.gt_edges, i.budgets, "full")
    return rows.select("dataset", "edge_tp", "edge_fp", "edge_fn", "num_pred_nodes", "node_recall", r6("adj_edge_jaccard"))


@query("a18_unique_ceiling", "A18", ctes("apart_gt", "gt_edges", "budgets") + f""",
own AS ({_own('apart_gt')}),
per AS (SELECT e.dataset, count(*) FILTER (WHERE o.d <= 1.2) AS tp, count(*) AS n FROM gt_edges e
  JOIN own o ON o.dataset = e.dataset AND o.source_id = e.source_id AND o.target_id = e.target_id GROUP BY e.dataset),
adj AS (SELECT p.*, greatest(CAST(0 AS DOUBLE), CAST(tp AS DOUBLE) / n * (1 - 0.1 * (k.nodes - est_total) / est_total)) AS a FROM per p
  JOIN budgets b ON b.dataset = p.dataset JOIN (SELECT dataset, count(*) AS nodes FROM apart_gt GROUP BY dataset) k ON k.dataset = p.dataset)
SELECT 'optimal' AS mode, CAST(sum(tp) AS BIGINT) AS edge_tp, CAST(0 AS BIGINT) AS edge_fp, CAST(sum(n - tp) AS BIGINT) AS edge_fn,
  round(CAST(sum(tp) AS DOUBLE) / sum(n), 6) AS edge_jaccard, round(sum(a * n) / sum(n), 6) AS adj_edge_jaccard FROM adj""")
def unique_ceiling(i: Inputs):
    links = assign.link_optimal(with_um(i.apart_gt), 1.2).withColumn("mode", F.lit("optimal"))
    return recon.linking_ceiling(links, i.apart_gt, i.gt_edges, i.budgets)


def _gaps(table: str) -> str:
    mids = ", ".join(f"0.5 * (a.{c} + b.{c}) AS {c}" for c in "zyx")
    return (f"SELECT a.dataset, a.t, a.node_id AS end_id, b.node_id AS start_id, a.cell, {mids} FROM {table} a "
            f"JOIN {table} b ON b.node_id = a.node_id + 2 AND b.cell = a.cell "
            f"LEFT JOIN {table} m ON m.node_id = a.node_id + 1 WHERE m.node_id IS NULL")


def _size(table: str) -> str:
    return f"SELECT dataset, count(*) AS n, max(node_id) AS top FROM {table} GROUP BY dataset"


@query("g3_unique_gaps", "G3 J13 W8", ctes("apart_some") + f""",
gaps AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t, end_id) AS rn FROM ({_gaps('apart_some')}) g)
SELECT g.dataset, s.top + rn AS node_id, t + 1 AS t, z, y, x FROM gaps g JOIN ({_size('apart_some')}) s ON s.dataset = g.dataset
WHERE rn <= greatest(1, CAST(ceil(s.n * CAST({GAP_SHARE} AS DOUBLE)) AS BIGINT))""")
def unique_gaps(i: Inputs):
    nodes, _ = repair.close_gaps(i.apart_some.drop("cell"), i.clean_edges, max_share=GAP_SHARE)
    return nodes


@query("g10_unique_reuse", "G10 J16 U3 W8", ctes("apart_some", "apart_lone") + f""",
gaps AS (SELECT * FROM ({_gaps('apart_some')}) g),
fresh AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t, end_id) AS rn FROM gaps WHERE cell % 3 <> 0),
mid AS (SELECT dataset, end_id, start_id, end_id + 1 AS node_id FROM gaps WHERE cell % 3 = 0
  UNION ALL SELECT f.dataset, end_id, start_id, s.top + rn FROM fresh f JOIN ({_size('apart_lone')}) s ON s.dataset = f.dataset
  WHERE rn <= least(1900, greatest(1, CAST(round_even(s.n * CAST({GAP_SHARE} AS DOUBLE), 0) AS BIGINT))))
SELECT dataset, end_id AS source_id, node_id AS target_id FROM mid UNION ALL SELECT dataset, node_id, start_id FROM mid""")
def unique_reuse(i: Inputs):
    """Every third cell has a lone detection in its gap, which is reused; the others get a new node."""
    _, links = repair.close_gaps_reusing(i.apart_lone.drop("cell"), i.clean_edges, **LIMITS["gaps"])
    return links

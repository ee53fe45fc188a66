"""Grids of detection and link settings, all arms of a grid in one plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackspark.operators import gate, score
from trackspark.plans import sweep
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6
from trackspark.plans.spatial_queries import _D
from trackspark.session import shared_dir
from trackspark.sources.results import read_results, write_results

_FLOORS, _SEPS, _RADII = [0.0, 12.5], [2.1, 5.3, 9.7], [4.0, 6.0, 9.0]

# Perfect detections keep their own true point in the best matching whatever a view leaves out.
_ROWS = ctes("graded", "gt_edges", "budgets") + f""",
strong AS (SELECT a.dataset, a.node_id, min({_D}) AS c FROM graded a JOIN graded b ON a.dataset=b.dataset AND a.t=b.t
  AND (b.score > a.score OR (b.score = a.score AND b.node_id < a.node_id)) WHERE {_D} <= 9.7 GROUP BY ALL),
views AS (SELECT * FROM (SELECT CAST(unnest({_FLOORS}) AS DOUBLE) AS floor), (SELECT CAST(unnest({_SEPS}) AS DOUBLE) AS sep)),
arms AS (SELECT v.*, CAST(r.radius AS DOUBLE) AS radius FROM views v, (SELECT unnest({_RADII}) AS radius) r),
seen AS (SELECT v.floor, v.sep, g.* FROM graded g LEFT JOIN strong s ON s.dataset=g.dataset AND s.node_id=g.node_id
  JOIN views v ON g.score >= v.floor AND coalesce(s.c, 1e9) > v.sep),
near AS (SELECT a.floor, a.sep, a.dataset, a.node_id AS source_id, min({{'d': {_D}, 'id': b.node_id}}) AS best
  FROM seen a JOIN seen b ON a.floor=b.floor AND a.sep=b.sep AND a.dataset=b.dataset AND b.t=a.t+1 WHERE {_D} < 9 GROUP BY ALL),
marked AS (SELECT a.floor, a.sep, a.radius, n.dataset, (e.source_id IS NOT NULL) AS tp,
    (o.source_id IS NOT NULL OR i.target_id IS NOT NULL) AS vis
  FROM near n JOIN arms a ON a.floor=n.floor AND a.sep=n.sep AND n.best.d < a.radius
  LEFT JOIN gt_edges e ON e.dataset=n.dataset AND e.source_id=n.source_id AND e.target_id=n.best.id
  LEFT JOIN gt_edges o ON o.dataset=n.dataset AND o.source_id=n.source_id
  LEFT JOIN gt_edges i ON i.dataset=n.dataset AND i.target_id=n.best.id),
hits AS (SELECT floor, sep, radius, dataset, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE vis AND NOT tp) AS fp
  FROM marked GROUP BY ALL),
kept AS (SELECT floor, sep, dataset, count(*) AS n FROM seen GROUP BY ALL),
truth AS (SELECT dataset, count(*) AS edges FROM gt_edges GROUP BY dataset),
per AS (SELECT a.floor, a.sep, a.radius, g.dataset, coalesce(h.tp, 0) AS tp, coalesce(h.fp, 0) AS fp,
    coalesce(t.edges, 0) - coalesce(h.tp, 0) AS fn, coalesce(k.n, 0) AS n, (coalesce(k.n, 0) - b.est_total) / b.est_total AS ratio
  FROM (SELECT DISTINCT dataset FROM graded) g CROSS JOIN arms a JOIN budgets b ON b.dataset=g.dataset
  LEFT JOIN truth t ON t.dataset=g.dataset
  LEFT JOIN kept k ON k.floor=a.floor AND k.sep=a.sep AND k.dataset=g.dataset
  LEFT JOIN hits h ON h.floor=a.floor AND h.sep=a.sep AND h.radius=a.radius AND h.dataset=g.dataset),
adj AS (SELECT *, tp + fp + fn AS w, greatest(0.0, CAST(tp AS DOUBLE) / (tp + fp + fn) * (1 - 0.1 * ratio)) AS a FROM per),
pooled AS (SELECT floor, sep, radius, sum(n) AS nodes, sum(tp) AS tp, sum(w) AS w, sum(a * w) / sum(w) AS score FROM adj GROUP BY ALL)
"""


def _arms(i: Inputs):
    return sweep.grid_arms(i.gt.select("dataset").distinct(), _SEPS, _RADII, _FLOORS)


def _summary(i: Inputs):
    rows = sweep.evaluate_grid(i.graded, i.gt, i.gt_edges, i.budgets, _arms(i))
    return score.summarise(rows, ["floor", "sep", "radius"])


@query("x3_settings_grid", "X3 X1 J19", _ROWS + """
SELECT floor, sep, radius, CAST(nodes AS BIGINT) AS num_pred_nodes, round(CAST(tp AS DOUBLE) / w, 6) AS edge_jaccard,
  round(score, 6) AS score FROM pooled""")
def settings_grid(i: Inputs):
    """Least score x separation x link radius: 18 arms, one range join for each kind of candidate."""
    return _summary(i).select("floor", "sep", "radius", "num_pred_nodes", r6("edge_jaccard"), r6("score"))


@query("a27_swept_grid", "A27 X3", _ROWS + """
SELECT sep, round(max(CASE WHEN radius = 4 THEN score END), 6) AS r4, round(max(CASE WHEN radius = 6 THEN score END), 6) AS r6,
  round(max(CASE WHEN radius = 9 THEN score END), 6) AS r9 FROM pooled WHERE floor = 0 GROUP BY sep""")
def swept_grid(i: Inputs):
    """Scores by separation and radius, of an actual sweep."""
    grid = gate.score_grid(_summary(i).where("floor = 0"), "sep", "radius", _RADII)
    return grid.select("sep", *[F.round(f"`{r}`", 6).alias(f"r{r:g}") for r in _RADII])


@query("s10_resumed_grid", "S10 X1 X3", _ROWS + """
SELECT dataset, floor, sep, radius, CAST(tp AS BIGINT) AS edge_tp, CAST(fp AS BIGINT) AS edge_fp, CAST(fn AS BIGINT) AS edge_fn,
  round(a, 6) AS adj_edge_jaccard, (radius = 4) AS stored FROM adj""")
def resumed_grid(i: Inputs):
    """A grid whose arms of the smallest radius are stored already: only the others are evaluated."""
    path = f"{shared_dir(i.spark)}/results/{uuid.uuid4().hex}"
    arms = _arms(i)
    columns = [c for c in i.metric_rows.columns]
    first = sweep.evaluate_grid(i.graded, i.gt, i.gt_edges, i.budgets, arms.where("radius = 4"))
    write_results(first.select(*columns), path)
    stored = read_results(i.spark, path)
    rest = sweep.resume_grid(i.graded, i.gt, i.gt_edges, i.budgets, arms, stored)
    kept = stored.select(*columns, F.lit(True).alias("stored"))
    rows = kept.unionByName(rest.select(*columns, F.lit(False).alias("stored"))).join(arms, ["arm", "dataset"])
    return rows.select("dataset", "floor", "sep", "radius", "edge_tp", "edge_fp", "edge_fn", r6("adj_edge_jaccard"), "stored")

"""Spatial joins, link ceilings and motion statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators import recon, spatial
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6

_D = ("sqrt((a.z-b.z)*1.625*((a.z-b.z)*1.625)+(a.y-b.y)*0.40625*((a.y-b.y)*0.40625)"
      "+(a.x-b.x)*0.40625*((a.x-b.x)*0.40625))")


def pairs_sql(table: str, delta: int = 1) -> str:
    return (f"SELECT a.dataset, a.t, a.node_id AS source_id, b.node_id AS target_id, {_D} AS d "
            f"FROM {table} a JOIN {table} b ON a.dataset=b.dataset AND b.t=a.t+{delta}")


def nearest_sql(table: str, radius: float) -> str:
    return (f"SELECT dataset, t, source_id, target_id, d FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) AS rn "
            f"FROM ({pairs_sql(table)}) p WHERE d < {radius}) q WHERE rn = 1")


@query("j1_range_join", "J1 P1 F1", ctes("pred") + f"""
SELECT dataset, t, source_id, CAST(count(*) AS BIGINT) AS n_candidates,
       round(min(d), 6) AS nearest_um, round(avg(d), 6) AS mean_um
FROM ({pairs_sql('pred')}) p WHERE d <= 9 GROUP BY dataset, t, source_id""")
def range_candidates(i: Inputs):
    pairs = spatial.link_candidates(with_um(i.pred), 9.0)
    return (pairs.groupBy("dataset", "t", "source_id")
            .agg(F.count(F.lit(1)).alias("n_candidates"), F.min("d").alias("nearest_um"),
                 F.avg("d").alias("mean_um"))
            .select("dataset", "t", "source_id", "n_candidates", r6("nearest_um"), r6("mean_um")))


@query("j2_nearest_links", "J2 G1", ctes("pred") + f"""
SELECT dataset, t, source_id, target_id, round(d, 6) AS d FROM ({nearest_sql('pred', 9)}) n""")
def nearest_links(i: Inputs):
    links = spatial.nearest_links(with_um(i.pred), 9.0)
    return links.select("dataset", "t", "source_id", "target_id", r6("d"))


@query("j3_neighbour_spacing", "J3", ctes("pred") + f"""
SELECT a.dataset, a.t, a.node_id, round(min({_D}), 6) AS d
FROM pred a JOIN pred b ON a.dataset=b.dataset AND a.t=b.t AND a.node_id<>b.node_id
GROUP BY a.dataset, a.t, a.node_id""")
def neighbour_spacing(i: Inputs):
    return spatial.spacing(with_um(i.pred)).select("dataset", "t", "node_id", r6("d"))


_RANKED = f"""
SELECT dataset, source_id, target_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, source_id ORDER BY d, target_id) AS rank
  FROM ({pairs_sql('gt')}) p) q WHERE rank <= 5"""


@query("j11_successor_rank", "J11", ctes("gt_edges") + f"""
SELECT e.dataset, e.source_id, e.target_id AS true_id, CAST(r.rank AS BIGINT) AS rank
FROM gt_edges e LEFT JOIN ({_RANKED}) r
  ON r.dataset=e.dataset AND r.source_id=e.source_id AND r.target_id=e.target_id""")
def successor_rank(i: Inputs):
    ranks = spatial.successor_rank(with_um(i.gt), i.gt_edges)
    return ranks.select("dataset", "source_id", "true_id", F.col("rank").cast("bigint").alias("rank"))


@query("a17_nearest_is_true", "A17", ctes("gt_edges") + f"""
SELECT coalesce(CAST(r.rank AS STRING), '>5') AS rank, CAST(count(*) AS BIGINT) AS n
FROM gt_edges e LEFT JOIN ({_RANKED}) r
  ON r.dataset=e.dataset AND r.source_id=e.source_id AND r.target_id=e.target_id
GROUP BY 1""")
def nearest_is_true(i: Inputs):
    return recon.rank_histogram(spatial.successor_rank(with_um(i.gt), i.gt_edges))


_CEILING = ctes("gt_edges", "budgets") + f""",
links AS ({nearest_sql('gt', 25)}),
outs AS (SELECT DISTINCT dataset, source_id FROM gt_edges),
ins AS (SELECT DISTINCT dataset, target_id FROM gt_edges),
marked AS (
  SELECT l.dataset, (e.source_id IS NOT NULL) AS tp,
         (o.source_id IS NOT NULL OR n.target_id IS NOT NULL) AS seen
  FROM links l
  LEFT JOIN (SELECT DISTINCT dataset, source_id, target_id FROM gt_edges) e
    USING (dataset, source_id, target_id)
  LEFT JOIN outs o ON o.dataset=l.dataset AND o.source_id=l.source_id
  LEFT JOIN ins n ON n.dataset=l.dataset AND n.target_id=l.target_id),
c AS (SELECT dataset, sum(CASE WHEN tp THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN seen AND NOT tp THEN 1 ELSE 0 END) AS fp FROM marked GROUP BY dataset),
g AS (SELECT dataset, count(*) AS n FROM gt_edges GROUP BY dataset),
k AS (SELECT dataset, count(*) AS nodes FROM gt GROUP BY dataset),
per AS (SELECT k.dataset, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp,
               coalesce(n, 0) - coalesce(tp, 0) AS fn, (nodes - est_total) / est_total AS ratio
        FROM k JOIN budgets USING (dataset) LEFT JOIN g USING (dataset) LEFT JOIN c USING (dataset)),
adj AS (SELECT *, tp + fp + fn AS w,
               greatest(0.0, CAST(tp AS DOUBLE) / (tp + fp + fn) * (1 - 0.1 * ratio)) AS a FROM per)
"""


@query("j10_identity_edge_counts", "J10 A3", _CEILING + """
SELECT dataset, CAST(tp AS BIGINT) AS edge_tp, CAST(fp AS BIGINT) AS edge_fp,
       CAST(fn AS BIGINT) AS edge_fn FROM per""")
def identity_edge_counts(i: Inputs):
    links = spatial.nearest_links(with_um(i.gt), 25.0)
    return recon.identity_counts(links, i.gt, i.gt_edges)


@query("a18_linking_ceiling_greedy", "A18", _CEILING + """
SELECT 'greedy' AS mode, CAST(sum(tp) AS BIGINT) AS edge_tp, CAST(sum(fp) AS BIGINT) AS edge_fp,
       CAST(sum(fn) AS BIGINT) AS edge_fn,
       round(CAST(sum(tp) AS DOUBLE) / sum(w), 6) AS edge_jaccard,
       round(sum(a * w) / sum(w), 6) AS adj_edge_jaccard FROM adj""")
def linking_ceiling_greedy(i: Inputs):
    links = spatial.nearest_links(with_um(i.gt), 25.0).withColumn("mode", F.lit("greedy"))
    return recon.linking_ceiling(links, i.gt, i.gt_edges, i.budgets)

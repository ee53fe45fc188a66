"""Edge rules, scoring, graph repair checks and the submission table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import scalars
from trackspark.functions.geometry import near_face, to_original_voxels, with_um
from trackspark.operators import edges as E
from trackspark.operators import graph, recon, score, submission
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6

_LEN = ("sqrt((s.z-d.z)*1.625*((s.z-d.z)*1.625)+(s.y-d.y)*0.40625*((s.y-d.y)*0.40625)"
        "+(s.x-d.x)*0.40625*((s.x-d.x)*0.40625))")
_ENDS = ("FROM raw_edges e JOIN pred s ON s.dataset=e.dataset AND s.node_id=e.source_id "
         "JOIN pred d ON d.dataset=e.dataset AND d.node_id=e.target_id")


@query("p1_physical_coordinates", "P1", ctes("pred") + """
SELECT dataset, node_id, round(z*1.625, 6) AS zu, round(y*0.40625, 6) AS yu,
       round(x*0.40625, 6) AS xu FROM pred""")
def physical(i: Inputs):
    return with_um(i.pred).select("dataset", "node_id", r6("zu"), r6("yu"), r6("xu"))


@query("p2_original_voxels", "P2", ctes("pred") + """
SELECT dataset, node_id, z, y*4 AS y, x*4 AS x FROM pred""")
def original_voxels(i: Inputs):
    return to_original_voxels(i.pred).select("dataset", "node_id", "z", "y", "x")


@query("p3_consecutive_edges", "P3", ctes("raw_edges", "pred") + f"""
SELECT e.dataset, e.edge_id, e.source_id, e.target_id {_ENDS} WHERE d.t - s.t = 1""")
def consecutive(i: Inputs):
    return E.consecutive(i.raw_edges, i.pred).select("dataset", "edge_id", "source_id", "target_id")


@query("p4_long_edge_filter", "P4", ctes("raw_edges", "pred") + f"""
SELECT e.dataset, e.edge_id, round({_LEN}, 6) AS distance_um {_ENDS}
WHERE d.t - s.t = 1 AND {_LEN} <= 3.0""")
def long_edges(i: Inputs):
    return (E.drop_long(i.raw_edges, i.pred, 3.0)
            .select("dataset", "edge_id", r6("distance_um")))


@query("p4_drop_counters", "P4 A26", ctes("raw_edges", "pred") + f"""
SELECT r.dataset, CAST(r.n AS BIGINT) AS raw_edges, CAST(r.n - k.attached AS BIGINT) AS dropped_dangling,
       CAST(k.nc AS BIGINT) AS dropped_nonconsecutive, CAST(k.lg AS BIGINT) AS dropped_long
FROM (SELECT dataset, count(*) AS n FROM raw_edges GROUP BY dataset) r
JOIN (SELECT e.dataset, count(*) AS attached,
             sum(CASE WHEN d.t - s.t <> 1 THEN 1 ELSE 0 END) AS nc,
             sum(CASE WHEN d.t - s.t = 1 AND {_LEN} > 3.0 THEN 1 ELSE 0 END) AS lg
      {_ENDS} GROUP BY e.dataset) k USING (dataset)""")
def drop_counters(i: Inputs):
    return E.long_edge_counters(i.raw_edges, i.pred, 3.0)


@query("p7_volume_range", "P7", ctes("pred") + """
SELECT dataset, node_id FROM pred
WHERE z >= 0 AND z < 31 AND y >= 0 AND y < 121 AND x >= 0 AND x < 119""")
def volume_range(i: Inputs):
    from trackspark.operators.volume import inside
    return inside(i.pred, i.dims).select("dataset", "node_id")


@query("p8_near_face", "P8", ctes("pred") + """
SELECT dataset, node_id,
  (z*1.625 < 10 OR z*1.625 > 31*1.625-10 OR y*0.40625 < 10 OR y*0.40625 > 121*0.40625-10
   OR x*0.40625 < 10 OR x*0.40625 > 119*0.40625-10) AS near_face FROM pred""")
def faces(i: Inputs):
    return i.pred.select("dataset", "node_id", near_face(i.dims).alias("near_face"))


_DEG = """
deg AS (SELECT p.dataset, p.node_id, p.t, p.z, p.y, p.x, coalesce(o.n, 0) AS od, coalesce(n.n, 0) AS ind
  FROM pred p
  LEFT JOIN (SELECT dataset, source_id, count(*) AS n FROM raw_edges GROUP BY 1, 2) o
    ON o.dataset=p.dataset AND o.source_id=p.node_id
  LEFT JOIN (SELECT dataset, target_id, count(*) AS n FROM raw_edges GROUP BY 1, 2) n
    ON n.dataset=p.dataset AND n.target_id=p.node_id)"""


@query("p9_interior_ends", "P9", ctes("raw_edges", "pred") + "," + _DEG + """
SELECT dataset, node_id, (t > lo AND t < hi AND ind = 0) AS is_start,
       (t > lo AND t < hi AND od = 0) AS is_end
FROM (SELECT *, min(t) OVER (PARTITION BY dataset) AS lo, max(t) OVER (PARTITION BY dataset) AS hi
      FROM deg) q""")
def interior_ends(i: Inputs):
    return (recon.interior_ends(i.pred, i.raw_edges, i.dims)
            .select("dataset", "node_id", "is_start", "is_end"))


@query("p11_link_decision", "P11", ctes("raw_edges") + """
SELECT dataset, edge_id FROM raw_edges WHERE edge_prob > 0.55 / (1 + 0.55)""")
def link_decision(i: Inputs):
    keep = F.col("edge_prob") > scalars.link_threshold(F.lit(0.55))
    return i.raw_edges.where(keep).select("dataset", "edge_id")


@query("p12_probability", "P12", ctes("raw_edges") + """
SELECT dataset, edge_id, round(CASE WHEN edge_prob IS NULL THEN 0
  WHEN edge_prob < 0 OR edge_prob > 1 THEN 1 / (1 + exp(-greatest(-20.0, least(20.0, edge_prob))))
  ELSE edge_prob END, 6) AS p FROM raw_edges""")
def probability(i: Inputs):
    p = scalars.sanitise_probability(F.col("edge_prob"))
    return i.raw_edges.select("dataset", "edge_id", F.round(p, 6).alias("p"))


@query("j8_relabelled_edges", "J8", ctes("raw_edges", "matches") + """
SELECT e.dataset, e.edge_id, a.gt_id AS matched_source, b.gt_id AS matched_target
FROM raw_edges e
LEFT JOIN matches a ON a.dataset=e.dataset AND a.pred_id=e.source_id
LEFT JOIN matches b ON b.dataset=e.dataset AND b.pred_id=e.target_id""")
def relabelled(i: Inputs):
    return (E.relabel(i.raw_edges, i.matches)
            .select("dataset", "edge_id", "matched_source", "matched_target"))


_SURVIVE = ctes("raw_edges", "pred", "matches", "gt_edges") + """,
w1 AS (SELECT * FROM (SELECT *, row_number() OVER (
         PARTITION BY dataset, source_id, target_id ORDER BY edge_id) AS rn FROM raw_edges) q WHERE rn = 1),
p3 AS (SELECT e.dataset, e.edge_id, e.source_id, e.target_id, a.gt_id AS ms, b.gt_id AS mt
  FROM w1 e JOIN pred s ON s.dataset=e.dataset AND s.node_id=e.source_id
  JOIN pred d ON d.dataset=e.dataset AND d.node_id=e.target_id AND d.t - s.t = 1
  LEFT JOIN matches a ON a.dataset=e.dataset AND a.pred_id=e.source_id
  LEFT JOIN matches b ON b.dataset=e.dataset AND b.pred_id=e.target_id),
w2 AS (SELECT * FROM (SELECT *, CASE WHEN ms IS NULL OR mt IS NULL THEN 1 ELSE row_number() OVER (
         PARTITION BY dataset, ms, mt ORDER BY edge_id) END AS rk FROM p3) q WHERE rk = 1),
w3 AS (SELECT * FROM (SELECT *, row_number() OVER (
         PARTITION BY dataset, source_id ORDER BY edge_id) AS rs FROM w2) q WHERE rs <= 2),
cls AS (SELECT w.*, (g.source_id IS NOT NULL) AS is_tp,
          (o.source_id IS NOT NULL OR n.target_id IS NOT NULL) AS is_visible
  FROM w3 w
  LEFT JOIN (SELECT DISTINCT dataset, source_id, target_id FROM gt_edges) g
    ON g.dataset=w.dataset AND g.source_id=w.ms AND g.target_id=w.mt
  LEFT JOIN (SELECT DISTINCT dataset, source_id FROM gt_edges) o
    ON o.dataset=w.dataset AND o.source_id=w.ms
  LEFT JOIN (SELECT DISTINCT dataset, target_id FROM gt_edges) n
    ON n.dataset=w.dataset AND n.target_id=w.mt)
"""


@query("w1_first_duplicates", "W1", _SURVIVE + "SELECT dataset, edge_id, source_id, target_id FROM w1")
def first_duplicates(i: Inputs):
    return (E.first_of_duplicates(i.raw_edges)
            .select("dataset", "edge_id", "source_id", "target_id"))


@query("w2_collapsed_merges", "W2", _SURVIVE + "SELECT dataset, edge_id, ms AS matched_source, mt AS matched_target FROM w2")
def collapsed_merges(i: Inputs):
    e = E.consecutive(E.first_of_duplicates(i.raw_edges), i.pred)
    return (E.collapse_merges(E.relabel(e, i.matches))
            .select("dataset", "edge_id", "matched_source", "matched_target"))


@query("w3_out_degree_cap", "W3", ctes("raw_edges") + """
SELECT dataset, edge_id FROM (SELECT *, row_number() OVER (
  PARTITION BY dataset, source_id ORDER BY edge_id) AS rs FROM raw_edges) q WHERE rs <= 2""")
def out_degree_cap(i: Inputs):
    return E.cap_out_degree(i.raw_edges).select("dataset", "edge_id")


@query("j9_classified_edges", "J9 U5", _SURVIVE + "SELECT dataset, edge_id, is_tp, is_visible FROM cls")
def classified(i: Inputs):
    return (score.classify_edges(i.pred, i.raw_edges, i.matches, i.gt_edges)
            .select("dataset", "edge_id", "is_tp", "is_visible"))


_COUNTS = _SURVIVE + """,
cnt AS (SELECT g.dataset, coalesce(c.tp, 0) AS tp, coalesce(c.fp, 0) AS fp,
       e.n - coalesce(c.tp, 0) AS fn, p.n AS np, coalesce(m.n, 0) AS nm, g.n AS ng
  FROM (SELECT dataset, count(*) AS n FROM gt GROUP BY 1) g
  JOIN (SELECT dataset, count(*) AS n FROM gt_edges GROUP BY 1) e USING (dataset)
  JOIN (SELECT dataset, count(*) AS n FROM pred GROUP BY 1) p USING (dataset)
  LEFT JOIN (SELECT dataset, count(*) AS n FROM matches GROUP BY 1) m USING (dataset)
  LEFT JOIN (SELECT dataset, sum(CASE WHEN is_tp THEN 1 ELSE 0 END) AS tp,
                    sum(CASE WHEN is_visible AND NOT is_tp THEN 1 ELSE 0 END) AS fp
             FROM cls GROUP BY 1) c USING (dataset))
"""


@query("a3_edge_counts", "A3", _COUNTS + """
SELECT dataset, CAST(tp AS BIGINT) AS edge_tp, CAST(fp AS BIGINT) AS edge_fp,
       CAST(fn AS BIGINT) AS edge_fn, CAST(0 AS BIGINT) AS division_fn,
       CAST(np AS BIGINT) AS num_pred_nodes, CAST(nm AS BIGINT) AS num_matched_nodes,
       CAST(ng AS BIGINT) AS num_gt_nodes FROM cnt""")
def edge_counts(i: Inputs):
    return score.edge_counts(i.pred, i.raw_edges, i.matches, i.gt, i.gt_edges)


@query("a4_metric_rows", "A4 F15", ctes("raw_edges", "pred", "matches", "gt_edges", "budgets")
       + _COUNTS[len(ctes("raw_edges", "pred", "matches", "gt_edges")):] + """
SELECT dataset, CAST(tp AS BIGINT) AS edge_tp, CAST(fp AS BIGINT) AS edge_fp,
       CAST(fn AS BIGINT) AS edge_fn,
       round(CAST(nm AS DOUBLE) / ng, 6) AS node_recall,
       round((np - est_total) / est_total, 6) AS total_node_ratio,
       round(CAST(tp AS DOUBLE) / (tp + fp + fn), 6) AS edge_jaccard,
       round(greatest(0.0, CAST(tp AS DOUBLE) / (tp + fp + fn) * (1 - 0.1 * ((np - est_total) / est_total))), 6)
         AS adj_edge_jaccard
FROM cnt JOIN budgets USING (dataset)""")
def metric_rows(i: Inputs):
    rows = score.metric_rows(
        score.edge_counts(i.pred, i.raw_edges, i.matches, i.gt, i.gt_edges), i.budgets)
    return rows.select("dataset", "edge_tp", "edge_fp", "edge_fn", r6("node_recall"),
                       r6("total_node_ratio"), r6("edge_jaccard"), r6("adj_edge_jaccard"))


@query("a1_degrees", "A1", ctes("raw_edges", "pred") + "," + _DEG + """
SELECT dataset, node_id, CAST(od AS BIGINT) AS out_degree, CAST(ind AS BIGINT) AS in_degree FROM deg""")
def node_degrees(i: Inputs):
    return (E.degrees(i.pred, i.raw_edges)
            .select("dataset", "node_id", "out_degree", "in_degree"))


@query("a2_division_count", "A2", ctes("raw_edges", "pred") + "," + _DEG + """
SELECT dataset, CAST(sum(CASE WHEN od > 1 THEN 1 ELSE 0 END) AS BIGINT) AS divisions,
       bool_or(od > 1) AS has_forks FROM deg GROUP BY dataset""")
def division_count(i: Inputs):
    return E.degrees(i.pred, i.raw_edges).groupBy("dataset").agg(
        F.count_if(F.col("out_degree") > 1).alias("divisions"),
        F.bool_or(F.col("out_degree") > 1).alias("has_forks"))


@query("j18_open_ends", "J18", ctes("raw_edges", "pred") + "," + _DEG + """
SELECT dataset, node_id, (od = 0) AS is_end, (ind = 0) AS is_start, (od = 0 AND ind = 0) AS is_isolated
FROM deg""")
def open_ends(i: Inputs):
    return (E.open_ends(i.pred, i.raw_edges)
            .select("dataset", "node_id", "is_end", "is_start", "is_isolated"))


_MEASURED = ctes("raw_edges", "pred") + f""",
m AS (SELECT e.*, s.t AS st, d.t AS dt, {_LEN} AS distance_um {_ENDS} WHERE d.t - s.t = 1 AND {_LEN} <= 14.2)
"""


def _best_sql(end: str) -> str:
    return _MEASURED + f"""SELECT dataset, edge_id, source_id, target_id FROM (
SELECT *, row_number() OVER (PARTITION BY dataset, {end}
  ORDER BY coalesce(edge_prob, 0) DESC, distance_um, edge_id) AS rn FROM m) q WHERE rn = 1"""


@query("t5_single_parent", "T5", _best_sql("target_id"))
def single_parent(i: Inputs):
    return (graph.single_parent(E.drop_long(i.raw_edges, i.pred))
            .select("dataset", "edge_id", "source_id", "target_id"))


@query("t5_single_child", "T5", _best_sql("source_id"))
def single_child(i: Inputs):
    return (graph.single_child(E.drop_long(i.raw_edges, i.pred))
            .select("dataset", "edge_id", "source_id", "target_id"))


@query("w11_only_successor", "W11", ctes("raw_edges") + """
SELECT dataset, source_id AS node_id, min(target_id) AS next_id FROM raw_edges
GROUP BY dataset, source_id HAVING count(*) = 1""")
def only_successor(i: Inputs):
    return E.only_neighbour(i.raw_edges, "source_id", "target_id", "next_id")


_CHAIN = ctes("raw_edges", "pred") + f""",
v AS (SELECT e.dataset, e.source_id, e.target_id {_ENDS} WHERE d.t - s.t = 1),
nx AS (SELECT dataset, source_id AS node_id, min(target_id) AS next_id FROM v GROUP BY 1, 2 HAVING count(*) = 1),
pv AS (SELECT dataset, target_id AS node_id, min(source_id) AS next_id FROM v GROUP BY 1, 2 HAVING count(*) = 1),
n1 AS (SELECT * FROM nx), n2 AS (SELECT a.dataset, a.node_id, b.next_id FROM nx a JOIN nx b ON b.dataset=a.dataset AND b.node_id=a.next_id),
p1 AS (SELECT * FROM pv), p2 AS (SELECT a.dataset, a.node_id, b.next_id FROM pv a JOIN pv b ON b.dataset=a.dataset AND b.node_id=a.next_id),
nb AS (SELECT dataset, node_id, 0 AS step, node_id AS other_id FROM pred
  UNION ALL SELECT dataset, node_id, 1, next_id FROM n1 UNION ALL SELECT dataset, node_id, 2, next_id FROM n2
  UNION ALL SELECT dataset, node_id, -1, next_id FROM p1 UNION ALL SELECT dataset, node_id, -2, next_id FROM p2)
"""


@query("w10_track_neighbours", "W10", _CHAIN + """
SELECT dataset, node_id, CAST(step AS BIGINT) AS step, other_id FROM nb""")
def track_neighbours(i: Inputs):
    return (graph.neighbourhood(i.pred, i.raw_edges)
            .select("dataset", "node_id", F.col("step").cast("bigint").alias("step"), "other_id"))


@query("g7_line_fit_smoothing", "G7", _CHAIN + """,
f AS (SELECT nb.dataset, nb.node_id, count(*) AS n,
        regr_intercept(o.z, nb.step) AS fz, regr_intercept(o.y, nb.step) AS fy, regr_intercept(o.x, nb.step) AS fx
      FROM nb JOIN pred o ON o.dataset=nb.dataset AND o.node_id=nb.other_id GROUP BY 1, 2)
SELECT p.dataset, p.node_id,
  round(CASE WHEN n >= 3 THEN 0.26 * z + 0.74 * fz ELSE z END, 6) AS z,
  round(CASE WHEN n >= 3 THEN 0.26 * y + 0.74 * fy ELSE y END, 6) AS y,
  round(CASE WHEN n >= 3 THEN 0.26 * x + 0.74 * fx ELSE x END, 6) AS x
FROM pred p JOIN f ON f.dataset=p.dataset AND f.node_id=p.node_id""")
def smoothing(i: Inputs):
    return (graph.smooth_tracks(i.pred, i.raw_edges)
            .select("dataset", "node_id", r6("z"), r6("y"), r6("x")))


@query("g4_prune_isolated", "G4", ctes("raw_edges", "pred") + "," + _DEG + """
SELECT dataset, node_id, CAST(row_number() OVER (PARTITION BY dataset ORDER BY node_id) - 1 AS BIGINT) AS new_id
FROM deg WHERE od > 0 OR ind > 0""")
def prune_isolated(i: Inputs):
    kept = graph.prune_isolated(i.pred, i.raw_edges).withColumn("old_id", F.col("node_id"))
    nodes, _ = graph.densify(kept, i.raw_edges)
    return nodes.select("dataset", F.col("old_id").alias("node_id"), F.col("node_id").alias("new_id"))


@query("s1_dense_ids", "S1 D4 G2", ctes("gt_edges") + """,
n AS (SELECT dataset, node_id, row_number() OVER (PARTITION BY dataset ORDER BY node_id) - 1 AS i FROM gt)
SELECT e.dataset, e.edge_id, CAST(a.i AS BIGINT) AS source_id, CAST(b.i AS BIGINT) AS target_id
FROM gt_edges e JOIN n a ON a.dataset=e.dataset AND a.node_id=e.source_id
JOIN n b ON b.dataset=e.dataset AND b.node_id=e.target_id""")
def dense_ids(i: Inputs):
    _, edges = graph.densify(i.gt, i.gt_edges)
    return edges.select("dataset", "edge_id", "source_id", "target_id")


_REACH = ctes("raw_edges", "pred") + """,
b AS (SELECT dataset, source_id AS u, target_id AS v FROM raw_edges
      UNION SELECT dataset, target_id, source_id FROM raw_edges),
reach(dataset, u, v) AS (SELECT dataset, node_id, node_id FROM pred
  UNION SELECT r.dataset, r.u, b.v FROM reach r JOIN b ON b.dataset=r.dataset AND b.u=r.v),
comp AS (SELECT dataset, u AS node_id, min(v) AS component FROM reach GROUP BY 1, 2)
"""


@query("g5_components", "G5", _REACH + "SELECT dataset, node_id, component FROM comp")
def components(i: Inputs):
    return graph.connected_components(i.pred, i.raw_edges)


@query("g5_short_track_filter", "G5", _REACH + """,
od AS (SELECT dataset, source_id, count(*) AS n FROM raw_edges GROUP BY 1, 2),
sz AS (SELECT c.dataset, c.component, count(*) AS n, bool_or(coalesce(od.n, 0) >= 2) AS div
  FROM comp c LEFT JOIN od ON od.dataset=c.dataset AND od.source_id=c.node_id GROUP BY 1, 2)
SELECT c.dataset, c.node_id FROM comp c JOIN sz USING (dataset, component)
WHERE sz.n >= 4 OR sz.div""")
def short_tracks(i: Inputs):
    nodes, _ = graph.long_tracks(i.pred, i.raw_edges)
    return nodes.select("dataset", "node_id")


@query("g6_track_lengths", "G6", _REACH + """,
sz AS (SELECT dataset, component, count(*) AS n FROM comp GROUP BY 1, 2)
SELECT dataset, CAST(count(*) AS BIGINT) AS n_tracks, round(quantile_cont(n, 0.5), 6) AS median_len,
       round(quantile_cont(n, 0.9), 6) AS p90_len FROM sz GROUP BY dataset""")
def track_lengths(i: Inputs):
    from trackspark.operators.ordering import exact_percentiles
    tracks = graph.track_table(i.pred, i.raw_edges)
    sizes = tracks.select("dataset", F.col("n_nodes").cast("double").alias("n"))
    return (exact_percentiles(sizes, ["dataset"], "n", {"median_len": .5, "p90_len": .9})
            .join(tracks.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_tracks")), "dataset")
            .select("dataset", "n_tracks", r6("median_len"), r6("p90_len")))


@query("g8_division_geometry", "G8", _MEASURED + f""",
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, source_id
  ORDER BY coalesce(edge_prob, 0) DESC, distance_um, edge_id) AS rn FROM m),
pair AS (SELECT a.dataset, a.source_id, (greatest(a.distance_um, b.distance_um) <= 10.5 AND {_LEN} <= 8.0) AS ok
  FROM k a JOIN k b ON b.dataset=a.dataset AND b.source_id=a.source_id AND a.rn=1 AND b.rn=2
  JOIN pred s ON s.dataset=a.dataset AND s.node_id=a.target_id
  JOIN pred d ON d.dataset=b.dataset AND d.node_id=b.target_id)
SELECT k.dataset, k.edge_id FROM k LEFT JOIN pair USING (dataset, source_id)
WHERE pair.ok IS NULL OR (pair.ok AND k.rn <= 2) OR (NOT pair.ok AND k.rn = 1)""")
def division_geometry(i: Inputs):
    return (graph.filter_divisions(E.drop_long(i.raw_edges, i.pred), i.pred)
            .select("dataset", "edge_id"))


_DENSE = ctes("raw_edges", "pred") + """,
num AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY node_id) - 1 AS i FROM pred),
de AS (SELECT e.dataset, e.edge_id, a.i AS s, b.i AS d, b.t - a.t AS dt FROM raw_edges e
  JOIN num a ON a.dataset=e.dataset AND a.node_id=e.source_id
  JOIN num b ON b.dataset=e.dataset AND b.node_id=e.target_id)
"""


@query("g13_graph_check", "G13", _DENSE + """
SELECT * FROM (
 SELECT dataset, 'not_one_frame' AS code, CAST(sum(CASE WHEN dt <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM de GROUP BY 1
 UNION ALL SELECT dataset, 'self_loop', CAST(sum(CASE WHEN s = d THEN 1 ELSE 0 END) AS BIGINT) FROM de GROUP BY 1
 UNION ALL SELECT dataset, 'duplicate_edge', CAST(sum(c - 1) AS BIGINT) FROM (SELECT dataset, s, d, count(*) AS c FROM de GROUP BY 1, 2, 3) q GROUP BY 1
 UNION ALL SELECT dataset, 'merge', CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT dataset, d, count(*) AS c FROM de GROUP BY 1, 2) q GROUP BY 1
 UNION ALL SELECT dataset, 'out_degree', CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT dataset, s, count(*) AS c FROM de GROUP BY 1, 2) q GROUP BY 1
) z WHERE n > 0""")
def graph_check(i: Inputs):
    nodes, edges = graph.densify(i.pred, i.raw_edges)
    return graph.check_graph(nodes, edges)


_FLAT = _DENSE + """,
flat AS (SELECT dataset, 'node' AS row_type, i AS node_id, t, CAST(round_even(z, 0) AS BIGINT) AS z,
    CAST(round_even(y, 0) AS BIGINT) AS y, CAST(round_even(x, 0) AS BIGINT) AS x,
    -1 AS source_id, -1 AS target_id, 0 AS k, i AS o FROM num
  UNION ALL SELECT dataset, 'edge', -1, -1, -1, -1, -1, s, d, 1, edge_id FROM de)
"""


@query("s8_submission_rows", "S8 W4 U2 F2 D9", _FLAT + """
SELECT CAST(row_number() OVER (ORDER BY dataset, k, o) - 1 AS BIGINT) AS id, dataset, row_type,
  CAST(node_id AS BIGINT) AS node_id, CAST(t AS BIGINT) AS t, z, y, x,
  CAST(source_id AS BIGINT) AS source_id, CAST(target_id AS BIGINT) AS target_id FROM flat""")
def submission_rows(i: Inputs):
    return submission.build_submission(*graph.densify(i.pred, i.raw_edges))


@query("w4_block_offsets", "W4", _FLAT + """,
c AS (SELECT dataset, sum(1 - k) AS nodes, sum(k) AS edges FROM flat GROUP BY dataset)
SELECT dataset, CAST(coalesce(sum(nodes + edges) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id,
       CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges FROM c""")
def block_offsets(i: Inputs):
    return submission.offsets(*graph.densify(i.pred, i.raw_edges))


@query("g14_submission_check", "G14 U4", ctes("raw_edges", "pred", "budgets", "names") + """,
pc AS (SELECT dataset, count(*) AS nodes FROM pred GROUP BY 1),
en AS (SELECT e.*, d.t - s.t AS dt FROM raw_edges e JOIN pred s ON s.dataset=e.dataset AND s.node_id=e.source_id
       JOIN pred d ON d.dataset=e.dataset AND d.node_id=e.target_id),
od AS (SELECT dataset, source_id, count(*) AS c FROM raw_edges GROUP BY 1, 2)
SELECT * FROM (
 SELECT dataset, 'problem' AS severity, 'not_one_frame' AS code, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS detail FROM en WHERE dt <> 1 GROUP BY 1
 UNION ALL SELECT dataset, 'problem', 'duplicate_edge', CAST(sum(c - 1) AS BIGINT), NULL FROM (SELECT dataset, source_id, target_id, count(*) AS c FROM raw_edges GROUP BY 1, 2, 3) q GROUP BY 1
 UNION ALL SELECT dataset, 'problem', 'out_degree', CAST(count(*) AS BIGINT), NULL FROM od WHERE c > 2 GROUP BY 1
 UNION ALL SELECT dataset, 'note', 'merge', CAST(count(*) AS BIGINT), NULL FROM (SELECT dataset, target_id, count(*) AS c FROM raw_edges GROUP BY 1, 2) q WHERE c > 1 GROUP BY 1
 UNION ALL SELECT p.dataset, 'note', 'summary', CAST(coalesce(q.n, 0) AS BIGINT), round(greatest(0.0, 1 - 0.1 * ((nodes - est_total) / est_total)), 6)
   FROM pc p JOIN budgets USING (dataset) LEFT JOIN (SELECT dataset, count(*) AS n FROM od WHERE c = 2 GROUP BY 1) q ON q.dataset=p.dataset
 UNION ALL SELECT dataset, 'fatal', 'missing_dataset', CAST(1 AS BIGINT), NULL FROM (SELECT dataset FROM names EXCEPT SELECT dataset FROM pred) q
 UNION ALL SELECT dataset, 'problem', 'unexpected_dataset', CAST(1 AS BIGINT), NULL FROM (SELECT dataset FROM pred EXCEPT SELECT dataset FROM names) q
) z WHERE n > 0 OR code = 'summary'""")
def submission_check(i: Inputs):
    rows = submission.build_submission(i.pred, i.raw_edges)
    return submission.validate(rows, i.names, i.budgets).withColumn("detail", F.round("detail", 6))


@query("s9_published_submission", "S9 S8 G14", _FLAT + """,
n AS (SELECT *, row_number() OVER (ORDER BY dataset, k, o) - 1 AS id FROM flat)
SELECT dataset, CAST(sum(1 - k) AS BIGINT) AS node_rows, CAST(sum(k) AS BIGINT) AS edge_rows, CAST(min(id) AS BIGINT) AS first_id,
  CAST(max(id) AS BIGINT) AS last_id, true AS readable, CAST(1 AS BIGINT) AS release FROM n GROUP BY dataset""")
def published_submission(i: Inputs):
    """The submission as written, audited and read back from its release."""
    import uuid

    from trackspark.operators import publish
    from trackspark.session import shared_dir
    path = f"{shared_dir(i.spark)}/releases-{uuid.uuid4().hex}"
    rows = submission.build_submission(*graph.densify(i.pred, i.raw_edges))
    publish.publish(rows, path, i.pred, i.budgets)
    back = publish.manifest(publish.read_published(i.spark, path))
    kept = publish.releases(i.spark, path).select("dataset", "release", F.col("content").alias("_c"))
    return back.join(kept, "dataset").select(
        "dataset", "node_rows", "edge_rows", "first_id", "last_id", (F.col("content") == F.col("_c")).alias("readable"), "release")


@query("s14_run_stats", "S14 A26", ctes("raw_edges", "pred") + "," + _DEG + """
SELECT dataset, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(od) AS BIGINT) AS edges,
  CAST(sum(CASE WHEN od >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS division_like_sources,
  round(CAST(sum(od) AS DOUBLE) / count(*), 6) AS edge_to_node_ratio FROM deg GROUP BY dataset""")
def run_stats(i: Inputs):
    return (submission.run_stats(i.pred, i.raw_edges)
            .select("dataset", "nodes", "edges", "division_like_sources", r6("edge_to_node_ratio")))


@query("g3_append_ids", "U3", ctes("pred", "lossy_edges") + """,
extra AS (SELECT p.dataset, p.t + 1 AS t, p.node_id AS from_id FROM pred p LEFT JOIN lossy_edges e
  ON e.dataset=p.dataset AND e.source_id=p.node_id WHERE e.source_id IS NULL)
SELECT e.dataset, e.from_id, CAST(m.top + row_number() OVER (PARTITION BY e.dataset ORDER BY e.t, e.from_id) AS BIGINT) AS node_id
FROM extra e JOIN (SELECT dataset, max(node_id) AS top FROM pred GROUP BY 1) m USING (dataset)""")
def append_ids(i: Inputs):
    extra = E.open_ends(i.pred, i.lossy_edges).where("is_end").select(
        "dataset", (F.col("t") + 1).alias("t"), F.col("node_id").alias("from_id"))
    return (graph.append_nodes(i.pred, extra, ["t", "from_id"])
            .select("dataset", "from_id", "node_id"))

"""Arms, gates, sampling, folds, descriptive statistics and the budget regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import scalars
from trackspark.functions.geometry import with_um
from trackspark.operators import budget, gate, recon, sampling, score, spatial
from trackspark.operators.ordering import exact_percentiles
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6
from trackspark.plans.spatial_queries import _D

_SUM = """count(*) AS n, CAST(sum(edge_tp) AS DOUBLE) / sum(edge_tp+edge_fp+edge_fn) AS ej,
  CASE WHEN sum(division_fn) > 0 THEN 0.0 END AS dj, avg(node_recall) AS nr,
  sum(adj_edge_jaccard * (edge_tp+edge_fp+edge_fn)) / sum(edge_tp+edge_fp+edge_fn) AS adj,
  sum(num_pred_nodes) AS npn, avg(total_node_ratio) AS ratio"""
_SCORE = "adj + 0.1 * coalesce(dj, 0)"


@query("a5_arm_summary", "A5", ctes("metric_rows") + f""", s AS (SELECT arm, {_SUM} FROM metric_rows GROUP BY arm)
SELECT arm, CAST(n AS BIGINT) AS n, round(ej, 6) AS edge_jaccard, CAST(dj AS DOUBLE) AS division_jaccard,
  round(nr, 6) AS node_recall, round(adj, 6) AS adj_edge_jaccard, round({_SCORE}, 6) AS score FROM s""")
def arm_summary(i: Inputs):
    return score.summarise(i.metric_rows, ["arm"]).select(
        "arm", "n", r6("edge_jaccard"), "division_jaccard", r6("node_recall"),
        r6("adj_edge_jaccard"), r6("score"))


@query("a6_fold_summary", "A6", ctes("metric_rows", "folds") + f""",
s AS (SELECT arm, fold, {_SUM} FROM metric_rows JOIN folds USING (dataset)
      GROUP BY GROUPING SETS ((arm, fold), (arm)))
SELECT arm, fold, CAST(n AS BIGINT) AS n, round(ej, 6) AS edge_jaccard, round({_SCORE}, 6) AS score FROM s""")
def fold_summary(i: Inputs):
    return score.summarise_folds(i.metric_rows, i.folds).select(
        "arm", "fold", "n", r6("edge_jaccard"), r6("score"))


@query("a24_arm_spread", "A24", ctes("metric_rows") + f""", s AS (SELECT arm, {_SUM} FROM metric_rows GROUP BY arm)
SELECT arm, round(ratio, 6) AS mean_node_ratio, round(adj / ej, 6) AS multiplier,
  CAST(npn AS BIGINT) AS num_pred_nodes FROM s""")
def arm_spread(i: Inputs):
    return score.arm_spread(i.metric_rows).select(
        "arm", r6("mean_node_ratio"), r6("multiplier"), "num_pred_nodes")


@query("a25_weight_share", "A25", ctes("metric_rows") + """
SELECT arm, dataset, round(CAST(edge_tp+edge_fp+edge_fn AS DOUBLE) / sum(edge_tp+edge_fp+edge_fn) OVER (PARTITION BY arm), 6) AS share,
  (adj_edge_jaccard = 0) AS zeroed FROM metric_rows""")
def weight_share(i: Inputs):
    return gate.weight_shares(i.metric_rows).select("arm", "dataset", r6("share"), "zeroed")


@query("f15_budget_multiplier", "F15", ctes("metric_rows") + """
SELECT arm, dataset, round(greatest(CAST(0 AS DOUBLE), 1 - 0.1 * total_node_ratio), 6) AS multiplier FROM metric_rows""")
def budget_multiplier(i: Inputs):
    return score.multiplier_of(i.metric_rows).select("arm", "dataset", r6("multiplier"))


_PAIRS = [("A", "N"), ("A", "R"), ("N", "R"), ("N", "A"), ("R", "A"), ("R", "N")]
_GATE = ctes("metric_rows", "folds") + f""",
sh AS (SELECT b.arm AS baseline, a.arm AS candidate, b.dataset FROM metric_rows b JOIN metric_rows a
       ON a.dataset=b.dataset AND a.arm<>b.arm),
m AS (SELECT sh.baseline, sh.candidate, 'b' AS role, f.fold, r.* FROM sh JOIN metric_rows r ON r.arm=sh.baseline AND r.dataset=sh.dataset JOIN folds f ON f.dataset=sh.dataset
  UNION ALL SELECT sh.baseline, sh.candidate, 'a', f.fold, r.* FROM sh JOIN metric_rows r ON r.arm=sh.candidate AND r.dataset=sh.dataset JOIN folds f ON f.dataset=sh.dataset),
s AS (SELECT baseline, candidate, role, fold, {_SUM} FROM m GROUP BY GROUPING SETS ((baseline, candidate, role, fold), (baseline, candidate, role))),
sc AS (SELECT baseline, candidate, role, fold, n, {_SCORE} AS score FROM s),
d AS (SELECT a.baseline, a.candidate, a.fold, a.n, a.score - b.score AS delta FROM sc a JOIN sc b
  ON a.baseline=b.baseline AND a.candidate=b.candidate AND a.role='a' AND b.role='b' AND a.fold IS NOT DISTINCT FROM b.fold),
v AS (SELECT baseline, candidate, max(CASE WHEN fold IS NULL THEN delta END) AS pooled,
  max(CASE WHEN fold IS NULL THEN n END) AS n_shared, max(CASE WHEN fold = 0 THEN delta END) AS f0,
  max(CASE WHEN fold = 1 THEN delta END) AS f1,
  sum(CASE WHEN fold IS NOT NULL AND delta < 0 THEN 1 ELSE 0 END) AS bad FROM d GROUP BY 1, 2),
verdict AS (SELECT *, (pooled > 0 AND bad = 0) AS promote FROM v)
"""


@query("x2_gate", "X2 J17 D8", _GATE + """
SELECT baseline, candidate, promote, round(pooled, 6) AS pooled_delta, round(f0, 6) AS fold_0,
  round(f1, 6) AS fold_1, CAST(n_shared AS BIGINT) AS n_shared, CAST(bad AS BIGINT) AS n_regressions FROM verdict""")
def gates(i: Inputs):
    v = gate.gate(i.metric_rows, i.folds, _PAIRS)
    return v.select("baseline", "candidate", "promote", r6("pooled_delta"),
                    F.round(F.element_at("fold_deltas", F.lit(0).cast("bigint")), 6).alias("fold_0"),
                    F.round(F.element_at("fold_deltas", F.lit(1).cast("bigint")), 6).alias("fold_1"),
                    "n_shared", "n_regressions")


@query("f13_gate_text", "F13", _GATE + """
SELECT baseline, candidate, concat(CASE WHEN promote THEN 'PROMOTE' ELSE 'REJECT' END, ' ',
  printf('%+.4f', pooled)) AS headline,
  (n_shared < (SELECT max(n) FROM (SELECT count(*) AS n FROM metric_rows GROUP BY arm) q)) AS partial
FROM verdict""")
def gate_text(i: Inputs):
    v = gate.gate(i.metric_rows, i.folds, _PAIRS)
    return v.select("baseline", "candidate", F.concat(
        F.when(F.col("promote"), "PROMOTE").otherwise("REJECT"), F.lit(" "),
        F.format_string("%+.4f", "pooled_delta")).alias("headline"),
        F.coalesce(F.get("reasons", F.lit(0)).startswith("compared on"), F.lit(False))
        .alias("partial"))


@query("w12_champion_chain", "W12", _GATE + """,
c(k, arm, gated_against, promoted, champion) AS (
  SELECT 0, CAST(NULL AS STRING), CAST(NULL AS STRING), false, 'N'
  UNION ALL SELECT c.k + 1, o.arm, c.champion, coalesce(v.promote, false),
    CASE WHEN coalesce(v.promote, false) THEN o.arm ELSE c.champion END
  FROM c JOIN (VALUES (1, 'A'), (2, 'R')) o(k, arm) ON o.k = c.k + 1
  LEFT JOIN verdict v ON v.baseline = c.champion AND v.candidate = o.arm)
SELECT arm, gated_against, promoted, champion FROM c WHERE k > 0""")
def champion_chain(i: Inputs):
    return gate.champion_chain(gate.gate(i.metric_rows, i.folds, _PAIRS), ["N", "A", "R"])


_ARMS = ctes("metric_rows") + f""", s0 AS (SELECT arm, {_SUM} FROM metric_rows GROUP BY arm),
s AS (SELECT *, {_SCORE} AS score FROM s0)"""


@query("w13_arm_ranking", "W13 T7", _ARMS + """
SELECT arm, round(score, 6) AS score, round(score - (SELECT score FROM s WHERE arm = 'A'), 6) AS delta,
  CAST(row_number() OVER (ORDER BY score DESC, arm DESC) AS BIGINT) AS rank FROM s""")
def arm_ranking(i: Inputs):
    s = score.summarise(i.metric_rows, ["arm"]).select("arm", "score")
    return gate.ranking(s, "A").select("arm", r6("score"), r6("delta"), "rank")


@query("t3_best_arm", "T3", _ARMS + """
SELECT arm, round(score, 6) AS score FROM s ORDER BY s.score DESC, arm DESC LIMIT 1""")
def best_arm(i: Inputs):
    return gate.best_arm(score.summarise(i.metric_rows, ["arm"])).select("arm", r6("score"))


@query("x4_margin_verdict", "X4 X5", _GATE + """
SELECT baseline, candidate, CASE WHEN pooled > 0.005 THEN 'CONFIRMED' WHEN pooled < -0.005 THEN 'FALSIFIED'
  ELSE 'INCONCLUSIVE' END AS verdict, (abs(pooled) > 0.005) AS drifted FROM verdict""")
def margin_verdict(i: Inputs):
    v = gate.gate(i.metric_rows, i.folds, _PAIRS)
    return v.select("baseline", "candidate", gate.margin_verdict(F.col("pooled_delta")).alias("verdict"),
                    gate.drifted(F.col("pooled_delta")).alias("drifted"))


@query("x6_score_decomposition", "X6", _ARMS + """
SELECT b.arm AS baseline, a.arm AS candidate, round((a.ej - b.ej) * (b.adj / b.ej), 6) AS from_edges,
  round(a.ej * (a.adj / a.ej - b.adj / b.ej), 6) AS from_multiplier
FROM s a JOIN s b ON a.arm <> b.arm""")
def score_decomposition(i: Inputs):
    d = gate.decompose(score.summarise(i.metric_rows, ["arm"]), _PAIRS)
    return d.select("baseline", "candidate", r6("from_edges"), r6("from_multiplier"))


@query("x7_gain_retention", "X7", _ARMS + """,
g AS (SELECT (SELECT score FROM s WHERE arm='R') - (SELECT score FROM s WHERE arm='A') AS og,
             (SELECT score FROM s WHERE arm='N') - (SELECT score FROM s WHERE arm='A') AS pg)
SELECT round(og, 6) AS oracle_gain, round(pg, 6) AS predicted_gain,
  round(CASE WHEN og > 0 THEN pg / og END, 4) AS retention,
  CASE WHEN og <= 0 THEN 'VACUOUS' WHEN pg / og >= 0.5 THEN 'CONFIRMED' ELSE 'FALSIFIED' END AS verdict FROM g""")
def gain_retention(i: Inputs):
    r = gate.retention(score.summarise(i.metric_rows, ["arm"]), "A", "R", "N")
    return r.select(r6("oracle_gain"), r6("predicted_gain"),
                    F.round("retention", 4).alias("retention"), "verdict")


# A two-parameter grid: separation from the return flag, radius from the line number.
_GRID = """g AS (SELECT CASE l_returnflag WHEN 'A' THEN 6.0 WHEN 'N' THEN 4.5 ELSE 3.5 END AS sep,
   CAST(3 + l_linenumber % 3 AS DOUBLE) AS radius, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2)"""


@query("a27_score_grid", "A27", f"WITH {_GRID}" + """
SELECT CAST(sep AS DOUBLE) AS sep, round(max(CASE WHEN radius = 3 THEN score END), 6) AS r3,
  round(max(CASE WHEN radius = 4 THEN score END), 6) AS r4,
  round(max(CASE WHEN radius = 5 THEN score END), 6) AS r5 FROM g GROUP BY sep""")
def score_grid(i: Inputs):
    sep = F.when(F.col("l_returnflag") == "A", 6.0).when(F.col("l_returnflag") == "N", 4.5).otherwise(3.5)
    cells = i.lineitem.groupBy(sep.alias("sep"), (3 + F.col("l_linenumber") % 3).cast("double").alias("radius")) \
        .agg(F.avg("l_discount").alias("score"))
    grid = gate.score_grid(cells, "sep", "radius", [3.0, 4.0, 5.0])
    return grid.select("sep", *[F.round(F.col(f"`{r}.0`"), 6).alias(f"r{r}") for r in (3, 4, 5)])


@query("t8_nearest_calibration", "T8 V15", ctes("pred") + """
, c AS (SELECT thr, count(*) AS n FROM pred JOIN (VALUES (50.0), (100.0), (150.0), (200.0)) v(thr) ON score > thr GROUP BY thr)
SELECT CAST(thr AS DOUBLE) AS threshold FROM c ORDER BY abs(n - (SELECT count(*) / 2.0 FROM pred)), thr LIMIT 1""")
def nearest_calibration(i: Inputs):
    # One pass: every detection counts towards the thresholds it clears.
    cleared = i.pred.select(F.explode(F.filter(
        F.array(*[F.lit(v) for v in (50.0, 100.0, 150.0, 200.0)]),
        lambda thr: F.col("score") > thr)).alias("threshold"))
    counts = cleared.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))
    target = i.pred.agg(F.count(F.lit(1)) / 2).scalar()
    return gate.nearest_to_target(counts.withColumn("gap", F.abs(F.col("n") - target)),
                                  "threshold", "gap", 0.0)


@query("j19_parameter_grid", "J19 D10", ctes("budgets") + """
SELECT dataset, CAST(sep AS DOUBLE) AS sep, CAST(radius AS DOUBLE) AS radius FROM budgets,
  (VALUES (6.0), (4.5), (3.5)) a(sep), (VALUES (9.0), (7.0), (5.0), (4.0)) b(radius)""")
def parameter_grid(i: Inputs):
    from trackspark.plans.sweep import with_grid
    return with_grid(i.budgets.select("dataset"), sep=[6.0, 4.5, 3.5], radius=[9.0, 7.0, 5.0, 4.0])


# -- folds and samples ---------------------------------------------------------

_HEXSUM = "(SELECT sum(strpos('0123456789abcdef', substr(h, k, 1)) - 1) FROM range(1, 41) r(k))"


@query("f7_hash_fold", "F7", ctes("names") + f"""
SELECT dataset, CAST({_HEXSUM} % 5 AS BIGINT) AS fold FROM (SELECT dataset, sha1(dataset) AS h FROM names) q""")
def hash_fold(i: Inputs):
    return sampling.hash_folds(i.names, 5)


@query("s7_split_folds", "S7", ctes("folds") + """
SELECT fold, CAST(count(*) AS BIGINT) AS n FROM folds GROUP BY fold""")
def split_folds(i: Inputs):
    # One listing row per test name, as an exploded splits file gives.
    splits = i.folds.select("fold", F.array("dataset").alias("test"))
    return sampling.fold_sizes(sampling.split_folds(splits))


@query("f8_embryo_fold", "F8 A8", ctes("names") + """
SELECT dataset, CAST(dense_rank() OVER (ORDER BY split_part(dataset, '_', 1)) - 1 AS BIGINT) AS fold FROM names""")
def embryo_fold(i: Inputs):
    return sampling.embryo_folds(i.names)


@query("a8_fold_sizes", "A8", ctes("names") + """
SELECT embryo, CAST(count(*) AS BIGINT) AS n, CAST(round_even(60.0 * count(*) / (SELECT count(*) FROM names), 0) AS BIGINT) AS take
FROM (SELECT split_part(dataset, '_', 1) AS embryo FROM names) q GROUP BY embryo""")
def fold_allocation(i: Inputs):
    return sampling.allocation(i.names, 60)


@query("w5_stratified_subset", "W5", ctes("names") + """,
e AS (SELECT dataset, split_part(dataset, '_', 1) AS embryo FROM names),
a AS (SELECT embryo, round_even(60.0 * count(*) / (SELECT count(*) FROM names), 0) AS take FROM e GROUP BY embryo),
r AS (SELECT dataset, embryo, row_number() OVER (PARTITION BY embryo ORDER BY sha1(dataset), dataset) AS rn FROM e)
SELECT dataset, embryo FROM r JOIN a USING (embryo) WHERE rn <= take""")
def stratified_subset(i: Inputs):
    return sampling.stratified_subset(i.names, 60)


@query("t9_evenly_spaced", "T9", ctes("names") + """,
r AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS pos FROM names),
k AS (SELECT DISTINCT CAST(floor(i * ((SELECT count(*) - 1 FROM names) / 16.0)) AS BIGINT) AS pos FROM range(17) t(i))
SELECT dataset FROM r JOIN k USING (pos)""")
def evenly_spaced(i: Inputs):
    return sampling.evenly_spaced(i.names, 17)


@query("s6_name_audit", "S6 U1 S12", ctes("names", "folds") + """
SELECT coalesce(a.dataset, b.dataset) AS dataset, CASE WHEN a.dataset IS NOT NULL AND b.dataset IS NOT NULL THEN 'usable'
  WHEN a.dataset IS NOT NULL THEN 'no_ground_truth' ELSE 'no_image' END AS status
FROM names a FULL JOIN folds b ON a.dataset = b.dataset""")
def name_audit(i: Inputs):
    return sampling.inventory_gaps(i.names, i.folds)


# -- descriptive statistics ----------------------------------------------------

_LEN = ("sqrt((d.z-s.z)*1.625*((d.z-s.z)*1.625)+(d.y-s.y)*0.40625*((d.y-s.y)*0.40625)"
        "+(d.x-s.x)*0.40625*((d.x-s.x)*0.40625))")
_MOVES = ctes("gt_edges") + f""",
mv AS (SELECT e.dataset, d.t - s.t AS dt, {_LEN} AS d, abs((d.z-s.z)*1.625) AS dz,
  sqrt((d.y-s.y)*0.40625*((d.y-s.y)*0.40625)+(d.x-s.x)*0.40625*((d.x-s.x)*0.40625)) AS dxy
  FROM gt_edges e JOIN gt s ON s.dataset=e.dataset AND s.node_id=e.source_id
  JOIN gt d ON d.dataset=e.dataset AND d.node_id=e.target_id)
"""


@query("a9_inventory", "A9", ctes("raw_edges", "gt", "gt_edges") + """,
o AS (SELECT dataset, source_id, count(*) AS n FROM gt_edges GROUP BY 1, 2)
SELECT g.dataset, CAST(count(*) AS BIGINT) AS gt_nodes, CAST(sum(coalesce(n, 0)) AS BIGINT) AS gt_edges,
  CAST(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS divisions, min(t) AS t_min, max(t) AS t_max
FROM gt g LEFT JOIN o ON o.dataset=g.dataset AND o.source_id=g.node_id GROUP BY ROLLUP (g.dataset)""")
def inventory(i: Inputs):
    return recon.inventory(i.gt, i.gt_edges)


@query("a10_annotated_fraction", "A10", ctes("gt", "budgets") + """,
f AS (SELECT dataset, count(*) / est_total AS f FROM gt JOIN budgets USING (dataset) GROUP BY dataset, est_total)
SELECT round(min(f), 6) AS lowest, round(quantile_cont(f, 0.5), 6) AS median, round(max(f), 6) AS highest FROM f""")
def annotated_fraction(i: Inputs):
    per = recon.annotated_fraction(i.gt, i.budgets, 20)
    levels = exact_percentiles(per, [], "annotated_fraction", {"lowest": 0, "median": .5, "highest": 1})
    return levels.select(r6("lowest"), r6("median"), r6("highest"))


_QS = [("p50", .5), ("p75", .75), ("p90", .9), ("p95", .95), ("p99", .99), ("p999", .999)]


def _move_sql(group: str) -> str:
    qs = ", ".join(f"round(quantile_cont(d, {q}), 6) AS {n}" for n, q in _QS)
    head = "dataset, " if group else ""
    return _MOVES + f"""SELECT {head}CAST(count(*) AS BIGINT) AS n_edges, {qs}, round(max(d), 6) AS max_um,
  round(avg(CASE WHEN d > 7 THEN 1.0 ELSE 0.0 END), 6) AS share_beyond,
  CAST(sum(CASE WHEN dt <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_dt FROM mv {group}"""


def _move_columns():
    return ["n_edges", *[r6(n) for n, _ in _QS], r6("max_um"), r6("share_beyond"), "bad_dt"]


@query("a11_displacement", "A11", _move_sql("GROUP BY dataset"))
def displacement(i: Inputs):
    moves = recon.displacements(i.gt, i.gt_edges)
    return recon.displacement_summary(moves, ["dataset"]).select("dataset", *_move_columns())


@query("a11_displacement_pooled", "A11", _move_sql(""))
def displacement_pooled(i: Inputs):
    moves = recon.displacements(i.gt, i.gt_edges)
    return recon.displacement_summary(moves, []).select(*_move_columns())


@query("a12_depth_plane_split", "A12", _MOVES + """
SELECT round(quantile_cont(dz, 0.5), 6) AS dz_p50, round(quantile_cont(dz, 0.9), 6) AS dz_p90,
  round(quantile_cont(dz, 0.99), 6) AS dz_p99, round(quantile_cont(dxy, 0.5), 6) AS dxy_p50,
  round(quantile_cont(dxy, 0.9), 6) AS dxy_p90, round(quantile_cont(dxy, 0.99), 6) AS dxy_p99 FROM mv""")
def depth_plane_split(i: Inputs):
    moves = recon.displacements(i.gt, i.gt_edges).withColumn("_k", F.lit(0))
    parts = [exact_percentiles(moves, ["_k"], c, {f"{c}_p50": .5, f"{c}_p90": .9, f"{c}_p99": .99})
             for c in ("dz", "dxy")]
    joined = parts[0].join(parts[1], "_k").drop("_k")
    return joined.select(*[r6(c) for c in joined.columns])


@query("a13_frame_interval", "A13", _MOVES + """
SELECT stage, CAST(speed AS DOUBLE) AS speed, round(60.0 * (SELECT quantile_cont(d, 0.5) FROM mv) / speed, 6) AS interval_s
FROM (VALUES ('somitogenesis', 0.83), ('epiboly', 1.0), ('peak_epiboly', 3.3)) v(stage, speed)""")
def frame_interval(i: Inputs):
    median = exact_percentiles(recon.displacements(i.gt, i.gt_edges), [], "d", {"median_um": .5})
    # Reference tissue speeds in µm per minute.
    speeds = {"somitogenesis": 0.83, "epiboly": 1.0, "peak_epiboly": 3.3}
    return recon.frame_interval(median, speeds).select("stage", "speed", r6("interval_s"))


@query("a14_depth_profile", "A14", ctes("gt") + """,
h AS (SELECT dataset, least(CAST(floor(z * 10 / 31.0) AS INT), 9) AS b FROM gt WHERE z >= 0 AND z <= 31)
SELECT dataset, """ + ", ".join(
    f"round(avg(CASE WHEN b = {b} THEN 1.0 ELSE 0.0 END), 6) AS b{b}" for b in range(10))
    + " FROM h GROUP BY dataset")
def depth_profile(i: Inputs):
    return recon.depth_profile(i.gt, 31).select("dataset", *[r6(f"b{b}") for b in range(10)])


@query("a15_division_rate", "A15", ctes("pred", "raw_edges") + """,
o AS (SELECT dataset, source_id, count(*) AS n FROM raw_edges GROUP BY 1, 2),
k AS (SELECT dataset, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS dv, count(*) AS su, sum(n) AS ne FROM o GROUP BY ROLLUP (dataset))
SELECT dataset, CAST(dv AS BIGINT) AS divisions, CAST(su AS BIGINT) AS with_successor, CAST(ne AS BIGINT) AS n_edges,
  round(CAST(dv AS DOUBLE) / su, 6) AS division_rate, round(1000.0 * dv / ne, 6) AS per_1000_edges FROM k""")
def division_rate(i: Inputs):
    return recon.division_rate(i.pred, i.raw_edges).select(
        "dataset", "divisions", "with_successor", "n_edges", r6("division_rate"), r6("per_1000_edges"))


@query("a16_border_rates", "A16", ctes("pred", "clean_edges") + """,
x AS (SELECT p.*, (o.source_id IS NULL) AS e, (n.target_id IS NULL) AS s,
  min(t) OVER (PARTITION BY p.dataset) AS lo, max(t) OVER (PARTITION BY p.dataset) AS hi,
  CASE WHEN z*1.625 < 10 OR z*1.625 > 31*1.625-10 OR y*0.40625 < 10 OR y*0.40625 > 121*0.40625-10
    OR x*0.40625 < 10 OR x*0.40625 > 119*0.40625-10 THEN 1.0 ELSE 0.0 END AS near
  FROM pred p LEFT JOIN (SELECT DISTINCT dataset, source_id FROM clean_edges) o ON o.dataset=p.dataset AND o.source_id=p.node_id
  LEFT JOIN (SELECT DISTINCT dataset, target_id FROM clean_edges) n ON n.dataset=p.dataset AND n.target_id=p.node_id)
SELECT dataset, CAST(sum(CASE WHEN s AND t > lo AND t < hi THEN 1 ELSE 0 END) AS BIGINT) AS starts,
  CAST(sum(CASE WHEN e AND t > lo AND t < hi THEN 1 ELSE 0 END) AS BIGINT) AS ends,
  round(coalesce(avg(CASE WHEN s AND t > lo AND t < hi THEN near END), 0), 6) AS start_share,
  round(coalesce(avg(CASE WHEN e AND t > lo AND t < hi THEN near END), 0), 6) AS end_share
FROM x GROUP BY dataset""")
def border_rates(i: Inputs):
    marked = recon.interior_ends(i.pred, i.clean_edges, i.dims)
    return recon.border_rates(marked).select("dataset", "starts", "ends", r6("start_share"), r6("end_share"))


@query("j20_clumping", "J20", ctes("pred") + f""",
big AS (SELECT dataset, t FROM pred GROUP BY 1, 2 HAVING count(*) >= 10),
p AS (SELECT * FROM pred JOIN big USING (dataset, t)),
box AS (SELECT dataset, t, min(z*1.625) AS lz, max(z*1.625) AS hz, min(y*0.40625) AS ly, max(y*0.40625) AS hy,
               min(x*0.40625) AS lx, max(x*0.40625) AS hx FROM p GROUP BY 1, 2),
q AS (SELECT dataset, t, node_id, lz + (hz-lz) * ((node_id*7919+17) % 1000003) / 1000003.0 AS z,
        ly + (hy-ly) * ((node_id*104729+17) % 1000003) / 1000003.0 AS y,
        lx + (hx-lx) * ((node_id*15485863+17) % 1000003) / 1000003.0 AS x FROM p JOIN box USING (dataset, t)),
o AS (SELECT a.dataset, min({_D}) AS d FROM p a JOIN p b ON a.dataset=b.dataset AND a.t=b.t AND a.node_id<>b.node_id GROUP BY a.dataset, a.node_id),
n AS (SELECT a.dataset, min(sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) AS d
  FROM q a JOIN q b ON a.dataset=b.dataset AND a.t=b.t AND a.node_id<>b.node_id GROUP BY a.dataset, a.node_id),
om AS (SELECT dataset, quantile_cont(d, 0.5) AS o FROM o GROUP BY 1),
nm AS (SELECT dataset, quantile_cont(d, 0.5) AS n FROM n GROUP BY 1)
SELECT dataset, round(o, 6) AS observed_um, round(n, 6) AS null_um, round(o / n, 6) AS ratio,
  CASE WHEN o / n < 0.85 THEN 'CLUMPED' WHEN o / n > 1.15 THEN 'dispersed' ELSE '~uniform' END AS verdict
FROM om JOIN nm USING (dataset)""")
def clumping(i: Inputs):
    nodes = recon.crowded_frames(with_um(i.pred))
    observed = spatial.spacing(nodes)
    null = spatial.spacing(recon.uniform_null(nodes))
    return recon.clumping(observed, null).select(
        "dataset", r6("observed_um"), r6("null_um"), r6("ratio"), "verdict")


# -- budget regression ---------------------------------------------------------

_LOGS = ", ".join([f"ln(1 + {f}) AS {f}" if f.startswith("n") else f"ln(greatest({f}, 1e-6)) AS {f}"
                   for f in budget.FEATURES])
_DESIGN = ctes("features") + f""",
dz AS (SELECT dataset, split_part(dataset, '_', 1) AS embryo, ln(est_total / t_frames) AS y, {_LOGS} FROM features)
"""


@query("a7_feature_correlation", "A7 F3", _DESIGN + "SELECT feature, embryo, round(corr(x, y), 6) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, embryo, {f} AS x, y FROM dz" for f in budget.FEATURES)
    + ") q GROUP BY GROUPING SETS ((feature, embryo), (feature))")
def feature_correlation(i: Inputs):
    return budget.feature_correlation(budget.log_design(i.features)).select("feature", "embryo", r6("r"))


@query("a20_single_feature_fit", "A20", _DESIGN + """
SELECT embryo, round(regr_slope(y, nstrong_sep4), 6) AS slope, round(regr_intercept(y, nstrong_sep4), 6) AS intercept
FROM dz GROUP BY embryo""")
def single_feature_fit(i: Inputs):
    d = budget.log_design(i.features)
    return d.groupBy("embryo").agg(
        F.round(F.regr_slope("y", "nstrong_sep4"), 6).alias("slope"),
        F.round(F.regr_intercept("y", "nstrong_sep4"), 6).alias("intercept"))


@query("a20_null_budget_error", "A20", _DESIGN + """,
o AS (SELECT e.embryo, d.y FROM (SELECT DISTINCT embryo FROM dz) e JOIN dz d ON d.embryo <> e.embryo),
m AS (SELECT embryo, quantile_cont(y, 0.5) AS med FROM o GROUP BY embryo)
SELECT dataset, round(abs(exp(med - y) - 1), 6) AS rel_error FROM dz JOIN m USING (embryo)""")
def null_budget_error(i: Inputs):
    d = budget.null_prediction(budget.log_design(i.features))
    return d.select("dataset", F.round(budget.relative_error("ynull"), 6).alias("rel_error"))


@query("a20_budget_regression", "A20")
def budget_regression(i: Inputs):
    d = budget.log_design(i.features)
    return budget.error_report(budget.predict(budget.null_prediction(d), budget.fit(d)))


@query("t4_widest_misses", "T4", ctes("metric_base") + """
SELECT arm, dataset, round(abs(ln(num_pred_nodes / est_total)), 6) AS miss FROM metric_base
ORDER BY abs(ln(num_pred_nodes / est_total)) DESC, concat(arm, dataset) LIMIT 5""")
def widest_misses(i: Inputs):
    pairs = i.metric_base.select(F.concat("arm", "dataset").alias("dataset"), "arm", F.col("dataset").alias("_d"),
                                 F.col("est_total").alias("truth"), F.col("num_pred_nodes").alias("predicted"))
    return budget.widest_misses(pairs).select("arm", F.col("_d").alias("dataset"), r6("miss"))


@query("t1_strongest_per_frame", "T1", ctes("pred") + """
SELECT dataset, node_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, t
  ORDER BY score DESC, z, y, x, node_id) AS rn FROM pred) q WHERE rn <= 25""")
def strongest_per_frame(i: Inputs):
    caps = i.budgets.select("dataset", F.lit(25).cast("bigint").alias("cap"))
    return budget.strongest_per_frame(i.pred, caps).select("dataset", "node_id")


@query("t2_budget_cap", "T2", ctes("pred", "budgets") + """,
c AS (SELECT dataset, least(greatest(1, CAST(floor(0.4 * est_total / 20) AS BIGINT)), 1000) AS cap FROM budgets)
SELECT dataset, node_id, CAST(cap AS BIGINT) AS cap FROM (SELECT *, row_number() OVER (PARTITION BY dataset, t
  ORDER BY score DESC, z, y, x, node_id) AS rn FROM pred) q JOIN c USING (dataset) WHERE rn <= cap""")
def budget_cap(i: Inputs):
    caps = budget.frame_caps(i.budgets, 0.4, 20, 1000)
    kept = budget.strongest_per_frame(i.pred, caps)
    return kept.join(caps, "dataset").select("dataset", "node_id", "cap")


@query("f17_sampled_frames", "F17", ctes("names") + """
SELECT dataset, n_t, list_sort(list_distinct([least(n_t-1, greatest(0, CAST(round_even(0.25*n_t, 0) AS BIGINT))),
  least(n_t-1, greatest(0, CAST(round_even(0.5*n_t, 0) AS BIGINT))),
  least(n_t-1, greatest(0, CAST(round_even(0.75*n_t, 0) AS BIGINT)))])) AS frames
FROM (SELECT dataset, 1 + s_suppkey % 13 AS n_t FROM names) q""")
def sampled_frames(i: Inputs):
    d = i.names.select("dataset", (1 + F.col("s_suppkey") % 13).alias("n_t"))
    return d.withColumn("frames", scalars.sampled_frames(F.col("n_t")))


# -- risks over voxel predictions ----------------------------------------------

_RISK = ctes("voxels") + """,
r AS (SELECT dataset, v * 10 AS l, CASE WHEN v > 0.2 THEN 1.0 ELSE 0.0 END AS y, CASE WHEN abs(v) > 0.05 THEN 1.0 ELSE 0.0 END AS m FROM voxels),
p AS (SELECT *, ln(1 + exp(-abs(l))) + greatest(-l, 0) AS sn, ln(1 + exp(-abs(l))) + greatest(l, 0) AS sp FROM r),
a AS (SELECT dataset, avg(50 * y * sn + (1 - y) * sp) AS naive, sum((50 * y * sn + (1 - y) * sp) * m) / greatest(sum(m), 1) AS masked,
  sum(y * sn) / greatest(sum(y), 1) AS pp, sum(y * sp) / greatest(sum(y), 1) AS pn,
  sum((1 - y) * sp) / greatest(sum(1 - y), 1) AS un, avg(y) AS pos, avg(m) AS keep FROM p GROUP BY dataset)
"""


@query("a23_label_risks", "A23 F16", _RISK + """
SELECT dataset, round(naive, 6) AS naive, round(masked, 6) AS masked,
  round(CASE WHEN un - 0.3 * pn < 0 THEN -(un - 0.3 * pn) ELSE 0.3 * pp + un - 0.3 * pn END, 6) AS pu FROM a""")
def label_risks(i: Inputs):
    from trackspark.operators.risk import label_risk
    rows = i.voxels.select("dataset", (F.col("v") * 10).alias("logit"), (F.col("v") > 0.2).alias("target"),
                           (F.abs("v") > 0.05).alias("mask"), F.lit(0.3).alias("prior"))
    return label_risk(rows, ["dataset"]).select("dataset", r6("naive"), r6("masked"), r6("pu"))


@query("a22_label_balance", "A22", _RISK + "SELECT dataset, round(pos, 6) AS positive, round(keep, 6) AS kept FROM a")
def label_balance(i: Inputs):
    from trackspark.operators.risk import label_balance as balance
    rows = i.voxels.select("dataset", (F.col("v") > 0.2).alias("target"), (F.abs("v") > 0.05).alias("mask"))
    return balance(rows, ["dataset"]).select("dataset", r6("positive"), r6("kept"))


@query("s11_report_json", "S11", ctes("metric_rows") + """
SELECT arm, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN edge_jaccard > 0.45 THEN 1 ELSE 0 END) AS BIGINT) AS kept
FROM metric_rows GROUP BY arm""")
def report_json(i: Inputs):
    from trackspark.sources.results import clean_json
    rows = i.metric_rows.withColumn("edge_jaccard", F.when(
        F.col("edge_jaccard") > 0.45, F.col("edge_jaccard")).otherwise(F.lit(float("nan"))))
    text = rows.select("arm", clean_json(rows).alias("j"))
    return text.groupBy("arm").agg(
        F.count("j").alias("n"),
        F.count(F.get_json_object("j", "$.edge_jaccard").cast("double")).alias("kept"))


@query("x8_metric_reactions", "X8", ctes("gt", "gt_edges") + """,
d AS (SELECT DISTINCT dataset FROM gt),
n AS (
  SELECT dataset, 'free_point' AS defect, count(*) AS c FROM gt WHERE (node_id * 7919 + 1) % 5 = 0 GROUP BY 1
  UNION ALL SELECT dataset, k, count(*) FROM gt_edges, (VALUES ('repeated_link'), ('missing_link'), ('stray_link')) v(k)
    WHERE (source_id * 7919 + 1) % 5 = 0 GROUP BY 1, 2
  UNION ALL SELECT g.dataset, 'bridge', count(*) FROM gt g JOIN gt_edges a ON a.dataset=g.dataset AND a.target_id=g.node_id
    JOIN gt_edges b ON b.dataset=g.dataset AND b.source_id=g.node_id WHERE g.t % 3 = 1 AND (g.node_id * 7919 + 1) % 5 = 0 GROUP BY 1
), e(defect, tp, fp, fn, nodes) AS (VALUES ('free_point', 0, 0, 0, 1), ('repeated_link', 0, 0, 0, 0), ('missing_link', -1, 0, 1, 0),
  ('stray_link', 0, 1, 0, 1), ('bridge', -2, 0, 2, 0)),
r AS (SELECT d.dataset, e.*, CAST(coalesce(n.c, 0) AS BIGINT) AS c FROM d CROSS JOIN e LEFT JOIN n ON n.dataset=d.dataset AND n.defect=e.defect)
SELECT dataset, defect, c AS injected, c*tp AS d_tp, c*fp AS d_fp, c*fn AS d_fn, c*nodes AS d_nodes,
  c*tp AS expected_tp, c*fp AS expected_fp, c*fn AS expected_fn, c*nodes AS expected_nodes FROM r""")
def metric_reactions(i: Inputs):
    """How the score's counts move per injected defect, measured and as expected."""
    from trackspark.operators import perturb
    return perturb.reaction(i.gt, i.gt_edges)

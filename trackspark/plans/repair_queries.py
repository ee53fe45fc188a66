"""Gap closing, motion links, division recovery, and the full repair chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import repair
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6
from trackspark.plans.spatial_queries import _D

_OPEN = ctes("pred", "lossy_edges") + """,
src AS (SELECT DISTINCT dataset, source_id FROM lossy_edges), dst AS (SELECT DISTINCT dataset, target_id FROM lossy_edges),
en AS (SELECT p.* FROM pred p LEFT JOIN src ON src.dataset=p.dataset AND src.source_id=p.node_id WHERE src.source_id IS NULL),
st AS (SELECT p.* FROM pred p LEFT JOIN dst ON dst.dataset=p.dataset AND dst.target_id=p.node_id WHERE dst.target_id IS NULL)"""


# The insertion limits of the experiments these queries repeat.
GAP_SHARE = 0.045
LIMITS = {
    "gaps": {"max_share": GAP_SHARE, "most": 1900},
    "wide_gaps": {"max_share": 0.0026, "most": 120, "frame_share": 0.004},
    "divisions": {"frame_share": 0.008, "global_share": 0.0036},
}


@query("j13_gap_pairs", "J13", _OPEN + f"""
SELECT a.dataset, a.t, a.node_id AS end_id, b.node_id AS start_id, round({_D}, 6) AS d
FROM en a JOIN st b ON a.dataset=b.dataset AND b.t=a.t+2 WHERE {_D} <= 11.8""")
def gap_pairs(i: Inputs):
    return repair.gap_pairs(i.pred, i.lossy_edges, 2, 11.8).select("dataset", "t", "end_id", "start_id", r6("d"))


@query("g3_close_gaps", "G3 J13 W8")
def close_gaps(i: Inputs):
    nodes, _ = repair.close_gaps(i.pred, i.lossy_edges, max_share=GAP_SHARE)
    return nodes


_GAP2 = _OPEN + f""",
nx AS (SELECT dataset, source_id AS node_id, min(target_id) AS o FROM lossy_edges GROUP BY 1, 2 HAVING count(*) = 1),
pv AS (SELECT dataset, target_id AS node_id, min(source_id) AS o FROM lossy_edges GROUP BY 1, 2 HAVING count(*) = 1),
pr AS (SELECT a.dataset, a.t, a.node_id AS end_id, b.node_id AS start_id, {_D} AS d,
    {', '.join(f"(b.{c}-a.{c})*{s}/3 AS s{c}" for c, s in zip("zyx", (1.625, 0.40625, 0.40625)))},
    {', '.join(f"(a.{c}-p.{c})*{s} AS k{c}" for c, s in zip("zyx", (1.625, 0.40625, 0.40625)))},
    {', '.join(f"(n.{c}-b.{c})*{s} AS q{c}" for c, s in zip("zyx", (1.625, 0.40625, 0.40625)))},
    p.node_id AS prev_id, n.node_id AS next_id
  FROM en a JOIN st b ON a.dataset=b.dataset AND b.t=a.t+3 AND {_D} <= 9.5
  LEFT JOIN pv ON pv.dataset=a.dataset AND pv.node_id=a.node_id LEFT JOIN pred p ON p.dataset=a.dataset AND p.node_id=pv.o
  LEFT JOIN nx ON nx.dataset=b.dataset AND nx.node_id=b.node_id LEFT JOIN pred n ON n.dataset=b.dataset AND n.node_id=nx.o),
ln AS (SELECT *, sqrt(sz*sz+sy*sy+sx*sx) AS ls, sqrt(kz*kz+ky*ky+kx*kx) AS lb, sqrt(qz*qz+qy*qy+qx*qx) AS lf FROM pr),
cs AS (SELECT *, (kz*sz+ky*sy+kx*sx)/(lb*ls+1e-9) AS cb, (qz*sz+qy*sy+qx*sx)/(lf*ls+1e-9) AS cf FROM ln),
ok AS (SELECT *, coalesce(prev_id IS NOT NULL AND (lb <= 0.01 OR ls <= 0.01 OR (cb > -0.25 AND sqrt((kz-sz)*(kz-sz)+(ky-sy)*(ky-sy)+(kx-sx)*(kx-sx)) <= 6)), false) AS okb,
  coalesce(next_id IS NOT NULL AND (lf <= 0.01 OR ls <= 0.01 OR (cf > -0.25 AND sqrt((qz-sz)*(qz-sz)+(qy-sy)*(qy-sy)+(qx-sx)*(qx-sx)) <= 6)), false) AS okf,
  CASE WHEN prev_id IS NOT NULL AND NOT (lb <= 0.01 OR ls <= 0.01) THEN greatest(0, 0.25-cb) ELSE 0 END
  + CASE WHEN next_id IS NOT NULL AND NOT (lf <= 0.01 OR ls <= 0.01) THEN greatest(0, 0.25-cf) ELSE 0 END AS pen FROM cs)
"""


@query("j14_two_frame_proposals", "J14 F4 F5", _GAP2 + """
SELECT dataset, t, end_id, start_id, round(d + 2 * pen, 6) AS score FROM ok WHERE okb OR okf""")
def two_frame_proposals(i: Inputs):
    return repair.two_frame_proposals(i.pred, i.lossy_edges).select(
        "dataset", "t", "end_id", "start_id", r6("score"))


# The plain walk: proposals in order, each end and each start once.
_GREEDY = _GAP2 + """,
pq AS (SELECT dataset, t, end_id, start_id, d + 2 * pen AS score,
    row_number() OVER (PARTITION BY dataset ORDER BY d + 2 * pen, end_id, start_id) AS k FROM ok WHERE okb OR okf),
walk(dataset, k, took, ends, starts) AS (
  SELECT DISTINCT dataset, CAST(0 AS BIGINT), false, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM pq
  UNION ALL
  SELECT w.dataset, p.k, NOT (list_contains(w.ends, p.end_id) OR list_contains(w.starts, p.start_id)),
    CASE WHEN list_contains(w.ends, p.end_id) OR list_contains(w.starts, p.start_id) THEN w.ends ELSE list_append(w.ends, p.end_id) END,
    CASE WHEN list_contains(w.ends, p.end_id) OR list_contains(w.starts, p.start_id) THEN w.starts ELSE list_append(w.starts, p.start_id) END
  FROM walk w JOIN pq p ON p.dataset = w.dataset AND p.k = w.k + 1),
gr AS (SELECT p.* FROM walk w JOIN pq p ON p.dataset = w.dataset AND p.k = w.k WHERE w.took)"""


@query("t6_greedy_gap_selection", "T6 W9 G11", _GREEDY + """
SELECT dataset, t, end_id, start_id, round(score, 6) AS score FROM gr""")
def greedy_selection(i: Inputs):
    return repair.greedy_pairs(repair.two_frame_proposals(i.pred, i.lossy_edges)).select(
        "dataset", "t", "end_id", "start_id", r6("score"))


@query("g11_two_frame_recovery", "G11", _GREEDY + """,
fc AS (SELECT dataset, t, greatest(1, CAST(round_even(count(*) * 0.004, 0) AS BIGINT)) AS cap FROM en GROUP BY ALL),
gc AS (SELECT dataset, least(120, greatest(1, CAST(round_even(count(*) * 0.0026, 0) AS BIGINT))) AS cap FROM lossy_edges GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY score, end_id, start_id) AS rf FROM gr),
ds AS (SELECT fr.*, row_number() OVER (PARTITION BY fr.dataset ORDER BY score, fr.t, end_id, start_id) AS turn
  FROM fr JOIN fc ON fc.dataset = fr.dataset AND fc.t = fr.t WHERE rf <= fc.cap),
ad AS (SELECT ds.*, m.top + 2 * turn - 1 AS a, m.top + 2 * turn AS b FROM ds JOIN gc ON gc.dataset = ds.dataset
  JOIN (SELECT dataset, max(node_id) AS top FROM pred GROUP BY dataset) m ON m.dataset = ds.dataset WHERE turn <= gc.cap)
SELECT dataset, end_id AS source_id, a AS target_id FROM ad UNION ALL SELECT dataset, a, b FROM ad
UNION ALL SELECT dataset, b, start_id FROM ad""")
def two_frame_recovery(i: Inputs):
    _, links = repair.recover_two_frame_gaps(i.pred, i.lossy_edges, **LIMITS["wide_gaps"])
    return links


_DIV = ctes("pred", "lossy_edges") + """,
ed AS (SELECT * FROM lossy_edges),
dst AS (SELECT DISTINCT dataset, target_id FROM ed),
ch AS (SELECT dataset, source_id, min(target_id) AS child FROM ed GROUP BY 1, 2 HAVING count(*) = 1),
dp AS (SELECT s.dataset, s.t, s.node_id AS source_id, o.node_id AS target_id,
   sqrt((s.z-o.z)*1.625*((s.z-o.z)*1.625)+(s.y-o.y)*0.40625*((s.y-o.y)*0.40625)+(s.x-o.x)*0.40625*((s.x-o.x)*0.40625)) AS pd,
   sqrt((c.z-o.z)*1.625*((c.z-o.z)*1.625)+(c.y-o.y)*0.40625*((c.y-o.y)*0.40625)+(c.x-o.x)*0.40625*((c.x-o.x)*0.40625)) AS sd,
   sqrt((s.z-c.z)*1.625*((s.z-c.z)*1.625)+(s.y-c.y)*0.40625*((s.y-c.y)*0.40625)+(s.x-c.x)*0.40625*((s.x-c.x)*0.40625)) AS cd
  FROM pred s JOIN ch ON ch.dataset=s.dataset AND ch.source_id=s.node_id
  JOIN pred c ON c.dataset=s.dataset AND c.node_id=ch.child AND c.t=s.t+1
  JOIN pred o ON o.dataset=s.dataset AND o.t=s.t+1
  LEFT JOIN dst ON dst.dataset=o.dataset AND dst.target_id=o.node_id WHERE dst.target_id IS NULL),
pp AS (SELECT *, pd + 0.15*sd AS score FROM dp WHERE pd <= 4.6 AND sd <= 6.9 AND cd <= 7.4)"""


@query("j15_division_proposals", "J15", _DIV + """
SELECT dataset, t, source_id, target_id, round(score, 6) AS score FROM pp""")
def division_proposals(i: Inputs):
    return repair.division_proposals(i.pred, i.lossy_edges).select("dataset", "t", "source_id", "target_id", r6("score"))


@query("g9_division_recovery", "G9 W9", _DIV + """,
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, target_id ORDER BY score, source_id) AS rn FROM pp) q WHERE rn = 1),
sc AS (SELECT p.dataset, p.t, greatest(1, CAST(round_even(count(*) * 0.008, 0) AS BIGINT)) AS fc FROM ch JOIN pred p
   ON p.dataset=ch.dataset AND p.node_id=ch.source_id GROUP BY 1, 2),
gc AS (SELECT dataset, greatest(1, CAST(round_even(count(*) * 0.0036, 0) AS BIGINT)) AS gcap FROM ed GROUP BY 1),
fr AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY score, source_id, target_id) AS rf FROM b),
ke AS (SELECT fr.*, row_number() OVER (PARTITION BY dataset ORDER BY t, score, source_id, target_id) AS rg FROM fr JOIN sc USING (dataset, t) WHERE rf <= fc)
SELECT dataset, source_id, target_id FROM ke JOIN gc USING (dataset) WHERE rg <= gcap""")
def division_recovery(i: Inputs):
    return repair.recover_divisions(i.pred, i.lossy_edges, **LIMITS["divisions"])


@query("j16_reuse_choices", "J16", _OPEN + """,
iso AS (SELECT en.* FROM en JOIN st USING (dataset, node_id)),
gp AS (SELECT node_id AS end_id, dataset, t, z + 0.5 AS z, y + 1 AS y, x - 1 AS x FROM en)
SELECT g.dataset, g.t, g.end_id, i.node_id AS iso_id,
  round(sqrt((g.z-i.z)*1.625*((g.z-i.z)*1.625)+(g.y-i.y)*0.40625*((g.y-i.y)*0.40625)+(g.x-i.x)*0.40625*((g.x-i.x)*0.40625)), 6) AS d_iso
FROM gp g JOIN iso i ON i.dataset=g.dataset AND i.t=g.t+1
WHERE sqrt((g.z-i.z)*1.625*((g.z-i.z)*1.625)+(g.y-i.y)*0.40625*((g.y-i.y)*0.40625)+(g.x-i.x)*0.40625*((g.x-i.x)*0.40625)) <= 6.0""")
def reuse_choices(i: Inputs):
    from trackspark.operators.edges import open_ends
    gaps = open_ends(i.pred, i.lossy_edges).where("is_end").select(
        "dataset", "t", F.col("node_id").alias("end_id"), (F.col("z") + 0.5).alias("z"),
        (F.col("y") + 1).alias("y"), (F.col("x") - 1).alias("x"))
    return repair.gap_choices(gaps, i.pred, i.lossy_edges, 6.0).select("dataset", "t", "end_id", "iso_id", r6("d_iso"))


@query("g10_gap_closing_with_reuse", "G10 J16 U3")
def gap_closing_with_reuse(i: Inputs):
    _, links = repair.close_gaps_reusing(i.pred, i.lossy_edges, **LIMITS["gaps"])
    return links


@query("j12_motion_links", "J12 P12")
def motion_links(i: Inputs):
    return repair.motion_links(i.pred, i.lossy_edges)


@query("g12_repaired_graph", "G12 A26")
def repaired_graph(i: Inputs):
    _, _, counts = repair.repair_graph(i.pred, i.raw_edges, limits=LIMITS)
    return counts

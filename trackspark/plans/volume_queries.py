"""Voxel queries: normalisation, smoothing, peaks, refinement, targets, density control."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import volume as V
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6

UM = (1.625, 1.625, 1.625)
DIMS = (4, 4, 4)
VOXEL = ["dataset", "t", "z", "y", "x"]

_NORM = """
lv AS (SELECT dataset, t, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.997) AS hi FROM voxels GROUP BY 1, 2),
norm AS (SELECT v.dataset, v.t, v.z, v.y, v.x, greatest((v.v - lo) / ((CASE WHEN hi <= lo THEN lo + 1 ELSE hi END) - lo), 0.0) AS v
  FROM voxels v JOIN lv USING (dataset, t))"""


def _smooth_sql(source: str, name: str, sigma: float) -> str:
    weights = V.gaussian_weights(sigma)
    reach = len(weights) // 2
    rows = ", ".join(f"({k - reach}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(weights))
    out, prior = [f"{name}k(o, w) AS (VALUES {rows})"], source
    for axis in "xyz":
        others = [a for a in "zyx" if a != axis]
        m = f"((s.{axis} + k.o) % 8 + 8) % 8"
        out.append(
            f"{name}{axis} AS (SELECT a.dataset, a.t, a.z, a.y, a.x, sum(a.w * b.v) AS v FROM ("
            f"SELECT s.dataset, s.t, s.z, s.y, s.x, k.w, CASE WHEN {m} < 4 THEN {m} ELSE 7 - {m} END AS j "
            f"FROM {prior} s, {name}k k) a JOIN {prior} b ON b.dataset=a.dataset AND b.t=a.t AND b.{axis}=a.j "
            + " ".join(f"AND b.{o}=a.{o}" for o in others) + " GROUP BY 1, 2, 3, 4, 5)")
        prior = f"{name}{axis}"
    return ",\n".join(out)


_DOG = ctes("voxels") + "," + _NORM + ",\n" + ",\n".join(
    _smooth_sql("norm", f"g{k}", s / 1.625) for k, s in enumerate((1.5, 2.5, 4.0, 6.0))) + """,
dog AS (SELECT n.dataset, n.t, n.z, n.y, n.x, n.v, greatest(a.v - c.v, b.v - d.v) AS dog FROM norm n
  JOIN g0z a USING (dataset, t, z, y, x) JOIN g1z b USING (dataset, t, z, y, x)
  JOIN g2z c USING (dataset, t, z, y, x) JOIN g3z d USING (dataset, t, z, y, x))"""
SCALES = ((1.5, 4.0), (2.5, 6.0))


def _near(a: str, b: str, radius: float) -> str:
    d = "+".join(f"(({a}.{c}-{b}.{c})*1.625)*(({a}.{c}-{b}.{c})*1.625)" for c in "zyx")
    return f"{d} <= {radius * radius}"


def _rounded(df, *names):
    return df.select(*VOXEL, *[r6(n) for n in names])


@query("v1_movie_normalise", "V1 S5 S4", ctes("voxels") + """,
q AS (SELECT dataset, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM voxels GROUP BY 1)
SELECT v.dataset, v.t, v.z, CAST(v.y // 2 AS INTEGER) AS y, CAST(v.x // 2 AS INTEGER) AS x,
  round(greatest((v.v - lo) / (hi - lo + 1e-6), 0.0), 6) AS v
FROM voxels v JOIN q USING (dataset) WHERE y % 2 = 0 AND x % 2 = 0""")
def movie_normalise(i: Inputs):
    meta = i.voxels.select("dataset", F.lit(0.0).alias("q_lo"), F.lit(0.0).alias("q_hi")).distinct()
    meta = V.quantile_fallback(i.voxels, meta)
    return _rounded(V.load_frames(i.voxels, meta, (1, 2, 2)), "v")


@query("v2_frame_normalise", "V2", ctes("voxels") + "," + _NORM + """
SELECT dataset, t, z, y, x, round(v, 6) AS v FROM norm""")
def frame_normalise(i: Inputs):
    return _rounded(V.normalise_frames(i.voxels), "v")


@query("v3_gaussian", "V3", ctes("voxels") + ",\n" + _smooth_sql("voxels", "g", 1.5 / 1.625) + """
SELECT dataset, t, z, y, x, round(v, 6) AS smooth FROM gz""")
def gaussian(i: Inputs):
    s = 1.5 / 1.625
    return _rounded(V.gaussian(i.voxels, {"smooth": (s, s, s)}), "smooth")


@query("v4_dog_response", "V4", _DOG + """
SELECT dataset, t, z, y, x, round(dog, 6) AS dog FROM dog""")
def dog_response(i: Inputs):
    return _rounded(V.dog_response(V.normalise_frames(i.voxels), UM, SCALES), "dog")


@query("w6_box_max", "W6", ctes("voxels") + """
SELECT a.dataset, a.t, a.z, a.y, a.x, round(max(b.v), 6) AS peak FROM voxels a JOIN voxels b
ON a.dataset=b.dataset AND a.t=b.t AND abs(a.z-b.z) <= 1 AND abs(a.y-b.y) <= 2 AND abs(a.x-b.x) <= 1
GROUP BY 1, 2, 3, 4, 5""")
def box_max(i: Inputs):
    return _rounded(V.box_max(i.voxels, (1, 2, 1)), "peak")


@query("w7_ball_max", "W7", ctes("voxels") + f"""
SELECT a.dataset, a.t, a.z, a.y, a.x, round(max(b.v), 6) AS peak FROM voxels a JOIN voxels b
ON a.dataset=b.dataset AND a.t=b.t AND {_near('a', 'b', 2.5)} GROUP BY 1, 2, 3, 4, 5""")
def ball_max(i: Inputs):
    return _rounded(V.ball_max(i.voxels, 2.5, UM), "peak")


@query("v5_intensity_peaks", "V5 P5", ctes("voxels") + "," + _NORM + """,
m AS (SELECT a.dataset, a.t, a.z, a.y, a.x, a.v FROM norm a JOIN norm b
  ON a.dataset=b.dataset AND a.t=b.t AND abs(a.z-b.z) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1
  GROUP BY 1, 2, 3, 4, 5, 6 HAVING a.v = max(b.v) AND a.v > 0.15),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY v DESC, z, y, x) AS rn FROM m)
SELECT dataset, t, z, y, x, round(v, 6) AS score FROM r WHERE rn <= 3""")
def intensity_peaks(i: Inputs):
    caps = i.voxels.select("dataset", F.lit(3).cast("bigint").alias("cap")).distinct()
    norm = V.cut_lineage(V.normalise_frames(i.voxels), "norm")
    return _rounded(V.detect_intensity(norm, UM, 5.0, 0.15, "box", caps), "score")


_PEAK6 = _DOG + f""",
fl AS (SELECT dataset, t, quantile_cont(v, 0.5) AS fl FROM norm GROUP BY 1, 2),
pk AS (SELECT a.dataset, a.t, a.z, a.y, a.x, a.dog, a.v FROM dog a JOIN fl USING (dataset, t)
  WHERE a.dog >= 0.02 AND a.v >= fl AND NOT EXISTS (SELECT 1 FROM dog b
    WHERE b.dataset=a.dataset AND b.t=a.t AND b.dog > a.dog AND {_near('a', 'b', 3.5)}))"""


@query("v6_dog_peaks", "V6 P6", _PEAK6 + """
SELECT dataset, t, z, y, x, round(dog, 6) AS score FROM pk""")
def dog_peaks(i: Inputs):
    return _rounded(V.detect_dog(V.dog_table(i.voxels, UM, SCALES), UM, 3.5), "score")


_PROB = ctes("voxels") + f""",
pr AS (SELECT dataset, t, z, y, x, least(CAST(1 AS DOUBLE), round(greatest(v, 0.0) * 8)) AS v FROM voxels),
pk AS (SELECT a.* FROM pr a WHERE a.v > 0.05 AND NOT EXISTS (SELECT 1 FROM pr b
  WHERE b.dataset=a.dataset AND b.t=a.t AND b.v > a.v AND {_near('a', 'b', 2.5)})),
ad AS (SELECT a.dataset, a.t, a.z*16+a.y*4+a.x AS u, b.z*16+b.y*4+b.x AS w FROM pk a JOIN pk b
  ON a.dataset=b.dataset AND a.t=b.t AND abs(a.z-b.z)+abs(a.y-b.y)+abs(a.x-b.x) = 1),
re(dataset, t, u, w) AS (SELECT dataset, t, z*16+y*4+x, z*16+y*4+x FROM pk
  UNION SELECT r.dataset, r.t, r.u, a.w FROM re r JOIN ad a ON a.dataset=r.dataset AND a.t=r.t AND a.u=r.w),
co AS (SELECT dataset, t, u, min(w) AS c FROM re GROUP BY 1, 2, 3)"""


@query("v7_probability_peaks", "V7", _PROB + """
SELECT p.dataset, p.t, round(sum(v*z)/sum(v), 6) AS z, round(sum(v*y)/sum(v), 6) AS y, round(sum(v*x)/sum(v), 6) AS x,
  round(max(v), 6) AS score
FROM pk p JOIN co ON co.dataset=p.dataset AND co.t=p.t AND co.u=p.z*16+p.y*4+p.x GROUP BY p.dataset, p.t, co.c""")
def probability_peaks(i: Inputs):
    prob = i.voxels.withColumn("v", F.least(F.lit(1.0), F.round(F.greatest("v", F.lit(0.0)) * 8)))
    return V.peaks_from_probability(prob, UM, 2.5).select(
        "dataset", "t", r6("z"), r6("y"), r6("x"), r6("score"))


@query("v8_refined_centroids", "V8", _PEAK6 + """,
w AS (SELECT p.dataset, p.t, p.z AS pz, p.y AS py, p.x AS px, sum(n.v) AS w, sum(n.v*n.z) AS sz, sum(n.v*n.y) AS sy, sum(n.v*n.x) AS sx
  FROM pk p JOIN norm n ON n.dataset=p.dataset AND n.t=p.t AND abs(n.z-p.z) <= 2 AND abs(n.y-p.y) <= 2 AND abs(n.x-p.x) <= 2
  GROUP BY 1, 2, 3, 4, 5)
SELECT dataset, t, round(CASE WHEN w <= 0 THEN pz ELSE sz/w END, 6) AS z, round(CASE WHEN w <= 0 THEN py ELSE sy/w END, 6) AS y,
  round(CASE WHEN w <= 0 THEN px ELSE sx/w END, 6) AS x FROM w""")
def refined_centroids(i: Inputs):
    table = V.dog_table(i.voxels, UM, SCALES)
    peaks = V.detect_dog(table, UM, 3.5)
    return V.refine_centroids(peaks, table, UM).select("dataset", "t", r6("z"), r6("y"), r6("x"))


_POINTS = """pts AS (SELECT dataset, t, t AS point_id, CAST(t % 7 AS DOUBLE) / 2 AS z, CAST((t * 3) % 9 AS DOUBLE) / 2 - 0.25 AS y,
  CAST((t * 5) % 11 AS DOUBLE) / 2 - 0.75 AS x FROM voxels WHERE z = 0 AND y = 0 AND x = 0)"""


def _points(i: Inputs):
    t = F.col("t")
    return i.voxels.where("z = 0 AND y = 0 AND x = 0").select(
        "dataset", "t", t.alias("point_id"), ((t % 7).cast("double") / 2).alias("z"),
        ((t * 3 % 9).cast("double") / 2 - 0.25).alias("y"), ((t * 5 % 11).cast("double") / 2 - 0.75).alias("x"))


@query("v9_refined_midpoints", "V9", ctes("voxels") + "," + _POINTS + """,
pa AS (SELECT p.point_id, p.z AS pz, p.y AS py, p.x AS px, v.z, v.y, v.x, v.v,
    quantile_cont(v.v, 0.2) OVER (PARTITION BY p.point_id) AS base
  FROM pts p JOIN voxels v ON v.dataset=p.dataset AND v.t=p.t AND abs(v.z-round_even(p.z, 0)) <= 1
    AND abs(v.y-round_even(p.y, 0)) <= 1 AND abs(v.x-round_even(p.x, 0)) <= 1),
ce AS (SELECT point_id, sum(greatest(v-base, 0)) AS w, sum(greatest(v-base, 0)*z) / sum(greatest(v-base, 0)) AS mz,
  sum(greatest(v-base, 0)*y) / sum(greatest(v-base, 0)) AS my, sum(greatest(v-base, 0)*x) / sum(greatest(v-base, 0)) AS mx FROM pa GROUP BY 1),
st AS (SELECT p.*, mz, my, mx, CASE WHEN w IS NULL OR w <= 0 THEN 'failed'
   WHEN sqrt(((mz-z)*1.625)*((mz-z)*1.625)+((my-y)*1.625)*((my-y)*1.625)+((mx-x)*1.625)*((mx-x)*1.625)) > 1.6 THEN 'rejected' ELSE 'refined' END AS status
  FROM pts p LEFT JOIN ce USING (point_id))
SELECT dataset, point_id, round(CASE WHEN status = 'refined' THEN mz ELSE z END, 6) AS z,
  round(CASE WHEN status = 'refined' THEN my ELSE y END, 6) AS y, round(CASE WHEN status = 'refined' THEN mx ELSE x END, 6) AS x, status FROM st""")
def refined_midpoints(i: Inputs):
    return V.refine_points(_points(i), i.voxels, UM, half=(1, 1, 1), max_shift_um=1.6).select(
        "dataset", "point_id", r6("z"), r6("y"), r6("x"), "status")


_TARGET = """
tg AS (SELECT DISTINCT v.dataset, v.t, v.z, v.y, v.x FROM pts p JOIN voxels v ON v.dataset=p.dataset AND v.t=p.t
  AND p.z >= 0 AND p.z < 4 AND p.y >= 0 AND p.y < 4 AND p.x >= 0 AND p.x < 4
  AND ((v.z-round_even(p.z,0))*1.625)*((v.z-round_even(p.z,0))*1.625)+((v.y-round_even(p.y,0))*1.625)*((v.y-round_even(p.y,0))*1.625)
    +((v.x-round_even(p.x,0))*1.625)*((v.x-round_even(p.x,0))*1.625) <= 4.0)"""


@query("v10_painted_targets", "V10 P7", ctes("voxels") + "," + _POINTS + "," + _TARGET + """
SELECT dataset, t, z, y, x FROM tg""")
def painted_targets(i: Inputs):
    return V.paint_targets(_points(i), DIMS, UM).select(*VOXEL)


@query("v11_trust_mask", "V11", _DOG + "," + _POINTS + "," + _TARGET + f""",
dl AS (SELECT dataset, t, quantile_cont(dog, 0.6) AS lim FROM dog GROUP BY 1, 2),
nr AS (SELECT DISTINCT v.dataset, v.t, v.z, v.y, v.x FROM tg b JOIN dog v ON v.dataset=b.dataset AND v.t=b.t AND {_near('v', 'b', 2.5)})
SELECT d.dataset, d.t, d.z, d.y, d.x, (tg.z IS NOT NULL) AS target,
  (tg.z IS NOT NULL OR (d.v < 0.4 AND d.dog < lim AND nr.z IS NULL)) AS mask
FROM dog d JOIN dl USING (dataset, t) LEFT JOIN tg ON tg.dataset=d.dataset AND tg.t=d.t AND tg.z=d.z AND tg.y=d.y AND tg.x=d.x
LEFT JOIN nr ON nr.dataset=d.dataset AND nr.t=d.t AND nr.z=d.z AND nr.y=d.y AND nr.x=d.x""")
def trust_mask(i: Inputs):
    table = V.dog_table(i.voxels, UM, SCALES)
    targets = V.paint_targets(_points(i), DIMS, UM)
    return V.trust_mask(table, targets, UM, empty_intensity=0.4, margin_um=2.5).select(*VOXEL, "target", "mask")


@query("v12_heat_map", "V12", ctes("voxels") + "," + _POINTS + """,
hit AS (SELECT dataset, t, CAST(round_even(z,0) AS INT) AS z, CAST(round_even(y,0) AS INT) AS y, CAST(round_even(x,0) AS INT) AS x, count(*) AS n
  FROM pts WHERE z >= 0 AND z < 4 AND y >= 0 AND y < 4 AND x >= 0 AND x < 4 GROUP BY 1, 2, 3, 4, 5),
raw AS (SELECT v.dataset, v.t, v.z, v.y, v.x, CAST(coalesce(h.n, 0) AS DOUBLE) AS v FROM voxels v LEFT JOIN hit h
  ON h.dataset=v.dataset AND h.t=v.t AND h.z=v.z AND h.y=v.y AND h.x=v.x),
""" + _smooth_sql("raw", "h", 2.0 / 1.625) + """,
tp AS (SELECT dataset, t, max(v) AS m FROM hz GROUP BY 1, 2)
SELECT dataset, t, z, y, x, round(CASE WHEN m > 0 THEN v / m ELSE 0 END, 6) AS v FROM hz JOIN tp USING (dataset, t)""")
def heat_map(i: Inputs):
    return _rounded(V.heat_map(i.voxels, _points(i), DIMS, UM, 2.0), "v")


@query("v13_adaptive_separation", "V13")
def adaptive_separation(i: Inputs):
    middle = i.voxels.groupBy("dataset").agg(F.median("t").cast("bigint").alias("_mid"))
    chosen = i.voxels.join(middle, "dataset").where(F.col("t") >= F.col("_mid"))
    first = chosen.groupBy("dataset").agg(F.min("t").alias("t"))
    mid = i.voxels.join(first, ["dataset", "t"], "left_semi")
    targets = first.select("dataset", F.lit(2.0).alias("target"))
    return V.adaptive_separation(V.dog_table(mid, UM, SCALES), targets, UM)


@query("v14_footprints", "V14", ctes("names") + """,
s AS (SELECT dataset, CAST(2 + s_suppkey % 9 AS DOUBLE) AS sep FROM names),
k AS (SELECT *, greatest(1, CAST(round_even(sep / 1.625, 0) AS INT)) AS rz, greatest(1, CAST(round_even(sep / 0.8125, 0) AS INT)) AS ry FROM s),
b AS (SELECT k.dataset, k.sep, k.rz, k.ry, count(*) AS n FROM k, range(-6, 7) z(oz), range(-13, 14) y(oy), range(-13, 14) x(ox)
  WHERE abs(oz) <= rz AND abs(oy) <= ry AND abs(ox) <= ry
   AND (oz*1.625)*(oz*1.625)+(oy*0.8125)*(oy*0.8125)+(ox*0.8125)*(ox*0.8125) <= sep*sep GROUP BY 1, 2, 3, 4)
SELECT dataset, sep, CAST(rz + (CASE WHEN rz % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS box_z,
  CAST(ry + (CASE WHEN ry % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS box_y,
  CAST(ry + (CASE WHEN ry % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS box_x, CAST(n AS BIGINT) AS ball_voxels,
  CASE WHEN n <= 4000 THEN 'ball' ELSE 'box' END AS shape FROM b""")
def footprints(i: Inputs):
    seps = i.names.select("dataset", (2 + F.col("s_suppkey") % 9).cast("double").alias("sep"))
    return V.footprint_table(seps, "sep", (1.625, 0.8125, 0.8125), most_ball=4000)


@query("v15_density_calibration", "V15", _DOG + f""",
c AS (SELECT thr, count(*) AS n FROM dog a JOIN (SELECT dataset, t, quantile_cont(v, 0.5) AS fl FROM norm GROUP BY 1, 2) f USING (dataset, t),
   (VALUES (0.005), (0.02), (0.08), (0.16)) h(thr)
  WHERE a.dog >= thr AND a.v >= fl AND NOT EXISTS (SELECT 1 FROM dog b
    WHERE b.dataset=a.dataset AND b.t=a.t AND b.dog > a.dog AND {_near('a', 'b', 3.5)}) GROUP BY thr)
SELECT CAST(thr AS DOUBLE) AS threshold, CAST(n AS BIGINT) AS n FROM c""")
def density_calibration(i: Inputs):
    # Peaks at the lowest threshold contain those of every higher one.
    table = V.dog_table(i.voxels, UM, SCALES)
    peaks = V.detect_dog(table, UM, 3.5, 0.005)
    cleared = peaks.select(F.explode(F.filter(
        F.array(*[F.lit(v) for v in (0.005, 0.02, 0.08, 0.16)]),
        lambda thr: F.col("score") >= thr)).alias("threshold"))
    return cleared.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


@query("a19_budget_features", "A19", _PEAK6 + """,
fr AS (SELECT dataset, t, avg(v) AS m, avg(CASE WHEN v > 0.15 THEN 1.0 ELSE 0.0 END) AS f FROM voxels GROUP BY 1, 2),
n AS (SELECT p.dataset, count(*) AS n, sum(CASE WHEN r.v > 0.2 THEN 1 ELSE 0 END) AS s
  FROM pk p JOIN voxels r USING (dataset, t, z, y, x) GROUP BY 1)
SELECT dataset, round(n / count(*), 6) AS n_sep, round(s / count(*), 6) AS nstrong_sep, round(avg(m), 6) AS mean_int,
  round(avg(f), 6) AS frac_fg FROM fr JOIN n USING (dataset) GROUP BY dataset, n, s""")
def budget_features(i: Inputs):
    f = V.budget_features(i.voxels, UM, (3.5,), scales=SCALES, strong=0.2)
    return f.select("dataset", F.round("`n_sep3.5`", 6).alias("n_sep"),
                    F.round("`nstrong_sep3.5`", 6).alias("nstrong_sep"), r6("mean_int"), r6("frac_fg"))


@query("s5_frame_files", "S5 D2", ctes("voxels") + """
SELECT dataset, t, CAST(count(*) AS BIGINT) AS n, round(sum(v), 6) AS total, round(sum(v * (16 * z + 4 * y + x)), 6) AS placed
FROM voxels GROUP BY dataset, t""")
def frame_files(i: Inputs):
    """Every frame written as a file and read back through the frame source."""
    import uuid

    from trackspark.session import shared_dir
    from trackspark.sources.frames import read_frames, write_frames
    folder = f"{shared_dir(i.spark)}/frames/{uuid.uuid4().hex}"
    table = i.embeddings.select(F.col("label").cast("string").alias("dataset"), F.col("vec_id").alias("t"),
                                F.col("embedding").alias("values"))
    shape = (table.agg((F.max(F.size("values")) / 16).cast("int")).first()[0], 4, 4)
    write_frames(table, folder, shape, "float32")
    voxels = read_frames(i.spark, folder, shape, "float32")
    place = F.col("v") * (16 * F.col("z") + 4 * F.col("y") + F.col("x"))
    return (voxels.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.sum(place).alias("placed"))
            .select("dataset", "t", "n", r6("total"), r6("placed")))

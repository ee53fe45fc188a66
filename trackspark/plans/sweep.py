"""Parameter grids over datasets and scoring of all arms of a grid in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators import assign, score
from trackspark.operators.spatial import range_join
from trackspark.schema import DEFAULT_SCALE
from trackspark.session import cut_lineage
from trackspark.sources.results import missing_results

_VIEW = ["floor", "sep"]                   # what decides which detections an arm sees
_ARM = ["arm", *_VIEW, "radius"]
_MARK = "\u0001"


def with_grid(datasets: DataFrame, **axes: list) -> DataFrame:
    """Every dataset once per combination of the given parameter values.

    The values are literals of the plan, so this is an explode per axis, not a join.
    """
    return reduce(lambda df, axis: df.withColumn(
        axis[0], F.explode(F.array(*[F.lit(v) for v in axis[1]]))), axes.items(), datasets)


def grid_arms(datasets: DataFrame, sep: list, radius: list, floor: list = (float("-inf"),)) -> DataFrame:
    """arms(dataset, arm, floor, sep, radius): every dataset under every combination, named by it."""
    grid = with_grid(datasets.select("dataset"), floor=[float(v) for v in floor],
                     sep=[float(v) for v in sep], radius=[float(v) for v in radius])
    name = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("floor", "sep", "radius")])
    return grid.select("dataset", name.alias("arm"), "floor", "sep", "radius")


def _strength(score: str) -> Column:
    worst = F.lit(float("-inf"))
    return F.coalesce(F.nanvl(score, worst), worst)


def clearance(nodes: DataFrame, widest: float) -> DataFrame:
    """``nodes`` with ``clear_um``: the distance to the nearest stronger detection of their frame.

    Stronger is of higher ``score``, at equal scores of smaller node_id; a null or NaN score is the
    lowest. Infinite where no stronger one is within ``widest``. A detection is the peak of its ball
    of any smaller radius exactly if it is clear by more, so one join serves all separations, and a
    least score changes nothing: whoever passes it has all stronger ones pass it too.
    """
    keys, widest = ["dataset", "t"], max(float(widest), 1e-3)
    a = nodes.select(*keys, "node_id", _strength("score").alias("_s"), "zu", "yu", "xu")
    b = nodes.select(*keys, F.col("node_id").alias("_other"), _strength("score").alias("_t"), "zu", "yu", "xu")
    stronger = (F.col("_t") > F.col("_s")) | ((F.col("_t") == F.col("_s")) & (F.col("_other") < F.col("node_id")))
    clear = (range_join(a, b, widest, keys).where(stronger)
             .groupBy("dataset", "node_id").agg(F.min("d").alias("clear_um")))
    return (nodes.join(clear, ["dataset", "node_id"], "left")
            .withColumns({"clear_um": F.coalesce("clear_um", F.lit(float("inf"))), "score": _strength("score")}))


def _seen(df: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` once per entry of the plan's ``column`` whose floor and separation they pass."""
    passes = F.filter(column, lambda v: (v["floor"] <= F.col("score")) & (v["sep"] < F.col("clear_um")))
    return df.join(plan.select("dataset", column), "dataset").withColumn("_v", F.explode(passes)).drop(column)


def _of_arms(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Links of views once per arm that uses them; links that name their ``arm`` already stay as they are."""
    if "arm" in df.columns:
        return df
    used = F.filter("_arms", lambda a: (a["floor"] == F.col("floor")) & (a["sep"] == F.col("sep"))
                    & (F.col("d") < a["radius"]))
    return (df.join(plan.select("dataset", "_arms"), "dataset").withColumn("_a", F.explode(used))
            .withColumn("arm", F.col("_a.arm")).drop("_arms", "_a"))


def evaluate_grid(nodes: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, budgets: DataFrame,
                  arms: DataFrame, scale=DEFAULT_SCALE, mode: str = "nearest") -> DataFrame:
    """Metric rows of every row of ``arms(dataset, arm, floor, sep, radius)``, all in one plan.

    ``nodes`` are detections with a ``score``. An arm sees those of at least ``floor`` that are the
    strongest within ``sep`` µm, links them within ``radius`` (``mode`` nearest or gated) and is
    scored like any graph. Link and match candidates are joined once, at the widest setting; an arm
    is a filter on them and part of every key after them: matchings are solved once per (floor,
    separation), nearest links of all radii are one minimum. What grows with the number of arms
    are the candidates themselves, not the joins that find them.

    A dataset has the arms that name it, so a stored part can be left out. An arm's name is unique
    per dataset and its settings are numbers; both are tested. Without arms there are no rows.
    """
    if mode not in ("nearest", "gated"):
        raise ValueError(f"mode {mode!r}: nearest or gated")
    arms = cut_lineage(arms.select("dataset", *_ARM), "arms")
    usable = F.lit(True)
    for c in ("dataset", "arm"):
        usable = usable & F.col(c).isNotNull()
    for c in ("floor", "sep", "radius"):
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c)
    top = arms.agg(F.coalesce(F.max("sep"), F.lit(0.0)).alias("sep"), F.coalesce(F.max("radius"), F.lit(1.0)).alias("radius"),
                   F.count_if(~usable).alias("odd"), F.count(F.lit(1)).alias("n"),
                   F.count_distinct("dataset", "arm").alias("names")).first()
    if top.odd or top.n != top.names:
        raise ValueError("arms need a name of their own in each dataset, and numbers as settings")
    plan = cut_lineage(arms.groupBy("dataset").agg(
        F.collect_set(F.struct(*_VIEW)).alias("_views"), F.collect_set(F.struct(*_ARM)).alias("_arms")), "plan")

    asked = plan.select("dataset")
    placed = cut_lineage(clearance(with_um(nodes, scale).join(asked, "dataset", "left_semi"), top.sep), "placed")
    keys = [*_VIEW, "dataset", "t"]
    truth = gt_nodes.join(plan.select("dataset", "_views"), "dataset").select(
        "dataset", "t", "node_id", F.inline("_views"))
    seen = _seen(placed.select("dataset", "t", "node_id", "score", "clear_um"), plan, "_views").select(
        "dataset", "t", "node_id", "_v.*")
    near = assign.match_candidates(placed, gt_nodes, scale=scale, carry=("score", "clear_um"))
    near = _seen(near, plan, "_views").select("dataset", "t", "gt_id", "pred_id", "d", "w", "_v.*")
    matches = cut_lineage(assign.match_pairs(near, seen, truth, keys), "matches")

    marked = _marked(_linked(placed, plan, top.radius, mode), matches, gt_edges)
    return score.metric_rows(_counts(arms, plan, marked, seen, matches, gt_nodes, gt_edges), budgets).join(arms, ["arm", "dataset"])


def _marked(links: DataFrame, matches: DataFrame, gt_edges: DataFrame) -> DataFrame:
    """The links that the metric sees, with ``is_tp``; what ``score.classify_edges`` gives for them.

    A source has one link in a view and matchings are one-to-one, so no two links repeat each other,
    meet at one pair of true points or leave one source: nothing is left to repair.
    """
    ends = gt_edges.select("dataset", F.explode(F.array(
        F.struct(F.col("source_id").alias("gt_id"), F.lit(True).alias("out")),
        F.struct(F.col("target_id").alias("gt_id"), F.lit(False).alias("out")))).alias("_e")).select("dataset", "_e.*")
    flags = ends.groupBy("dataset", "gt_id").agg(F.bool_or("out").alias("_out"), F.bool_or(~F.col("out")).alias("_in"))
    known = cut_lineage(matches.join(flags, ["dataset", "gt_id"], "left"), "known")

    def end(name, flag):
        return known.select(*_VIEW, "dataset", F.col("pred_id").alias(f"{name}_id"), F.col("gt_id").alias(f"_{name}"),
                            F.coalesce(flag, F.lit(False)).alias(flag))
    sides = (links.join(end("source", "_out"), [*_VIEW, "dataset", "source_id"], "left")
             .join(end("target", "_in"), [*_VIEW, "dataset", "target_id"], "left").where("_out OR _in"))
    pairs = gt_edges.select("dataset", F.col("source_id").alias("_source"), F.col("target_id").alias("_target")) \
        .distinct().withColumn("is_tp", F.lit(True))
    return sides.join(pairs, ["dataset", "_source", "_target"], "left").fillna(False, ["is_tp"])


def _counts(arms: DataFrame, plan: DataFrame, marked: DataFrame, seen: DataFrame, matches: DataFrame,
            gt_nodes: DataFrame, gt_edges: DataFrame) -> DataFrame:
    """The columns of ``score.edge_counts`` per arm: links count per arm, points per view, truth per dataset."""
    view = ["dataset", *_VIEW]

    def per(df, keys, out):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    hits = _of_arms(marked, plan).groupBy("dataset", "arm").agg(
        F.count_if("is_tp").alias("edge_tp"), F.count_if(~F.col("is_tp")).alias("edge_fp"))
    truth = per(gt_edges, ["dataset", "source_id"], "_deg").groupBy("dataset").agg(
        F.sum("_deg").alias("_edges"), F.count_if(F.col("_deg") > 1).alias("division_fn"))
    return (arms.join(per(gt_nodes, ["dataset"], "num_gt_nodes"), "dataset").join(truth, "dataset", "left")
            .join(per(seen, view, "num_pred_nodes"), view, "left")
            .join(per(matches, view, "num_matched_nodes"), view, "left")
            .join(hits, ["dataset", "arm"], "left")
            .fillna(0, ["_edges", "division_fn", "num_pred_nodes", "num_matched_nodes", "edge_tp", "edge_fp"])
            .withColumn("edge_fn", F.col("_edges") - F.col("edge_tp")).drop("_edges"))


def _linked(placed: DataFrame, plan: DataFrame, widest: float, mode: str) -> DataFrame:
    """Links of all views with their length; if an arm's links depend on its radius, of all arms, with ``arm``."""
    def end(name, frame):
        return placed.select("dataset", frame.alias("t"), F.col("node_id").alias(f"{name}_id"), "zu", "yu", "xu",
                             F.col("score").alias(f"_{name}_s"), F.col("clear_um").alias(f"_{name}_c"))
    pairs = range_join(end("source", F.col("t")), end("target", F.col("t") - 1), widest, ["dataset", "t"]).select(
        "dataset", "t", "source_id", "target_id", "d", F.least("_source_s", "_target_s").alias("score"),
        F.least("_source_c", "_target_c").alias("clear_um"))
    if mode == "nearest":
        nearest = (_seen(pairs, plan, "_views").groupBy("dataset", "source_id", "_v")
                   .agg(F.min(F.struct("d", "target_id")).alias("_b")))
        return nearest.select("dataset", "source_id", "_b.*", "_v.*")
    near = _seen(pairs, plan, "_arms").where("d <= _v.radius").select(
        F.concat_ws(_MARK, "_v.arm", "dataset").alias("dataset"), "t", "source_id", "target_id", "d",
        (F.col("_v.radius") - F.col("d")).alias("_w"))
    found = assign.max_weight_matching(near, ["dataset", "t"], "source_id", "target_id", "_w", fullest=True)
    both = F.split("dataset", _MARK, 2)
    return (found.select(both[1].alias("dataset"), both[0].alias("arm"), "source_id", "target_id")
            .join(plan.select("dataset", F.inline("_arms")), ["dataset", "arm"]).drop("radius"))


def resume_grid(nodes: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, budgets: DataFrame, arms: DataFrame,
                stored: DataFrame | None, scale=DEFAULT_SCALE, mode: str = "nearest") -> DataFrame:
    """Metric rows of the arms whose (arm, dataset) isn't among the ``stored`` rows yet."""
    left = arms if stored is None else arms.join(missing_results(arms, stored), ["arm", "dataset"], "left_semi")
    return evaluate_grid(nodes, gt_nodes, gt_edges, budgets, left, scale, mode)

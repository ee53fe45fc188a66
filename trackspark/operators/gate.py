"""Experiment arms: paired gate, rankings, verdicts, champion chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.operators.ordering import rank_rows
from trackspark.operators.score import summarise, summarise_folds
from trackspark.session import cut_lineage


def arm_pairs(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of the datasets scored in both arms of each (baseline, arm) pair.

    Each row is taken once per pair it takes part in, with its ``role``; a dataset
    stays only if both roles are present.
    """
    roles = rows.sparkSession.createDataFrame(
        [(b, a, r, b if r == "b" else a) for b, a in pairs for r in ("b", "a")],
        "baseline string, candidate string, role string, arm string")
    tagged = rows.join(roles, "arm")
    both = (tagged.groupBy("baseline", "candidate", "dataset")
            .agg(F.count_distinct("role").alias("_n")).where("_n = 2").drop("_n"))
    return tagged.join(both, ["baseline", "candidate", "dataset"], "left_semi")


def gate(rows: DataFrame, folds: DataFrame, pairs: list[tuple[str, str]],
         min_gain: float = 0.0) -> DataFrame:
    """Promote an arm only if the pooled score gains and no fold loses.

    One row per pair: baseline, candidate, promote, pooled_delta, fold_deltas (map),
    n_shared, reasons (array). A missing fold delta is no regression; a missing pooled
    delta never promotes; arms without a common dataset get a row that says so.
    """
    paired = arm_pairs(rows, pairs)
    keyed = paired.withColumn("arm", F.concat_ws("\u0001", "baseline", "candidate", "role"))
    scores = summarise_folds(keyed.drop("baseline", "candidate", "role"), folds)
    parts = F.split("arm", "\u0001")
    wide = (scores.select(parts[0].alias("baseline"), parts[1].alias("candidate"),
                          parts[2].alias("role"), "fold", "score", "n")
            .groupBy("baseline", "candidate", "fold")
            .agg(F.max(F.when(F.col("role") == "b", F.col("score"))).alias("_b"),
                 F.max(F.when(F.col("role") == "a", F.col("score"))).alias("_a"),
                 F.max("n").alias("n"))
            .withColumn("delta", F.col("_a") - F.col("_b")))
    entries = F.sort_array(F.collect_list(F.when(
        F.col("fold").isNotNull(), F.struct("fold", "delta"))))
    verdict = wide.groupBy("baseline", "candidate").agg(
        F.max(F.when(F.col("fold").isNull(), F.col("delta"))).alias("pooled_delta"),
        F.max(F.when(F.col("fold").isNull(), F.col("n"))).alias("n_shared"),
        F.count_if(F.col("fold").isNotNull()).alias("n_folds"),
        F.count_if(F.col("fold").isNotNull() & F.coalesce(F.col("delta") < 0, F.lit(False)))
        .alias("n_regressions"),
        F.map_from_entries(entries).alias("fold_deltas"))
    asked = rows.sparkSession.createDataFrame(pairs, "baseline string, candidate string")
    verdict = asked.join(verdict, ["baseline", "candidate"], "left").fillna(0, ["n_shared", "n_folds", "n_regressions"])
    gains = F.coalesce(F.col("pooled_delta") > min_gain, F.lit(False))
    sizes = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("_size"))
    for role in ("baseline", "candidate"):
        verdict = verdict.join(sizes.withColumnsRenamed({"arm": role, "_size": f"_{role}_n"}), role, "left")
    promote = gains & (F.col("n_regressions") == 0)
    delta = F.coalesce(F.format_string("%+.4f", "pooled_delta"), F.lit("nan"))
    losing = F.array_join(F.transform(F.map_keys(F.map_filter(
        "fold_deltas", lambda k, d: d < 0)), lambda k: k.cast("string")), ", ")
    reasons = F.array_compact(F.array(
        F.when(F.col("n_shared") == 0, "no dataset in common"),
        F.when((F.col("n_shared") > 0) & (F.col("n_shared") < F.greatest("_baseline_n", "_candidate_n")),
               F.concat(F.lit("compared on "), F.col("n_shared").cast("string"),
                        F.lit(" shared datasets"))),
        F.when(F.coalesce(F.col("pooled_delta") <= min_gain, F.lit(False)),
               F.concat(F.lit("pooled gain "), delta, F.lit(" is not enough"))),
        F.when(F.col("n_regressions") > 0,
               F.concat(F.lit("regresses folds ["), losing, F.lit("]"))),
        F.when(promote, F.lit("no fold loses")),
        F.when(F.col("n_folds") < 2, F.lit("fewer than two folds: regressions go untested"))))
    return verdict.select("baseline", "candidate", promote.alias("promote"), "pooled_delta",
                          "fold_deltas", "n_shared", "n_regressions", reasons.alias("reasons"))


def champion_chain(verdicts: DataFrame, order: list[str]) -> DataFrame:
    """Walk the arms in ``order``; each is gated against the standing champion.

    ``verdicts`` holds all pairs of the listed arms; a pair without one isn't promoted, and one with
    several only if all promote. The champion moves only on a promotion. One row per challenger:
    arm, gated_against, promoted, champion. A recursive query with one level per challenger, in
    which the standing champion looks up its one verdict.
    """
    spark = verdicts.sparkSession
    settled = verdicts.groupBy("baseline", "candidate").agg(
        F.bool_and(F.coalesce("promote", F.lit(False))).alias("promote"))
    turns = spark.createDataFrame(list(enumerate(order))[1:], "k int, arm string")
    return spark.sql(f"""
        WITH RECURSIVE chain(k, arm, gated_against, promoted, champion) MAX RECURSION LEVEL {len(order) + 1} AS (
          SELECT 0, CAST(NULL AS STRING), CAST(NULL AS STRING), false, :first
          UNION ALL
          SELECT o.k, o.arm, c.champion, coalesce(v.promote, false), if(coalesce(v.promote, false), o.arm, c.champion)
          FROM chain c JOIN {{turns}} o ON o.k = c.k + 1
          LEFT JOIN {{settled}} v ON v.baseline = c.champion AND v.candidate = o.arm)
        SELECT arm, gated_against, promoted, champion FROM chain WHERE k > 0""",
        args={"first": order[0]}, turns=turns, settled=cut_lineage(settled, "verdicts"))


def ranking(summary: DataFrame, reference: str) -> DataFrame:
    """Arms by score, then by name, with their difference to one reference arm."""
    bar = summary.where(F.col("arm") == reference).agg(F.max("score").alias("s"))
    # One scalar, carried in as a subquery result rather than a join side.
    ranked = summary.withColumn("delta", F.col("score") - bar.scalar())
    return rank_rows(ranked, [], ["-score", "-arm"])


def best_arm(summary: DataFrame) -> DataFrame:
    return summary.agg(F.max_by("arm", F.struct("score", "arm")).alias("arm"),
                       F.max("score").alias("score"))


def margin_verdict(delta: Column, margin: float = 0.005) -> Column:
    return (F.when(delta > margin, "CONFIRMED").when(delta < -margin, "FALSIFIED")
            .otherwise("INCONCLUSIVE"))


def drifted(delta: Column, limit: float = 0.005) -> Column:
    return F.abs(delta) > limit


def weight_shares(rows: DataFrame) -> DataFrame:
    """Each dataset's share of its arm's scoring weight, and whether it scored zero."""
    weight = F.col("edge_tp") + F.col("edge_fp") + F.col("edge_fn")
    totals = rows.groupBy("arm").agg(F.sum(weight).alias("_total"))
    return rows.join(totals, "arm").select(
        "arm", "dataset", F.try_divide(weight, F.col("_total")).alias("share"),
        (F.col("adj_edge_jaccard") == 0).alias("zeroed"))


def decompose(summary: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Split a score difference into the part from edges and the part from the multiplier."""
    s = summary.select("arm", "edge_jaccard", "adj_edge_jaccard",
                       F.try_divide("adj_edge_jaccard", "edge_jaccard").alias("mult"))
    wanted = F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), F.lit(a).alias("candidate"))
                                 for b, a in pairs]))
    base = (s.select("*", wanted.alias("_p")).where(F.col("arm") == F.col("_p.baseline"))
            .select("_p.baseline", "_p.candidate", F.col("edge_jaccard").alias("_j0"),
                    F.col("mult").alias("_m0")))
    cand = s.select(F.col("arm").alias("candidate"), F.col("edge_jaccard").alias("_j1"),
                    F.col("mult").alias("_m1"))
    return base.join(cand, "candidate").select(
        "baseline", "candidate", ((F.col("_j1") - F.col("_j0")) * F.col("_m0")).alias("from_edges"),
        (F.col("_j1") * (F.col("_m1") - F.col("_m0"))).alias("from_multiplier"))


def retention(summary: DataFrame, base: str, oracle: str, predicted: str) -> DataFrame:
    """Share of the oracle arm's gain over the base that the predicted arm keeps."""
    def score(arm):
        return F.max(F.when(F.col("arm") == arm, F.col("score")))
    gains = summary.agg((score(oracle) - score(base)).alias("oracle_gain"),
                        (score(predicted) - score(base)).alias("predicted_gain"))
    share = F.when(F.col("oracle_gain") > 0, F.col("predicted_gain") / F.col("oracle_gain"))
    return gains.withColumn("retention", share).withColumn(
        "verdict", F.when(F.col("oracle_gain") <= 0, "VACUOUS")
        .when(F.col("retention") >= 0.5, "CONFIRMED").otherwise("FALSIFIED"))


def score_grid(summary: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    return summary.groupBy(rows).pivot(cols, values).agg(F.first("score"))


def nearest_to_target(counts: DataFrame, setting: str, count: str, target: float) -> DataFrame:
    """The setting whose count is closest to ``target`` (lowest setting on ties)."""
    gap = F.abs(F.col(count) - F.lit(target))
    return counts.agg(F.min_by(setting, F.struct(gap, F.col(setting))).alias(setting))


__all__ = ["gate", "champion_chain", "ranking", "summarise"]

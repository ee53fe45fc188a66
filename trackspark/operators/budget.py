"""Cell-count regression and the detection caps derived from a node budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scalars import embryo, log_feature
from trackspark.operators.ordering import exact_percentiles, rank_rows
from trackspark.session import cut_lineage

FEATURES = ["n_sep4", "n_sep8", "n_sep16", "nstrong_sep4", "nstrong_sep8", "nstrong_sep16",
            "mean_int", "frac_fg"]


def log_design(features: DataFrame) -> DataFrame:
    """dataset, embryo, y = log(budget per frame), and the logged features."""
    return features.select(
        "dataset", embryo(F.col("dataset")).alias("embryo"),
        F.log(F.try_divide("est_total", "t_frames")).alias("y"),
        *[log_feature(name).alias(name) for name in FEATURES])


def feature_correlation(design: DataFrame) -> DataFrame:
    """Correlation of each feature with the target, per embryo and pooled (embryo null)."""
    long = design.select("embryo", "y", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in FEATURES])).alias("_f")) \
        .select("embryo", "y", "_f.feature", "_f.x")
    return (long.groupingSets([[F.col("feature"), F.col("embryo")], [F.col("feature")]],
                              F.col("feature"), F.col("embryo"))
            .agg(F.corr("x", "y").alias("r")))


def moments(design: DataFrame) -> DataFrame:
    """Per embryo: the sums of XᵀX (upper triangle) and Xᵀy, with an intercept column."""
    cols = [F.lit(1.0)] + [F.col(f) for f in FEATURES]
    sums = [F.sum(cols[a] * cols[b]).alias(f"m{a}_{b}")
            for a in range(len(cols)) for b in range(a, len(cols))]
    sums += [F.sum(c * F.col("y")).alias(f"v{k}") for k, c in enumerate(cols)]
    return design.groupBy("embryo").agg(F.count(F.lit(1)).alias("n"), *sums)


def _solve(row) -> list[float]:
    size = len(FEATURES) + 1
    xtx = np.zeros((size, size))
    for a in range(size):
        for b in range(a, size):
            xtx[a, b] = xtx[b, a] = row[f"m{a}_{b}"]
    xty = np.array([row[f"v{k}"] for k in range(size)])
    # Scaling the columns first keeps the minimum-norm solve well conditioned.
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    inner = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-12, hermitian=True)
    return list((inner @ (xty / scale)) / scale)


def fit(design: DataFrame, hold_out: bool = True) -> DataFrame:
    """Coefficients (embryo, beta) for each held-out embryo, fitted on all the others.

    Spark reduces the data to one 9x9 system per embryo; every system is the sum of all of them
    minus the embryo's own, so their number may be any. An embryo without others has no row.
    ``hold_out=False`` fits on everything and gives one row with a null embryo.
    """
    own = moments(design)
    names = [c for c in own.columns if c != "embryo"]
    total = own.agg(*[F.sum(c).alias(c) for c in names])
    if hold_out:
        every = total.select(F.lit(1).alias("_k"), *[F.col(c).alias(f"_{c}") for c in names])
        systems = (own.withColumn("_k", F.lit(1)).join(every, "_k").where((F.col("_n") > F.col("n")) & F.col("embryo").isNotNull())
                   .select("embryo", *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in names]))
    else:
        systems = total.where("n > 0").select(F.lit(None).cast("string").alias("embryo"), *names)

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame({"embryo": pdf["embryo"],
                                "beta": [_solve(row) for row in pdf.to_dict("records")]})

    return systems.mapInPandas(solve, "embryo string, beta array<double>")


def predict(design: DataFrame, coefficients: DataFrame) -> DataFrame:
    """design plus ``yhat`` from the coefficients of the row's embryo, or else from those of all."""
    general = coefficients.where("embryo IS NULL").select(F.lit(1).alias("_k"), F.col("beta").alias("_general"))
    rows = (design.join(coefficients.where("embryo IS NOT NULL"), "embryo", "left")
            .withColumn("_k", F.lit(1)).join(general, "_k", "left")
            .withColumn("_beta", F.coalesce("beta", "_general")))
    yhat = F.col("_beta")[0]
    for k, f in enumerate(FEATURES, 1):
        yhat = yhat + F.col(f) * F.col("_beta")[k]
    return rows.withColumn("yhat", yhat).select(*design.columns, "yhat")


def null_prediction(design: DataFrame) -> DataFrame:
    """design plus ``ynull``: the median target of all other embryos, null where there are none.

    No row is copied to the other embryos. With targets ranked over all rows and within their own
    embryo, the k-th target of the others stands at rank k plus the number of own targets that
    precede it, and those are the ones with fewer than k foreign targets below them.
    """
    known = design.where(F.col("y").isNotNull()).select("embryo", "dataset", "y", F.lit(1).alias("_all"))
    ranked = rank_rows(rank_rows(known, ["_all"], ["y", "embryo", "dataset"], "_r"),
                       ["embryo"], ["y", "_r"], "_i")
    ranked = cut_lineage(ranked, "ranks")
    total = ranked.groupBy("_all").agg(F.count(F.lit(1)).alias("_t"))
    sizes = (ranked.groupBy("_all", "embryo").agg(F.count(F.lit(1)).alias("_n")).join(total, "_all")
             .withColumn("_m", F.col("_t") - F.col("_n")).where("_m > 0")
             .select("embryo", F.floor((F.col("_m") + 1) / 2).alias("_lo"), F.floor((F.col("_m") + 2) / 2).alias("_hi")))
    foreign = F.col("_r") - F.col("_i")
    spots = (ranked.join(sizes, "embryo").groupBy("embryo", "_lo", "_hi")
             .agg(*[(F.col(k) + F.count_if(foreign < F.col(k))).alias(f"{k}_r") for k in ("_lo", "_hi")]))
    at = ranked.select(F.col("_r"), "y")
    medians = (spots.join(at.withColumnsRenamed({"_r": "_lo_r", "y": "_a"}), "_lo_r")
               .join(at.withColumnsRenamed({"_r": "_hi_r", "y": "_b"}), "_hi_r")
               .select("embryo", ((F.col("_a") + F.col("_b")) / 2).alias("ynull")))
    return design.join(medians, "embryo", "left")


def relative_error(pred, truth="y"):
    return F.abs(F.exp(F.col(pred) - F.col(truth)) - 1)


def error_report(predicted: DataFrame) -> DataFrame:
    """Median and mean relative error of ``yhat`` and ``ynull`` per embryo and pooled."""
    errors = predicted.select(
        F.explode(F.array("embryo", F.lit("pooled"))).alias("part"),
        relative_error("yhat").alias("e_model"), relative_error("ynull").alias("e_null"))
    out = errors.groupBy("part").agg(F.avg("e_model").alias("mean_model"),
                                     F.avg("e_null").alias("mean_null"))
    for name in ("model", "null"):
        out = out.join(exact_percentiles(errors, ["part"], f"e_{name}", {f"median_{name}": .5}),
                       "part")
    return out


def widest_misses(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of (dataset, truth, predicted) with the largest |log ratio|."""
    miss = F.abs(F.log(F.try_divide("predicted", "truth")))
    return pairs.withColumn("miss", miss).orderBy(F.col("miss").desc(), "dataset").limit(k)


def frame_caps(budgets: DataFrame, fill: float, n_t: int, max_per_frame: int | None) -> DataFrame:
    """Detections allowed per frame: the budget's share, at least 1; null means no cap."""
    share = F.greatest(F.lit(1), F.floor(F.lit(float(fill)) * F.col("est_total")
                                         / F.lit(float(max(1, n_t))))).cast("bigint")
    top = F.lit(max_per_frame).cast("bigint")
    return budgets.select("dataset", F.when(F.col("est_total") > 0, F.least(share, top))
                          .otherwise(top).alias("cap"))


def strongest_per_frame(detections: DataFrame, caps: DataFrame) -> DataFrame:
    """The ``cap`` highest scores of every frame; ties go to the lower position."""
    ranked = rank_rows(detections, ["dataset", "t"], ["-score", "z", "y", "x", "node_id"], "_rank")
    return (ranked.join(caps, "dataset", "left")
            .where(F.col("cap").isNull() | (F.col("_rank") <= F.col("cap")))
            .select(*detections.columns))

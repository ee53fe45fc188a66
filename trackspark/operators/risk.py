"""Label statistics and training risks as aggregates over (logit, target, mask, prior)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scalars import clip_prior, softplus


def label_balance(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.col("target").cast("double")).alias("positive"),
                                   F.avg(F.col("mask").cast("double")).alias("kept"))


def label_risk(rows: DataFrame, keys: list[str], pos_weight: float = 50.0) -> DataFrame:
    """Naive, masked and non-negative positive-unlabelled risk per ``keys``.

    The last one takes the class prior as known; where the estimated negative part
    falls below zero its sign is flipped instead of following it down.
    """
    y = F.col("target").cast("double")
    m = F.col("mask").cast("double")
    as_pos, as_neg = softplus(-F.col("logit")), softplus(F.col("logit"))
    loss = F.lit(pos_weight) * y * as_pos + (1 - y) * as_neg
    one = F.lit(1.0)
    sums = rows.groupBy(*keys).agg(
        F.avg(loss).alias("naive"),
        (F.sum(loss * m) / F.greatest(F.sum(m), one)).alias("masked"),
        (F.sum(y * as_pos) / F.greatest(F.sum(y), one)).alias("_pp"),
        (F.sum(y * as_neg) / F.greatest(F.sum(y), one)).alias("_pn"),
        (F.sum((1 - y) * as_neg) / F.greatest(F.sum(1 - y), one)).alias("_un"),
        clip_prior(F.max("prior")).alias("_pi"))
    negative = F.col("_un") - F.col("_pi") * F.col("_pn")
    return sums.select(*keys, "naive", "masked", F.when(negative < 0, -negative)
                       .otherwise(F.col("_pi") * F.col("_pp") + negative).alias("pu"))

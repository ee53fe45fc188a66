"""Deterministic folds and samples of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scalars import embryo, hash_fold
from trackspark.operators.ordering import rank_rows


def embryo_folds(names: DataFrame) -> DataFrame:
    """Leave-one-embryo-out fold per dataset; the name hash where only one embryo exists."""
    tagged = names.select("dataset").distinct().withColumn("embryo", embryo(F.col("dataset")))
    counted = tagged.agg(F.count_distinct("embryo").alias("e"), F.count(F.lit(1)).alias("n"))
    order = rank_rows(tagged.select("embryo").distinct(), [], ["embryo"], "_pos")
    k = F.least(F.lit(5), F.greatest(F.lit(1), counted.select("n").scalar()))
    by_hash = F.element_at(F.array(*[hash_fold(F.col("dataset"), F.lit(j)) for j in range(1, 6)]),
                           k.cast("int"))
    several = counted.select("e").scalar() > 1
    return tagged.join(order, "embryo").select(
        "dataset", F.when(several, F.col("_pos") - 1).otherwise(by_hash).alias("fold"))


def hash_folds(names: DataFrame, k: int = 5) -> DataFrame:
    return names.select("dataset", hash_fold(F.col("dataset"), F.lit(k)).alias("fold"))


def split_folds(splits: DataFrame) -> DataFrame:
    """Fold of every test name in ``splits(fold, test array<string>)``; the last one wins."""
    return (splits.select("fold", F.explode("test").alias("dataset"))
            .groupBy("dataset").agg(F.max("fold").alias("fold")))


def allocation(names: DataFrame, size: int) -> DataFrame:
    """Datasets to take per embryo: its share of ``size``, rounded half to even."""
    tagged = names.select("dataset", embryo(F.col("dataset")).alias("embryo"))
    counts = tagged.groupBy("embryo").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("take", F.rint(F.lit(float(size)) * F.col("n") / total).cast("bigint"))


def stratified_subset(names: DataFrame, size: int) -> DataFrame:
    """The first ``take`` datasets of each embryo in SHA-1 order of the name."""
    tagged = names.select("dataset", embryo(F.col("dataset")).alias("embryo"),
                          F.sha1("dataset").alias("_key"))
    ranked = rank_rows(tagged, ["embryo"], ["_key", "dataset"], "_rank")
    return (ranked.join(allocation(names, size), "embryo")
            .where(F.col("_rank") <= F.col("take")).select("dataset", "embryo"))


def evenly_spaced(names: DataFrame, k: int) -> DataFrame:
    """``k`` names at evenly spaced positions of the sorted list (truncated positions)."""
    distinct = names.select("dataset").distinct()
    ranked = rank_rows(distinct, [], ["dataset"], "_pos")
    last = distinct.agg(F.count(F.lit(1)) - 1).scalar()
    step = last / F.lit(float(max(1, k - 1)))
    wanted = names.sparkSession.range(k).select(
        (F.floor(F.col("id") * step) + 1).cast("bigint").alias("_pos")).distinct()
    return ranked.join(wanted, "_pos", "left_semi").select("dataset")


def inventory_gaps(images: DataFrame, truths: DataFrame) -> DataFrame:
    """Every name with whether it is usable, or lacks its image or its ground truth."""
    a = images.select("dataset").distinct().withColumn("_i", F.lit(True))
    b = truths.select("dataset").distinct().withColumn("_g", F.lit(True))
    return a.join(b, "dataset", "full").select(
        "dataset", F.when(F.col("_i") & F.col("_g"), "usable")
        .when(F.col("_i"), "no_ground_truth").otherwise("no_image").alias("status"))


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))

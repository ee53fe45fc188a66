"""Ranks, running sums and exact percentiles that never sort one group in one task.

A window partitioned by a recording (or by a hot frame) would send that whole group
to a single task. Here rows are range-partitioned on the full order instead, numbered
inside each range, and shifted by the totals of the earlier ranges. The shift table
has at most one row per range, so broadcasting it is bounded by the number of shuffle
partitions, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import cut_lineage


def _keys(order):
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def running_sum(df: DataFrame, group: list[str], order: list[str], out: str,
                weight: str | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` (1 if None) per group, in ``order``.

    ``order`` names columns, a leading ``-`` meaning descending; together with
    ``group`` it must identify a row for the result to be deterministic.
    """
    keys = [F.col(g).asc() for g in group] + _keys(order)
    step = F.col(weight) if weight else F.lit(1)
    # Range boundaries come from sampling, so the range number is stored with the row
    # before anything is derived from it.
    placed = cut_lineage(
        df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranged")

    slices = placed.groupBy("_range", *group).agg(F.sum(step).alias("_slice"))
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))
    earlier = earlier.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (slices.withColumn("_shift", F.sum("_slice").over(earlier))
              .where(F.col("_shift").isNotNull())
              .select("_range", *group, "_shift"))

    inside = (Window.partitionBy("_range", *group).orderBy(*_keys(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = placed.withColumn("_inside", F.sum(step).over(inside))
    return (numbered.join(F.broadcast(shifts), ["_range", *group], "left")
            .withColumn(out, F.col("_inside") + F.coalesce("_shift", F.lit(0)))
            .drop("_range", "_inside", "_shift"))


def rank_rows(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """1-based rank inside each group."""
    ranked = running_sum(df, group, order, out)
    return ranked.withColumn(out, F.col(out).cast("bigint"))


def exact_percentiles(df: DataFrame, group: list[str], value: str,
                      percentiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per group; ``percentiles`` maps name -> q in [0, 1].

    Equal values are counted first, so a group made of copies costs one row, and the
    value order is ranked by ``running_sum`` rather than held in one aggregation buffer.
    """
    keys = group or ["_all"]
    data = df if group else df.withColumn("_all", F.lit(0))
    counts = (data.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    upto = running_sum(counts, keys, [value], "_upto", weight="_n")
    # From the ranked table, which is already written, not from the source again.
    totals = upto.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = upto.join(totals, keys)

    picks, outputs = [], []
    for name, q in percentiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            covers = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{side}"))
        spread = F.lit(float(q)) * (F.col("_n_all") - 1)
        outputs.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
                        * (spread - F.floor(spread))).alias(name))
    return (placed.groupBy(*keys).agg(F.max("_total").alias("_n_all"), *picks)
            .select(*group, *outputs))

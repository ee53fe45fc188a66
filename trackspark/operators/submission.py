"""The flat submission table: building, reading back and validating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scalars import budget_multiplier
from trackspark.operators.edges import degrees
from trackspark.operators.ordering import rank_rows, running_sum
from trackspark.schema import SUBMISSION_COLUMNS


def flat_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node rows and edge rows of every dataset with ``-1`` in the unused columns.

    Coordinates are rounded half to even. ``_kind`` and ``_ord`` give the row order.
    """
    none = F.lit(-1).cast("bigint")
    node_rows = nodes.select(
        "dataset", F.lit("node").alias("row_type"), "node_id", "t",
        *[F.rint(a).cast("bigint").alias(a) for a in "zyx"],
        none.alias("source_id"), none.alias("target_id"),
        F.lit(0).alias("_kind"), F.col("node_id").alias("_ord"))
    edge_rows = edges.select(
        "dataset", F.lit("edge").alias("row_type"), none.alias("node_id"), none.alias("t"),
        *[none.alias(a) for a in "zyx"], "source_id", "target_id",
        F.lit(1).alias("_kind"), F.col("edge_id").alias("_ord"))
    return node_rows.unionByName(edge_rows)


def build_submission(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Flat rows with a contiguous ``id`` over datasets, nodes before edges."""
    rows = rank_rows(flat_rows(nodes, edges), [], ["dataset", "_kind", "_ord"], "id")
    return rows.withColumn("id", F.col("id") - 1).select(*SUBMISSION_COLUMNS)


def offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """First row id and row counts of every dataset block."""
    counts = (flat_rows(nodes, edges).groupBy("dataset")
              .agg(F.count_if(F.col("_kind") == 0).alias("nodes"),
                   F.count_if(F.col("_kind") == 1).alias("edges")))
    total = running_sum(counts.withColumn("_rows", F.col("nodes") + F.col("edges")),
                        [], ["dataset"], "_end", weight="_rows")
    return total.select("dataset", (F.col("_end") - F.col("_rows")).alias("first_id"),
                        "nodes", "edges")


def validate(rows: DataFrame, expected: DataFrame | None = None,
             budgets: DataFrame | None = None) -> DataFrame:
    """Problems and notes, one row each: (dataset, severity, code, n, detail).

    ``detail`` holds the budget multiplier of the ``summary`` note and is null elsewhere.
    """
    nodes = rows.where("row_type = 'node'")
    edges = rows.where("row_type = 'edge'")
    base = rows.groupBy("dataset").agg(
        F.count_if(F.col("row_type") == "node").alias("nodes"),
        F.count_if(F.col("row_type") == "edge").alias("edges"),
        F.count_if(~F.col("row_type").isin("node", "edge")).alias("bad_row_type"))

    # Several rows may carry one node id; the last frame listed is the one that counts.
    ids = nodes.groupBy("dataset", "node_id").agg(
        F.count(F.lit(1)).alias("_c"), F.max_by("t", "id").alias("t"))
    dup_nodes = ids.groupBy("dataset").agg(F.sum(F.col("_c") - 1).alias("duplicate_node_id"))

    src = ids.select("dataset", F.col("node_id").alias("source_id"), F.col("t").alias("s_t"))
    dst = ids.select("dataset", F.col("node_id").alias("target_id"), F.col("t").alias("d_t"))
    ends = (edges.select("dataset", "source_id", "target_id")
            .join(src, ["dataset", "source_id"], "left")
            .join(dst, ["dataset", "target_id"], "left")
            .groupBy("dataset").agg(
                F.count_if(F.col("s_t").isNull() | F.col("d_t").isNull()).alias("dangling_edge"),
                F.count_if(F.col("d_t") - F.col("s_t") != 1).alias("not_one_frame")))
    pairs = (edges.groupBy("dataset", "source_id", "target_id").agg(F.count(F.lit(1)).alias("_c"))
             .groupBy("dataset").agg(F.sum(F.col("_c") - 1).alias("duplicate_edge")))
    outs = (edges.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("dataset").agg(F.count_if(F.col("_c") > 2).alias("out_degree"),
                                    F.count_if(F.col("_c") == 2).alias("divisions")))
    ins = (edges.groupBy("dataset", "target_id").agg(F.count(F.lit(1)).alias("_c"))
           .groupBy("dataset").agg(F.count_if(F.col("_c") > 1).alias("merge")))

    table = base
    for part in (dup_nodes, ends, pairs, outs, ins):
        table = table.join(part, "dataset", "left")
    table = table.fillna(0)
    if budgets is not None:
        table = table.join(budgets, "dataset", "left").withColumn(
            "_mult", F.when(F.col("est_total") > 0, budget_multiplier(
                (F.col("nodes") - F.col("est_total")) / F.col("est_total"))))
    else:
        table = table.withColumn("_mult", F.lit(None).cast("double"))

    def row(severity, code, n, detail=None):
        return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                        n.cast("bigint").alias("n"),
                        (detail if detail is not None else F.lit(None).cast("double"))
                        .alias("detail"))

    full = (F.col("nodes") > 0) & (F.col("edges") > 0)
    problems = ["duplicate_node_id", "dangling_edge", "not_one_frame", "duplicate_edge",
                "out_degree"]
    found = F.filter(F.array(
        F.when(F.col("bad_row_type") > 0, row("fatal", "bad_row_type", F.col("bad_row_type"))),
        F.when(F.col("nodes") == 0, row("problem", "no_node_rows", F.lit(1))),
        F.when((F.col("nodes") > 0) & (F.col("edges") == 0),
               row("problem", "no_edge_rows", F.lit(1))),
        *[F.when(full & (F.col(c) > 0), row("problem", c, F.col(c))) for c in problems],
        F.when(full & (F.col("merge") > 0), row("note", "merge", F.col("merge"))),
        F.when(full, row("note", "summary", F.col("divisions"), F.col("_mult"))),
    ), lambda e: e.isNotNull())
    out = table.select("dataset", F.explode(found).alias("_f")).select("dataset", "_f.*")
    if expected is not None:
        have = rows.select("dataset").distinct()
        want = expected.select("dataset").distinct()

        def gap(df, severity, code):
            return df.select("dataset", F.lit(severity).alias("severity"),
                             F.lit(code).alias("code"), F.lit(1).cast("bigint").alias("n"),
                             F.lit(None).cast("double").alias("detail"))

        out = (out.unionByName(gap(want.exceptAll(have), "fatal", "missing_dataset"))
               .unionByName(gap(have.exceptAll(want), "problem", "unexpected_dataset")))
    return out


def missing_columns(rows: DataFrame) -> list[str]:
    return [c for c in SUBMISSION_COLUMNS if c not in rows.columns]


def run_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per dataset: nodes, edges, forking sources and edges per node."""
    d = degrees(nodes, edges)
    return d.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"),
        F.count_if(F.col("out_degree") >= 2).alias("division_like_sources")).withColumn(
        "edge_to_node_ratio", F.col("edges") / F.greatest(F.col("nodes"), F.lit(1)))

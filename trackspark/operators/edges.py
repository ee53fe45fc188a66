"""Edge-table rules: degrees, de-duplication, frame span, caps, best edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.geometry import norm3
from trackspark.schema import DEFAULT_SCALE


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes plus ``out_degree`` and ``in_degree`` (0 where a node has no edge)."""
    ends = edges.select(
        "dataset", F.explode(F.array(
            F.struct(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("e")).select("dataset", "e.*")
    counts = ends.groupBy("dataset", "node_id").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return (nodes.join(counts, ["dataset", "node_id"], "left")
            .fillna(0, ["out_degree", "in_degree"]))


def first_of_duplicates(edges: DataFrame) -> DataFrame:
    """Keep the lowest edge id of every (source, target) pair."""
    rest = [c for c in edges.columns if c not in ("dataset", "source_id", "target_id")]
    lead = ["edge_id"] + [c for c in rest if c != "edge_id"]
    return (edges.groupBy("dataset", "source_id", "target_id")
            .agg(F.min(F.struct(*lead)).alias("_e"))
            .select("dataset", "source_id", "target_id", *[F.col(f"_e.{c}") for c in lead])
            .select(*edges.columns))


def with_endpoints(edges: DataFrame, nodes: DataFrame, columns=("t",)) -> DataFrame:
    """Attach ``s_<col>`` and ``d_<col>``; edges with a missing endpoint drop out."""
    src = nodes.select("dataset", F.col("node_id").alias("source_id"),
                       *[F.col(c).alias(f"s_{c}") for c in columns])
    dst = nodes.select("dataset", F.col("node_id").alias("target_id"),
                       *[F.col(c).alias(f"d_{c}") for c in columns])
    return edges.join(src, ["dataset", "source_id"]).join(dst, ["dataset", "target_id"])


def spans_one_frame() -> Column:
    return F.col("d_t") - F.col("s_t") == 1


def consecutive(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return (with_endpoints(edges, nodes).where(spans_one_frame())
            .select(*edges.columns))


def edge_length(scale=DEFAULT_SCALE) -> Column:
    return norm3(*[(F.col(f"s_{a}") - F.col(f"d_{a}")) * F.lit(float(s))
                   for a, s in zip("zyx", scale)])


def drop_long(edges: DataFrame, nodes: DataFrame, limit_um: float = 14.2) -> DataFrame:
    """Edges that exist, span one frame and are at most ``limit_um`` long, with ``distance_um``."""
    spatial = with_endpoints(edges, nodes, ("t", "z", "y", "x"))
    return (spatial.where(spans_one_frame())
            .withColumn("distance_um", edge_length())
            .where(F.col("distance_um") <= limit_um)
            .select(*edges.columns, "distance_um"))


def long_edge_counters(edges: DataFrame, nodes: DataFrame, limit_um: float = 14.2) -> DataFrame:
    """Per dataset: raw edges and how many each rule removes, in rule order."""
    spatial = with_endpoints(edges, nodes, ("t", "z", "y", "x"))
    long = spans_one_frame() & (edge_length() > limit_um)
    kept = spatial.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("attached"),
        F.count_if(~spans_one_frame()).alias("dropped_nonconsecutive"),
        F.count_if(long).alias("dropped_long"))
    raw = edges.groupBy("dataset").agg(F.count(F.lit(1)).alias("raw_edges"))
    return (raw.join(kept, "dataset", "left").fillna(0)
            .select("dataset", "raw_edges",
                    (F.col("raw_edges") - F.col("attached")).alias("dropped_dangling"),
                    "dropped_nonconsecutive", "dropped_long"))


def cap_out_degree(edges: DataFrame, limit: int = 2) -> DataFrame:
    """Keep each source's ``limit`` lowest edge ids."""
    order = Window.partitionBy("dataset", "source_id").orderBy("edge_id")
    return (edges.withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= limit).drop("_rank"))


def best_edge(edges: DataFrame, end: str) -> DataFrame:
    """One edge per ``end`` node: highest probability, then shortest, then first seen."""
    keep = F.struct((-F.coalesce("edge_prob", F.lit(0.0))).alias("_p"),
                    F.col("distance_um").alias("_d"), F.col("edge_id").alias("_i"),
                    *[F.col(c) for c in edges.columns if c not in ("dataset", end)])
    return (edges.groupBy("dataset", end).agg(F.min(keep).alias("_e"))
            .select("dataset", end, "_e.*").select(*edges.columns))


def relabel(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Attach the matched ground-truth ids of both endpoints (null where unmatched)."""
    ms = matches.select("dataset", F.col("pred_id").alias("source_id"),
                        F.col("gt_id").alias("matched_source"))
    mt = matches.select("dataset", F.col("pred_id").alias("target_id"),
                        F.col("gt_id").alias("matched_target"))
    return (edges.join(ms, ["dataset", "source_id"], "left")
            .join(mt, ["dataset", "target_id"], "left"))


def collapse_merges(edges: DataFrame) -> DataFrame:
    """Of relabelled edges landing on one ground-truth pair keep the lowest edge id."""
    both = F.col("matched_source").isNotNull() & F.col("matched_target").isNotNull()
    rest = [c for c in edges.columns
            if c not in ("dataset", "matched_source", "matched_target", "edge_id")]
    one = (edges.where(both).groupBy("dataset", "matched_source", "matched_target")
           .agg(F.min(F.struct("edge_id", *rest)).alias("_e"))
           .select("dataset", "matched_source", "matched_target", "_e.*")
           .select(*edges.columns))
    return one.unionByName(edges.where(~both))


def only_neighbour(edges: DataFrame, end: str, other: str, out: str) -> DataFrame:
    """The neighbour of every node that has exactly one edge on that side."""
    return (edges.groupBy("dataset", F.col(end).alias("node_id"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(other).alias(out))
            .where("_n = 1").drop("_n"))


def open_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes plus ``is_end`` (no out-edge), ``is_start`` (no in-edge), ``is_isolated``."""
    d = degrees(nodes, edges)
    return (d.withColumns({
        "is_end": F.col("out_degree") == 0, "is_start": F.col("in_degree") == 0,
        "is_isolated": (F.col("out_degree") == 0) & (F.col("in_degree") == 0)})
        .drop("out_degree", "in_degree"))

"""Track-graph operators: ids, pruning, components, smoothing, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.geometry import norm3
from trackspark.operators.edges import (
    best_edge, degrees, edge_length, only_neighbour, spans_one_frame, with_endpoints)
from trackspark.operators.ordering import rank_rows
from trackspark.schema import DEFAULT_SCALE
from trackspark.session import cut_lineage, discard, is_empty


# -- identifiers ---------------------------------------------------------------

def densify(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-number nodes 0..N-1 per dataset in id order and re-key the edges."""
    numbered = rank_rows(nodes, ["dataset"], ["node_id"], "_rank")
    numbered = numbered.withColumn("_rank", F.col("_rank") - 1)
    new_id = numbered.select("dataset", "node_id", "_rank")
    out_nodes = numbered.withColumn("node_id", F.col("_rank")).drop("_rank")
    rest = [c for c in edges.columns if c not in ("dataset", "source_id", "target_id")]
    out_edges = (
        edges.join(new_id.withColumnsRenamed({"node_id": "source_id", "_rank": "_s"}),
                   ["dataset", "source_id"])
        .join(new_id.withColumnsRenamed({"node_id": "target_id", "_rank": "_d"}),
              ["dataset", "target_id"])
        .select("dataset", *rest, F.col("_s").alias("source_id"), F.col("_d").alias("target_id"))
        .select(*edges.columns))
    return out_nodes, out_edges


def incident_nodes(edges: DataFrame) -> DataFrame:
    return (edges.select("dataset", F.explode(F.array("source_id", "target_id")).alias("node_id"))
            .distinct())


def prune_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with at least one edge."""
    return nodes.join(incident_nodes(edges), ["dataset", "node_id"], "left_semi")


def append_nodes(nodes: DataFrame, extra: DataFrame, order: list[str]) -> DataFrame:
    """Number ``extra`` rows after each dataset's highest node id, in ``order``.

    Returns ``extra`` with ``node_id``; the caller unions it to the nodes.
    """
    top = nodes.groupBy("dataset").agg(F.max("node_id").alias("_top"))
    return (rank_rows(extra, ["dataset"], order, "_rank").join(top, "dataset")
            .withColumn("node_id", F.col("_top") + F.col("_rank")).drop("_top", "_rank"))


# -- components ----------------------------------------------------------------

def connected_components(nodes: DataFrame, edges: DataFrame,
                         keys=("dataset",), node: str = "node_id",
                         source: str = "source_id", target: str = "target_id") -> DataFrame:
    """``component`` (the lowest node id) of every node, direction ignored.

    Rounds of contraction: every node joins the neighbour of least hash (or stays), the
    edges are rewritten to the new labels and repeats dropped, so the graph shrinks by
    a constant factor per round whatever its shape. The hash is re-drawn each round.
    Neighbour minima are partial aggregates, so a hub never gathers in one task.
    """
    keys = list(keys)
    labels = nodes.select(*keys, F.col(node).alias("_node"), F.col(node).alias("_label"))
    live = (edges.where(F.col(source) != F.col(target))
            .select(*keys, F.col(source).alias("_u"), F.col(target).alias("_v")))
    live = cut_lineage(_both_ways(live, keys).distinct(), "links")
    moves, kept = [], None
    for turn in range(64):
        if is_empty(live):
            break

        def draw(c):
            return F.xxhash64(F.lit(turn), F.col(c))

        pull = (live.groupBy(*keys, "_u")
                .agg(F.min(F.struct(draw("_v").alias("h"), F.col("_v").alias("v"))).alias("_m"))
                .select(*keys, F.col("_u").alias("_node"),
                        F.when(F.struct(draw("_u").alias("h"), F.col("_u").alias("v"))
                               < F.col("_m"), F.col("_u"))
                        .otherwise(F.col("_m.v")).alias("_next")))
        pull = cut_lineage(pull, "pull")
        rest = cut_lineage(
            live.join(pull.withColumnsRenamed({"_node": "_u", "_next": "_nu"}), [*keys, "_u"])
            .join(pull.withColumnsRenamed({"_node": "_v", "_next": "_nv"}), [*keys, "_v"])
            .where("_nu <> _nv")
            .select(*keys, F.col("_nu").alias("_u"), F.col("_nv").alias("_v")).distinct(), "links")
        discard(live)
        live = rest
        # Each round's moves are smaller than the last; they are applied to the nodes in
        # one plan, written out now and then so that the plan stays short.
        moves.append(pull)
        labels = (labels.join(pull.withColumnsRenamed({"_node": "_label"}), [*keys, "_label"], "left")
                  .select(*keys, "_node", F.coalesce("_next", "_label").alias("_label")))
        if len(moves) == 8:
            written = cut_lineage(labels, "labels")
            discard(*moves, kept)
            labels, kept, moves = written, written, []
    else:
        raise RuntimeError("components did not settle")
    lowest = labels.groupBy(*keys, "_label").agg(F.min("_node").alias("component"))
    return (labels.join(lowest, [*keys, "_label"])
            .select(*keys, F.col("_node").alias(node), "component"))


def _both_ways(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return (pairs.select(*keys, F.explode(F.array(
        F.struct(F.col("_u").alias("a"), F.col("_v").alias("b")),
        F.struct(F.col("_v").alias("a"), F.col("_u").alias("b")))).alias("p"))
        .select(*keys, F.col("p.a").alias("_u"), F.col("p.b").alias("_v")))


def track_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component: size, first and last frame, and whether any node divides."""
    parts = connected_components(nodes, edges)
    return (degrees(nodes, edges).join(parts, ["dataset", "node_id"])
            .groupBy("dataset", "component")
            .agg(F.count(F.lit(1)).alias("n_nodes"), F.min("t").alias("t_first"),
                 F.max("t").alias("t_last"),
                 F.bool_or(F.col("out_degree") >= 2).alias("divides")))


def long_tracks(nodes: DataFrame, edges: DataFrame, min_len: int = 4,
                keep_divisions: bool = True) -> tuple[DataFrame, DataFrame]:
    """Drop components shorter than ``min_len`` unless they divide.

    A dataset that would lose everything is left as it is.
    """
    parts = cut_lineage(connected_components(nodes, edges), "components")
    sized = (degrees(nodes, edges).join(parts, ["dataset", "node_id"])
             .groupBy("dataset", "component")
             .agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("out_degree") >= 2).alias("_div")))
    good = (F.col("_n") >= min_len) | (F.col("_div") if keep_divisions else F.lit(False))
    kept = sized.where(good)
    spared = sized.join(kept.select("dataset").distinct(), "dataset", "left_anti")
    keep = (kept.unionByName(spared).select("dataset", "component")
            .join(parts, ["dataset", "component"]).select("dataset", "node_id"))
    keep = cut_lineage(keep, "kept")
    out_nodes = nodes.join(keep, ["dataset", "node_id"], "left_semi")
    # Both ends of an edge share a component, so one end decides.
    out_edges = edges.join(keep.withColumnsRenamed({"node_id": "source_id"}),
                           ["dataset", "source_id"], "left_semi")
    return out_nodes, out_edges


# -- smoothing -----------------------------------------------------------------

def neighbourhood(nodes: DataFrame, edges: DataFrame, reach: int = 2) -> DataFrame:
    """Rows (dataset, node_id, step, other_id) along unambiguous links, step in -reach..reach.

    The walk stops at the first node with no or several neighbours on that side.
    """
    valid = with_endpoints(edges, nodes).where(spans_one_frame())
    ahead = only_neighbour(valid, "source_id", "target_id", "next_id")
    behind = only_neighbour(valid, "target_id", "source_id", "next_id")
    rows = nodes.select("dataset", "node_id", F.lit(0).alias("step"),
                        F.col("node_id").alias("other_id"))
    for hop, sign in ((ahead, 1), (behind, -1)):
        front = nodes.select("dataset", "node_id", F.col("node_id").alias("other_id"))
        link = hop.withColumnsRenamed({"node_id": "other_id"})
        for n in range(1, reach + 1):
            front = (front.join(link, ["dataset", "other_id"])
                     .select("dataset", "node_id", F.col("next_id").alias("other_id")))
            rows = rows.unionByName(front.select("dataset", "node_id",
                                                 F.lit(sign * n).alias("step"), "other_id"))
    return rows


def smooth_tracks(nodes: DataFrame, edges: DataFrame, weight: float = 0.74,
                  reach: int = 2) -> DataFrame:
    """Blend each position with the value at 0 of a line fitted through its neighbourhood.

    Nodes with fewer than three points on their chain keep their position. All fits
    read the original positions, so one pass suffices.
    """
    spots = nodes.select("dataset", F.col("node_id").alias("other_id"),
                         *[F.col(a).alias(f"o{a}") for a in "zyx"])
    step = F.col("step").cast("double")
    fits = (neighbourhood(nodes, edges, reach).join(spots, ["dataset", "other_id"])
            .groupBy("dataset", "node_id")
            .agg(F.count(F.lit(1)).alias("_n"),
                 *[F.regr_intercept(F.col(f"o{a}"), step).alias(f"f{a}") for a in "zyx"]))
    joined = nodes.join(fits, ["dataset", "node_id"], "left")
    w = min(1.0, max(0.0, weight))
    return joined.withColumns({
        a: F.when(F.col("_n") >= 3, F.lit(1.0 - w) * F.col(a) + F.lit(w) * F.col(f"f{a}"))
        .otherwise(F.col(a)) for a in "zyx"}).select(*nodes.columns)


# -- divisions -----------------------------------------------------------------

def filter_divisions(edges: DataFrame, nodes: DataFrame, parent_um: float = 10.5,
                     sister_um: float = 8.0, single_if_bad: bool = True) -> DataFrame:
    """Of each forking source keep its two best edges if they look like a division, else one.

    Edges are ranked by probability, then length, then id; both children must lie in the
    next frame, within ``parent_um`` of the parent and ``sister_um`` of each other.
    """
    measured = (with_endpoints(edges, nodes, ("t", "z", "y", "x"))
                .withColumn("_len", F.col("distance_um") if "distance_um" in edges.columns
                            else edge_length()))
    order = Window.partitionBy("dataset", "source_id").orderBy(
        F.coalesce("edge_prob", F.lit(0.0)).desc(), F.col("_len").asc(), F.col("edge_id").asc())
    ranked = measured.withColumn("_rank", F.row_number().over(order))
    top = ranked.where(F.col("_rank") <= 2)

    def side(k, prefix):
        return top.where(F.col("_rank") == k).select(
            "dataset", "source_id", F.col("_len").alias(f"{prefix}len"),
            spans_one_frame().alias(f"{prefix}ok"),
            *[F.col(f"d_{a}").alias(f"{prefix}{a}") for a in "zyx"])

    apart = norm3(*[(F.col(f"p_{a}") - F.col(f"q_{a}")) * F.lit(float(s))
                    for a, s in zip("zyx", DEFAULT_SCALE)])
    verdict = (side(1, "p_").join(side(2, "q_"), ["dataset", "source_id"])
               .select("dataset", "source_id",
                       ((F.greatest("p_len", "q_len") <= parent_um) & (apart <= sister_um)
                        & F.col("p_ok") & F.col("q_ok")).alias("_division")))
    keep = F.when(F.col("_division").isNull(), True).when(F.col("_division"), F.col("_rank") <= 2)
    keep = keep.otherwise(F.col("_rank") == 1 if single_if_bad else F.lit(True))
    source = ranked if not single_if_bad else top
    return source.join(verdict, ["dataset", "source_id"], "left").where(keep).select(*edges.columns)


# -- validation ----------------------------------------------------------------

def check_graph(nodes: DataFrame, edges: DataFrame, allow_divisions: bool = False) -> DataFrame:
    """One row per dataset and defect: (dataset, code, n).

    Node ids are expected to be 0..N-1; a dataset with an endpoint outside reports only
    that, because the other checks would not be meaningful.
    """
    limit = 2 if allow_divisions else 1
    size = nodes.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.greatest(*[F.abs(F.nanvl(F.col(a).cast("double"), F.lit(float("inf")))) for a in "zyx"]) == float("inf"))
        .alias("non_finite"))
    bounds = edges.groupBy("dataset").agg(
        F.min(F.least("source_id", "target_id")).alias("_lo"),
        F.max(F.greatest("source_id", "target_id")).alias("_hi"),
        F.count(F.lit(1)).alias("_edges"),
        F.count_if(F.col("source_id") == F.col("target_id")).alias("self_loop"))
    pairs = (edges.groupBy("dataset", "source_id", "target_id").agg(F.count(F.lit(1)).alias("_c"))
             .groupBy("dataset").agg(F.sum(F.col("_c") - 1).alias("duplicate_edge")))
    spans = (with_endpoints(edges, nodes).groupBy("dataset")
             .agg(F.count_if(~spans_one_frame()).alias("not_one_frame")))
    deg = degrees(nodes.select("dataset", "node_id"), edges).groupBy("dataset").agg(
        F.count_if(F.col("in_degree") > 1).alias("merge"),
        F.count_if(F.col("out_degree") > limit).alias("out_degree"))
    table = (size.join(bounds, "dataset", "left").join(pairs, "dataset", "left")
             .join(spans, "dataset", "left").join(deg, "dataset", "left"))
    outside = F.coalesce((F.col("_lo") < 0) | (F.col("_hi") >= F.col("_n")), F.lit(False))
    codes = ["not_one_frame", "self_loop", "duplicate_edge", "merge", "out_degree", "non_finite"]
    found = F.when(outside, F.array(F.struct(F.lit("endpoint_outside").alias("code"),
                                             F.lit(1).cast("bigint").alias("n")))).otherwise(
        F.array(*[F.struct(F.lit(c).alias("code"),
                           F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n"))
                  for c in codes]))
    return (table.select("dataset", F.explode(found).alias("_f"))
            .select("dataset", "_f.code", "_f.n").where("n > 0"))


def single_parent(edges: DataFrame) -> DataFrame:
    return best_edge(edges, "target_id")


def single_child(edges: DataFrame) -> DataFrame:
    return best_edge(edges, "source_id")

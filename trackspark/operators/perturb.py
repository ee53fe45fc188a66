"""How a score reacts to defects: seeded injection into a graph, all defects in one plan.

Every defect is a set operation over the whole graph; each makes an arm of its own, named in front
of the dataset, so one run of the scorer measures them all. What a defect should change
is counted where it is injected, and compared with what the scorer reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.operators import score

#: Changes of (true positives, false positives, false negatives, nodes) per injected defect.
EXPECTED = {
    "free_point": (0, 0, 0, 1),          # a detection far from everything
    "repeated_link": (0, 0, 0, 0),       # a link that is listed twice
    "missing_link": (-1, 0, 1, 0),
    "stray_link": (0, 1, 0, 1),          # a second child that is no cell
    "bridge": (-2, 0, 2, 0),             # two links replaced by one over their frame
}
_MADE = F.lit(-1).cast("bigint")


def picked(number: Column, seed: int, every: int) -> Column:
    """True for about one number in ``every``, the same ones for the same seed."""
    return (number * F.lit(7919) + F.lit(seed)) % F.lit(every) == 0


def injected(nodes: DataFrame, edges: DataFrame, seed: int = 1, every: int = 5,
             far: float = 1e6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of an intact arm and one arm per defect, by column ``arm``.

    ``edges`` should be consecutive links with one parent and one child per node. Ids of made nodes
    and links are negative. Bridges are taken at every third frame only, so that no link
    belongs to two.
    """
    nodes = nodes.select("dataset", "node_id", "t", "z", "y", "x")
    edges = edges.select("dataset", "edge_id", "source_id", "target_id")
    moved = nodes.withColumns({"node_id": _MADE - F.col("node_id"), "y": F.col("y") + F.lit(far)})
    chosen = edges.where(picked(F.col("source_id"), seed, every))
    chosen_ids = chosen.select("dataset", "edge_id")
    new_id = _MADE - F.col("edge_id")

    free = moved.where(picked(-1 - F.col("node_id"), seed, every))
    repeats = chosen.withColumn("edge_id", new_id)
    stray = chosen.withColumns({"edge_id": new_id, "target_id": _MADE - F.col("target_id")})
    stray_nodes = moved.join(stray.select("dataset", F.col("target_id").alias("node_id")), ["dataset", "node_id"], "left_semi")
    middle = nodes.where((F.col("t") % 3 == 1) & picked(F.col("node_id"), seed, every)).select("dataset", "node_id")
    into = edges.join(middle.withColumnRenamed("node_id", "target_id"), ["dataset", "target_id"])
    out = edges.join(middle.withColumnRenamed("node_id", "source_id"), ["dataset", "source_id"])
    over = into.select("dataset", F.col("target_id").alias("m"), "edge_id", "source_id").join(
        out.select("dataset", F.col("source_id").alias("m"), F.col("edge_id").alias("_e"), "target_id"), ["dataset", "m"])
    lost = over.select("dataset", F.explode(F.array("edge_id", "_e")).alias("edge_id"))
    bridges = over.select("dataset", new_id.alias("edge_id"), "source_id", "target_id")

    arms = {
        "intact": (nodes, edges, None),
        "free_point": (nodes.unionByName(free), edges, free),
        "repeated_link": (nodes, edges.unionByName(repeats), repeats),
        "missing_link": (nodes, edges.join(chosen_ids, ["dataset", "edge_id"], "left_anti"), chosen),
        "stray_link": (nodes.unionByName(stray_nodes), edges.unionByName(stray), stray),
        "bridge": (nodes, edges.join(lost, ["dataset", "edge_id"], "left_anti").unionByName(bridges), bridges),
    }

    def named(k: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [parts[k].withColumn("arm", F.lit(name)) for name, parts in arms.items()
                                              if parts[k] is not None])

    counts = reduce(DataFrame.unionByName, [
        parts[2].groupBy("dataset").agg(F.count(F.lit(1)).alias("injected")).withColumn("arm", F.lit(name))
        for name, parts in arms.items() if parts[2] is not None])
    return named(0), named(1), counts


def reaction(nodes: DataFrame, edges: DataFrame, seed: int = 1, every: int = 5) -> DataFrame:
    """Per dataset and defect: injected, and the changes of tp, fp, fn and nodes, measured and expected.

    The graph is scored against itself, every node matched to itself, so the intact arm is perfect.
    """
    p_nodes, p_edges, counts = injected(nodes, edges, seed, every)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("dataset", F.concat_ws("/", "arm", "dataset")).drop("arm")

    def for_all(df: DataFrame) -> DataFrame:
        return keyed(df.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ("intact", *EXPECTED)]))))

    matches = for_all(nodes.select("dataset", "t", F.col("node_id").alias("pred_id"), F.col("node_id").alias("gt_id")))
    measured = score.edge_counts(keyed(p_nodes), keyed(p_edges), matches, for_all(nodes), for_all(edges)).select(
        F.split_part("dataset", F.lit("/"), F.lit(1)).alias("arm"), F.expr("substring(dataset, instr(dataset, '/') + 1)").alias("dataset"),
        F.col("edge_tp").alias("tp"), F.col("edge_fp").alias("fp"), F.col("edge_fn").alias("fn"), F.col("num_pred_nodes").alias("nodes"))
    names = ("tp", "fp", "fn", "nodes")
    intact = measured.where("arm = 'intact'").select("dataset", *[F.col(c).alias(f"_{c}") for c in names])
    per_one = F.create_map(*[x for arm, change in EXPECTED.items()
                             for x in (F.lit(arm), F.struct(*[F.lit(v).alias(c) for c, v in zip(names, change)]))])
    rows = (measured.where("arm <> 'intact'").join(intact, "dataset").join(counts, ["dataset", "arm"], "left")
            .withColumn("injected", F.coalesce("injected", F.lit(0).cast("bigint"))).withColumn("_one", per_one[F.col("arm")]))
    return rows.select("dataset", F.col("arm").alias("defect"), "injected",
                       *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in names],
                       *[(F.col(f"_one.{c}") * F.col("injected")).cast("bigint").alias(f"expected_{c}") for c in names])

"""Movie metadata from nested JSON attributes: node budget, voxel scale, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.schema import DEFAULT_SCALE
from trackspark.session import cut_lineage, is_empty

BUDGET_KEY = "estimated_number_of_nodes"


def find_key(docs: DataFrame, json: str, key: str, ids: list[str]) -> DataFrame:
    """First value of ``key`` anywhere in a JSON document, depth first, an object's own
    key before its members. Result: ids, value (JSON text).

    One explode per nesting level over all documents at once; members keep their
    position, and the hit with the least position path wins.
    """
    level = docs.select(*ids, F.array().cast("array<int>").alias("path"), F.col(json).alias("_j"))
    hits = None
    while True:
        members = level.select(*ids, "path", F.posexplode(
            F.from_json("_j", "map<string,string>")).alias("_i", "_k", "_v"))
        items = level.where(F.ltrim("_j").startswith("[")).select(*ids, "path", F.posexplode(
            F.from_json("_j", "array<string>")).alias("_i", "_v")).withColumn("_k", F.lit(None).cast("string"))
        objects = members.where(F.col("_k").isNotNull())
        nodes = cut_lineage(objects.unionByName(items), "json")
        # An own key sorts before every member.
        here = nodes.where(F.col("_k") == key).select(
            *ids, F.concat("path", F.array(F.lit(-1))).alias("path"), F.col("_v").alias("value"))
        hits = here if hits is None else hits.unionByName(here)
        owners = here.select(*ids, F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
        # An object that has the key answers for its whole subtree.
        level = (nodes.join(owners, [*ids, "path"], "left_anti").where(F.col("_v").rlike(r"^\s*[\[{]"))
                 .select(*ids, F.concat("path", F.array("_i")).alias("path"), F.col("_v").alias("_j")))
        level = cut_lineage(level, "json")
        if is_empty(level):
            break
    found = hits.where(F.col("value").isNotNull())
    return found.groupBy(*ids).agg(F.min_by("value", "path").alias("value"))


def node_budget(docs: DataFrame, sources: list[str], ids=("dataset",)) -> DataFrame:
    """Budget per dataset from the first of several JSON columns that states one."""
    ids = list(ids)
    out = docs.select(*ids)
    names = []
    for k, source in enumerate(sources):
        found = find_key(docs, source, BUDGET_KEY, ids)
        out = out.join(found.select(*ids, F.col("value").try_cast("double").alias(f"_b{k}")), ids, "left")
        names.append(F.col(f"_b{k}"))
    return out.select(*ids, F.coalesce(*names).alias("est_total"))


def _transform(json: Column, field: str) -> Column:
    return F.get_json_object(
        json, f"$.multiscales[0].datasets[0].coordinateTransformations[0].{field}")


def voxel_scale(json: Column) -> Column:
    """(z, y, x) voxel size: the last three scale entries, or the default."""
    given = F.slice(F.from_json(_transform(json, "scale"), "array<double>"), -3, 3)
    usable = (_transform(json, "type") == "scale") & (F.size(given) == 3)
    return F.when(usable, given).otherwise(F.array(*[F.lit(v) for v in DEFAULT_SCALE]))


def stored_quantile(json: Column, level: str) -> Column:
    """A stored intensity quantile, 0 when absent."""
    levels = F.from_json(F.get_json_object(json, "$.image_statistics.quantiles"), "map<string,string>")
    return F.coalesce(F.element_at(levels, level).try_cast("double"), F.lit(0.0))


def movie_table(docs: DataFrame, json: str, stride=(1, 4, 4)) -> DataFrame:
    """dataset, scale, voxel size on the strided grid, stored quantiles."""
    scale = voxel_scale(F.col(json))
    return docs.select("dataset", scale.alias("scale"),
                       F.transform(F.arrays_zip(scale.alias("s"), F.array(*[F.lit(float(s)) for s in stride]).alias("k")),
                                   lambda e: e["s"] * e["k"]).alias("voxel_um"),
                       stored_quantile(F.col(json), "0.001").alias("q_lo"),
                       stored_quantile(F.col(json), "0.999").alias("q_hi"))

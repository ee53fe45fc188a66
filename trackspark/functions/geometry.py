"""Coordinates and distances (voxel units in, micrometres out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.schema import DEFAULT_SCALE


def with_um(df: DataFrame, scale=DEFAULT_SCALE) -> DataFrame:
    """Add physical coordinates ``zu, yu, xu``.

    ``scale`` is one (z, y, x) voxel size for all rows, or a table (dataset, scale) with an array
    of three per recording, so that recordings of different microscopes share one plan: radii in
    micrometres then mean the same everywhere. A recording without a row, or whose entry isn't three
    positive numbers, has the default size; of several rows of a recording the least counts.
    """
    if not isinstance(scale, DataFrame):
        return df.withColumns({
            f"{axis}u": F.col(axis) * F.lit(float(step)) for axis, step in zip("zyx", scale)
        })
    size = F.transform("scale", lambda v: v.cast("double"))
    usable = (F.size("scale") == 3) & F.forall("scale", lambda v: F.coalesce(v > 0, F.lit(False)))
    own = scale.where(usable).groupBy("dataset").agg(F.min(size).alias("_scale"))
    default = F.array(*[F.lit(float(v)) for v in DEFAULT_SCALE])
    placed = df.join(own, "dataset", "left").withColumn("_scale", F.coalesce("_scale", default))
    return placed.withColumns({
        f"{axis}u": F.col(axis) * F.col("_scale")[k] for k, axis in enumerate("zyx")
    }).drop("_scale")


def to_original_voxels(df: DataFrame, stride=(1, 4, 4)) -> DataFrame:
    """Map coordinates on the strided detection grid back to stored voxels."""
    return df.withColumns({
        axis: F.col(axis) * F.lit(float(step)) for axis, step in zip("zyx", stride)
    })


def norm3(dz: Column, dy: Column, dx: Column) -> Column:
    return F.sqrt(dz * dz + dy * dy + dx * dx)


def distance(a: str, b: str, scale=(1.0, 1.0, 1.0), suffix: str = "") -> Column:
    """Euclidean distance between points held in ``{prefix}z{suffix}, …`` columns."""
    deltas = [
        (F.col(f"{a}{axis}{suffix}") - F.col(f"{b}{axis}{suffix}")) * F.lit(float(step))
        for axis, step in zip("zyx", scale)
    ]
    return norm3(*deltas)


def near_face(dims, scale=DEFAULT_SCALE, margin_um: float = 10.0) -> Column:
    """True within ``margin_um`` of any face of a volume of ``dims`` voxels."""
    tests = []
    for axis, size, step in zip("zyx", dims, scale):
        um = F.col(axis) * F.lit(float(step))
        tests.append((um < F.lit(margin_um)) | (um > F.lit(size * step - margin_um)))
    return tests[0] | tests[1] | tests[2]


def cosine(a: str, b: str) -> Column:
    """Cosine of two step vectors, guarded against zero length."""
    dot = sum((F.col(f"{a}{axis}") * F.col(f"{b}{axis}") for axis in "zyx"), F.lit(0.0))
    la = norm3(*[F.col(f"{a}{axis}") for axis in "zyx"])
    lb = norm3(*[F.col(f"{b}{axis}") for axis in "zyx"])
    return dot / (la * lb + F.lit(1e-9))


def lerp(a: Column, b: Column, fraction: float) -> Column:
    return a + (b - a) * F.lit(fraction)

"""Volumes in block form: a frame is a few slabs of whole planes, each an array in one row.

``slabs(dataset, t, slab, z0, n, nz, ny, nx, <value arrays>)``: slab ``k`` of a table of depth
``d`` holds the planes from ``k * d`` on, ``n`` of the frame's ``nz``, in z, y, x order. Work along
x and y stays inside a row. Work along z needs some planes of the neighbours, which
:func:`haloed` exchanges: only those planes are copied, however large the neighbourhood
is in voxels. A depth of None keeps frames whole, which needs no exchange after the first.

Frames must be dense; a plane must fit a task. Everything else scales with slabs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.operators.volume import gaussian_weights, half_box, steps
from trackspark.session import cut_lineage, discard

FRAME = ["dataset", "t"]
_PLACE = ["slab", "z0", "n", "nz", "ny", "nx"]
_KEYS = "dataset string, t bigint, slab int, z0 int, n int, nz int, ny int, nx int"


@dataclass(frozen=True)
class Blocks:
    """A slab table, how many planes its slabs hold (None: all of a frame), and its value columns."""

    df: DataFrame
    depth: int | None
    values: tuple[str, ...] = ("v",)

    def with_df(self, df: DataFrame, *values: str) -> Blocks:
        return Blocks(df, self.depth, values or self.values)


# -- between voxel rows and slabs ---------------------------------------------------

def to_slabs(voxels: DataFrame, depth: int | None = None, value: str = "v", dims: DataFrame | None = None) -> Blocks:
    """Slabs of the dense frames of ``voxels(dataset, t, z, y, x, value)``.

    ``dims(dataset, nz, ny, nx)`` saves a pass that finds the sizes. Rows are sorted inside
    partitions by slab and packed as they stream by, so a task holds one slab at a time.
    A frame that lacks voxels, or has some twice, is an error.
    """
    if dims is None:
        dims = voxels.groupBy("dataset").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"])
    deep = F.col("nz") if depth is None else F.lit(depth)
    rows = (voxels.join(dims.select("dataset", "nz", "ny", "nx"), "dataset")
            .withColumn("slab", F.floor(F.col("z") / deep).cast("int"))
            .withColumn("z0", (F.col("slab") * deep).cast("int"))
            .withColumn("n", F.least(deep, F.col("nz") - F.col("z0")).cast("int"))
            .withColumn("at", ((F.col("z") - F.col("z0")) * F.col("ny").cast("bigint") + F.col("y")) * F.col("nx") + F.col("x")))
    dealt = (rows.select(*FRAME, *_PLACE, "at", F.col(value).cast("double").alias("v"))
             .repartition(*FRAME, "slab").sortWithinPartitions(*FRAME, "slab", "at"))
    packed = dealt.mapInArrow(_packed, f"{_KEYS}, v array<double>")
    return Blocks(packed.withColumnRenamed("v", value), depth, (value,))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted voxel rows as slab rows."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        place = [rows.column(c).to_numpy() for c in ("n", "ny", "nx")]
        at, v = rows.column("at").to_numpy(), rows.column("v").to_numpy()
        begin, starts = 0, []
        while begin < len(at):
            size = int(place[0][begin]) * int(place[1][begin]) * int(place[2][begin])
            if begin + size > len(at):
                break
            if not np.array_equal(at[begin:begin + size], np.arange(size)):
                raise ValueError("a frame is not dense: voxels are missing or repeated")
            starts.append(begin)
            begin += size
        if starts:
            offsets = pa.array(np.append(starts, begin).astype(np.int32))
            done = rows.select([*FRAME, *_PLACE]).take(pa.array(starts)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*done.columns, pa.ListArray.from_arrays(offsets, pa.array(v[:begin]))],
                                             [*FRAME, *_PLACE, "v"])
        rest = rows.slice(begin)
    if rest is not None and rest.num_rows:
        raise ValueError("a frame is not dense: voxels are missing")


def to_voxels(blocks: Blocks) -> DataFrame:
    """One row per voxel with its values."""
    plane = F.col("ny") * F.col("nx")
    rows = blocks.df.select(*FRAME, "z0", "ny", "nx", F.posexplode(F.arrays_zip(*blocks.values)).alias("_at", "_e"))
    return rows.select(*FRAME, (F.col("z0") + F.floor(F.col("_at") / plane)).cast("int").alias("z"),
                       F.floor(F.col("_at") % plane / F.col("nx")).cast("int").alias("y"),
                       (F.col("_at") % F.col("nx")).cast("int").alias("x"), *[F.col(f"_e.{c}").alias(c) for c in blocks.values])


# -- exchange of border planes ------------------------------------------------------

def haloed(blocks: Blocks, reach: int) -> DataFrame:
    """The slab rows with the ``reach`` planes before and after each, as far as the frame has them.

    Adds ``lo``, the first plane that a row now holds. Other columns than keys and values must be the
    same for all slabs of a frame.
    """
    df, d = blocks.df, blocks.depth
    if d is None or reach == 0:
        return df.withColumn("lo", F.col("z0"))
    plane, end = F.col("ny") * F.col("nx"), F.col("z0") + F.col("n")
    more = [c for c in df.columns if c not in (*FRAME, *_PLACE, *blocks.values)]
    sent = df.withColumn("_to", F.explode(F.sequence(
        F.greatest(F.floor((F.col("z0") - reach) / d), F.lit(0)).cast("int"),
        F.least(F.floor((end - 1 + reach) / d), F.floor((F.col("nz") - 1) / d)).cast("int"))))
    z0 = F.col("_to") * d
    n = F.least(F.lit(d), F.col("nz") - z0)
    begin, stop = F.greatest(F.col("z0"), z0 - reach), F.least(end, z0 + n + reach)
    parts = [F.slice(c, (begin - F.col("z0")) * plane + 1, (stop - begin) * plane).alias(c) for c in blocks.values]
    met = (sent.groupBy(*FRAME, F.col("_to").alias("slab"), "nz", "ny", "nx")
           .agg(F.array_sort(F.collect_list(F.struct(begin.alias("begin"), *parts))).alias("_p"),
                *[F.first(c).alias(c) for c in more]))
    slab0 = F.col("slab") * d
    return met.select(
        *FRAME, "slab", slab0.cast("int").alias("z0"), F.least(F.lit(d), F.col("nz") - slab0).cast("int").alias("n"),
        "nz", "ny", "nx", *more, F.col("_p")[0]["begin"].cast("int").alias("lo"),
        *[F.flatten(F.col(f"_p.{c}")).alias(c) for c in blocks.values])


@dataclass
class Slab:
    """One row in a task: value arrays of shape (planes, ny, nx) that begin with plane ``lo``."""

    z0: int
    n: int
    nz: int
    lo: int
    values: dict[str, np.ndarray]
    more: dict

    def own(self, name: str) -> np.ndarray:
        return self.values[name][self.z0 - self.lo:self.z0 - self.lo + self.n]


#: Slab rows that a kernel takes at a time, so that what it makes of a large batch isn't held at once.
STEP_ROWS = 1024


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(k, STEP_ROWS)


def _slabs(batch: pa.RecordBatch, values: tuple[str, ...]) -> Iterator[Slab]:
    place = {c: batch.column(c).to_numpy().tolist() for c in ("z0", "n", "nz", "ny", "nx", "lo")}
    more = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in (*FRAME, *_PLACE, "lo", *values)}
    flat = {}
    for c in values:
        lists = batch.column(c)
        flat[c] = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for i in range(batch.num_rows):
        shape = (-1, place["ny"][i], place["nx"][i])
        yield Slab(place["z0"][i], place["n"][i], place["nz"][i], place["lo"][i],
                   {c: v[o[i]:o[i + 1]].reshape(shape) for c, (v, o) in flat.items()}, {c: m[i] for c, m in more.items()})


def mapped(blocks: Blocks, reach: int, made: tuple[str, ...], kernel: Callable[[Slab], list[np.ndarray]],
           kept: tuple[str, ...] = ()) -> Blocks:
    """Slabs whose ``made`` arrays (of their own planes) a kernel computes from haloed ones.

    ``kept`` value columns are carried along, and so are the columns that are no values.
    """
    values, df = blocks.values, haloed(blocks, reach)
    more = [c for c in df.columns if c not in (*FRAME, *_PLACE, "lo", *values)]
    kinds = dict(df.dtypes)
    schema = ", ".join([_KEYS, *[f"{c} {kinds[c]}" for c in more], *[f"{c} array<double>" for c in (*kept, *made)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out: list[list[np.ndarray]] = [[] for _ in (*kept, *made)]
            for slab in _slabs(batch, values):
                for column, array in zip(out, [*[slab.own(c) for c in kept], *kernel(slab)]):
                    column.append(array.ravel())
            names = [*FRAME, *_PLACE, *more]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[_lists(column) for column in out]], [*names, *kept, *made])

    return blocks.with_df(df.mapInArrow(run, schema), *kept, *made)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0)))


# -- order statistics of frames ------------------------------------------------------

def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles they stand for; the function is its own inverse."""
    bits = np.ascontiguousarray(v).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.arrow_udf(T.DoubleType())
def _double(whole: pa.Array) -> pa.Array:
    return pa.array(_ordered(whole.to_numpy()).view(np.float64))


#: Low bits left out in each round of the selection; a round counts 2**22 buckets a frame at most.
_SHIFTS = (42, 21, 0)


def frame_ranks(blocks: Blocks, shares: dict[str, float], value: str = "v") -> DataFrame:
    """(dataset, t, <name>_a, <name>_b, <name>_f): neighbouring order statistics of every frame.

    The percentile ``share`` lies between the a-th and b-th value at fraction f. No value is sorted
    across tasks: slabs count their values by leading bits, the counts of a frame are added
    up, and only the bucket that holds a rank is counted again, by more bits.
    """
    df = blocks.df.withColumn("size", F.col("nz").cast("bigint") * F.col("ny") * F.col("nx"))
    ranks = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("size") - 1)
        low = F.floor(place).cast("bigint")
        ranks += [F.struct(F.lit(f"{name}_a").alias("name"), low.alias("rank"), (place - low).alias("f")),
                  F.struct(F.lit(f"{name}_b").alias("name"), F.least(low + 1, F.col("size") - 1).alias("rank"), (place - low).alias("f"))]
    wanted = (df.where("slab = 0").select(*FRAME, F.explode(F.array(*ranks)).alias("_r"))
              .select(*FRAME, "_r.*", F.lit(0).cast("bigint").alias("prefix")))
    before = 64
    for shift in _SHIFTS:
        looked = wanted.groupBy(*FRAME).agg(F.collect_set("prefix").alias("prefixes"))
        rows = df.select(*FRAME, F.col(value).alias("v")).join(looked, FRAME)

        def count(batches: Iterator[pa.RecordBatch], shift=shift, before=before) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                out: list[list] = [[], [], [], [], []]
                lists = batch.column(2)
                values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                for i, (d, t, prefixes) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                    whole = _ordered(values[offsets[i]:offsets[i + 1]])
                    for p in prefixes:
                        bucket, n = np.unique((whole if before == 64 else whole[whole >> before == p]) >> shift, return_counts=True)
                        for column, x in zip(out, ([d] * len(n), [t] * len(n), [p] * len(n), bucket, n)):
                            column.append(x)
                kinds = (pa.string(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)],
                                                 [*FRAME, "prefix", "bucket", "n"])

        counts = (rows.mapInArrow(count, "dataset string, t bigint, prefix bigint, bucket bigint, n bigint")
                  .groupBy(*FRAME, "prefix", "bucket").agg(F.sum("n").alias("n")))
        upto = F.sum("n").over(Window.partitionBy(*FRAME, "prefix").orderBy("bucket"))
        found = counts.withColumn("upto", upto)
        step = (wanted.join(found, [*FRAME, "prefix"])
                .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
                .select(*FRAME, "name", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "f", F.col("bucket").alias("prefix")))
        done = wanted
        wanted, before = cut_lineage(step, "ranks"), shift
        discard(done)
    picked = wanted.withColumn("v", _double("prefix"))
    return picked.groupBy(*FRAME).agg(*[
        F.max(F.when(F.col("name") == f"{name}_{end}", F.col(col))).alias(f"{name}_{as_}")
        for name in shares for end, col, as_ in (("a", "v", "a"), ("b", "v", "b"), ("a", "f", "f"))])


def _between(a, b, f):
    return a + (b - a) * f


def normalised(blocks: Blocks, low: float = 0.01, high: float = 0.997, floor: float = 0.5) -> Blocks:
    """Every frame on the scale of its own percentiles, clipped at zero; adds the column ``floor``.

    ``floor`` is a percentile of the result. Whole frames settle their percentiles inside the task.
    """
    shares = {"lo": low, "hi": high, "fl": floor}
    if blocks.depth is None:
        columns = [(name, share) for name, share in shares.items()]

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made: dict[str, list[float]] = {f"{n}_{e}": [] for n in shares for e in "abf"}
                for slab in _slabs(batch, ("v",)):
                    v = np.sort(slab.values["v"], axis=None)
                    for name, share in columns:
                        place = share * (len(v) - 1)
                        at = int(place)
                        for end, x in zip("abf", (v[at], v[min(at + 1, len(v) - 1)], place - at)):
                            made[f"{name}_{end}"].append(float(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64()) for x in made.values()]],
                                                 [*batch.schema.names, *made])

        df = blocks.df.select(*FRAME, *_PLACE, "v").withColumn("lo", F.col("z0"))
        names = ", ".join(f"{n}_{e} double" for n in shares for e in "abf")
        ranked = df.mapInArrow(pick, f"{_KEYS}, v array<double>, lo int, {names}").drop("lo")
    else:
        # Read four times: packed once, and no task runs the packing beside another kernel.
        blocks = blocks.with_df(cut_lineage(blocks.df, "slabs"))
        ranked = blocks.df.join(frame_ranks(blocks, shares), FRAME)
    lo, hi = (_between(F.col(f"{n}_a"), F.col(f"{n}_b"), F.col(f"{n}_f")) for n in ("lo", "hi"))
    rows = ranked.withColumns({"_lo": lo, "_hi": F.when(hi <= lo, lo + 1.0).otherwise(hi)})

    def scaled(v: Column) -> Column:
        return F.greatest((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0))

    floors = _between(scaled(F.col("fl_a")), scaled(F.col("fl_b")), F.col("fl_f"))
    return blocks.with_df(rows.select(*FRAME, *_PLACE, F.transform("v", scaled).alias("v"), floors.alias("floor")), "v")


# -- kernels -------------------------------------------------------------------------

def _weighted(a: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Symmetric weights along an axis that is padded by their reach."""
    reach = len(weights) // 2
    n = a.shape[axis] - 2 * reach

    def shifted(k: int) -> np.ndarray:
        return a[tuple(slice(k, k + n) if i == axis else slice(None) for i in range(3))]

    out = shifted(reach) * weights[reach]
    for k in range(reach):
        out += (shifted(k) + shifted(2 * reach - k)) * weights[k]
    return out


def _mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Plane numbers outside a frame as the planes they mirror."""
    at = at % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def smooth_kernel(slab: Slab, name: str, sigma: tuple[float, float, float]) -> np.ndarray:
    """Gaussian of a slab's own planes; borders of the frame are mirrored."""
    a = slab.values[name]
    for axis, s in ((2, sigma[2]), (1, sigma[1])):
        if s > 0:
            weights = gaussian_weights(s)
            a = _weighted(np.pad(a, [(len(weights) // 2,) * 2 if i == axis else (0, 0) for i in range(3)], mode="symmetric"), weights, axis)
    if sigma[0] <= 0:
        return a[slab.z0 - slab.lo:slab.z0 - slab.lo + slab.n]
    weights = gaussian_weights(sigma[0])
    reach = len(weights) // 2
    planes = _mirrored(np.arange(slab.z0 - reach, slab.z0 + slab.n + reach), slab.nz) - slab.lo
    return _weighted(a[planes], weights, 0)


def _reach(sigma: float) -> int:
    return len(gaussian_weights(sigma)) // 2 if sigma > 0 else 0


def gaussian(blocks: Blocks, sigmas: dict[str, tuple[float, float, float]], value: str = "v") -> Blocks:
    """Smoothed copies of ``value``, one per entry (sigmas in voxels), after one exchange of planes."""
    reach = max(_reach(s[0]) for s in sigmas.values())
    return mapped(blocks, reach, tuple(sigmas), lambda slab: [smooth_kernel(slab, value, s) for s in sigmas.values()], (value,))


def dog_response(norm: Blocks, voxel_um, scales=((1.5, 4.0),)) -> Blocks:
    """Adds ``dog``: per voxel the largest difference of Gaussians over the scale pairs (µm)."""
    sigma = {s: tuple(s / u for u in voxel_um) for pair in scales for s in pair}

    def bands(slab: Slab) -> list[np.ndarray]:
        smooth = {s: smooth_kernel(slab, "v", at) for s, at in sigma.items()}
        return [reduce(np.maximum, [smooth[a] - smooth[b] for a, b in scales])]

    return mapped(norm, max(_reach(s[0]) for s in sigma.values()), ("dog",), bands, ("v",))


def _around(slab: Slab, name: str, reach: int) -> np.ndarray:
    """A slab's own planes with ``reach`` planes on both sides; those outside the frame are minus infinity."""
    a, before = slab.values[name], slab.z0 - slab.lo
    after = len(a) - before - slab.n
    a = a[max(0, before - reach):len(a) - max(0, after - reach)]
    return np.pad(a, [(reach - min(before, reach), reach - min(after, reach)), (0, 0), (0, 0)], constant_values=-np.inf)


def _line_max(a: np.ndarray, half: int, axis: int) -> np.ndarray:
    """Maximum over a line of 2 * half + 1 voxels; the axis is padded by ``half`` already."""
    n = a.shape[axis] - 2 * half
    return reduce(np.maximum, [a[tuple(slice(k, k + n) if i == axis else slice(None) for i in range(3))]
                               for k in range(2 * half + 1)])


def _padded(a: np.ndarray, half: int, axis: int) -> np.ndarray:
    return np.pad(a, [(half, half) if i == axis else (0, 0) for i in range(3)], constant_values=-np.inf)


def box_kernel(slab: Slab, name: str, half: tuple[int, int, int]) -> np.ndarray:
    a = _line_max(_around(slab, name, half[0]), half[0], 0)
    for axis in (1, 2):
        a = _line_max(_padded(a, half[axis], axis), half[axis], axis)
    return a


def ball_kernel(slab: Slab, name: str, radius_um: float, voxel_um) -> np.ndarray:
    """A ball is a bundle of lines along x: line maxima once per length, then one shift per line."""
    reach = [steps(radius_um, s) for s in voxel_um]
    a = _padded(_around(slab, name, reach[0]), reach[1], 1)
    n, ny = slab.n, a.shape[1] - 2 * reach[1]
    wide = _padded(a, reach[2], 2)
    nx = a.shape[2]
    lines, best = [], None
    for half in range(reach[2] + 1):
        pair = np.maximum(wide[:, :, reach[2] - half:reach[2] - half + nx], wide[:, :, reach[2] + half:reach[2] + half + nx])
        lines.append(pair if not lines else np.maximum(lines[-1], pair))
    for oz in range(-reach[0], reach[0] + 1):
        for oy in range(-reach[1], reach[1] + 1):
            cross = (oz * voxel_um[0]) * (oz * voxel_um[0]) + (oy * voxel_um[1]) * (oy * voxel_um[1])
            half = max((k for k in range(reach[2] + 1) if cross + (k * voxel_um[2]) * (k * voxel_um[2]) <= radius_um ** 2), default=-1)
            if half >= 0:
                part = lines[half][reach[0] + oz:reach[0] + oz + n, reach[1] + oy:reach[1] + oy + ny]
                best = part.copy() if best is None else np.maximum(best, part, out=best)
    return best


def box_max(blocks: Blocks, half: tuple[int, int, int], value: str = "v", out: str = "peak") -> Blocks:
    return mapped(blocks, half[0], (out,), lambda slab: [box_kernel(slab, value, half)], (value,))


def ball_max(blocks: Blocks, radius_um: float, voxel_um, value: str = "v", out: str = "peak") -> Blocks:
    reach = steps(radius_um, voxel_um[0])
    return mapped(blocks, reach, (out,), lambda slab: [ball_kernel(slab, value, radius_um, voxel_um)], (value,))


# -- peaks ---------------------------------------------------------------------------

_PEAK = "dataset string, t bigint, z int, y int, x int, score double, rz double, ry double, rx double"


def peaks(blocks: Blocks, value: str, voxel_um, separation_um: float, passing: Callable[[Slab], np.ndarray],
          shape: str = "ball", refine_um: float | None = None, weight: str = "v") -> DataFrame:
    """Voxels that ``passing`` admits and none in their neighbourhood exceeds: dataset, t, z, y, x, score.

    With ``refine_um`` also rz, ry, rx: the centre of ``weight`` in a box of that half-width,
    or the voxel where the box weighs nothing (else null).
    """
    half = half_box(separation_um, voxel_um)
    near = half[0] if shape == "box" else steps(separation_um, voxel_um[0])
    window = None if refine_um is None else [max(1, int(round(refine_um / s))) for s in voxel_um]
    values, df = blocks.values, haloed(blocks, max(near, window[0] if window else 0))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, where, score, centre = [], [], [], []
            for i, slab in enumerate(_slabs(batch, values)):
                own = slab.own(value)
                top = box_kernel(slab, value, half) if shape == "box" else ball_kernel(slab, value, separation_um, voxel_um)
                at = np.argwhere((own == top) & passing(slab))
                row.append(np.full(len(at), i))
                where.append(at + [slab.z0, 0, 0])
                score.append(own[tuple(at.T)])
                centre.append(_centres(slab, weight, where[-1], window) if window else np.full(at.shape, np.nan))
            at, middle = np.concatenate([np.zeros((0, 3), np.int64), *where]), np.concatenate([np.zeros((0, 3)), *centre])
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *row]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in FRAME] + [pa.array(at[:, k].astype(np.int32)) for k in range(3)]
                + [pa.array(np.concatenate([np.zeros(0), *score]))]
                + [pa.array(middle[:, k], from_pandas=True) for k in range(3)],
                [*FRAME, "z", "y", "x", "score", "rz", "ry", "rx"])

    return df.mapInArrow(find, _PEAK)


def _centres(slab: Slab, name: str, at: np.ndarray, window: list[int]) -> np.ndarray:
    a, out = slab.values[name], at.astype(float)
    for k, (z, y, x) in enumerate(at.tolist()):
        begin = [max(0, z - window[0] - slab.lo), max(0, y - window[1]), max(0, x - window[2])]
        part = a[begin[0]:z + window[0] + 1 - slab.lo, begin[1]:y + window[1] + 1, begin[2]:x + window[2] + 1]
        total = part.sum()
        if total > 0:
            out[k] = [(part.sum(tuple(i for i in range(3) if i != axis)) * (np.arange(part.shape[axis]) + begin[axis])).sum() / total
                      for axis in range(3)]
            out[k, 0] += slab.lo
    return out


def detect_dog(voxels: Blocks, voxel_um, separation_um: float = 6.0, scales=((1.5, 4.0),), rel_threshold: float = 0.02,
               floor_percentile: float = 0.5, refine_um: float | None = None) -> DataFrame:
    """Peaks of the band-pass response above both floors, as in :func:`volume.detect_dog`, from slabs."""
    dog = dog_response(normalised(voxels, floor=floor_percentile), voxel_um, scales)
    return peaks(dog, "dog", voxel_um, separation_um,
                 lambda slab: (slab.own("dog") >= rel_threshold) & (slab.own("v") >= slab.more["floor"]), refine_um=refine_um)

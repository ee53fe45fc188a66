"""Frames of recordings as a Spark data source: one file a frame, ``<folder>/<dataset>/0/c/<t>/0/0/0``.

``spark.read.format("frames")`` gives voxel rows. Filters on ``dataset`` and ``t`` are pushed to the
source, so other recordings are not listed and other frames not opened. A task reads a run of
neighbouring frames of one recording, one frame in memory at a time; the driver keeps two numbers a
task, never the list of files. Writing takes one row a frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
                                    WriterCommitMessage)

from trackspark.session import ship_package

#: A task reads so many bytes of frames, and so many frames at most.
TASK_BYTES, TASK_FRAMES = 1 << 27, 1024
_FIELDS = "dataset string, t bigint, z int, y int, x int, v double"


@dataclass
class FrameRun(InputPartition):
    """Frames ``first`` to ``last`` of one recording."""

    folder: str
    dataset: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    frames: int


def _frame_path(folder: str, dataset: str, t: int) -> str:
    return f"{folder}/{dataset}/0/c/{t}/0/0/0"


class FrameReader(DataSourceReader):
    def __init__(self, uri: str, shape: tuple[int, int, int], dtype: str):
        self.uri, self.shape, self.dtype = uri, shape, dtype
        self.run = max(1, min(TASK_FRAMES, TASK_BYTES // (int(np.prod(shape)) * np.dtype(dtype).itemsize)))
        self.names: set[str] | None = None
        self.low, self.high = 0, float("inf")

    def pushFilters(self, filters):
        """Takes what bounds ``dataset`` or ``t``; Spark tests the rest, and these once more."""
        for f in filters:
            column = tuple(getattr(f, "attribute", ()))
            if column == ("dataset",) and isinstance(f, (EqualTo, In)):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = found if self.names is None else self.names & found
            elif column == ("t",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if column == ("t",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self):
        system, folder = fs.FileSystem.from_uri(self.uri)
        if self.names is None:
            names = [e.base_name for e in system.get_file_info(fs.FileSelector(folder)) if e.type == fs.FileType.Directory]
        else:
            names = [n for n in self.names if n and "/" not in n]
        runs = []
        for name in sorted(names):
            chunks = system.get_file_info(fs.FileSelector(f"{folder}/{name}/0/c", allow_not_found=True))
            frames = sorted(t for t in (int(e.base_name) for e in chunks if e.base_name.isdecimal()) if self.low <= t <= self.high)
            # runs hold frames that exist, so recordings with gaps make no more tasks than others
            runs += [FrameRun(folder, name, part[0], part[-1])
                     for part in (frames[k:k + self.run] for k in range(0, len(frames), self.run))]
        return runs

    def read(self, partition: FrameRun) -> Iterator[pa.RecordBatch]:
        if partition is None:              # Spark's stand-in where there is no partition at all
            return
        system, _ = fs.FileSystem.from_uri(self.uri)
        size = int(np.prod(self.shape))
        z, y, x = (g.ravel().astype(np.int32) for g in np.indices(self.shape))
        for t in range(partition.first, partition.last + 1):
            try:
                with system.open_input_stream(_frame_path(partition.folder, partition.dataset, t)) as f:
                    values = np.frombuffer(f.read(), dtype=self.dtype)
            except FileNotFoundError:
                continue
            if values.size != size:
                raise ValueError(f"{partition.dataset} frame {t}: {values.size} voxels, expected {size}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.dataset] * size), pa.array(np.full(size, t, np.int64)), pa.array(z), pa.array(y),
                 pa.array(x), pa.array(values.astype(np.float64))], names=["dataset", "t", "z", "y", "x", "v"])


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, shape: tuple[int, int, int], dtype: str):
        self.uri, self.shape, self.dtype = uri, shape, dtype

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each frame goes to a name of its own and is then renamed, so a task run again leaves whole files."""
        import uuid
        system, folder = fs.FileSystem.from_uri(self.uri)
        size, done = int(np.prod(self.shape)), 0
        for batch in iterator:
            for row in zip(*(batch.column(c) for c in ("dataset", "t", "values"))):
                name, t = row[0].as_py(), row[1].as_py()
                values = row[2].values.to_numpy(zero_copy_only=False)
                if values.size != size:
                    raise ValueError(f"{name} frame {t}: {values.size} voxels, expected {size}")
                path = _frame_path(folder, name, t)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                own = f"{path}-{uuid.uuid4().hex}"
                with system.open_output_stream(own) as f:
                    f.write(values.astype(self.dtype).tobytes())
                system.move(own, path)
                done += 1
        return Written(done)


class FrameSource(DataSource):
    """Options: ``path``, ``shape`` (z,y,x), ``dtype`` (by default uint16)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return _FIELDS

    def _settings(self):
        shape = tuple(int(n) for n in self.options["shape"].split(","))
        if len(shape) != 3 or min(shape) < 1:
            raise ValueError(f"shape {shape}: three positive sizes")
        uri = self.options["path"]
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = uri[5:]
        return uri, shape, self.options.get("dtype", "uint16")

    def reader(self, schema):
        return FrameReader(*self._settings())

    def writer(self, schema, overwrite):
        return FrameWriter(*self._settings())


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def _options(shape, dtype) -> dict[str, str]:
    return {"shape": ",".join(map(str, shape)), "dtype": dtype}


def read_frames(spark: SparkSession, folder: str, shape: tuple[int, int, int], dtype: str = "uint16") -> DataFrame:
    """Voxels dataset, t, z, y, x, v; filter it by dataset and t to read only those files."""
    _register(spark)
    return spark.read.format("frames").options(**_options(shape, dtype)).load(folder)


def write_frames(frames: DataFrame, folder: str, shape: tuple[int, int, int], dtype: str = "uint16") -> None:
    """One file per row of ``frames(dataset, t, values)``, values in z, y, x order.

    A frame that exists is replaced. Null names, times or values are an error.
    """
    _register(frames.sparkSession)
    (frames.selectExpr("dataset", "CAST(t AS BIGINT) AS t", "CAST(values AS array<double>) AS values")
     .write.format("frames").options(**_options(shape, dtype)).mode("append").save(folder))


__all__ = ["FrameSource", "read_frames", "write_frames"]

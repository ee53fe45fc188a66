"""Online nearest links as one stateful operator, keyed by block of space.

A recording is cut into cubes a few radii wide. A detection is a source in the cube that holds it
and a target, for the frame before its own, in every cube that its ball reaches; so the
nearest target of a source is always known to the source's cube, and the state of a recording
is spread over its cubes. State holds what is still open, by frame: once the watermark has passed
the next frame, an event-time timer closes a frame, emits its links and forgets it. Frames
may arrive in any number of batches and pieces; only rows later than the watermark are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackspark.functions.geometry import with_um
from trackspark.schema import DEFAULT_SCALE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A source, or a target, of the links that start from frame t.
_ROW = np.dtype([("target", "?"), ("t", "<i8"), ("id", "<i8"), ("z", "<f8"), ("y", "<f8"), ("x", "<f8")])
LINK = "dataset string, t bigint, source_id bigint, target_id bigint, d double"
#: Distances that one vectorised step of a closing frame holds.
STEP_CELLS = 1 << 20


def nearest(sources: tuple, targets: tuple, radius: float,
            times: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source ids, target ids, distances) of the nearest targets closer than ``radius``; ties to the lowest id.

    With ``times`` (of sources, of targets, most that lies between) a target is neither earlier nor later than that.
    """
    s_ids, t_ids = np.asarray(sources[0], np.int64), np.asarray(targets[0], np.int64)
    s, t = (np.stack([np.asarray(c, float) for c in p[1:]], 1) for p in (sources, targets))
    order = np.argsort(t_ids, kind="stable")
    t_ids, t = t_ids[order], t[order]
    if times is not None:
        s_at, t_at, most = times[0], times[1][order], times[2]
        if len(s) and len(t) and s_at.max() <= t_at.min() and t_at.max() <= s_at.min() + most:
            times = None
    found = [], [], []
    step = max(1, STEP_CELLS // max(len(t), 1))
    for k in range(0, len(s) if len(t) else 0, step):
        part = s[k:k + step]
        d = np.sqrt(sum((part[:, None, a] - t[None, :, a]) ** 2 for a in range(3)))
        if times is not None:
            lag = t_at[None, :] - s_at[k:k + step, None]
            d[(lag < 0) | (lag > most)] = np.inf
        d[np.isnan(d)] = np.inf
        best = d.argmin(1)
        d = d[np.arange(len(part)), best]
        near = d < radius
        for out, x in zip(found, (s_ids[k:k + step][near], t_ids[best[near]], d[near])):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in found)


class BlockLinker(StatefulProcessor):
    """State of one cube: the packed rows of its open sources and targets, in the pieces they came in.

    Frames follow a clock: frame t happens at ``start_ms + t * frame_ms``, and closes with frame t + 1.
    Every call to the state store is a round trip, so a batch costs a cube one append and one timer,
    and one timer closes all frames that the watermark has passed. Some timer is never later than
    the first open frame.
    """

    def __init__(self, radius: float, start_ms: int, frame_ms: int):
        self.radius, self.start_ms, self.frame_ms = radius, start_ms, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")

    def _due(self, t):
        return self.start_ms + (t + 1) * self.frame_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if not len(part):
                continue
            packed = np.empty(len(part), _ROW)
            packed["target"] = part["side"].to_numpy() == "target"
            for name, column in (("t", "t"), ("id", "node_id"), ("z", "zu"), ("y", "yu"), ("x", "xu")):
                packed[name] = part[column].to_numpy()
            self.open.appendValue((packed.tobytes(),))
            least = int(packed["t"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(self._due(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pieces = [np.frombuffer(piece[0], _ROW) for piece in self.open.get()]
        if not pieces:
            return iter([])
        rows = np.concatenate(pieces)
        passed = self._due(rows["t"]) <= timerValues.getCurrentWatermarkInMs()
        rest = rows[~passed]
        if len(rest):
            self.open.put([(rest.tobytes(),)])
            self.handle.registerTimer(self._due(int(rest["t"].min())))
        else:
            self.open.clear()
        return iter(self._closed(key[0], rows[passed]))

    def _closed(self, dataset: str, rows: np.ndarray) -> list[pd.DataFrame]:
        found = []
        rows = rows[np.argsort(rows["t"], kind="stable")]
        for frame in np.split(rows, np.flatnonzero(np.diff(rows["t"])) + 1):
            sides = [tuple(part[c] for c in ("id", "z", "y", "x")) for part in (frame[~frame["target"]], frame[frame["target"]])]
            if len(sides[0][0]) and len(sides[1][0]):
                source, target, d = nearest(*sides, self.radius)
                found.append((np.full(len(source), frame["t"][0]), source.astype(np.int64), target.astype(np.int64), d))
        if not sum(len(f[0]) for f in found):
            return []
        t, source, target, d = (np.concatenate(c) for c in zip(*found))
        return [pd.DataFrame({"dataset": dataset, "t": t, "source_id": source, "target_id": target, "d": d})]

    def close(self) -> None:
        pass


def block_rows(stream: DataFrame, radius: float, start_ms: int, frame_ms: int, block_radii: float = 8.0,
               scale=DEFAULT_SCALE) -> DataFrame:
    """Every detection as a source of its cube and as a target of the cubes in reach, with the time its frame closes."""
    width = block_radii * radius
    um = with_um(stream.where("t IS NOT NULL"), scale)
    home = [F.floor(F.col(f"{a}u") / width).cast("bigint") for a in "zyx"]
    reach = [F.sequence(F.floor((F.col(f"{a}u") - radius) / width).cast("bigint"),
                        F.floor((F.col(f"{a}u") + radius) / width).cast("bigint")) for a in "zyx"]
    columns = ["dataset", "node_id", "zu", "yu", "xu", "ts"]

    def due(t):
        return (F.lit(start_ms) + (t + 1) * F.lit(frame_ms)).alias("due")

    sources = um.select(*columns, "t", F.lit("source").alias("side"), due(F.col("t")),
                        *[h.alias(f"b{a}") for a, h in zip("zyx", home)])
    targets = um
    for a, r in zip("zyx", reach):
        targets = targets.withColumn(f"b{a}", F.explode(r))
    targets = targets.select(*columns, (F.col("t") - 1).alias("t"), F.lit("target").alias("side"), due(F.col("t") - 1), "bz", "by", "bx")
    return sources.unionByName(targets)


def online_links(stream: DataFrame, radius: float, start_ms: int, frame_ms: int = 1000, delay: str = "2 seconds",
                 block_radii: float = 8.0, scale=DEFAULT_SCALE) -> DataFrame:
    """Nearest links into the next frame of ``stream(dataset, node_id, t, z, y, x, ts)``, in append mode.

    Frame t of every recording happens at ``start_ms + t * frame_ms``, and so says ``ts``. Run it
    by :func:`run_stateful`.
    """
    rows = block_rows(stream.withWatermark("ts", delay), radius, start_ms, frame_ms, block_radii, scale)
    return rows.groupBy("dataset", "bz", "by", "bx").transformWithStateInPandas(
        statefulProcessor=BlockLinker(radius, start_ms, frame_ms), outputStructType=LINK,
        outputMode="Append", timeMode="EventTime")


@contextmanager
def rocks_state(spark) -> Iterator[None]:
    """State of the streams started inside is kept by RocksDB, off the heap; the session is left as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_stateful(stream: DataFrame, path: str, checkpoint: str | None = None) -> int:
    """Process everything available into Parquet under ``path``, one folder per batch; the number of batches.

    State is kept by RocksDB and saved with the checkpoint, which must lie in a shared folder.
    """
    seen = []

    def store(batch: DataFrame, batch_id: int) -> None:
        seen.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocks_state(stream.sparkSession):
        (stream.writeStream.outputMode("append").foreachBatch(store).trigger(availableNow=True)
         .option("checkpointLocation", checkpoint or f"{path}-checkpoint").start().awaitTermination())
    return len(set(seen))

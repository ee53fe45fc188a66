"""What the operators of this folder share: table access, lineage cuts, vectorised words."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.session import cut_lineage, discard, shared_dir, ship_package

__all__ = [
    "cut_lineage", "discard", "shared_dir", "table", "settled", "free_name", "keyed", "components", "pieces", "utf8",
    "word_bounds", "word_hashes", "powers", "WHITE", "BENCH_SEPARATORS",
]

# The bytes that separate words in the two word definitions of this folder.
WHITE = [0x20, *range(0x09, 0x0E)]
BENCH_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]

#: Text bytes that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, label: str, *done: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; ``done`` are tables nobody reads any more.

    Also lets Spark drop the shuffle files of what was just written: it does so when the
    plans that own them are collected, which a long-lived driver does too rarely.
    """
    out = cut_lineage(df, label)
    discard(*done)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until none of ``taken`` has it."""
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_fp, text): the two columns an operator needs and a fingerprint of the text.

    Rows are told apart by (doc_id, doc_fp), so that repeated ids with different texts keep
    separate results; rows equal in both get equal results.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc_fp"),
        F.col(text_col).alias("text"),
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of ``links`` (a, b); the component is its smallest node.

    Rounds of contraction: every node moves to the least of itself and its neighbours, by id
    and by a fresh hash in turn. Ids bring stars together at once, hashes shrink any other shape
    by a constant factor. Neighbour minima are partial aggregates, so hubs do not gather.
    """
    live = settled(links.filter("a <> b").select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*").distinct(), "edges")
    labels = (links.filter("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
              .withColumn("label", F.col("node")))
    moves: list[DataFrame] = []
    turn = 0
    while not live.isEmpty():
        order = (lambda c: F.struct(c.alias("k"))) if turn % 2 == 0 else (
            lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("k")))
        move = settled(live.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
                       .select(F.col("a").alias("label"), F.least(F.col("m"), order(F.col("a"))).getField("k").alias("to")),
                       "moves")
        rest = settled(
            live.join(move.select(F.col("label").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("label").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges", live)
        live, turn = rest, turn + 1
        labels = labels.join(move, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        moves.append(move)
        if len(moves) == 6:
            labels = settled(labels, "labels", *moves)
            moves = []
    labels = settled(labels, "labels", live, *moves)
    lowest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(lowest, "label").select("node", "component")


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each (or one row)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; null reads as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _flags(separators: list[int]) -> np.ndarray:
    flags = np.ones(256, bool)
    flags[separators] = False
    return flags


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: list[int]):
    """(starts, ends, first): byte bounds of all words and, per row, its first word's index."""
    inside = _flags(separators)[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (of the inverse, on request); base is odd."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 18), step, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 1 << 19:             # of longer texts nothing is kept: workers are used again
            _POWERS[(base, inverse)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)


_BYTES = {seed: _byte_values(seed) for seed in (11, 12)}
_BASE = {11: 0x9E3779B97F4A7C15, 12: 0xC2B2AE3D27D4EB4F}


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range, modulo 2**64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(base, len(values) + 1, inverse=True)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """One 64-bit hash per word, a function of its bytes alone."""
    return mixed(range_hashes(_BYTES[seed][data], starts, ends, _BASE[seed]))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

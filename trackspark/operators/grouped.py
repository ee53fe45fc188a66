"""Many small groups a task: a kernel per group over arrays, without a data frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.session import cut_lineage, is_empty

#: Distances of a group that fit a task; larger groups are split or joined on a grid.
TASK_CELLS = 4_000_000
#: Distances that one vectorised step of a group holds.
STEP_CELLS = 1 << 20


def spread(rows: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """``rows`` sorted by group inside partitions, a group in one of them.

    Groups cost far more time than bytes, so their number of partitions follows the cores, and
    adaptive coalescing by size leaves it alone.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, each with the bounds of its groups."""
    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            codes = pd.factorize(table.column(key).to_pandas(), use_na_sentinel=False)[0]
            new[1:] |= codes[1:] != codes[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held:
            # while one group fills whole batches they only pile up, they are not read again
            seam = bounds(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]))
            inner = bounds(table)
            if len(seam) == 2 and len(inner) == 2:
                held.append(table)
                continue
        rows = pa.concat_tables([*held, table]).combine_chunks()
        at = bounds(rows)
        if len(at) > 2:
            yield rows.slice(0, at[-2]), at[:-1]
        held = [rows.slice(at[-2])]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield rows, np.array([0, rows.num_rows])


def picked(rows: DataFrame, keys: list[str], columns: list[str],
           pick: Callable[..., list[tuple[np.ndarray, bool]]], flag: str | None = None) -> DataFrame:
    """The rows of every group that ``pick`` names by position, from the group's ``columns`` as arrays.

    ``pick`` gives (positions, flag) pairs; the flag goes to the column ``flag`` if there is one.
    """
    schema = ", ".join([*[f"`{n}` {kind}" for n, kind in rows.dtypes], *([f"{flag} boolean"] if flag else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys):
            arrays = [table.column(c).to_numpy() for c in columns]
            spots, flags = [], []
            for a, b in zip(at[:-1], at[1:]):
                for where, told in pick(*[x[a:b] for x in arrays]):
                    spots.append(where + a)
                    flags.append(np.full(len(where), told))
            found = table.take(pa.array(np.concatenate(spots).astype(np.int64)))
            if flag:
                found = found.append_column(flag, pa.array(np.concatenate(flags).astype(bool)))
            yield from found.combine_chunks().to_batches()

    return spread(rows, keys).mapInArrow(run, schema)


def crowded(left: DataFrame, right: DataFrame, keys: list[str], cells: int) -> DataFrame | None:
    """The groups with more than ``cells`` pairs of a left and a right row; None if there are none."""
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_nl")).join(
        right.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_nr")), keys)
    found = cut_lineage(sizes.where(F.col("_nl") * F.col("_nr") > cells).select(*keys), "crowded")
    return None if is_empty(found) else found


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], made: str,
                 kernel: Callable[..., list[np.ndarray]]) -> DataFrame:
    """What ``kernel`` makes of every group with rows on both sides: the keys and the columns ``made``.

    The kernel gets the ``columns`` of the left rows and of the right rows as lists of arrays, both in
    the order of the first column. Only rows are exchanged, so a group's pairs exist in its task alone.
    """
    both = left.select(*keys, *columns, F.lit(0).alias("_side")).unionByName(
        right.select(*keys, *columns, F.lit(1).alias("_side")))
    return _kernelled(both, keys, ["_side", *columns], made, lambda side, *arrays: _both(kernel, side, arrays))


def _both(kernel, side: np.ndarray, arrays: tuple[np.ndarray, ...]) -> list[np.ndarray] | None:
    mid = int(np.searchsorted(side, 1))
    return kernel([a[:mid] for a in arrays], [a[mid:] for a in arrays]) if 0 < mid < len(side) else None


def within(rows: DataFrame, keys: list[str], columns: list[str], made: str,
           kernel: Callable[..., list[np.ndarray]]) -> DataFrame:
    """The same for groups of one kind of rows, given as one array a column."""
    return _kernelled(rows.select(*keys, *columns), keys, columns, made, kernel)


def _kernelled(rows: DataFrame, keys: list[str], columns: list[str], made: str, kernel) -> DataFrame:
    kinds = dict(rows.dtypes)
    names = [*keys, *[c.split()[0] for c in made.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys):
            arrays = [table.column(c).to_numpy() for c in columns]
            heads, parts = [], []
            for a, b in zip(at[:-1], at[1:]):
                out = kernel(*[x[a:b] for x in arrays])
                if out is not None and len(out[0]):
                    heads.append(np.full(len(out[0]), a))
                    parts.append(out)
            if parts:
                head = table.select(keys).take(pa.array(np.concatenate(heads)))
                values = [pa.chunked_array([np.concatenate(x)]) for x in zip(*parts)]
                yield from pa.Table.from_arrays([*head.columns, *values], names).combine_chunks().to_batches()

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], made])
    return spread(rows, keys, columns[:2] if columns[0] == "_side" else columns[:1]).mapInArrow(run, schema)


def distances(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """All distances of two lists of coordinate arrays, added up as ``geometry.norm3`` does."""
    squares = [np.subtract.outer(a, b) ** 2 for a, b in zip(left, right)]
    return np.sqrt(squares[0] + squares[1] + squares[2])

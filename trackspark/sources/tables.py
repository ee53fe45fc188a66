"""Readers and writers of graphs, frames, splits, submissions and thread archives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.operators.graph import densify
from trackspark.schema import EDGES, NODES, SUBMISSION, SUBMISSION_COLUMNS, VOXELS


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str,
               fmt: str = "parquet", **options) -> tuple[DataFrame, DataFrame]:
    """Exported node and edge tables with dense ids; a missing depth is 0."""
    nodes = spark.read.schema(NODES).options(**options).format(fmt).load(nodes_path)
    edges = spark.read.schema(EDGES).options(**options).format(fmt).load(edges_path)
    return densify(nodes.withColumn("z", F.coalesce("z", F.lit(0.0))), edges)


def list_names(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Dataset names that have a file or folder entry ending in ``suffix`` (contents unread)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("path"))
    name = F.regexp_extract("path", rf"/([^/]+){suffix.replace('.', chr(92) + '.')}(/|$)", 1)
    return files.select(name.alias("dataset")).where("dataset <> ''").distinct()


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Official splits file: a JSON list of {train, test}; fold = position in the list."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "array<struct<split:bigint,train:array<string>,test:array<string>>>")
    return text.select(F.posexplode(parsed).alias("fold", "_s")).select(
        F.col("fold").cast("bigint").alias("fold"), "_s.train", "_s.test")


def read_raw_frames(spark: SparkSession, folder: str, shape: tuple[int, int, int],
                    dtype: str = "uint16") -> DataFrame:
    """Voxels of uncompressed chunk files laid out as ``<dataset>/0/c/<t>/0/0/0``.

    One chunk is one frame of ``shape``; each file is decoded where it is read.
    """
    nz, ny, nx = shape
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("content",
                     F.regexp_extract("path", r"/([^/]+?)(\.zarr)?/0/c/(\d+)/0/0/0$", 1).alias("dataset"),
                     F.regexp_extract("path", r"/0/c/(\d+)/0/0/0$", 1).try_cast("bigint").alias("t"))
             .where("t IS NOT NULL"))
    z, y, x = (g.ravel().astype("int32") for g in np.meshgrid(
        np.arange(nz), np.arange(ny), np.arange(nx), indexing="ij"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                values = np.frombuffer(row.content, dtype=dtype)
                if values.size != nz * ny * nx:
                    raise ValueError(f"{row.dataset} frame {row.t}: {values.size} voxels, "
                                     f"expected {nz * ny * nx}")
                yield pd.DataFrame({"dataset": row.dataset, "t": row.t, "z": z, "y": y, "x": x,
                                    "v": values.astype("float64")})

    return files.mapInPandas(decode, VOXELS)


def write_submission(rows: DataFrame, path: str) -> None:
    """The flat table as CSV part files with a header, in id order across files."""
    (rows.select(*SUBMISSION_COLUMNS).repartitionByRange("id").sortWithinPartitions("id")
     .write.mode("overwrite").option("header", "true").csv(path))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSION).option("header", "true").option("enforceSchema", "false").csv(path)


def check_submission(spark: SparkSession, path: str, expected_rows: int, names: DataFrame) -> list[str]:
    """Read a written submission back: header, row count and coverage of ``names``."""
    problems = []
    header = spark.read.option("header", "true").csv(path).columns
    if tuple(header) != SUBMISSION_COLUMNS:
        return [f"header is {header}"]
    rows = read_submission(spark, path)
    found = rows.count()
    if found != expected_rows:
        problems.append(f"{found} rows, expected {expected_rows}")
    absent = names.select("dataset").distinct().join(rows, "dataset", "left_anti").count()
    if absent:
        problems.append(f"{absent} datasets missing")
    return problems


def read_threads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Archived threads, one JSON document per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_stats(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)

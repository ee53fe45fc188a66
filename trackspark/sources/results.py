"""Stored metric rows: per-arm Parquet with reuse, and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.schema import METRIC_ROWS


def clean_json(df: DataFrame) -> Column:
    """Row as JSON text with NaN written as a missing value."""
    fields = [F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
              if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
              for f in df.schema.fields]
    return F.to_json(F.struct(*fields))


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("arm").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_ROWS).parquet(path)


def missing_results(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(arm, dataset) pairs that have no stored row yet."""
    return wanted.select("arm", "dataset").join(
        stored.select("arm", "dataset"), ["arm", "dataset"], "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    df.select(clean_json(df).alias("value")).write.mode("overwrite").text(path)

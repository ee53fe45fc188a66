"""Publishing a submission: write, read back, audit, and only then release.

``path`` holds numbered releases. The rows of a release are written first, as CSV; they are then
read back and compared, dataset by dataset, with what was to be written, and the validator runs over
what was read. A release counts from the moment its manifest exists, which is written last and
only if the audit found nothing that blocks, so readers never see half a release or a bad one
and no folder has to be renamed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trackspark.operators.submission import missing_columns, validate
from trackspark.schema import SUBMISSION_COLUMNS
from trackspark.session import cut_lineage
from trackspark.sources.tables import read_submission, write_submission

MANIFEST = "dataset string, node_rows bigint, edge_rows bigint, first_id bigint, last_id bigint, content string, release bigint"


@dataclass(frozen=True)
class Release:
    """What came of one attempt: its number (0: nothing released) and all findings."""

    number: int
    findings: DataFrame          # dataset, severity, code, n, detail

    @property
    def published(self) -> bool:
        return self.number > 0


def manifest(rows: DataFrame) -> DataFrame:
    """Per dataset: rows of each type, range of ids and a sum of row hashes, which no order of rows changes."""
    row = F.xxhash64(*[F.col(c) for c in SUBMISSION_COLUMNS]).cast("decimal(38,0)")
    return rows.groupBy("dataset").agg(
        F.count_if(F.col("row_type") == "node").alias("node_rows"), F.count_if(F.col("row_type") == "edge").alias("edge_rows"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(row).cast("string").alias("content"))


def _finding(df: DataFrame, severity: str, code: str, n=None) -> DataFrame:
    return df.select(F.col("dataset"), F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                     (F.lit(1) if n is None else n).cast("bigint").alias("n"), F.lit(None).cast("double").alias("detail"))


def audit(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Datasets whose manifest differs from the one wanted: dataset, severity, code, n, detail."""
    both = wanted.alias("w").join(found.alias("f"), "dataset", "full")
    counts = [(F.col(f"w.{c}"), F.col(f"f.{c}")) for c in ("node_rows", "edge_rows")]
    lost = sum((F.coalesce(w, F.lit(0)) - F.coalesce(f, F.lit(0)) for w, f in counts), F.lit(0))
    changed = both.where("w.dataset IS NOT NULL AND f.dataset IS NOT NULL").withColumn("_lost", lost)
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("first_id", "last_id", "content")]
    return (_finding(both.where("f.dataset IS NULL").withColumn("_lost", lost), "fatal", "lost_dataset", F.col("_lost"))
            .unionByName(_finding(both.where("w.dataset IS NULL"), "fatal", "strange_dataset"))
            .unionByName(_finding(changed.where("_lost <> 0"), "fatal", "row_count", F.col("_lost")))
            .unionByName(_finding(changed.where((F.col("_lost") == 0) & ~(same[0] & same[1] & same[2])), "fatal", "content")))


def releases(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all releases (none: an empty table)."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the latest release; None if there is none."""
    last = releases(spark, path).agg(F.max("release")).first()[0]
    return None if last is None else read_submission(spark, f"{path}/rows/release={last}")


def publish(rows: DataFrame, path: str, expected: DataFrame | None = None, budgets: DataFrame | None = None,
            blocking: tuple[str, ...] = ("fatal",)) -> Release:
    """Write ``rows`` as the next release of ``path``, unless the audit blocks it.

    ``expected(dataset)`` and ``budgets`` go to the validator. Findings whose severity is in
    ``blocking`` keep the release from being published; its rows stay for inspection and the
    number is used again. Missing columns block before anything is written.
    """
    spark = rows.sparkSession
    gaps = missing_columns(rows)
    if gaps:
        return Release(0, spark.createDataFrame([(None, "fatal", f"no column {c}", 1, None) for c in gaps],
                                                "dataset string, severity string, code string, n bigint, detail double"))
    number = (releases(spark, path).agg(F.max("release")).first()[0] or 0) + 1
    rows = cut_lineage(rows.select(*SUBMISSION_COLUMNS), "submission")
    place = f"{path}/rows/release={number}"
    write_submission(rows, place)
    wanted = cut_lineage(manifest(rows), "manifest")
    back = read_submission(spark, place)
    findings = audit(wanted, manifest(back)).unionByName(validate(back, expected, budgets))
    header = tuple(spark.read.option("header", "true").csv(place).columns)
    if header != SUBMISSION_COLUMNS and not rows.isEmpty():
        findings = findings.unionByName(spark.createDataFrame(
            [(None, "fatal", f"header {','.join(header)}", 1, None)], findings.schema))
    findings = cut_lineage(findings, "findings")
    if not findings.where(F.col("severity").isin(*blocking)).isEmpty():
        return Release(0, findings)
    wanted.withColumn("release", F.lit(number).cast("bigint")).write.mode("append").parquet(f"{path}/manifest")
    return Release(number, findings)

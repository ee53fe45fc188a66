"""Session construction and durable lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "trackspark", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster use the session you were given."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Shared folders of local applications that name none, by application id.
_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application, if they run elsewhere than the driver's path.

    Functions that Arrow workers run refer to modules of the package. An installed package or a
    PYTHONPATH serves as well; the archive comes last in their search path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="trackspark-")
    archive = shutil.make_archive(os.path.join(folder, "trackspark"), "zip", os.path.dirname(package),
                                  os.path.basename(package))
    context.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back
    to a temporary folder; a cluster without the setting is a configuration error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[context.applicationId]


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where a plan is consumed several times or inside a loop. The table outlives
    any executor, is computed once, and gives later joins a true size to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut_lineage` that no later plan reads.

    Loops call this for the tables of the round before, so a long loop keeps a fixed
    number of them.
    """
    for table in tables:
        path = getattr(table, "stage_path", None) if table is not None else None
        if path is not None:
            jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0

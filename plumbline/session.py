"""Session defaults and the shared checkpoint location."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """A folder that every executor can reach, as named by the session.

    On a cluster, a warehouse on each machine's own disk cannot stand in for one that is not named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    root = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    if not spark.sparkContext.master.startswith("local") and root.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that tasks find it wherever the driver was started."""
    folder = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline"), "zip", folder.parent, folder.name)
    spark.sparkContext.addPyFile(archive)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse is used, which executors share as well.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        else:
            sc.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def row_count_within(df: DataFrame, bound: int) -> bool:
    """True if ``df`` has at most ``bound`` rows; reads no more than ``bound + 1`` of them."""
    return df.limit(bound + 1).count() <= bound


def fan_out(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition before a step that multiplies rows, over at least as many tasks as cores.

    Adaptive execution sizes partitions by the bytes that enter them and would run a small input
    with a large expansion in one task; a partition count given here is kept.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)

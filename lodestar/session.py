"""Sessions, shipping the package to workers, and cutting lineage durably."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(master: str = "local[*]", app: str = "lodestar", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; conf overrides, with "__" for "."."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on workers, where PYTHONPATH doesn't hold it already."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = str(_PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="lodestar-ship-")  # on the driver alone; Spark serves the file from there
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where the setting is absent and Spark runs in this one process, as in tests, a
    temporary folder is made for the session and removed at exit; on a cluster the
    setting is needed, as no folder of this machine would do there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestar-shared-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/lodestar-{label}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and the loss of an executor costs nothing.

    Shuffle files of the write go at its end; the table stays until discard().
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._lodestar_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small table has fewer partitions than half of them; as it is otherwise, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if 2 * have >= cores else df.repartition(cores)


#: Estimates from here on stand for an unknown size.
UNKNOWN_BYTES = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes df reads, UNKNOWN_BYTES or more where it has none; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def source_bytes(df: DataFrame) -> int:
    """The bytes of the files df reads, each time it reads them; no job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN_BYTES)


#: Bytes of files for a partition of a shuffle.
PARTITION_BYTES = 8 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def part_finely(df: DataFrame) -> None:
    """Has shuffles begin with partitions enough for what df reads, so that a task's memory doesn't grow with the input.

    The setting is only ever raised, and stays for what is computed later; adaptive
    execution merges partitions that turn out to be small.
    """
    spark = df.sparkSession
    wanted = -(-source_bytes(df) // PARTITION_BYTES)
    if wanted > int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_INITIAL, wanted)

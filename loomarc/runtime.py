"""Session and scratch-space helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is developed under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomarc")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent (tests, notebooks).
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        found = "file://" + tempfile.mkdtemp(prefix="loomarc-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``discard_scratch`` deletes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def discard_scratch(spark: SparkSession) -> None:
    """Delete all scratch this process wrote. Frames that were read from it are of no use any more."""
    while _SCRATCH:
        discard(spark, _SCRATCH.pop())


def _files(spark: SparkSession, path: str):
    """(file system, path object) of a path on any storage Spark can reach."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    files, found = _files(spark, path)
    return files.exists(found)


def make_folder(spark: SparkSession, path: str) -> None:
    files, found = _files(spark, path)
    files.mkdirs(found)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder or file; false where there is none."""
    files, found = _files(spark, source)
    return files.exists(found) and files.rename(found, spark._jvm.org.apache.hadoop.fs.Path(target))


def discard(spark: SparkSession, path: str) -> None:
    """Delete scratch that is no longer read."""
    files, found = _files(spark, path)
    files.delete(found, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The full paths in a folder, in order; none where it is absent."""
    files, found = _files(spark, path)
    return sorted(str(s.getPath().toString()) for s in files.listStatus(found)) if files.exists(found) else []


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor costs a
    re-read and never a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than there are cores, for a heavy stage behind it.

    A row group is the finest split of a scan, so one small file feeds one core. Only file
    metadata is looked at. A table with a split per core or more is left as it is, so at
    scale there is no shuffle. Use it on plain scans only (filters and projections).
    """
    cores = max(scan.sparkSession.sparkContext.defaultParallelism, 1)
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: How much larger rows are in memory than the files they are read from (compressed columns; measured: 9).
EXPANSION = 9
#: Bytes in memory up to which a join side is broadcast.
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frame is expected to take no more than a bound in memory.

    The optimizer's estimate of a scan is its file size (columns pruned proportionally), so it is
    scaled by ``EXPANSION``; joins and generators over-estimate, which errs on the side of a shuffle.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) * EXPANSION <= limit_bytes


def small_or_shuffled(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast only when its estimated size is below the bound."""
    return F.broadcast(df) if fits_broadcast(df, limit_bytes) else df


def data_dir(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)

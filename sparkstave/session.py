"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read by Spark only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in fewer parts than there are cores (one small file); a table of many files stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is local (tests)
    a temporary folder is taken instead. A cluster without the setting is an error, as its nodes share no local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    if not named and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for one written intermediate table."""
    return f"{shared_dir(spark)}/{label}-{os.urandom(8).hex()}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    Written with zstd, whose streams need no direct buffers: those of snappy pile up outside the heap
    of an executor that writes many small files between two collections.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """``stored`` in ``n`` buckets by the hash of ``key``: groups and windows by it and other columns need no shuffle.

    Each task writes a file for each bucket that it has rows of. Buckets are a matter of the catalog, so a table stands there until it has been found.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    name = f"spark_catalog.default.{path.rpartition('/')[2].replace('-', '_')}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return rows


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def default_session(app: str = "sparkstave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

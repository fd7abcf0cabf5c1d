"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own in local mode and an error on a cluster."""
    where = spark.conf.get(CHECKPOINT_KEY, None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_KEY} is unset: it must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it, the session has the setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it back.

    The files outlive executors, so a lost executor costs a re-read and not a recomputation, and the
    lineage ends there. Shuffle files of the write are of no use once it is done and go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphlake-{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEAN_KEY, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that shuffle both sides and never send one whole through the driver.

    Runs, labels and boxes fill few bytes as Parquet and many in memory, so by its size on disk a table
    that grows with the input would be taken for one to broadcast.
    """
    return df.hint("merge")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``written``, for tables that grow with the input: their joins are ``shuffled``."""
    return shuffled(written(df, name))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        where = shared_dir(spark)
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/glyphlake-" in folder and where.split(":")[-1].strip("/") in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tallyworks") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the session the cluster provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A single-process session (tests, bench) that names none gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyworks-"))
    return spark.sparkContext.getCheckpointDir()


_BATCH = threading.local()


@contextmanager
def batch(spark: SparkSession) -> Iterator[list[str]]:
    """Own the intermediate tables that this thread writes: they are deleted at the end, also after an error.

    Results must be written inside; a DataFrame of the batch cannot be read after it. Batches may be
    nested; each deletes its own tables. Yields the paths.
    """
    outer, paths = getattr(_BATCH, "paths", None), []
    _BATCH.paths = paths
    try:
        yield paths
    finally:
        _BATCH.paths = outer
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here and the
    rows survive the loss of executors."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    if getattr(_BATCH, "paths", None) is not None:
        _BATCH.paths.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)

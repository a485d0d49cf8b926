"""Spark session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ripplework", cores: str = "*") -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    parallelism = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Test data is small: let every core have some of it, parsers above all.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where it is set.

    An unset value falls back to a temporary folder on a single machine and is an error on a
    cluster, where no such folder would be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ripplework-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def spread(frame: DataFrame) -> DataFrame:
    """*frame* dealt over four tasks a core: narrow rows that much is made of may all come from one file."""
    spark = frame.sparkSession
    return frame.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write *frame* to the shared folder and read it back.

    A table rather than an RDD checkpoint: it survives the loss of any executor in the same
    way, and its file sizes give the optimiser true statistics, so the next join broadcasts
    a side only when that side is really under the broadcast threshold.
    """
    spark = frame.sparkSession
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(target)
    return spark.read.schema(frame.schema).parquet(target)

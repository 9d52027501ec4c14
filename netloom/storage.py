"""Cutting lineage with Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a temporary folder serves a session of one
    machine (tests); a cluster has to name a folder that all its machines see."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="netloom-"))
        atexit.register(shutil.rmtree, _local_dir[0], True)
    return f"file://{_local_dir[0]}"


def staged(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: it cuts the lineage,
    survives lost executors, and a join on what was read gets a fresh exchange on both
    sides, so that AQE may split the partitions of a hot key."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what `staged` wrote in this process, and return how many folders that were.
    Call it when no DataFrame made so far is needed any more."""
    paths = [_written.pop() for _ in range(len(_written))]
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)

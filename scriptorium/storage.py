"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: One folder a process, so that its scratch tables can be removed together.
RUN = uuid.uuid4().hex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, the session's checkpoint folder or, in one process, one made once."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = f"file://{tempfile.mkdtemp(prefix='scriptorium-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    if not _spark:
        _spark.append(spark)
        atexit.register(_last)
    return f"{shared_dir(spark)}/scriptorium/{RUN}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: this cuts the lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Removes scratch tables of saved() that nothing reads any more: what was made of them must have been written."""
    for df in tables:
        remove(df.sparkSession, df.scratch)


def clear(spark: SparkSession | None = None) -> None:
    """Removes all scratch tables of this process; also done when it ends. DataFrames returned before can't be read after."""
    spark = spark or _spark[0]
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, f"{shared_dir(spark)}/scriptorium/{RUN}")


def _last() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        clear()


_spark: list[SparkSession] = []


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it has fewer partitions than these, as a table of one small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

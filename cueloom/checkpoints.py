"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode without that setting, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="spark-cueloom-")
    return _LOCAL_ROOTS[app]


def freeze(df: DataFrame, name: str = "table", compression: str = "zstd", few: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    few is for tables with a small share of the rows: they are written in fewer files, a sixteenth of the shuffle
    partitions but no fewer than the cluster has cores, so that many steps leave no crowd of tiny files.

    What follows starts from the written rows, so a lost executor costs no recomputation of what lies before,
    and values such as row numbers stay as they were written. release() deletes what is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cueloom/{uuid.uuid4().hex}/{name}"
    if few:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    frozen = spark.read.schema(df.schema).parquet(path)
    frozen._frozen_at = path
    return frozen


def by_video(spark: SparkSession) -> None:
    """Let joins on video_id and further keys take rows where they lie by video_id alone, from now on in this session.

    By default Spark shuffles both sides of such a join once more, by all of its keys, though no row would have to move.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """These settings, named without spark.sql. and with __ for each dot, while a step runs; then those before."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """While a table is written: its plan's shuffle files go when it is, and not when the driver happens to collect garbage."""
    return settings(spark, classic__shuffleDependency__fileCleanup__enabled="true")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def release(*frozen: DataFrame) -> None:
    """Delete the tables that freeze() wrote. Nothing that is still to be computed may start from them."""
    for df in frozen:
        delete(df.sparkSession, df._frozen_at.rpartition("/")[0])


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""Written tables that cut a lineage.

A stage is a Parquet table in the folder the cluster shares
(``spark.checkpoint.dir``). Unlike cached blocks it outlives the executors that
wrote it, so everything read back from it is fixed. Stages belong to the
application that wrote them: they go when it ends, or when ``release`` is called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: set[str] = set()


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's folder for stages."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.mode("errorifexists").option("maxRecordsPerFile", 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all stages of this application; frames that read them can't be used any more."""
    folder = _own_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _owned.discard(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.conf.get("spark.master", "").startswith("local"):
        folder = spark.conf.get("spark.sql.warehouse.dir", None)  # one machine has no other
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/rollbook/{spark.sparkContext.applicationId}"
    if folder not in _owned:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _owned.add(folder)
    return folder

"""Reading and writing the tables that the operators work on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rollbook.plans.staging import stage, stage_path

__all__ = ["documents", "put_file", "stage", "stage_path", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def put_file(spark: SparkSession, label: str, content: bytes) -> str:
    """Write a file below the shared folder and hand it to every executor.

    Returns the name that ``SparkFiles.get`` takes inside tasks.
    """
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    name = f"{label}-{uuid.uuid4().hex}.bin"
    path = jvm.org.apache.hadoop.fs.Path(f"{stage_path(spark, label)}/{name}")
    out = path.getFileSystem(hadoop).create(path, False)
    try:
        out.write(content)
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name

"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, a cluster's one in the warehouse, if its
    executors share that."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = tempfile.mkdtemp(prefix="corpuslens-") if local else f"{on_cluster(spark)}/corpuslens-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def on_cluster(spark: SparkSession) -> str:
    """The warehouse folder; an error where it is of one machine only (a file: path), as executors couldn't meet there."""
    where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if (jvm.org.apache.hadoop.fs.Path(where).toUri().getScheme() or jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).getScheme()) == "file":
        raise ValueError(f"executors can't meet in {where}: set spark.checkpoint.dir to a folder that they share")
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own: computed once, so every reader sees the same rows and partition numbers."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)

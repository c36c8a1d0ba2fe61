"""Session settings for this library, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "sparkward", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; more settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Local runs may do without; a cluster may not."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if spark.sparkContext.master.split("[")[0] == "local":
        return os.path.join(tempfile.gettempdir(), "spark-checkpoints")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

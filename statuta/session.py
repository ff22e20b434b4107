"""Session settings and table access shared by every query."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "statuta", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster passes its own settings at submit time."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir.

    Where that is unset, one machine (a local master, as in tests) gets a temporary folder that goes with the process; a cluster gets one
    under the warehouse, which its executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        base = tempfile.mkdtemp(prefix="spark-statuta-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/statuta-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables, in whatever store it is; call it when what was read from it is no longer used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it again."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

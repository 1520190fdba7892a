"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Variant objects with repeated keys keep the last one; timestamps are read in UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, **more: str) -> SparkSession:
    """For tests and benchmarks on one machine."""
    conf = SETTINGS | {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"} | more
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset and all runs on one machine (tests), a temporary folder is set as
    it; on a cluster, whose executors wouldn't see it, an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recordloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back, so that several readers don't make it anew."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings and the shared scratch folder."""

import os
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app="placelens", **overrides):
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_STAGES = []


def shared_dir(spark, purpose):
    """A new path under the folder named by spark.checkpoint.dir, which all executors must share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
    _STAGES.append(path)
    return path


def drop_stages(spark):
    """Delete the stage tables written so far. Call it once their DataFrames are no longer needed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df):
    """Write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan):
    """Use all cores on a small input: a plain scan with fewer splits than cores is repartitioned.

    Large tables have more splits than the cluster has cores and are left as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan

"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint that forgets the estimated size and the partitionings: from join to join, these would double in length."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder(spark))
    saved = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(saved.toJavaRDD(), saved.schema()), spark)

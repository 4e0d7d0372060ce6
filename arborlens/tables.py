"""Cutting lineage: tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet under spark.checkpoint.dir and read it back. A local folder only where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order. A window of one rank: Spark keeps one row a key before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")

"""Metric streams: windows with watermarks, alerts, query learning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def tumbling(points: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, name, n, total of points (name, ts, value); rows later than ``late`` are dropped on a stream."""
    if points.isStreaming:
        points = points.withWatermark("ts", late)
    return points.groupBy(F.window("ts", size).alias("w"), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "name", "n", "total")


def alerts(points: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Points that break a rule (series, condition, threshold), as they come."""
    tests = {"gt": lambda v, t: v > t, "lt": lambda v, t: v < t, "gte": lambda v, t: v >= t, "lte": lambda v, t: v <= t}
    broken = F.array_compact(F.array(*[F.when((F.col("name") == n) & tests[c](F.col("value"), t), F.struct(F.lit(c).alias("condition"), F.lit(t).alias("threshold"))) for n, c, t in rules]))
    return points.select("*", F.explode(broken).alias("b")).select(*points.columns, "b.*")


def learn(log: DataFrame) -> DataFrame:
    """pattern, usageCount, averageExecutionTime after each batch of a query log stream (query, executionTime)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["executionTime"].sum())
        state.update((n, total))
        yield pd.DataFrame({"pattern": [key[0]], "usageCount": [n], "averageExecutionTime": [total / n]})

    keyed = log.select(T.query_pattern(F.col("query")).alias("pattern"), F.col("executionTime").cast("double").alias("executionTime"))
    return keyed.groupBy("pattern").applyInPandasWithState(step, "pattern string, usageCount long, averageExecutionTime double", "n long, total double", "update", GroupStateTimeout.NoTimeout)

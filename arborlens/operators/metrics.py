"""Metric series, operation and query logs, sessions: aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def in_range(points: DataFrame, start=None, end=None, name: str | None = None) -> DataFrame:
    """Points (name, ts, value, ...) between two times, both included."""
    if name is not None:
        points = points.filter(F.col("name") == name)
    if start is not None:
        points = points.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        points = points.filter(F.col("ts") <= F.lit(end))
    return points


def aggregate(points: DataFrame, how: str, start=None, end=None) -> DataFrame:
    """name, value: sum, avg, min, max or count of each series."""
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    return in_range(points, start, end).groupBy("name").agg(F.coalesce(f("value"), F.lit(0)).cast("double").alias("value"))


def aggregate_one(points: DataFrame, name: str, how: str, start=None, end=None) -> DataFrame:
    """One row for one series; 0 where nothing is in range."""
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    return in_range(points, start, end, name).agg(F.coalesce(f("value"), F.lit(0)).cast("double").alias("value"))


def summary(points: DataFrame, tie: str = "ts") -> DataFrame:
    """name, count, avg, min, max, last of each series."""
    return points.groupBy("name").agg(F.count("value").alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", F.struct("ts", tie)).alias("last"))


def keep_last(rows: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def trend(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, trend: the mean of the last three against the three before; under four rows, or within a tenth, stable."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = rows.withColumn("_k", F.row_number().over(w)).filter("_k <= 6")
    both = last.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_k") <= 3, F.col(value))).alias("recent"), F.avg(F.when(F.col("_k") > 3, F.col(value))).alias("older"))
    gain = F.try_divide(F.col("older") - F.col("recent"), F.col("older"))
    return both.select(key, F.when((F.col("n") < 4) | gain.isNull(), "stable").when(gain > 0.1, "improving").when(gain < -0.1, "degrading").otherwise("stable").alias("trend"))


def running_mean(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("runningMean", F.avg(value).over(w))


def operation_report(ops: DataFrame, last: int | None = None) -> DataFrame:
    """operation, total, succeeded, failed, average, least, most of operations (operation, duration, success, timestamp)."""
    if last is not None:
        ops = ops.orderBy(F.desc("timestamp")).limit(last)
    return ops.groupBy("operation").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.avg("duration").alias("average"), F.min("duration").alias("least"), F.max("duration").alias("most"))


def query_performance(log: DataFrame, most: int = 50) -> DataFrame:
    """key, averageExecutionTime (of successes), successRate, totalExecutions, lastExecution, trend of each query."""
    keyed = keep_last(log.withColumn("key", T.query_hash(F.col("query"))), "key", most, ["timestamp"])
    sums = keyed.groupBy("key").agg(F.coalesce(F.avg(F.when(F.col("success"), F.col("executionTime"))), F.lit(0.0)).alias("averageExecutionTime"), F.avg(F.col("success").cast("int")).alias("successRate"), F.count(F.lit(1)).alias("totalExecutions"), F.max("timestamp").alias("lastExecution"))
    return sums.join(trend(keyed, "key", "executionTime", ["timestamp"]), "key")


def optimisation_stats(log: DataFrame) -> DataFrame:
    """One row: totals, success rate, how many queries improve, degrade, stay."""
    per = query_performance(log)
    totals = log.agg(F.count(F.lit(1)).alias("totalQueries"), F.coalesce(F.avg("executionTime"), F.lit(0.0)).alias("averageExecutionTime"), F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)).alias("successRate"))
    trends = per.agg(F.count(F.lit(1)).alias("uniqueQueries"), *[F.count_if(F.col("trend") == t).alias(t) for t in ("improving", "degrading", "stable")])
    return totals.crossJoin(trends)  # one row each


def learn_patterns(log: DataFrame) -> DataFrame:
    """pattern, description, usageCount, averageExecutionTime, successRate, examples (five at most)."""
    keyed = log.withColumn("pattern", T.query_pattern(F.col("query")))
    return keyed.groupBy("pattern").agg(F.count(F.lit(1)).alias("usageCount"), F.avg("executionTime").alias("averageExecutionTime"), F.avg(F.col("success").cast("int")).alias("successRate"), F.slice(F.array_sort(F.collect_set("query")), 1, 5).alias("examples")).withColumn("description", T.pattern_description(F.col("pattern")))


def best_patterns(patterns: DataFrame, most: int = 10, least_used: int = 3) -> DataFrame:
    score = F.col("successRate") * (1000 / F.greatest(F.col("averageExecutionTime"), F.lit(1.0)))
    return patterns.filter(F.col("usageCount") >= least_used).withColumn("score", score).orderBy(F.desc("score"), "pattern").limit(most)


def cache_stats(cache: DataFrame) -> DataFrame:
    ok = F.col("success")
    return cache.agg(F.count(F.lit(1)).alias("totalQueries"), F.count_if(ok).alias("successfulQueries"), F.coalesce(F.avg(F.when(ok, F.col("executionTime"))), F.lit(0.0)).alias("averageExecutionTime"), F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("averageConfidence"))


def session_stats(messages: DataFrame) -> DataFrame:
    """session, messages, queries, averageResponse, first, last of messages (session, timestamp, query, executionTime)."""
    return messages.groupBy("session").agg(F.count(F.lit(1)).alias("messages"), F.count("query").alias("queries"), F.avg("executionTime").alias("averageResponse"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def storage_stats(messages: DataFrame) -> DataFrame:
    size = F.octet_length(F.to_json(F.struct(*messages.columns)))
    return messages.agg(F.count_distinct("session").alias("sessions"), F.count(F.lit(1)).alias("messages"), F.sum(size).alias("bytes"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def search_messages(messages: DataFrame, term: str, each: int | None = None, most: int = 20) -> DataFrame:
    """The first messages (session, turn, content) that contain a term; ``each`` so many a session."""
    hits = messages.filter(F.lower(F.col("content")).contains(term.lower()))
    if each is not None:
        w = Window.partitionBy("session").orderBy("turn")
        return hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= each).drop("_k")
    return hits.orderBy("session", "turn").limit(most)


def recent_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("last"), "session")


def sessions_to_clean(sessions: DataFrame, created_before, accessed_before, most: int) -> DataFrame:
    """Sessions too old by both ages, or beyond the ``most`` last used."""
    w = Window.orderBy(F.desc("last"), "session")  # over sessions, one row each
    ranked = sessions.withColumn("_k", F.row_number().over(w))
    old = (F.col("first") < F.lit(created_before)) & (F.col("last") < F.lit(accessed_before))
    return ranked.filter(old | (F.col("_k") > most)).drop("_k")


def basic_statistics(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


def frequency(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def engine_comparison(runs: DataFrame, last: int = 10) -> DataFrame:
    """engine, average of its last runs, ratio to the slowest."""
    kept = keep_last(runs, "engine", last, ["timestamp"])
    means = kept.groupBy("engine").agg(F.avg("duration").alias("average"))
    return means.withColumn("ratio", F.max("average").over(Window.partitionBy(F.lit(1))) / F.col("average"))  # a row an engine


def breaches(points: DataFrame, name: str, condition: str, threshold: float) -> DataFrame:
    """Points of a series that an alert is for: gt, lt, gte or lte of a threshold."""
    v = F.col("value")
    test: Column = {"gt": v > threshold, "lt": v < threshold, "gte": v >= threshold, "lte": v <= threshold}[condition]
    return points.filter(F.col("name") == name).filter(test)


#: Alerts that hold by default: (series, condition, threshold).
ALERTS = [("memory_usage", "gt", 80.0), ("error_rate", "gt", 0.1), ("response_time", "gt", 5000.0)]

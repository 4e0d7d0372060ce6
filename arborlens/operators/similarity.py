"""Top matches by text similarity, and the query cache's searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def token_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """q, c of texts that share a token: the only pairs whose blend can reach 0.3 or more."""
    left = queries.select("q", F.explode(F.array_distinct(T.tokens(F.col("q_text")))).alias("t"))
    right = candidates.select("c", F.explode(F.array_distinct(T.tokens(F.col("c_text")))).alias("t"))
    return left.join(right, "t").groupBy("q", "c").agg(F.count(F.lit(1)).alias("shared"))


def similar(queries: DataFrame, candidates: DataFrame, threshold: float = 0.5, most: int = 10) -> DataFrame:
    """(q, q_text) x (c, c_text) -> q, c, similarity, rank: blends over the threshold, the best first, ties by c.

    Token sets of the pair bound the blend from above (0.3 J + 0.4 * 1 + 0.3 * 1): pairs without a shared
    token are never made, which is exact from a threshold of 0.3 on.
    """
    if threshold < 0.3:
        raise ValueError("below 0.3 pairs without a shared token would count")
    sizes = lambda df, k: df.select(k, F.col(f"{k}_text"), F.size(F.array_distinct(T.tokens(F.col(f"{k}_text")))).alias(f"n_{k}"))
    pairs = token_pairs(queries, candidates).join(sizes(queries, "q"), "q").join(sizes(candidates, "c"), "c")
    j = F.col("shared") / (F.col("n_q") + F.col("n_c") - F.col("shared"))
    longest = F.greatest(F.length("q_text"), F.length("c_text"))
    most_l = F.least(F.length("q_text"), F.length("c_text")) / longest
    near = pairs.filter(j * 0.3 + 0.4 + most_l * 0.3 > threshold)
    scored = near.withColumn("similarity", T.blend(F.col("q_text"), F.col("c_text"))).filter(F.col("similarity") > threshold)
    best = Window.partitionBy("q").orderBy(F.desc("similarity"), "c")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("q", "c", "similarity", "rank")


def most_similar(queries: DataFrame, candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    return similar(queries, candidates, threshold, 1).drop("rank")


def similar_questions(queries: DataFrame, candidates: DataFrame, threshold: float = 0.6, most: int = 5) -> DataFrame:
    """``similar`` on normalised questions; of candidates with equal normal forms the first stands for all."""
    q = queries.withColumn("q_text", T.question(F.col("q_text")))
    c = candidates.withColumn("c_text", T.question(F.col("c_text"))).groupBy("c_text").agg(F.min("c").alias("c"))
    return similar(q, c, threshold, most)


def cached(question: str, cache: DataFrame, least: float = 0.7, confidence: float = 0.6, most: int = 5) -> DataFrame:
    """Cache rows (question, query, success, confidence, executionTime) like a question, best similarity * confidence first."""
    s = T.word_jaccard(F.lit(question), F.col("question"))
    rows = cache.filter("success").filter(F.col("confidence") >= confidence).withColumn("similarity", s).filter(F.col("similarity") >= least)
    return rows.orderBy((F.col("similarity") * F.col("confidence")).desc(), "question").limit(most)


def upsert(cache: DataFrame, entries: DataFrame, capacity: int = 1000) -> DataFrame:
    """The latest row of each normalised question, the newest ``capacity``."""
    key = T.question(F.col("question"))
    latest = Window.partitionBy(key).orderBy(F.desc("timestamp"))
    return cache.unionByName(entries).withColumn("_k", F.row_number().over(latest)).filter("_k = 1").drop("_k").orderBy(F.desc("timestamp")).limit(capacity)


def pattern_suggestions(question: str, patterns: DataFrame) -> DataFrame:
    """Patterns (pattern, example, successRate) that succeed over 0.7 and whose example is like the question."""
    s = T.word_jaccard(F.lit(question), F.col("example"))
    return patterns.filter("successRate > 0.7").withColumn("similarity", s).filter("similarity > 0.6").orderBy(F.desc("successRate"), "pattern")


def similar_successes(question: str, log: DataFrame, most: int = 3) -> DataFrame:
    """The fastest success of each query, of those whose question is over 0.3 like this one."""
    best = log.filter("success AND resultCount > 0").groupBy(T.query_hash(F.col("query")).alias("key")).agg(F.min_by(F.struct("query", "question", "executionTime"), F.struct("executionTime", "timestamp")).alias("b")).select("b.*")
    return best.withColumn("similarity", T.word_jaccard(F.lit(question), F.col("question"))).filter("similarity > 0.3").orderBy(F.desc("similarity"), "query").limit(most)


def cosine(a, b):
    """Cosine of two float arrays; 0 where one is all nought."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def suggestions(log: DataFrame) -> DataFrame:
    """query, kind, severity, message for what a query log (query, executionTime, resultCount) shows."""
    q = F.col("query")
    rules = [
        (F.col("executionTime") > 1000, "performance", "high", "over one second"),
        (F.col("resultCount") == 0, "accuracy", "medium", "no results"),
        (F.col("resultCount") > 1000, "performance", "medium", "over a thousand results"),
        (q.contains("MATCH ()") & ~q.contains("LIMIT"), "performance", "high", "matches all nodes"),
        (q.contains("*1..10"), "performance", "medium", "long paths"),
        (~q.contains("LIMIT") & ~q.contains("COUNT"), "performance", "low", "no LIMIT"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for test, k, s, m in rules]))
    return log.select("query", F.explode(found).alias("s")).select("query", "s.*")


def shortened(query: str, limit: int = 50, hops: int = 3) -> str:
    """A slow query with a LIMIT and shorter paths."""
    import re

    query = re.sub(r"\*1\.\.\d+", f"*1..{hops}", query)
    return query if "LIMIT" in query else f"{query} LIMIT {limit}"

"""Routing of queries to named routes: by vectors, by words, or by both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.functions import vectors as V


#: Utterances of all routes that a broadcast takes; more are joined in blocks by the planner's choice.
MOST_UTTERANCES = 10_000


def _sized(routes: DataFrame) -> DataFrame:
    return F.broadcast(routes) if routes.count() <= MOST_UTTERANCES else routes


def _best(scored: DataFrame, threshold: float) -> DataFrame:
    """The route of the largest score of each query; ties go to the first route."""
    route = scored.groupBy("query_id", "route", "place").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("score"))
    ranked = route.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "place", "route"))).where("_r = 1")
    return ranked.select("query_id", "route", "score", (F.col("score") >= threshold).alias("matched"))


def semantic(queries: DataFrame, routes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """queries (query_id, vector), routes (route, place, utterance vector)."""
    pairs = queries.crossJoin(_sized(routes.select("route", "place", F.col("vector").alias("u"))))
    return _best(pairs.select("query_id", "route", "place", V.cosine(F.col("vector"), F.col("u")).alias("s")), threshold)


def lexical(queries: DataFrame, routes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """queries (query_id, text), routes (route, place, utterance)."""
    q = queries.select("query_id", F.array_distinct(T.ascii_tokens(F.col("text"))).alias("q"))
    r = routes.select("route", "place", F.array_distinct(T.ascii_tokens(F.col("utterance"))).alias("u"))
    return _best(q.crossJoin(_sized(r)).select("query_id", "route", "place", T.jaccard(F.col("q"), F.col("u")).alias("s")), threshold)


def hybrid(semantic_hits: DataFrame, lexical_hits: DataFrame, weight: float = 0.7, threshold: float = 0.75) -> DataFrame:
    """Agreeing routes add up against the semantic threshold; else the higher weighted side that matched."""
    w = weight if 0 <= weight <= 1 else 0.7
    s = semantic_hits.select("query_id", F.col("route").alias("sr"), F.col("score").alias("ss"), F.col("matched").alias("sm"))
    x = lexical_hits.select("query_id", F.col("route").alias("lr"), F.col("score").alias("ls"), F.col("matched").alias("lm"))
    j = s.join(x, "query_id")
    both = F.col("sm") & F.col("lm") & (F.col("sr") == F.col("lr"))
    a, b = F.when(F.col("sm"), F.col("ss") * w).otherwise(0.0), F.when(F.col("lm"), F.col("ls") * (1 - w)).otherwise(0.0)
    total = F.col("ss") * w + F.col("ls") * (1 - w)
    left = a >= b
    return j.select(
        "query_id",
        F.when(both | left, F.col("sr")).otherwise(F.col("lr")).alias("route"),
        F.when(both, total).when(left, F.col("ss")).otherwise(F.col("ls")).alias("score"),
        F.when(both, total >= threshold).when(left, F.col("sm")).otherwise(F.col("lm")).alias("matched"),
    )

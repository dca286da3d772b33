"""Ranking and reciprocal-rank fusion for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.vectors import dot
from quarryline.operators import lexical
from quarryline.staging import small

#: Fixed value: the constant of reciprocal-rank fusion; ranks start at 0.
LAMBDA = 60
DIGITS = 9


def rrf(rank: Column) -> Column:
    return 1 / (F.lit(float(LAMBDA)) + rank)


def rank(score: str, *partition: str, tie: str = "chunk_id") -> Column:
    """0-based; scores are rounded, so that engines that add in another order rank alike, and ties go by id."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.round(score, DIGITS).desc(), tie)) - 1


def scored_pairs(chunks: DataFrame, queries: DataFrame, index: lexical.Index) -> DataFrame:
    """Every chunk for every query of the stated set, with both scores; the cosine is null without a vector. The queries, not the chunks, are sent to
    all tasks, if they are few enough."""
    own = chunks.select("chunk_id", "source", "embedding")
    pairs = own.join(small(queries.select("query_id", F.col("embedding").alias("q"))))
    pairs = pairs.select("query_id", "chunk_id", "source", dot(F.col("embedding"), F.col("q")).alias("cosine"))
    found = lexical.scores(index, queries)
    return pairs.join(found, ["query_id", "chunk_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def fused(pairs: DataFrame, *partition: str, weight: Column | float = 0.5) -> DataFrame:
    """Adds score: BM25 and vector ranks within the partition, fused by weight; a row without a cosine stands in the
    BM25 list alone. Each partition is sorted whole, twice; ``scan.best`` finds the best of large ones without that."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    rows = pairs.withColumn("_b", rank("bm25", *partition)).withColumn("_v", rank("cosine", *partition))
    near = F.when(F.col("cosine").isNull(), 0.0).otherwise((1 - w) * rrf(F.col("_v")))
    return rows.withColumn("score", w * rrf(F.col("_b")) + near).drop("_b", "_v")


def places(k: int, weight: float = 0.5) -> int:
    """How many rows of each list can be among the k best: one behind the first R of both scores less than
    1 / (60 + R), and the k best score at least weight / (59 + k) each, by the list that weighs more."""
    return int((LAMBDA - 1 + k) / max(weight, 1 - weight)) - LAMBDA + 1


def top(rows: DataFrame, k: int, *partition: str) -> DataFrame:
    """The k best by score, with their place ``pos`` from 0."""
    return rows.withColumn("pos", rank("score", *partition)).filter(F.col("pos") < k)


def across(hits: DataFrame) -> DataFrame:
    """Fusion over a question's queries: hits (question_id, query_id, chunk_id, score) to (question_id, chunk_id,
    score)."""
    ranked = hits.withColumn("_r", rank("score", "question_id", "query_id"))
    return ranked.groupBy("question_id", "chunk_id").agg(F.sum(rrf(F.col("_r"))).alias("score"))


def floor(hits: DataFrame, top_k: int, low: int = 2, high: int = 3) -> DataFrame:
    """The head of each query's list, which no cut may drop, with its place ``floor_pos`` in the question."""
    keep = max(low, min(high, top_k // 3))
    ranked = hits.withColumn("_r", rank("score", "question_id", "query_id")).filter(F.col("_r") < keep)
    first = ranked.groupBy("question_id", "chunk_id").agg(F.min(F.struct("query_id", "_r")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("_f", "chunk_id")) - 1
    return first.select("question_id", "chunk_id", place.alias("floor_pos"))

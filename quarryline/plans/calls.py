"""Queries that call services which answer out of order and fail: stand-ins whose answers SQL can work out."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.plans import fixtures as fx
from quarryline.registry import query
from quarryline.sources import providers

#: Texts of a length divisible by this are refused, and a call is refused the first time if its hash is divisible by the other.
REFUSED, SHAKY = 97, 3
#: Documents a rerank call takes, fewer than most questions have.
MOST = 100


class Flaky:
    """A service in a task: it shuffles its answers, refuses each call that holds a text of a refused length, and some
    others when they are made first."""

    def __init__(self, answer):
        self.answer, self.seen = answer, set()

    def __call__(self, *asked):
        texts = asked[-1]
        mark = zlib.crc32("\x1f".join(texts).encode())
        if mark % SHAKY == 0 and mark not in self.seen:
            self.seen.add(mark)
            raise TimeoutError("try again")
        if any(len(t) % REFUSED == 0 for t in texts):
            raise ValueError("refused")
        order = sorted(range(len(texts)), key=lambda i: zlib.crc32(texts[i].encode()) ^ mark)
        return [(i, self.answer(*asked[:-1], texts[i])) for i in order]


def vector(text: str) -> list[float]:
    return [float(len(text)), float(text.count("e") + 1), float(text.count(" "))]


def relevance(question: str, text: str) -> float:
    """How near a text's share of blanks is to the question's."""
    share = lambda t: t.count(" ") / max(len(t), 1)
    return 1.0 - abs(share(question) - share(text))


_VECTOR = "sqrt(n * n + e * e + b * b)"


@query("k1_embedding_calls", f"""WITH d AS (SELECT doc_id, length(text)::DOUBLE AS n, (length(text) - length(replace(text, 'e', '')) + 1)::DOUBLE AS e, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b FROM documents)
SELECT doc_id, length % {REFUSED} = 0 AS failed, CASE WHEN length % {REFUSED} > 0 THEN round(n / {_VECTOR}, 4) END AS x, CASE WHEN length % {REFUSED} > 0 THEN round(e / {_VECTOR}, 4) END AS y,
  CASE WHEN length % {REFUSED} > 0 THEN round(b / {_VECTOR}, 4) END AS z FROM (SELECT *, n::BIGINT AS length FROM d)""")  # fmt: skip
def embedding_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: calls of ten texts; each text has its own vector, and only those that the service refuses have none."""
    docs = fx.spread(fx.table(spark, sf_dir, "documents")).select("doc_id", "text")
    rows = providers.called(docs, "text", Flaky(vector), pause=0.0)
    axes = {c: F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(c) for i, c in enumerate("xyz")}
    return rows.select("doc_id", F.col("embedding_error").isNotNull().alias("failed"), *axes.values())


@query("k2_rerank_calls", f"""WITH n AS (SELECT count(DISTINCT source) AS n FROM documents), s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
c AS (SELECT b.item_id AS query_id, b.text AS q, d.doc_id, d.text AS t, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) - 1 AS pos
  FROM benchmark b, n JOIN s ON s.k = b.item_id % n.n JOIN documents d ON d.source = s.source),
r AS (SELECT query_id, pos, length(t) % {REFUSED} = 0 AS failed,
  round(1.0 - abs((length(q) - length(replace(q, ' ', '')))::DOUBLE / greatest(length(q), 1) - (length(t) - length(replace(t, ' ', '')))::DOUBLE / greatest(length(t), 1)), 12) AS score FROM c)
SELECT query_id, pos, CASE WHEN NOT failed THEN round(score, 6) END AS score, failed, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 1 ELSE 0 END, CASE WHEN failed THEN 0 ELSE score END DESC, pos) - 1 AS place FROM r""")  # fmt: skip
def rerank_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: each question's candidates are the documents of one source, ranked over all of its calls."""
    docs = fx.table(spark, sf_dir, "documents")
    sources = docs.filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("_n"))
    # One row a source.
    numbered = sources.select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("_k"), F.count("*").over(Window.partitionBy()).alias("_sources"))
    asked = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = asked.join(numbered.select("_sources").limit(1)).withColumn("_k", F.col("query_id") % F.col("_sources")).join(numbered.select("source", "_k"), "_k")
    # A question has one source's documents, so they are numbered once, before they meet questions.
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    placed = docs.filter("source IS NOT NULL").select("source", "text", place.cast("long").alias("pos"))
    candidates = asked.join(placed, "source")
    score = lambda question, text: round(relevance(question, text), 12)
    rows = providers.reranked(candidates, Flaky(score), most=MOST, pause=0.0)
    return rows.select("query_id", "pos", F.round("relevance_score", 6).alias("score"), F.col("error").isNotNull().alias("failed"), F.col("place").cast("long").alias("place"))

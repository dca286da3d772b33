"""How the driver's tables stand in for a corpus, its questions and its operational data, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that play the policy's part on the synthetic texts.
CONCEPTS = ["tion", "heit", "aux"]
WIDE, MARKERS = "tion", ["ing", "tist"]
GATES = [{"required_context_keywords": ["then", "ally"], "blocked_text_keywords": ["license", "heit"], "chunk_types": ["clause"]}]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt out; larger ones, which need no shuffle, as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    parent = F.min("doc_id").over(Window.partitionBy("source", F.floor(F.col("doc_id") / 100)))
    rows = docs.withColumn("parent", parent).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    role = F.when(F.col("quality") == 0, "behavior_penalty").when(F.col("toxic") == 1, "procedural").when(F.col("quality") == 1, "definition").otherwise("substantive")
    is_parent = F.col("doc_id") == F.col("parent")
    parent_no = F.concat(F.lit("a"), F.col("parent"))
    return rows.select(
        F.col("doc_id").alias("chunk_id"), "text", "source", F.col("lang").alias("section_header"), role.alias("role"),
        F.when(is_parent, "article").otherwise("clause").alias("chunk_type"), parent_no.alias("parent_article_no"),
        F.when(is_parent, parent_no).otherwise(F.concat_ws("-", parent_no, F.col("doc_id"))).alias("article_no"), F.substring("text", 1, 20).alias("penalty_context"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks' ids and texts alone, for which nothing has to meet."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_id"), "text")


def sourced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their sources."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_id"), "source", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have a vector, for searches by vector alone."""
    return chunks(spark, sf_dir).join(vectors(spark, sf_dir), "chunk_id")


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, with a vector or a null."""
    return chunks(spark, sf_dir).join(vectors(spark, sf_dir), "chunk_id", "left")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, embedding; four queries make a question, the first of them as asked."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(vectors, "query_id").withColumns({"question_id": F.floor(F.col("query_id") / 4), "query_pos": F.pmod("query_id", F.lit(4))})


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: every question, with or without a vector."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


CHUNKS = """base AS (
  SELECT d.doc_id, d.text, d.source, d.lang, l.quality, l.toxic, min(d.doc_id) OVER (PARTITION BY d.source, d.doc_id // 100) AS parent
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), chunks AS (
  SELECT doc_id AS chunk_id, text, source, lang AS section_header,
    CASE WHEN quality = 0 THEN 'behavior_penalty' WHEN toxic = 1 THEN 'procedural' WHEN quality = 1 THEN 'definition' ELSE 'substantive' END AS role,
    CASE WHEN doc_id = parent THEN 'article' ELSE 'clause' END AS chunk_type, 'a' || parent AS parent_article_no,
    CASE WHEN doc_id = parent THEN 'a' || parent ELSE 'a' || parent || '-' || doc_id END AS article_no, substr(text, 1, 20) AS penalty_context
  FROM base
)"""

QUESTIONS = """qs AS (
  SELECT b.item_id AS query_id, b.text, e.embedding AS q, b.item_id // 4 AS question_id, b.item_id % 4 AS query_pos
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id
)"""

TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_BM25 = f"""tf AS (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TERMS}) AS term FROM vc) GROUP BY chunk_id, term
), lengths AS (
  SELECT chunk_id, len({TERMS}) AS dl FROM vc
), corpus AS (
  SELECT count(*) AS n, avg(dl) AS mean FROM lengths
), dfs AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), raws AS (
  SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus
), idf AS (
  SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws
), asked AS (
  SELECT query_id, term, count(*) AS asked FROM (SELECT query_id, unnest({TERMS}) AS term FROM qs) GROUP BY query_id, term
), bm AS (
  SELECT query_id, chunk_id, sum(asked * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS bm25
  FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN lengths USING (chunk_id), corpus GROUP BY query_id, chunk_id
)"""



def lexical_sql(corpus: str) -> str:
    """BM25 of all questions over a corpus (chunk_id, text)."""
    return f"""vc AS ({corpus}), qs AS (SELECT item_id AS query_id, text FROM benchmark), {_BM25}"""


INDEX = f"""{CHUNKS}, {QUESTIONS}, vc AS (
  SELECT c.*, e.embedding FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.chunk_id
), {_BM25}"""
#: The same over all chunks and all questions: BM25 needs no vectors.
LEXICAL = lexical_sql("SELECT doc_id AS chunk_id, text FROM documents")

PAIRS = f"""{INDEX}, pairs AS (
  SELECT qs.query_id, vc.chunk_id, vc.source, coalesce(bm25, 0.0) AS bm25,
    CASE WHEN vc.embedding IS NOT NULL THEN list_sum(list_transform(list_zip(vc.embedding, qs.q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) END AS cosine
  FROM qs CROSS JOIN vc LEFT JOIN bm ON bm.query_id = qs.query_id AND bm.chunk_id = vc.chunk_id
)"""


def fused_sql(name: str, rows: str, *partition: str, weight: str = "0.5", extra: str = "") -> str:
    """A CTE that ranks ``rows`` in the partition and fuses."""
    over = f"OVER (PARTITION BY {', '.join(partition)} ORDER BY"
    return f"""{name} AS (
  SELECT *, {weight} / (60.0 + b) + CASE WHEN cosine IS NULL THEN 0.0 ELSE (1 - {weight}) / (60.0 + v) END AS score FROM (
    SELECT *, row_number() {over} round(bm25, 9) DESC, chunk_id) - 1 AS b, row_number() {over} round(cosine, 9) DESC NULLS LAST, chunk_id) - 1 AS v FROM {rows}{extra}
  )
)"""


ROUTES = f"""{PAIRS}, {fused_sql('whole', 'pairs', 'query_id')}, {fused_sql('each_source', 'pairs', 'query_id', 'source')}, found AS (
  SELECT query_id, chunk_id, source, score, 0 AS route FROM whole
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 10
  UNION ALL
  SELECT query_id, chunk_id, source, score, 1 AS route FROM each_source
  QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, chunk_id) <= 3
), hits AS (
  SELECT query_id, chunk_id, source, score, route FROM found
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY route) = 1
), ranked_hits AS (
  SELECT h.*, qs.question_id, qs.query_pos, row_number() OVER (PARTITION BY h.query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS r
  FROM hits h JOIN qs USING (query_id)
)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: a trace per user and day, tokens from the value, purchases as cache hits."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"),
        F.floor("value").cast("long").alias("tokens"), (F.col("event_type") == "purchase").alias("cache_hit"), (F.col("value") * 10).alias("duration_ms"), "ts",
    )


TRACES = """traces AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, event_id AS span_id, event_type AS name, CAST(floor(value) AS BIGINT) AS tokens,
    event_type = 'purchase' AS cache_hit, value * 10 AS duration_ms, ts
  FROM events
)"""

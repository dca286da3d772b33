"""Queries of the rerank stage and of contexts, citations and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.text import clause_label, numeral
from quarryline.functions.vectors import dot
from quarryline.operators import context, fusion, lexical, rerank, scan
from quarryline.plans import fixtures as fx
from quarryline.plans.texts import spelled
from quarryline.registry import literal, query
from quarryline.staging import small, stage
from quarryline.sources import providers

WIDTH, LEAST, TOP = 24, 0.05, 7

CANDIDATES = f"""{fx.CHUNKS}, {fx.QUESTIONS}, cands AS (
  SELECT qs.query_id, c.*, list_sum(list_transform(list_zip(e.embedding, qs.q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS cosine
  FROM qs CROSS JOIN chunks c JOIN embeddings e ON e.vec_id = c.chunk_id
), pool AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) - 1 AS pos, round(cosine, 9) AS rerank_score FROM cands QUALIFY pos < {WIDTH}
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks of each query; their cosine is the offline reranker's score."""
    c, q = fx.vector_chunks(spark, sf_dir), fx.queries(spark, sf_dir)
    near = c.select("chunk_id", "embedding").join(small(q.select("query_id", F.col("embedding").alias("q"))))
    near = near.select("query_id", "chunk_id", dot(F.col("embedding"), F.col("q")).alias("cosine"))
    near = near.withColumn("pos", fusion.rank("cosine", "query_id")).filter(F.col("pos") < WIDTH)
    return near.join(c.drop("embedding"), "chunk_id")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    answer = providers.cosine_reranker(rows).withColumn("relevance_score", F.round("relevance_score", 9))
    return rerank.scored(rows, answer)


@query("j15_rerank_join", f"WITH {CANDIDATES} SELECT query_id, chunk_id, pos, round(rerank_score, 6) AS rerank_score FROM pool")
def rerank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, K2."""
    return reranked(spark, sf_dir).select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"), F.round("rerank_score", 6).alias("rerank_score"))


_KEPT = f"""{CANDIDATES}, passed AS (
  SELECT *, role IN ('definition', 'behavior_penalty') AS prot FROM pool WHERE role IN ('definition', 'behavior_penalty') OR rerank_score >= {LEAST}
), fewer AS (
  SELECT * FROM passed QUALIFY role <> 'behavior_penalty' OR row_number() OVER (PARTITION BY query_id, role ORDER BY rerank_score DESC, chunk_id) <= 3
), firsts AS (
  SELECT *, prot OR row_number() OVER (PARTITION BY query_id, source, section_header ORDER BY rerank_score DESC, chunk_id) = 1 AS eligible FROM fewer
), counted AS (
  SELECT *, count(*) FILTER (WHERE eligible) OVER (PARTITION BY query_id, source ORDER BY rerank_score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM firsts
), keep AS (
  SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) - 1 AS pos FROM counted WHERE eligible AND (prot OR above < 3)
)"""


@query("p5_rerank_filter", f"WITH {_KEPT} SELECT query_id, chunk_id, pos FROM keep")
def rerank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5's filter stage: F4, W6, W7, W8, A16."""
    return rerank.kept(reranked(spark, sf_dir), LEAST).select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


_DIVERSE = f"""{_KEPT}, fronts AS (
  SELECT *, count(*) OVER (PARTITION BY query_id, source) AS n FROM keep WHERE pos < {TOP}
), lows AS (
  SELECT query_id, pos, n, row_number() OVER (PARTITION BY query_id, source ORDER BY pos DESC) AS e FROM fronts WHERE NOT prot
), slots AS (
  SELECT query_id, pos AS slot, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) AS k FROM lows WHERE e <= n - 1
), newcomers AS (
  SELECT query_id, min(pos) AS newcomer FROM keep WHERE pos >= {TOP} AND (query_id, source) NOT IN (SELECT (query_id, source) FROM fronts) GROUP BY query_id, source
), swaps AS (
  SELECT * FROM slots JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY newcomer) AS k FROM newcomers) USING (query_id, k)
), moved AS (
  SELECT keep.* EXCLUDE (pos), coalesce(a.newcomer, b.slot, keep.pos) AS pos FROM keep
  LEFT JOIN swaps a ON a.query_id = keep.query_id AND a.slot = keep.pos LEFT JOIN swaps b ON b.query_id = keep.query_id AND b.newcomer = keep.pos
)"""


@query("p9_diversity_swap", f"WITH {_DIVERSE} SELECT query_id, chunk_id, pos FROM moved WHERE pos < {TOP}")
def diversity_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    rows = rerank.diverse(rerank.kept(reranked(spark, sf_dir), LEAST), TOP).filter(F.col("pos") < TOP)
    return rows.select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


@query("p10_quota_inserts")
def quota_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 on top of P9, K2."""
    scored = reranked(spark, sf_dir)
    rows = rerank.diverse(rerank.kept(scored, LEAST), TOP)
    out = rerank.with_quotas(rows, scored, fx.queries(spark, sf_dir), fx.CONCEPTS, "ing", TOP)
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("o5_role_order", f"""WITH {CANDIDATES} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY
  CASE role WHEN 'procedural' THEN -1 WHEN 'substantive' THEN 1 ELSE 0 END, rerank_score DESC, pos) - 1 AS pos FROM pool""")  # fmt: skip
def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5, Q11."""
    return rerank.role_order(reranked(spark, sf_dir), ["procedure"]).select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


@query("f17_roles", """WITH h AS (SELECT doc_id, substr(text, 1, 20) || ' / ' || lang AS h FROM documents)
SELECT doc_id, CASE WHEN contains(h, 'tion') OR contains(h, 'heit') THEN 'behavior_penalty' WHEN contains(h, 'the') OR contains(h, 'fr') THEN 'definition' WHEN contains(h, 'ie') THEN 'procedural' ELSE 'substantive' END AS role FROM h""")  # fmt: skip
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """heads and languages of documents as headers of two parts."""
    words = {"behavior_penalty": ["tion", "heit"], "definition": ["the", "fr"], "procedural": ["ie"]}
    header = F.concat(F.substring("text", 1, 20), F.lit(" / "), "lang")
    return fx.table(spark, sf_dir, "documents").select("doc_id", rerank.role(header, words).alias("role"))


_CONTEXTS = f"{CANDIDATES}, ctx AS (SELECT * FROM pool WHERE pos < 7), named AS (SELECT DISTINCT query_id, source, parent_article_no AS article_no FROM ctx WHERE chunk_type = 'clause'), missing AS (SELECT * FROM named WHERE (query_id, source, article_no) NOT IN (SELECT (query_id, source, article_no) FROM ctx WHERE chunk_type = 'article'))"


def contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pool = candidates(spark, sf_dir)
    return pool.filter("pos < 7"), pool


@query("j7_parent_repair", f"""WITH {_CONTEXTS} SELECT query_id, chunk_id FROM ctx UNION ALL
SELECT p.query_id, p.chunk_id FROM pool p JOIN missing m ON m.query_id = p.query_id AND m.source = p.source AND m.article_no = p.article_no WHERE p.chunk_type = 'article' AND p.pos >= 7""")  # fmt: skip
def parent_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    return context.with_parents(*contexts(spark, sf_dir)).select("query_id", "chunk_id")


@query("j8_penalty_injection", f"""WITH {_CONTEXTS} SELECT c.query_id, c.chunk_id, md5(CASE WHEN c.chunk_type = 'clause' AND m.source IS NOT NULL AND trim(substr(c.text, 1, 20) || 'x') <> 'x'
  THEN 'penalty of ' || c.source || chr(10) || trim(c.text) ELSE c.text END) AS text_md5
FROM ctx c LEFT JOIN missing m ON m.query_id = c.query_id AND m.source = c.source AND m.article_no = c.parent_article_no""")  # fmt: skip
def penalty_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    ctx, _ = contexts(spark, sf_dir)
    rows = context.with_penalties(ctx.withColumn("penalty_context", F.concat(F.lit("penalty of "), F.col("source"))))
    return rows.select("query_id", "chunk_id", F.md5("text").alias("text_md5"))


@query("j9_expansion_guarantee", f"""WITH {fx.INDEX}, near AS (
  SELECT qs.query_id, vc.chunk_id, row_number() OVER (PARTITION BY qs.query_id ORDER BY CASE WHEN vc.embedding IS NOT NULL THEN round(list_sum(list_transform(list_zip(vc.embedding, qs.q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 9) END DESC NULLS LAST, vc.chunk_id) - 1 AS pos
  FROM qs CROSS JOIN vc
), ctx AS (SELECT * FROM near WHERE pos < 3), heads AS (
  SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS r FROM bm QUALIFY r <= 3 AND bm25 >= 10
), more AS (
  SELECT query_id, chunk_id, 2 + row_number() OVER (PARTITION BY query_id ORDER BY r, chunk_id) AS pos FROM heads
  WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM ctx)
) SELECT * FROM ctx UNION ALL SELECT * FROM more WHERE pos <= 7""")  # fmt: skip
def expansion_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk is a candidate; the nearest and the best by words come as heads of scans."""
    c, q = fx.all_chunks(spark, sf_dir), fx.queries(spark, sf_dir)
    scans = scan.scanned(c, q, lexical.build(fx.texts(spark, sf_dir)))
    first = stage(scan.nearest(scans, 3), "nearest")
    bm25 = stage(scan.bm25_heads(scans, 3).select("query_id", F.lit("as asked").alias("expansion"), "chunk_id", "bm25"), "heads")
    return context.ensured(first, bm25, bm25).withColumn("pos", F.col("pos").cast("long"))


@query("a10_merged_citations", f"""WITH {_CONTEXTS}, grouped AS (
  SELECT query_id, source, parent_article_no AS article_no, min(pos) AS first_pos, arg_min(section_header, pos) AS section_header,
    CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg(trim(chr(10) || text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY pos) END AS text, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY pos) AS merged_from
  FROM ctx GROUP BY query_id, source, parent_article_no
) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_pos) - 1 AS place, source, article_no, section_header, length(text) AS n_chars, merged_from FROM grouped""")  # fmt: skip
def merged_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here without clause labels; labels and their order are tested on literal rows."""
    ctx, _ = contexts(spark, sf_dir)
    out = context.merged_references(ctx.withColumn("text", F.trim("text")), F.lit(0), F.lit(""))
    return out.select("query_id", F.col("place").cast("long").alias("place"), "source", "article_no", "section_header", F.char_length("text").cast("long").alias("n_chars"), F.array_join(F.transform("merged_from", lambda i: i.cast("string")), ",").alias("merged_from"))


@query("o9_clause_order", """WITH c AS (SELECT doc_id // 10 AS query_id, 9 - doc_id % 10 AS pos, 'law' || (doc_id % 2) AS source, doc_id * 7 % 10 AS n, 'text ' || doc_id AS text FROM documents),
g AS (SELECT query_id, source, min(pos) AS f, CASE WHEN count(*) = 1 THEN any_value(text)
  ELSE string_agg('（第' || ['五', '六', '七', '八', '九', '十', '十一', '十二', '十三', '十四'][n + 1] || '款）' || chr(10) || text, chr(10) || chr(10) ORDER BY n) END AS text FROM c GROUP BY query_id, source)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f) - 1 AS place, source, '第五条' AS article_no, text FROM g""")  # fmt: skip
def clause_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents are the clauses of two articles, in another order than their numbers'."""
    d = F.col("doc_id")
    rows = fx.table(spark, sf_dir, "documents").select(
        F.floor(d / 10).alias("query_id"), (9 - d % 10).alias("pos"), F.concat(F.lit("law"), d % 2).alias("source"), F.lit("第五条").alias("parent_article_no"),
        F.concat(F.lit("第五条第"), spelled(d * 7 % 10 + 5), F.lit("款")).alias("article_no"), F.concat(F.lit("text "), d).alias("text"), F.lit("").alias("section_header"), d.alias("chunk_id"),
    )
    label = clause_label(F.col("article_no"))
    number = numeral(F.regexp_extract(label, "第(.*)款", 1))
    return context.merged_references(rows, number, label).select("query_id", F.col("place").cast("long").alias("place"), "source", "article_no", "text")


@query("a11_prompt_groups", f"""WITH {_CONTEXTS}, grp AS (
  SELECT query_id, source, min(pos) AS f, '# ' || source || chr(10) || string_agg('[' || article_no || '] ' || text, chr(10) ORDER BY pos) AS b FROM ctx GROUP BY query_id, source
) SELECT query_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY f) || CASE WHEN count(*) > 1 THEN chr(10) || chr(10) || '(several sources)' ELSE '' END) AS prompt_md5, count(*) AS n_sources FROM grp GROUP BY query_id""")  # fmt: skip
def prompt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A15, C34."""
    ctx, _ = contexts(spark, sf_dir)
    return context.prompt_blocks(ctx).select("query_id", F.md5("prompt").alias("prompt_md5"), "n_sources")


LAWS = "(VALUES (1, '中华人民共和国道路法', '第一条', '依照本法第三条处理'), (2, '中华人民共和国道路法', '第三条', '没有引用'), (3, '登记规定', '第七条', '按照《道路法》第三条执行'), (4, '登记规定', '第八条', '依据《道路》第一条'), (5, '登记规定', '第九条', '根据《不存在的法》第一条'), (6, '登记规定', '第十条', '按照《没有》第二条，并依据《道路法》第三条'), (7, '道路', '第一条', '短名')) AS t(chunk_id, source, article_no, text)"


@query("j5_cited_articles", "SELECT * FROM (VALUES (1, 2, 1), (2, 2, 3), (2, 7, 4), (3, 2, 6)) AS t(question_id, chunk_id, cited_by)")
def cited_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own law; by whole name, before others that contain it; by name without the state's; an unknown
    law cites nothing, but the next one that is known does."""
    hits = literal(spark, "(VALUES (1, 1, 0), (2, 3, 0), (2, 4, 1), (2, 5, 2), (3, 6, 0)) AS t(question_id, chunk_id, pos)")
    return context.cited_chunks(hits, literal(spark, LAWS))


@query("j16_citation_audit", "SELECT * FROM (VALUES (1, '道路法', '第九条', 'article not in the contexts'), (1, '海商法', '第二条', 'unknown law')) AS t(query_id, cited, article_no, problem)")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, C26, C27."""
    answers = literal(spark, "(VALUES (1, '见《道路法》第三条、《道路法》第 九 条第一款和《海商法》第二条'), (2, '没有')) AS t(query_id, answer)")
    known = literal(spark, "(VALUES (1, '中华人民共和国道路法', '第三条'), (2, '登记规定', '第七条')) AS t(query_id, source, article_no)")
    return context.audit(answers, known)

"""From questions to contexts in one plan: query lists, retrieval over all of them, gates, rerank, quotas, role order,
expansion guarantee, parents and penalties."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.vectors import dot
from quarryline.operators import context, fusion, lexical, rerank, rules, scan
from quarryline.plans import answers, policies, retrieval
from quarryline.plans import fixtures as fx
from quarryline.registry import ORACLES, literal, query
from quarryline.staging import small, stage


@dataclass
class Policy:
    """What a retrieval run is told: words, gates, caps and thresholds."""

    concepts: list[str]
    wide: str
    markers: list[str]
    kind_word: str
    gates: list[dict] = field(default_factory=list)
    source: str | None = None
    min_score: float | None = 0.05
    top_n: int = rerank.TOP_N
    expansion_least: float = 10.0


def _place(pos: Column, i: Column) -> Column:
    return F.struct(pos.cast("long").alias("pos"), i.cast("long").alias("i")).alias("at")


def query_table(questions: DataFrame, expansion_rules: DataFrame, synonym_table: DataFrame) -> DataFrame:
    """(question_id, query_pos, kind, text): every question (kind 0), its expansions by rule (1) and by synonym (2), each
    text once, in this order. questions: (query_id, text)."""
    own = questions.select(F.col("query_id").alias("question_id"), F.lit(0).alias("kind"), _place(F.lit(0), F.lit(0)), "text")
    ruled = rules.matching_rules(questions, expansion_rules).select(F.col("query_id").alias("question_id"), F.lit(1).alias("kind"), _place(F.col("pos"), F.lit(0)), F.col("enhancement").alias("text"))
    said = rules.synonyms(questions, synonym_table).select(F.col("query_id").alias("question_id"), F.lit(2).alias("kind"), _place(F.col("pos.pos"), F.col("pos.i")), F.col("synonym").alias("text"))
    listed = own.unionByName(ruled).unionByName(said).groupBy("question_id", "text").agg(F.min(F.struct("kind", "at")).alias("_at"))
    place = Window.partitionBy("question_id").orderBy("_at", "text")
    return listed.select("question_id", (F.row_number().over(place) - 1).alias("query_pos"), F.col("_at.kind").alias("kind"), "text")


def retrieved_contexts(chunks: DataFrame, queries: DataFrame, found_intents: DataFrame, policy: Policy) -> DataFrame:
    """(query_id, chunk_id, pos, text and the chunk's columns): the contexts of every question. chunks with embedding;
    queries (query_id, question_id, query_pos, kind, text, embedding), of which query_pos 0 is the question itself;
    found_intents (query_id, pos, intent) of the questions."""
    index = lexical.build(chunks)
    queries = stage(queries, "queries")
    scans = scan.scanned(chunks, queries, index)
    found = retrieval.multi_query(chunks, queries, scans, policy.concepts, policy.wide, policy.markers)
    asked = queries.filter("query_pos = 0").select("question_id", F.col("text").alias("query_text"), F.col("embedding").alias("_q"))
    rows = found.select("question_id", "chunk_id", "pos").join(chunks, "chunk_id").join(small(asked), "question_id")
    rows = rules.scoped(rules.gated(rows, policy.gates), source=policy.source)
    score = F.coalesce(F.round(dot(F.col("embedding"), F.col("_q")), fusion.DIGITS), F.lit(0.0))
    rows = rows.withColumn("rerank_score", score).withColumnRenamed("question_id", "query_id")
    candidates = stage(rows.drop("embedding", "_q", "query_text"), "candidates")
    kept = stage(rerank.diverse(rerank.kept(candidates.drop("pos"), policy.min_score), policy.top_n), "reranked")
    questions = asked.select(F.col("question_id").alias("query_id"), F.col("query_text").alias("text"))
    final = rerank.with_quotas(kept, candidates, questions, policy.concepts, policy.kind_word, policy.top_n)
    final = final.join(candidates.drop("pos"), ["query_id", "chunk_id"])
    final = stage(rerank.role_order_by(final, stage(found_intents, "intents")), "contexts")
    expansions = queries.filter("kind = 1").select("query_id", "question_id", F.col("query_pos").alias("expansion"))
    said = scan.bm25(scans).join(small(expansions), "query_id").select(F.col("question_id").alias("query_id"), "expansion", "chunk_id", "bm25")
    sure = context.ensured(final, candidates, said, least=policy.expansion_least)
    whole = stage(sure.join(candidates.drop("pos"), ["query_id", "chunk_id"]), "ensured")
    return context.with_penalties(context.with_parents(whole, candidates.select(*whole.columns)))


RULES = "(VALUES (0, 'tion', '', 'under the mit license'), (1, 'the,und', 'ally,ther', 'all rights reserved'), (2, 'heit', '', 'das und die'), (3, 'ing', 'then', 'under the mit license')) AS t(pos, triggers, requires, enhancement)"
POLICY = Policy(fx.CONCEPTS, fx.WIDE, fx.MARKERS, "ing", fx.GATES, min_score=answers.LEAST, top_n=answers.TOP, expansion_least=2.0)

_HAS = policies._HAS
_LISTS = f"""matched AS (
  SELECT b.item_id AS question_id, r.enhancement AS text, min(r.pos) AS place FROM benchmark b JOIN {RULES.replace(' AS t(', ' AS r(')}
  ON {_HAS.format(words='r.triggers', text='b.text')} AND (r.requires = '' OR {_HAS.format(words='r.requires', text='b.text')}) GROUP BY b.item_id, r.enhancement
), said AS (
  SELECT question_id, synonym AS text, min(pos * 10 + i) AS place FROM (
    SELECT b.item_id AS question_id, s.pos, unnest(string_split(s.expansions, ',')) AS synonym, generate_subscripts(string_split(s.expansions, ','), 1) - 1 AS i
    FROM benchmark b JOIN {policies.SYNONYMS.replace(' AS t(', ' AS s(')} ON contains(b.text, s.word)) GROUP BY question_id, synonym
), listed AS (
  SELECT question_id, text, min(k * 1000 + place) AS spot FROM (
    SELECT item_id AS question_id, 0 AS k, 0 AS place, text FROM benchmark UNION ALL SELECT question_id, 1, place, text FROM matched UNION ALL SELECT question_id, 2, place, text FROM said
  ) GROUP BY question_id, text
), query_numbers AS (
  SELECT question_id, text, spot // 1000 AS kind, row_number() OVER (PARTITION BY question_id ORDER BY spot, text) - 1 AS query_pos FROM listed
), qs AS (
  SELECT n.question_id * 100 + n.query_pos AS query_id, n.text, e.embedding AS q, n.question_id, n.query_pos, n.kind
  FROM query_numbers n JOIN embeddings e ON e.vec_id = (n.question_id * 7 + n.query_pos * 13) % (SELECT count(*) FROM embeddings)
)"""


def _quota(name: str, before: str, rule: str, asks: str) -> str:
    """One of the quotas in turn: ``before`` holds the list so far."""
    return f"""{name}_open AS (
  SELECT query_id FROM asked_words WHERE {asks} AND query_id NOT IN (SELECT s.query_id FROM {before} s JOIN info i USING (query_id, chunk_id) WHERE {rule})
), {name}_pick AS (
  SELECT query_id, chunk_id FROM (
    SELECT i.*, 0 AS part FROM moved o JOIN info i USING (query_id, chunk_id) WHERE o.pos >= {answers.TOP} AND {rule}
    UNION ALL SELECT i.*, 1 AS part FROM info i WHERE {rule} AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM {before})
  ) WHERE query_id IN (SELECT query_id FROM {name}_open) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, rerank_score DESC, chunk_id) = 1
), {name}_place AS (
  SELECT query_id, coalesce(max(pos) FILTER (WHERE NOT i.prot), CASE WHEN count(*) < {answers.TOP} THEN count(*) ELSE count(*) - 1 END) AS pos
  FROM {before} s JOIN info i USING (query_id, chunk_id) GROUP BY query_id
), {name} AS (
  SELECT query_id, s.chunk_id, s.pos FROM {before} s WHERE (query_id, s.pos) NOT IN (SELECT (p.query_id, p.pos) FROM {name}_place p JOIN {name}_pick USING (query_id))
  UNION ALL SELECT query_id, k.chunk_id, p.pos FROM {name}_pick k JOIN {name}_place p USING (query_id)
)"""


def quotas_sql(question_texts: str) -> str:
    """CTEs from pool, moved and (query_id, text) of the questions to ``quota_rows``."""
    words = ", ".join(f"'{w}'" for w in fx.CONCEPTS)
    any_word = "len(list_filter(i.ws, lambda w: contains(i.text, w))) > 0"
    rule2 = f"i.prot AND contains(i.text, 'ing') AND {any_word}"
    rule3 = "i.role = 'behavior_penalty' AND len(list_filter(i.ws, lambda w: contains(i.text, w) OR contains(coalesce(i.penalty_context, ''), w))) > 0"
    return f"""asked_words AS (SELECT query_id, list_filter([{words}], lambda w: contains(text, w)) AS ws FROM ({question_texts})), info AS (
  SELECT p.query_id, p.chunk_id, p.role, p.text, p.penalty_context, p.rerank_score, p.role IN ('definition', 'behavior_penalty') AS prot, a.ws FROM pool p JOIN asked_words a USING (query_id)
), quota_0 AS (SELECT query_id, chunk_id, pos FROM moved WHERE pos < {answers.TOP}),
{_quota('quota_1', 'quota_0', 'i.prot', 'true')}, {_quota('quota_2', 'quota_1', rule2, 'len(ws) > 0')}, {_quota('quota_3', 'quota_2', rule3, 'len(ws) > 0')}, quota_rows AS (SELECT * FROM quota_3)"""


#: The quotas alone, over what ``p9_diversity_swap`` leaves.
ORACLES["p10_quota_inserts"] = f"WITH {answers._DIVERSE}, {quotas_sql('SELECT query_id, text FROM qs')} SELECT query_id, pos, chunk_id FROM quota_rows"


def _after_pool(sql: str) -> str:
    """The part of a query of CTEs that follows its ``pool``."""
    return sql[sql.index("passed AS (") :]


_SQL = f"""WITH {retrieval._BUDGET.replace(fx.QUESTIONS, _LISTS).replace('pool AS (', 'budget_pool AS (').replace('FROM pool QUALIFY', 'FROM budget_pool QUALIFY')}, questions AS (
  SELECT question_id AS query_id, text, q FROM qs WHERE query_pos = 0
), pool AS (
  SELECT b.question_id AS query_id, vc.*, b.pos, CASE WHEN vc.embedding IS NULL THEN 0.0 ELSE round(list_sum(list_transform(list_zip(vc.embedding, q.q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 9) END AS rerank_score
  FROM budget b JOIN vc USING (chunk_id) JOIN questions q ON q.query_id = b.question_id
  WHERE NOT (vc.chunk_type = 'clause' AND NOT (contains(q.text, 'then') OR contains(q.text, 'ally')) AND (contains(vc.text, 'license') OR contains(vc.text, 'heit')))
), {_after_pool(answers._DIVERSE)}, {quotas_sql('SELECT query_id, text FROM questions')}, found_intents AS (
  SELECT q.query_id, list(r.intent) AS intents FROM questions q JOIN {policies.INTENTS.replace(' AS t(', ' AS r(')}
  ON {_HAS.format(words='r.keywords', text='q.text')} OR regexp_matches(q.text, r.patterns) GROUP BY q.query_id
), ordered AS (
  SELECT s.query_id, s.chunk_id, CASE WHEN f.intents IS NULL THEN s.pos ELSE row_number() OVER (PARTITION BY s.query_id ORDER BY
    CASE WHEN (p.role = 'definition' AND list_contains(f.intents, 'definition')) OR (p.role = 'behavior_penalty' AND list_contains(f.intents, 'penalty')) OR (p.role = 'procedural' AND list_contains(f.intents, 'procedure')) THEN -1
      WHEN p.role IN ('definition', 'behavior_penalty') THEN 0 WHEN p.role = 'substantive' THEN 1 ELSE 2 END, p.rerank_score DESC, s.pos) - 1 END AS pos
  FROM quota_rows s JOIN pool p USING (query_id, chunk_id) LEFT JOIN found_intents f ON f.query_id = s.query_id
), heads_e AS (
  SELECT qs.question_id AS query_id, qs.query_pos AS expansion, bm.chunk_id, row_number() OVER (PARTITION BY bm.query_id ORDER BY round(bm25, 9) DESC, bm.chunk_id) AS r
  FROM bm JOIN qs USING (query_id) WHERE qs.kind = 1 QUALIFY r <= 3 AND bm25 >= {POLICY.expansion_least}
), more AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(expansion * 10 + r), chunk_id) AS k FROM heads_e
  WHERE (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM pool) AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM ordered) GROUP BY query_id, chunk_id QUALIFY k <= 5
), sure AS (
  SELECT * FROM ordered UNION ALL SELECT query_id, chunk_id, coalesce((SELECT max(pos) FROM ordered o WHERE o.query_id = more.query_id), -1) + k FROM more
), ctx AS (
  SELECT p.* EXCLUDE (pos), s.pos FROM sure s JOIN pool p USING (query_id, chunk_id)
), lacking AS (
  SELECT DISTINCT query_id, source, parent_article_no AS article_no FROM ctx WHERE chunk_type = 'clause' AND (query_id, source, parent_article_no) NOT IN (SELECT (query_id, source, article_no) FROM ctx WHERE chunk_type = 'article')
), parents AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY p.pos) AS k FROM (
    SELECT p.* FROM pool p JOIN lacking l ON l.query_id = p.query_id AND l.source = p.source AND l.article_no = p.article_no WHERE p.chunk_type = 'article'
    QUALIFY row_number() OVER (PARTITION BY p.query_id, p.source, p.article_no ORDER BY p.pos) = 1) p
), repaired AS (
  SELECT * FROM ctx UNION ALL SELECT * EXCLUDE (pos, k), (SELECT max(pos) FROM ctx c WHERE c.query_id = parents.query_id) + k AS pos FROM parents
), still AS (
  SELECT * FROM lacking WHERE (query_id, source, article_no) NOT IN (SELECT (query_id, source, article_no) FROM repaired WHERE chunk_type = 'article')
)
SELECT w.query_id, w.chunk_id, w.pos, md5(CASE WHEN w.chunk_type = 'clause' AND s.source IS NOT NULL AND trim(coalesce(w.penalty_context, '')) <> '' AND NOT starts_with(trim(w.text), trim(w.penalty_context))
  THEN trim(w.penalty_context) || chr(10) || trim(w.text) ELSE w.text END) AS text_md5
FROM repaired w LEFT JOIN still s ON s.query_id = w.query_id AND s.source = w.source AND s.article_no = w.parent_article_no"""


@query("p6_retrieval_contexts", _SQL)
def p6_retrieval_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question from its text to its contexts."""
    questions = fx.asked(spark, sf_dir)
    vectors = fx.table(spark, sf_dir, "embeddings")
    lists = query_table(questions, policies.lists(literal(spark, RULES), "triggers", "requires"), policies.lists(literal(spark, policies.SYNONYMS), "expansions"))
    number = F.pmod(F.col("question_id") * 7 + F.col("query_pos") * 13, F.lit(vectors.count()))
    lists = lists.withColumn("vec_id", number).join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")
    lists = lists.withColumn("query_id", F.col("question_id") * 100 + F.col("query_pos"))
    chunks = stage(fx.all_chunks(spark, sf_dir), "chunks")
    found = rules.intents(questions, policies.intent_frame(spark))
    out = retrieved_contexts(chunks, lists, found, POLICY)
    return out.select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("text_md5"))

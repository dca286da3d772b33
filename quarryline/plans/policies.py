"""Queries of the rule engine over the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import normalized, stripped_negation
from quarryline.operators import rules
from quarryline.plans import fixtures as fx
from quarryline.registry import literal, query
from quarryline.sources import providers

RULES = "(VALUES (0, 'tion', '', 'one'), (1, 'the,und', 'ally,ther', 'two'), (2, 'heit', '', 'three'), (3, 'ing', 'then', 'one')) AS t(pos, triggers, requires, enhancement)"
MORE = "(VALUES (0, 'heit', '', 'three'), (1, 'aux', '', 'four')) AS t(pos, triggers, requires, enhancement)"
INTENTS = "(VALUES (0, 'definition', 'heit,aux', 'z{9}'), (1, 'penalty', 'ting', '[aeiou]{4}'), (2, 'procedure', 'the ', 'x$')) AS t(pos, intent, keywords, patterns)"
WEIGHTS = "(VALUES ('penalty', 0.7), ('procedure', 0.4)) AS t(intent, weight)"
SYNONYMS = "(VALUES (0, 'tion', 'act,deed'), (1, 'ing', 'deed,doing')) AS t(pos, word, expansions)"
SERVICE = "(VALUES (0, 'Hello,Never', ''), (1, 'Hel Lo!', 'greeting'), (2, 'HELP,?,ello', 'what I do')) AS t(pos, keywords, reply)"
EXCLUDED = ["No Hello", "!"]
#: Short questions made of documents, for both engines.
SHORT = "CASE doc_id % 6 WHEN 0 THEN 'Hello, ' || source || '?' WHEN 1 THEN 'HELP ' || lang || '!' WHEN 2 THEN 'no hello ' || source WHEN 3 THEN substr(text, 1, 15) WHEN 4 THEN 'hello ' || substr(text, 1, 40) ELSE '  ' END"
_HAS = "len(list_filter(string_split({words}, ','), lambda w: contains({text}, w))) > 0"


def lists(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.filter(F.split(c, ","), lambda x: x != "") for c in columns})


def rule_frame(spark: SparkSession, values: str = RULES) -> DataFrame:
    return lists(literal(spark, values), "triggers", "requires")


def intent_frame(spark: SparkSession) -> DataFrame:
    return literal(spark, INTENTS).withColumns({"keywords": F.split("keywords", ","), "patterns": F.array("patterns")})


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_MATCH = f"""matched AS (
  SELECT b.item_id AS query_id, r.enhancement, min(r.pos) AS pos FROM benchmark b JOIN {RULES.replace(' AS t(', ' AS r(')}
  ON {_HAS.format(words='r.triggers', text='b.text')} AND (r.requires = '' OR {_HAS.format(words='r.requires', text='b.text')}) GROUP BY b.item_id, r.enhancement
)"""


@query("j10_rule_expansion", f"WITH {_MATCH} SELECT query_id, enhancement, pos FROM matched")
def rule_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    return rules.matching_rules(asked(spark, sf_dir), rule_frame(spark)).select("query_id", "enhancement", "pos")


_INTENT = f"""intents AS (
  SELECT b.item_id AS query_id, r.pos, r.intent FROM benchmark b JOIN {INTENTS.replace(' AS t(', ' AS r(')}
  ON {_HAS.format(words='r.keywords', text='b.text')} OR regexp_matches(b.text, r.patterns)
)"""


@query("c19_intents", f"WITH {_INTENT} SELECT * FROM intents")
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C19."""
    return rules.intents(asked(spark, sf_dir), intent_frame(spark))


@query("c16_bm25_weight", f"""WITH {_INTENT} SELECT b.item_id AS query_id, coalesce((SELECT arg_min(CAST(w.weight AS DOUBLE), i.pos) FROM intents i JOIN {WEIGHTS.replace(' AS t(', ' AS w(')} USING (intent) WHERE i.query_id = b.item_id), 0.5) AS weight FROM benchmark b""")
def bm25_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first intent that has a weight."""
    q = asked(spark, sf_dir)
    weights = literal(spark, WEIGHTS).withColumn("weight", F.col("weight").cast("double"))
    return rules.bm25_weight(q, rules.intents(q, intent_frame(spark)), weights)


@query("j11_synonyms", f"""SELECT query_id, synonym, min(pos * 10 + i) AS place FROM (
  SELECT b.item_id AS query_id, s.pos, unnest(string_split(s.expansions, ',')) AS synonym, generate_subscripts(string_split(s.expansions, ','), 1) - 1 AS i
  FROM benchmark b JOIN {SYNONYMS.replace(' AS t(', ' AS s(')} ON contains(b.text, s.word)) GROUP BY query_id, synonym""")  # fmt: skip
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    found = rules.synonyms(asked(spark, sf_dir), lists(literal(spark, SYNONYMS), "expansions"))
    return found.select("query_id", "synonym", (F.col("pos.pos") * 10 + F.col("pos.i")).cast("long").alias("place"))


@query("u6_merged_rules", f"""SELECT row_number() OVER (ORDER BY min(k), enhancement) - 1 AS pos, triggers, requires, enhancement FROM (
  SELECT pos AS k, triggers, requires, enhancement FROM {RULES} UNION ALL SELECT 1000 + pos, triggers, requires, enhancement FROM {MORE}) GROUP BY triggers, requires, enhancement""")  # fmt: skip
def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6."""
    out = rules.merged_rules(rule_frame(spark), rule_frame(spark, MORE))
    return out.select(F.col("pos").cast("long").alias("pos"), F.array_join("triggers", ",").alias("triggers"), F.array_join("requires", ",").alias("requires"), "enhancement")


@query("u5_query_lists", f"""WITH {_MATCH}, all_texts AS (
  SELECT item_id AS question_id, 0 AS k, 0 AS pos, text FROM benchmark UNION ALL SELECT query_id, 1, pos, enhancement FROM matched
) SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY min(k * 100 + pos), text) - 1 AS pos, text FROM all_texts GROUP BY question_id, text""")  # fmt: skip
def query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewriter's offline default gives none."""
    q = asked(spark, sf_dir)
    questions = q.select(F.col("query_id").alias("question_id"), F.lit(0).alias("pos"), "text")
    expansions = rules.matching_rules(q, rule_frame(spark)).select(F.col("query_id").alias("question_id"), "pos", F.col("enhancement").alias("text"))
    return rules.query_lists(questions, expansions, providers.no_rewrites(questions)).withColumn("pos", F.col("pos").cast("long"))


@query("f3_context_gate", f"""WITH {fx.CHUNKS} SELECT b.item_id AS query_id, c.chunk_id FROM benchmark b CROSS JOIN chunks c
WHERE NOT (c.chunk_type = 'clause' AND NOT (contains(b.text, 'then') OR contains(b.text, 'ally')) AND (contains(c.text, 'license') OR contains(c.text, 'heit')))""")  # fmt: skip
def context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every chunk for every question of the stated set."""
    return rules.gated_pairs(fx.chunks(spark, sf_dir), asked(spark, sf_dir), fx.GATES)


@query("f1_scope_filter", f"WITH {fx.CHUNKS} SELECT chunk_id, article_no FROM chunks WHERE source = 'src3' AND chunk_type = 'article'")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, U4, S8."""
    return rules.scoped(fx.chunks(spark, sf_dir), source="src3").filter("chunk_type = 'article'").select("chunk_id", "article_no")


@query("f7_trivial_query", r"""WITH q AS (SELECT doc_id, lower(trim(CASE doc_id % 3 WHEN 0 THEN substr(text, 1, (doc_id % 8)::INTEGER) WHEN 1 THEN doc_id || '.' || (doc_id % 7) ELSE '?!' || substr(text, 1, (doc_id % 5)::INTEGER) END)) AS t FROM documents)
SELECT doc_id, length(t) <= 1 OR regexp_matches(t, '^[\d.]+$') OR regexp_matches(t, '^[^\p{L}\p{N}]+$') OR t IN ('enthe', 'ander') OR (length(t) <= 4 AND NOT contains(t, 'the')) AS is_trivial FROM q""")  # fmt: skip
def trivial_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """heads of documents, numbers and signs as questions."""
    k = F.col("doc_id") % 3
    head = lambda n: F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % n).cast("int"))
    text = F.when(k == 0, head(8)).when(k == 1, F.concat("doc_id", F.lit("."), F.col("doc_id") % 7)).otherwise(F.concat(F.lit("?!"), head(5)))
    return fx.table(spark, sf_dir, "documents").select("doc_id", rules.trivial(text, ["enthe", "ander"], ["the"]).alias("is_trivial"))


_PLAIN = "regexp_replace(lower({}), '[\\s　，。！？、,.!?;；:：()（）]+', '', 'g')"


@query("f8_public_service", f"""WITH asked AS (SELECT query_id, {_PLAIN.format('text')} AS t FROM (SELECT doc_id AS query_id, {SHORT} AS text FROM documents)), words AS (
  SELECT pos, reply, {_PLAIN.format('unnest(string_split(keywords, chr(44)))')} AS word FROM {SERVICE} WHERE reply <> ''
), hit AS (
  SELECT query_id, pos, reply FROM asked JOIN words ON word <> '' AND contains(t, word) WHERE length(t) BETWEEN 1 AND 15
  AND NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{w}')" for w in EXCLUDED)}) AS x(w) WHERE {_PLAIN.format('w')} <> '' AND contains(t, {_PLAIN.format('w')}))
) SELECT query_id, arg_min(reply, pos) AS reply FROM hit GROUP BY query_id""")  # fmt: skip
def public_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule order decides; a long text and one with an excluded word get none; words are normalized like
    questions, and empty ones and rules without a reply don't count."""
    asked = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.expr(SHORT).alias("text"))
    return rules.service_reply(asked, lists(literal(spark, SERVICE), "keywords"), EXCLUDED)


@query("f9_about_conversation", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?:the|der).*(?:ing|ung)')")
def about_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as questions, with words that they have."""
    return fx.table(spark, sf_dir, "documents").filter(rules.about_conversation(F.col("text"), ["the", "der"], ["ing", "ung"])).select("doc_id")


@query("c20_negation", r"SELECT doc_id, 'x' || regexp_replace(substr(text, 1, 60), ' \s*', '', 'g') AS plain FROM documents")
def negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: the heads of documents with a mark of negation before each blank."""
    text = F.concat(F.lit("没有 x"), F.replace(F.substring("text", 1, 60), F.lit(" "), F.lit("未 ")))
    return fx.table(spark, sf_dir, "documents").select("doc_id", stripped_negation(text, ["没", "未", "没有", "不"]).alias("plain"))


@query("c23_normalized", f"SELECT item_id AS query_id, {_PLAIN.format('text')} AS plain FROM benchmark")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C23."""
    return asked(spark, sf_dir).select("query_id", normalized(F.col("text")).alias("plain"))


@query("j12_domains", """SELECT DISTINCT doc_id // 100 AS query_id, pos, domain FROM documents JOIN (VALUES (0, 'one', 'src1,src9'), (1, 'two', 'src2')) AS d(pos, domain, keywords)
ON len(list_filter(string_split(keywords, ','), lambda w: contains(source, w))) > 0""")  # fmt: skip
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    contexts = fx.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("query_id"), "source")
    return rules.domains(contexts, lists(literal(spark, "(VALUES (0, 'one', 'src1,src9'), (1, 'two', 'src2')) AS t(pos, domain, keywords)"), "keywords"))


@query("c38_refusal_class", """SELECT b.item_id AS query_id, CASE WHEN b.item_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = 'src' || (b.item_id % 30)) THEN 'out_of_scope'
  WHEN b.item_id % 4 = 0 THEN CASE WHEN b.item_id % 3 = 0 THEN 'no_law' ELSE 'insufficient' END END AS reason FROM benchmark b""")  # fmt: skip
def refusal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C38, J17."""
    q = asked(spark, sf_dir).withColumn("_asked", F.when(F.col("query_id") % 3 > 0, F.concat(F.lit("src"), F.col("query_id") % 30)))
    known = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("_asked")).distinct().withColumn("_known", F.lit(True))
    rows = q.join(known, "_asked", "left")
    return rows.select("query_id", rules.refusal(F.col("_asked"), F.coalesce("_known", F.lit(False)), F.col("query_id") % 4).alias("reason"))

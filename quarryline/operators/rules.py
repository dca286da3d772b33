"""Rule tables against queries and candidates: triggers, intents, synonyms, gates, predicates. Rules are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.text import any_in, normalized
from quarryline.staging import small


def matching_rules(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, pos, enhancement): rules (pos, triggers, requires, enhancement) of which a trigger is in the text
    and, if any are asked for, a required word, too. Equal enhancements of a query keep the first."""
    fits = any_in(F.col("text"), F.col("triggers")) & ((F.size("requires") == 0) | any_in(F.col("text"), F.col("requires")))
    hit = queries.select("query_id", "text").join(small(rules), fits)
    return hit.groupBy("query_id", "enhancement").agg(F.min("pos").alias("pos"))


def intents(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, pos, intent): intents (pos, intent, keywords, patterns) by a keyword or a pattern."""
    asked = queries.select("query_id", "text")
    words = rules.select("pos", "intent", F.explode("keywords").alias("_word")).filter("_word <> ''")
    patterns = rules.select("pos", "intent", F.explode("patterns").alias("_pattern")).filter("_pattern <> ''")
    hit = asked.join(small(words), F.contains("text", "_word")).select("query_id", "pos", "intent")
    met = asked.join(small(patterns), F.regexp_like("text", "_pattern")).select("query_id", "pos", "intent")
    return hit.unionByName(met).distinct()


def bm25_weight(queries: DataFrame, found: DataFrame, weights: DataFrame, default: float = 0.5) -> DataFrame:
    """(query_id, weight): the weight of the first of the query's intents, in policy order, that has one."""
    first = found.join(small(weights), "intent").groupBy("query_id").agg(F.min_by("weight", "pos").alias("weight"))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce("weight", F.lit(default)).alias("weight"))


def synonyms(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, synonym, pos): expansions (pos, word, expansions) of words in the text, each once, in order."""
    hit = queries.select("query_id", "text").join(small(table), F.contains("text", "word"))
    rows = hit.select("query_id", "pos", F.posexplode("expansions").alias("i", "synonym"))
    return rows.groupBy("query_id", "synonym").agg(F.min(F.struct("pos", "i")).alias("pos"))


def merged_rules(*tables: DataFrame) -> DataFrame:
    """Rule lists one after the other; equal rules keep their first place. (pos, triggers, requires, enhancement)."""
    rows = None
    for i, t in enumerate(tables):
        own = t.withColumn("_list", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("triggers", "requires", "enhancement").agg(F.min(F.struct("_list", "pos")).alias("_p"))
    place = F.row_number().over(Window.orderBy("_p", "enhancement")) - 1  # rule lists are config, not data
    return first.select(place.alias("pos"), "triggers", "requires", "enhancement")


def gated(candidates: DataFrame, gates: list[dict]) -> DataFrame:
    """Drops candidates that a gate blocks: a chunk of the gates' types whose text has a blocked word while the
    query has none of the words that the gate requires. A chunk without type counts as a clause, here alone."""
    if not gates:
        return candidates
    kinds = sorted({k for g in gates for k in (g.get("chunk_types") or ["clause"])})
    blocked = F.lit(False)
    for g in gates:
        asked, words = g.get("required_context_keywords") or [], g.get("blocked_text_keywords") or []
        if asked and words:
            in_query = any_in(F.coalesce("query_text", F.lit("")), F.array(*map(F.lit, asked)))
            in_text = any_in(F.coalesce("text", F.lit("")), F.array(*map(F.lit, words)))
            blocked = blocked | (~in_query & in_text)
    return candidates.filter(~(F.coalesce("chunk_type", F.lit("clause")).isin(kinds) & blocked))


def gated_pairs(chunks: DataFrame, queries: DataFrame, gates: list[dict]) -> DataFrame:
    """``gated`` over every chunk for every query: (query_id, chunk_id). Texts are searched once a chunk and once a
    query, not once a pair; the pairs meet with a flag per gate."""
    kinds = sorted({k for g in gates for k in (g.get("chunk_types") or ["clause"])})
    words = [(g["required_context_keywords"], g["blocked_text_keywords"]) for g in gates if g.get("required_context_keywords") and g.get("blocked_text_keywords")]
    flags = lambda text, lists: F.array(*[any_in(F.coalesce(text, F.lit("")), F.array(*map(F.lit, w))) for w in lists]).cast("array<boolean>")
    own = chunks.select("chunk_id", F.coalesce("chunk_type", F.lit("clause")).isin(kinds).alias("_kind"), flags("text", [b for _, b in words]).alias("_has"))
    asked = queries.select("query_id", flags("text", [a for a, _ in words]).alias("_asks"))
    blocked = F.exists(F.arrays_zip("_has", "_asks"), lambda x: x["_has"] & ~x["_asks"])
    return own.crossJoin(small(asked)).filter(~(F.col("_kind") & blocked)).select("query_id", "chunk_id")


def scoped(rows: DataFrame, source: str | None = None, article: str | None = None) -> DataFrame:
    """Equality on what is given; no filter on what is empty."""
    if source:
        rows = rows.filter(F.col("source") == source)
    if article:
        rows = rows.filter(F.col("article_no") == article)
    return rows


def trivial(text: Column, stop_words: list[str], domain: list[str]) -> Column:
    """A query that asks nothing: a character, a number, only signs, a stop word, or up to four characters without
    a domain word."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    short = (F.char_length(t) <= 4) & ~any_in(t, F.array(*map(F.lit, domain or ["\0"])))
    return (F.char_length(t) <= 1) | t.rlike(r"^[\d.]+$") | t.rlike(r"^[^\p{L}\p{N}]+$") | t.isin(stop_words) | short


def service_reply(queries: DataFrame, rules: DataFrame, exclude: list[str], longest: int = 15) -> DataFrame:
    """(query_id, reply): the first rule (pos, keywords, reply) that a short query without excluded words meets.
    Questions, keywords and excluded words are all normalized; empty words and rules without a reply don't count."""
    some = lambda words: F.filter(F.transform(words, normalized), lambda w: w != "")
    none = F.array(*map(F.lit, exclude)) if exclude else F.array().cast("array<string>")
    plain = queries.select("query_id", normalized(F.col("text")).alias("_t"))
    plain = plain.filter((F.char_length("_t") <= longest) & (F.char_length("_t") > 0) & ~any_in(F.col("_t"), some(none)))
    table = rules.filter("coalesce(reply, '') <> ''").select("pos", "reply", some(F.col("keywords")).alias("_words"))
    return plain.join(small(table), any_in(F.col("_t"), F.col("_words"))).groupBy("query_id").agg(F.min_by("reply", "pos").alias("reply"))


def about_conversation(text: Column, times: list[str], verbs: list[str]) -> Column:
    """A word for an earlier time, then one for speaking."""
    return text.rlike(f"(?:{'|'.join(times)}).*(?:{'|'.join(verbs)})")


def domains(contexts: DataFrame, table: DataFrame) -> DataFrame:
    """(query_id, pos, domain): domains (pos, domain, keywords) of which a source of the contexts holds a keyword."""
    hit = contexts.select("query_id", "source").distinct().join(small(table), any_in(F.col("source"), F.col("keywords")))
    return hit.select("query_id", "pos", "domain").distinct()


def query_lists(queries: DataFrame, expansions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(question_id, pos, text): the question, then its expansions, then its rewrites, each text once. All have
    (question_id, pos, text)."""
    parts = [t.select("question_id", "pos", "text", F.lit(i).alias("_k")) for i, t in enumerate((queries, expansions, rewrites))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = rows.groupBy("question_id", "text").agg(F.min(F.struct("_k", "pos")).alias("_p"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("_p", "text")) - 1
    return first.select("question_id", place.alias("pos"), "text")


def refusal(asked: Column, known: Column, hits: Column) -> Column:
    """Why a question gets no answer; null if it gets one."""
    return F.when(asked.isNotNull() & ~known, "out_of_scope").when(hits == 0, F.when(asked.isNull(), "no_law").otherwise("insufficient"))

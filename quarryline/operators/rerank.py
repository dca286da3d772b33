"""Rerank post-processing: roles, score filter, caps, diversity and quotas.

The filter stage is windows alone: role is a function of the section, so "first of its section" and "fewer than the
cap above it in its source" can be counted over the rows that are eligible at all. The diversity swap pairs the
lowest replaceable places with the sources left out, in order. The final quotas, three dependent inserts into a
list of top_n rows, run per query in Python on the rows that can matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.text import any_in

PROTECTED = ("definition", "behavior_penalty")
#: Order of roles when intents are given, and the caps.
PRIORITY = {"definition": 0, "behavior_penalty": 0, "substantive": 1, "procedural": 2}
PROMOTED = {"definition": "definition", "penalty": "behavior_penalty", "procedure": "procedural"}
PER_SOURCE, PENALTIES, TOP_N = 3, 3, 7


def _holds(words: Column):
    return lambda part: any_in(part, words)


def role(section: Column, keywords: dict[str, list[str]]) -> Column:
    """Role by the parts of a section header; roles are tried in the order of ``keywords``, else substantive."""
    parts = F.transform(F.split(F.coalesce(section, F.lit("")), "/"), F.trim)
    out = None
    for name, words in keywords.items():
        listed = F.array(*map(F.lit, words))
        hit = F.exists(parts, _holds(listed))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit("substantive") if out is None else out.otherwise("substantive")


def scored(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Joins a reranker's answer (query_id, index, relevance_score) to candidates (query_id, pos) by place."""
    answer = responses.select("query_id", F.col("index").alias("pos"), F.col("relevance_score").alias("rerank_score"))
    return candidates.join(answer, ["query_id", "pos"])


def kept(rows: DataFrame, min_score: float | None, per_source: int = PER_SOURCE, penalties: int = PENALTIES) -> DataFrame:
    """The rows (query_id, chunk_id, source, section_header, role, rerank_score) that the filters leave, with their
    place. Protected roles pass the score, section and source rules but count for their source; rows without source
    and section pass both rules."""
    protected = F.col("role").isin(*PROTECTED)
    bare = (F.coalesce("source", F.lit("")) == "") & (F.coalesce("section_header", F.lit("")) == "")
    order = [F.col("rerank_score").desc(), F.col("chunk_id")]
    passes = protected | (F.lit(True) if min_score is None else F.col("rerank_score") >= min_score)
    rows = rows.filter(passes).withColumns({"_source": F.coalesce("source", F.lit("")), "_section": F.coalesce("section_header", F.lit(""))})
    by_role = Window.partitionBy("query_id", "role").orderBy(*order)
    rows = rows.withColumn("_role_rank", F.row_number().over(by_role)).filter((F.col("role") != "behavior_penalty") | (F.col("_role_rank") <= penalties))
    by_section = Window.partitionBy("query_id", "_source", "_section").orderBy(*order)
    rows = rows.withColumn("_first", F.row_number().over(by_section) == 1)
    rows = rows.withColumn("_eligible", protected | F.col("_first") | bare)
    above = Window.partitionBy("query_id", "_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_above", F.coalesce(F.sum(F.col("_eligible").cast("int")).over(above), F.lit(0)))
    rows = rows.filter(F.col("_eligible") & (protected | bare | (F.col("_above") < per_source)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1
    return rows.withColumn("pos", place).drop("_source", "_section", "_role_rank", "_first", "_eligible", "_above")


def diverse(rows: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Swaps, from the end of the first top_n, unprotected rows of sources that have more rows for the best row of
    each source that has none. Places (pos) change hands."""
    protected = F.col("role").isin(*PROTECTED)
    head, tail = rows.filter(F.col("pos") < top_n), rows.filter(F.col("pos") >= top_n)
    source = F.coalesce("source", F.lit(""))
    own = Window.partitionBy("query_id", source)
    slots = head.withColumn("_n", F.count("*").over(own)).filter(~protected)
    # A source gives up its lowest unprotected rows, but keeps one row.
    slots = slots.withColumn("_from_end", F.row_number().over(own.orderBy(F.col("pos").desc()))).filter(F.col("_from_end") <= F.col("_n") - 1)
    slots = slots.select("query_id", F.col("pos").alias("slot"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("pos").desc())).alias("_k"))
    there = head.select("query_id", source.alias("_s")).distinct()
    new = tail.withColumn("_s", source).join(there, ["query_id", "_s"], "left_anti")
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_s").orderBy("pos"))).filter("_r = 1")
    new = new.select("query_id", F.col("pos").alias("newcomer"), F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("_k"))
    swaps = slots.join(new, ["query_id", "_k"]).select("query_id", "slot", "newcomer")
    both = swaps.select("query_id", F.col("slot").alias("pos"), F.col("newcomer").alias("_to")).unionByName(swaps.select("query_id", F.col("newcomer").alias("pos"), F.col("slot").alias("_to")))
    return rows.join(both, ["query_id", "pos"], "left").withColumn("pos", F.coalesce("_to", "pos")).drop("_to")


def _has(flag: str) -> Callable[[Column], Column]:
    return lambda c: c[flag]


def with_quotas(rows: DataFrame, everything: DataFrame, queries: DataFrame, concepts: list[str], kind_word: str, top_n: int = TOP_N) -> DataFrame:
    """(query_id, pos, chunk_id): the head of each query's list after three quotas in turn: a protected row; where the
    query has concept words, a protected row of the kind word that names one, and a penalty row that does. What is
    missing comes from the list beyond the head, else from all scored rows, best first, and takes the place of the last
    unprotected row, else an open place, else the last.

    A query's head and its protected candidates, a few rows by their caps, are two arrays; each quota is an expression
    on them, so the rows meet in one shuffle."""
    protected = F.col("role").isin(*PROTECTED)
    words = F.filter(F.array(*map(F.lit, concepts)), lambda w: F.contains("_asked", w)) if concepts else F.array().cast("array<string>")
    asked = queries.select("query_id", F.col("text").alias("_asked")).withColumn("_words", words).select("query_id", "_words")
    text, penalty = F.coalesce("text", F.lit("")), F.coalesce("penalty_context", F.lit(""))
    named = any_in(text, F.col("_words"))
    flags = [
        protected.alias("q1"),
        (protected & F.contains(text, F.lit(kind_word)) & named).alias("q2"),
        ((F.col("role") == "behavior_penalty") & (named | any_in(penalty, F.col("_words")))).alias("q3"),
    ]
    head = F.when(F.col("_part") == 0, F.struct(F.col("pos").cast("int").alias("pos"), "chunk_id", *flags))
    spare = F.when((F.col("_part") > 0) & protected, F.struct("_part", (-F.col("rerank_score")).alias("_s"), "chunk_id", *flags))
    columns = ["query_id", "chunk_id", "role", "text", "penalty_context", "rerank_score"]
    listed = rows.select(*columns, "pos", F.when(F.col("pos") < top_n, 0).otherwise(1).alias("_part"))
    both = listed.unionByName(everything.filter(protected).select(*columns, F.lit(0).alias("pos"), F.lit(2).alias("_part")))
    lists = both.join(asked, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(head)).alias("_head"), F.array_sort(F.collect_list(spare)).alias("_spare"), F.max(F.size("_words")).alias("_n"))
    for flag, asks in (("q1", F.lit(True)), ("q2", F.col("_n") > 0), ("q3", F.col("_n") > 0)):
        there = F.transform("_head", lambda c: c["chunk_id"])
        named_by = F.filter("_spare", _has(flag))
        fits = F.filter(named_by, lambda c: (c["_part"] == 1) | ~F.array_contains(F.col("_there"), c["chunk_id"]))
        lists = lists.withColumn("_there", there).withColumn("_fits", fits)
        plain = F.array_max(F.transform(F.filter("_head", lambda c: ~c["q1"]), lambda c: c["pos"]))
        size = F.size("_head")
        lists = lists.withColumn("_place", F.coalesce(plain, F.when(size < top_n, size).otherwise(size - 1)))
        best = F.get("_fits", F.lit(0))
        new = F.struct(F.col("_place").alias("pos"), best["chunk_id"].alias("chunk_id"), *[best[q].alias(q) for q in ("q1", "q2", "q3")])
        kept = F.filter("_head", lambda c: c["pos"] != F.col("_place"))
        open_ = asks & ~F.exists("_head", _has(flag)) & (F.size("_fits") > 0)
        lists = lists.withColumn("_head", F.when(open_, F.array_sort(F.concat(kept, F.array(new)))).otherwise(F.col("_head")))
    out = lists.select("query_id", F.explode("_head").alias("c"))
    return out.select("query_id", F.col("c.pos").alias("pos"), F.col("c.chunk_id").alias("chunk_id"))


def role_order(contexts: DataFrame, intents: list[str]) -> DataFrame:
    """Places by role, promoted by intents, then by score; unchanged without intents."""
    if not intents:
        return contexts
    order = PRIORITY | {PROMOTED[i]: -1 for i in intents if i in PROMOTED}
    value = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])[F.col("role")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(value, F.col("rerank_score").desc(), "pos")) - 1
    return contexts.withColumn("pos", place)


def role_order_by(contexts: DataFrame, intents: DataFrame) -> DataFrame:
    """The same where each query has intents (query_id, intent) of its own."""
    found = intents.groupBy("query_id").agg(F.collect_set("intent").alias("_intents"))
    roles = F.create_map(*[F.lit(x) for pair in PROMOTED.items() for x in pair])
    order = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    rows = contexts.join(found, "query_id", "left")
    promoted = F.array_contains(F.transform("_intents", lambda i: roles[i]), F.col("role"))
    value = F.when(promoted, -1).otherwise(order[F.col("role")])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(value, F.col("rerank_score").desc(), "pos")) - 1
    return rows.withColumn("pos", F.when(F.col("_intents").isNull(), F.col("pos")).otherwise(place)).drop("_intents")


def penalty_signal(row_role: Column, text: Column, context: Column, concepts: Column, wide: str, markers: list[str]) -> Column:
    """Whether a row may be recalled as protected: a penalty row must hold one of the query's concept words, if it
    has any, in its text or its context; the wide word stands for any marker."""
    both = F.concat_ws(" ", text, F.coalesce(context, F.lit("")))
    marked = any_in(both, F.array(*map(F.lit, markers)))
    named = F.exists(concepts, lambda w: F.when(w == wide, marked).otherwise(F.contains(both, w)))
    return (row_role != "behavior_penalty") | (F.size(concepts) == 0) | named

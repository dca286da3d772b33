"""Contexts after the rerank: expansion guarantee, parents, penalty prefixes; hierarchy and citations of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.text import stripped
from quarryline.staging import small

DECAY = 0.95


def ensured(contexts: DataFrame, candidates: DataFrame, bm25: DataFrame, top: int = 3, quota: int = 5, least: float = 10.0) -> DataFrame:
    """(query_id, chunk_id, pos): the contexts and, behind them, up to ``quota`` candidates that are among the best
    ``top`` of an expansion by BM25 (query_id, expansion, chunk_id, bm25) with at least ``least``."""
    best = Window.partitionBy("query_id", "expansion").orderBy(F.round("bm25", 9).desc(), "chunk_id")
    heads = bm25.withColumn("_r", F.row_number().over(best)).filter((F.col("_r") <= top) & (F.col("bm25") >= least))
    first = heads.groupBy("query_id", "chunk_id").agg(F.min(F.struct("expansion", "_r")).alias("_at"))
    first = first.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").join(contexts.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "chunk_id"))).filter(F.col("_k") <= quota)
    last = contexts.groupBy("query_id").agg(F.max("pos").alias("_last"))
    added = first.join(last, "query_id", "left").select("query_id", "chunk_id", (F.coalesce("_last", F.lit(-1)) + F.col("_k")).alias("pos"))
    return contexts.select("query_id", "chunk_id", "pos").unionByName(added)


def missing_parents(contexts: DataFrame) -> DataFrame:
    """(query_id, source, article_no) of parents that clauses among the contexts name and the contexts lack."""
    there = contexts.filter("chunk_type = 'article'").select("query_id", "source", "article_no")
    named = contexts.filter("chunk_type = 'clause' AND coalesce(parent_article_no, '') <> '' AND coalesce(source, '') <> ''")
    needed = named.select("query_id", "source", F.col("parent_article_no").alias("article_no")).distinct()
    return needed.join(there, ["query_id", "source", "article_no"], "left_anti")


def with_parents(contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The contexts and the parents they lack, where a candidate has them (one for each, the first)."""
    found = candidates.filter("chunk_type = 'article'").join(missing_parents(contexts), ["query_id", "source", "article_no"], "left_semi")
    found = found.join(contexts.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "source", "article_no").orderBy("pos"))).filter("_r = 1").drop("_r")
    last = contexts.groupBy("query_id").agg(F.max("pos").alias("_last"))
    found = found.join(last, "query_id").withColumn("pos", F.col("_last") + F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).drop("_last")
    return contexts.unionByName(found.select(*contexts.columns))


def with_penalties(contexts: DataFrame) -> DataFrame:
    """Clauses whose parent is missing get their penalty context in front, unless it already stands there."""
    lack = missing_parents(contexts).select("query_id", "source", F.col("article_no").alias("parent_article_no"), F.lit(True).alias("_lack"))
    context, text = F.trim(F.coalesce("penalty_context", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    add = F.coalesce("_lack", F.lit(False)) & (F.col("chunk_type") == "clause") & (context != "") & ~text.startswith(context)
    rows = contexts.join(lack, ["query_id", "source", "parent_article_no"], "left")
    return rows.withColumn("text", F.when(add, F.concat(context, F.lit("\n"), text)).otherwise(F.col("text"))).drop("_lack").select(*contexts.columns)


def hierarchy(hits: DataFrame, chunks: DataFrame, quota: int = 8) -> DataFrame:
    """(question_id, chunk_id, score) of clauses of articles that are hit and of the articles of clauses that are,
    if not hit themselves; score decays, the best hits' relations come first. hits: question_id, chunk_id, score."""
    own = chunks.select("chunk_id", "source", "article_no", "parent_article_no", "chunk_type")
    known = hits.join(own, "chunk_id")
    below = own.filter("chunk_type = 'clause'").select(F.col("chunk_id").alias("other"), "source", F.col("parent_article_no").alias("article_no"))
    above = own.filter("chunk_type = 'article'").groupBy("source", "article_no").agg(F.max("chunk_id").alias("other"))  # of equal parents the last
    down = known.filter("chunk_type = 'article'").select("question_id", "score", "source", "article_no").join(below, ["source", "article_no"])
    up = known.filter("chunk_type = 'clause'").select("question_id", "score", "source", F.col("parent_article_no").alias("article_no")).join(above, ["source", "article_no"])
    rows = down.select("question_id", "other", "score").unionByName(up.select("question_id", "other", "score"))
    rows = rows.groupBy("question_id", F.col("other").alias("chunk_id")).agg((F.max("score") * DECAY).alias("score"))
    rows = rows.join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    best = Window.partitionBy("question_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return rows.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= quota).drop("_r")


#: Words that introduce a citation, and the numerals in article numbers.
CITES = "(?:依照|按照|依据|根据)"
ARTICLE = "第[零一二三四五六七八九十百千]+条"
SAME_LAW = f"{CITES}本(?:法|条例|规定|办法)({ARTICLE})"
CROSS_LAW = f"{CITES}[《<]([^》>]+)[》>]({ARTICLE})"
STATE_PREFIX = "中华人民共和国"


def citations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, at, article_no, named): the article that a chunk's text cites first of its own law or, if it
    cites none, those of the laws that it names, in order."""
    own = F.regexp_extract("text", SAME_LAW, 1)
    laws, numbers = (F.regexp_extract_all("text", F.lit(CROSS_LAW), F.lit(i)) for i in (1, 2))
    pair = "array<struct<named:string,article_no:string>>"
    cited = F.when(own != "", F.array(F.struct(F.lit(None).cast("string").alias("named"), own.alias("article_no"))).cast(pair))
    cited = cited.otherwise(F.arrays_zip(laws.alias("named"), numbers.alias("article_no")).cast(pair))
    rows = chunks.select("chunk_id", "source", F.posexplode(cited).alias("at", "_c"))
    return rows.select("chunk_id", "source", "at", "_c.article_no", "_c.named")


def resolved(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds target: the source that ``named`` means (its own source if null): by name, by name without the state's,
    or by containment either way, in this order. Names meet whole and short names by equality; only those that are
    left are searched for in the others. Of a chunk's citations the first whose name means a source stays; a chunk
    whose names mean none has no row."""
    laws = sources.filter("coalesce(source, '') <> ''").select(F.col("source").alias("target")).distinct()
    laws = laws.withColumn("short", F.replace("target", F.lit(STATE_PREFIX), F.lit("")))
    own = cited.filter("named IS NULL").withColumn("target", F.col("source"))
    names = cited.filter("named IS NOT NULL").select("named").distinct()
    whole = names.join(laws.select(F.col("target").alias("named"), "target"), "named").withColumn("_step", F.lit(0))
    short = laws.filter("short <> '' AND short <> target").select(F.col("short").alias("named"), "target")
    equal = whole.unionByName(names.join(short, "named").withColumn("_step", F.lit(1)))
    left = names.join(equal.select("named").distinct(), "named", "left_anti")
    inside = left.join(small(laws), F.contains("target", "named") | F.contains("named", "short")).select("named", "target", F.lit(2).alias("_step"))
    best = equal.unionByName(inside).groupBy("named").agg(F.min(F.struct("_step", "target")).alias("_b")).select("named", F.col("_b.target").alias("target"))
    found = own.unionByName(cited.filter("named IS NOT NULL").join(best, "named").select(*cited.columns, "target"))
    first = Window.partitionBy("chunk_id").orderBy("at")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "at")


def cited_chunks(hits: DataFrame, chunks: DataFrame, quota: int = 3) -> DataFrame:
    """(question_id, chunk_id, cited_by): articles that hit chunks cite and that aren't hit themselves, the citations
    of the best hits first. hits: question_id, chunk_id, pos."""
    cited = citations(chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    links = resolved(cited, chunks)
    targets = chunks.groupBy(F.col("source").alias("target"), "article_no").agg(F.min("chunk_id").alias("found"))
    rows = hits.join(links, "chunk_id").join(targets, ["target", "article_no"])
    rows = rows.select("question_id", F.col("found").alias("chunk_id"), F.col("chunk_id").alias("cited_by"), "pos")
    rows = rows.join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    rows = rows.groupBy("question_id", "chunk_id").agg(F.min(F.struct("pos", "cited_by")).alias("_f"))
    w = Window.partitionBy("question_id").orderBy("_f", "chunk_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= quota).select("question_id", "chunk_id", F.col("_f.cited_by").alias("cited_by"))


def audit(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, cited, article_no, problem): citations in answers that the contexts (query_id, source, article_no)
    don't bear out: a law they lack (names match by containment either way), or an article of it."""
    numeral = r"[一二三四五六七八九十百千零\d]+"
    pattern = rf"《([^》]+)》\s*第\s*({numeral})\s*条"
    pair = F.arrays_zip(F.regexp_extract_all("answer", F.lit(pattern), F.lit(1)).alias("law"), F.regexp_extract_all("answer", F.lit(pattern), F.lit(2)).alias("number"))
    cited = answers.select("query_id", F.explode(pair).alias("c")).select("query_id", F.trim("c.law").alias("cited"), F.concat(F.lit("第"), F.col("c.number"), F.lit("条")).alias("article_no")).distinct()
    allowed = contexts.select("query_id", "source", F.col("article_no").alias("has")).distinct()
    both = cited.join(allowed, "query_id", "left").withColumn("_law", F.contains("source", "cited") | F.contains("cited", "source"))
    found = both.groupBy("query_id", "cited", "article_no").agg(F.coalesce(F.max("_law"), F.lit(False)).alias("law"), F.coalesce(F.max(F.col("_law") & (F.col("has") == F.col("article_no"))), F.lit(False)).alias("article"))
    problem = F.when(~F.col("law"), "unknown law").when(~F.col("article"), "article not in the contexts")
    return found.withColumn("problem", problem).filter("problem IS NOT NULL").select("query_id", "cited", "article_no", "problem")


def merged_references(contexts: DataFrame, clause_order: Column, label: Column) -> DataFrame:
    """One row per (query_id, source, article): texts of several clauses in the order of their numbers, each under
    its label; ids in the order of the contexts; groups in the order of first sight (pos)."""
    item = F.struct(clause_order.alias("n"), F.col("pos").alias("pos"), stripped(F.concat(F.when(label != "", F.concat(F.lit("（"), label, F.lit("）"))).otherwise(""), F.lit("\n"), F.col("text"))).alias("labelled"), F.col("text").alias("text"))
    rows = contexts.groupBy("query_id", "source", "parent_article_no").agg(
        F.min("pos").alias("first_pos"), F.min_by("section_header", "pos").alias("section_header"), F.array_sort(F.collect_list(item)).alias("_items"),
        F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("_ids"),
    )
    text = F.when(F.size("_items") == 1, F.col("_items")[0]["text"]).otherwise(F.array_join(F.transform("_items", lambda i: i["labelled"]), "\n\n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first_pos")) - 1
    return rows.select("query_id", place.alias("place"), "source", F.col("parent_article_no").alias("article_no"), "section_header", text.alias("text"), F.transform("_ids", lambda i: i["chunk_id"]).alias("merged_from"))


def prompt_blocks(contexts: DataFrame) -> DataFrame:
    """(query_id, prompt, n_sources): contexts grouped by source in the order of first sight, and a note where they
    come from several."""
    block = F.concat(F.lit("["), F.col("article_no"), F.lit("] "), F.col("text"))
    groups = contexts.groupBy("query_id", "source").agg(F.min("pos").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), block.alias("b")))), lambda i: i["b"]), "\n").alias("_body"))
    whole = groups.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.array_sort(F.collect_list(F.struct("_first", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("_body")).alias("b")))).alias("_all"))
    hint = F.when(F.col("n_sources") > 1, "\n\n(several sources)").otherwise("")
    return whole.select("query_id", F.concat(F.array_join(F.transform("_all", lambda i: i["b"]), "\n\n"), hint).alias("prompt"), "n_sources")

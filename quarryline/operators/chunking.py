"""Statute paragraphs to articles and clauses; texts to chunks of a target length.

A document's paragraphs are one window partition, ordered by place, of their marks alone: no text goes through a window,
and texts are dealt out by paragraph and by article, so a document may be as large as the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.text import NUMBER_CLASS, clean_title, stripped
from quarryline.staging import parts, stage

N = f"[{NUMBER_CLASS}]+"
CHAPTER = rf"^第({N})章\s*(.*)$"
SECTION = rf"^第({N})节\s*(.*)$"
ARTICLE = rf"^第({N})条(之{N})?"
#: The numerals of clauses and the three marks that start one at the head of a line.
M = "[一二三四五六七八九十百千万]+"
MARK = rf"^(?:（({M})）|\(({M})\)|({M})、)"
CLAUSE = rf"(?dm)(?={MARK})"
#: Paragraphs that a task takes.
SHARE = 20_000


def articles(paragraphs: DataFrame) -> DataFrame:
    """(doc, ordinal, article_no, section_header, text) of paragraphs (doc, pos, text). Chapters and sections fill
    forward and a chapter ends its predecessor's section. A table of contents leaves no trace: its lines stand before
    the first article, and of its headings none outlives the body's own."""
    rows = paragraphs.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    w = Window.partitionBy("doc").orderBy("pos", "_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    article = F.col("text").rlike(ARTICLE)
    mark = lambda p, unit: F.when(F.col("text").rlike(p), F.concat(F.lit("第"), F.regexp_extract("text", p, 1), F.lit(unit + " "), clean_title(F.regexp_extract("text", p, 2))))
    piece = F.when(article, stripped(F.regexp_replace("text", ARTICLE, ""))).otherwise(F.col("text"))
    number = F.when(article, F.concat(F.lit("第"), F.regexp_extract("text", ARTICLE, 1), F.lit("条"), F.regexp_extract("text", ARTICLE, 2)))
    rows = rows.select("doc", "pos", F.monotonically_increasing_id().alias("_id"), mark(CHAPTER, "章").alias("_chapter"), mark(SECTION, "节").alias("_section"), article.alias("_article"), number.alias("_no"), F.nullif(piece, F.lit("")).alias("_piece"))
    rows = stage(rows, "paragraphs")
    marks = rows.select("doc", "pos", "_id", "_chapter", "_section", "_article")
    marks = marks.withColumns({"_chapters": F.count("_chapter").over(upto), "_heading": F.col("_chapter").isNotNull() | F.col("_section").isNotNull()})
    marks = marks.withColumn("_chapter", F.last("_chapter", True).over(upto))
    inside = Window.partitionBy("doc", "_chapters").orderBy("pos", "_id").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_section", F.last("_section", True).over(inside))
    # A heading closes the article before it: text after one belongs to no article until the next begins.
    marks = marks.withColumn("ordinal", F.sum((F.col("_article") | F.col("_heading")).cast("int")).over(upto))
    marks = marks.withColumn("_open", F.max("_article").over(Window.partitionBy("doc", "ordinal"))).filter(F.col("_open") & ~F.col("_heading"))
    header = F.when(F.col("_chapter").isNull(), "").otherwise(F.concat_ws(" / ", "_chapter", "_section"))
    n = parts(rows.sparkSession, rows.count(), SHARE)
    placed = marks.select("_id", "ordinal", header.alias("_header")).repartition(n, "_id")
    texts = rows.select("_id", "doc", "pos", "_no", "_piece").repartition(n, "_id").join(placed, "_id")
    out = texts.repartition(n, "doc", "ordinal").groupBy("doc", "ordinal").agg(
        F.max("_no").alias("article_no"), F.min_by("_header", F.struct("pos", "_id")).alias("section_header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_id", "_piece"))), lambda p: p["_piece"]), "\n").alias("text"),
    )
    return out.filter("text <> ''")


def clauses(rows: DataFrame) -> DataFrame:
    """The articles (article_no, text, others) and, of those with two marks or more, their clauses as well: adds
    chunk_type, parent_article_no and penalty_context, the text before the first mark. A clause's number is the
    mark's own."""
    parts = F.split("text", CLAUSE)
    starts = F.filter(parts, lambda p: p.rlike(MARK))
    marked = rows.withColumns({"_starts": starts, "_prefix": F.when(parts[0].rlike(MARK), "").otherwise(stripped(parts[0]))})
    whole = marked.withColumns({"chunk_type": F.lit("article"), "parent_article_no": F.col("article_no"), "penalty_context": F.lit(""), "clause_pos": F.lit(0)})
    split = marked.filter(F.size("_starts") >= 2).select(*marked.columns, F.posexplode("_starts").alias("_i", "_clause"))
    label = F.concat(*[F.regexp_extract("_clause", MARK, i) for i in (1, 2, 3)])
    split = split.withColumns({"parent_article_no": F.col("article_no"), "clause_pos": F.col("_i") + 1, "penalty_context": F.col("_prefix"), "chunk_type": F.lit("clause")})
    split = split.withColumns({"article_no": F.concat("article_no", F.lit("第"), label, F.lit("款")), "text": stripped(F.col("_clause"))}).filter("text <> ''")
    names = [c for c in whole.columns if not c.startswith("_")]
    return whole.select(*names).unionByName(split.select(*names))


def _packed(pieces: Column, target: int, joint: str) -> Column:
    """Greedy runs of an array of strings, joined while a run and the next piece stay under the target."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, p: Column) -> Column:
        grown = F.concat_ws(joint, s["open"], p)
        fits = F.coalesce(F.char_length(s["open"]), F.lit(0)) + F.char_length(p) < target
        closed = F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(F.when(fits, s["done"]).otherwise(closed).alias("done"), F.when(fits, grown).otherwise(p).alias("open"))

    return F.aggregate(pieces, state, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


#: Fixed value: the marks that end a sentence.
ENDS = "。！？；"


def _sentences(text: Column, target: int) -> Column:
    """Sentences with their ends; an end behind a sentence of ``target`` characters or more stands alone."""
    whole = F.filter(F.split(text, rf"(?<=[{ENDS}])"), lambda s: s != "")
    long = lambda s: (F.char_length(s) > target) & s.rlike(rf"[{ENDS}]\z")
    cut = lambda s: F.array(F.substring(s, F.lit(1), F.char_length(s) - 1), F.right(s, F.lit(1)))
    return F.flatten(F.transform(whole, lambda s: F.when(long(s), cut(s)).otherwise(F.array(s))))


def upload_chunks(text: Column, target: int = 400, longest: int = 600) -> Column:
    """Paragraphs, those over ``longest`` cut at sentence ends, packed up to the target; what still is too long is
    cut at sentence ends again."""
    paragraphs = F.filter(F.transform(F.split(text, "\n"), stripped), lambda p: p != "")
    cut = lambda p: F.when(F.char_length(p) > longest, _sentences(p, target)).otherwise(F.array(p))
    return F.flatten(F.transform(_packed(F.flatten(F.transform(paragraphs, cut)), target, "\n"), cut))

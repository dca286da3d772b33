"""Lines of PDF pages to headed articles: reading order, contents pages, repeated headers, outline levels.

Lines come as (doc, page, line, x0, y0, x1, y1, text) from any extractor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.text import clean_title, dot_leader, glyphs, has_leader, level, stripped, table_text

#: Thresholds of the layout rules.
LEADER_LINES, REPEATED_PAGES, SHORT_LINE, FOOT, ROW_GAP = 3, 3, 30, 70.0, 5.0
#: A chapter's line, a clause's, a fragment of a clause's number and the leaf that ends such a number.
CHAPTER = r"^(\d{1,3})\s+(\S.*)$"
NUMBERED = r"^(\d+(?:\.\d+)+)\s*(.*)$"
FRAGMENT = r"^(\d+)\.$"
LEAF = r"^(\d+)(.*)$"
PAGE_NUMBER = r"^[0-9ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]{1,3}$"
REFERENCES = "参考文献"


def contents_pages(lines: DataFrame) -> DataFrame:
    """(doc, page): pages with three lines or more that hold leader dots, if these are half of the page's lines."""
    leaders = F.sum(has_leader(F.col("text")).cast("int"))
    found = lines.groupBy("doc", "page").agg(leaders.alias("leaders"), F.count("*").alias("n"))
    return found.filter((F.col("leaders") >= LEADER_LINES) & (2 * F.col("leaders") >= F.col("n"))).select("doc", "page")


def without_contents(lines: DataFrame) -> DataFrame:
    """Drops contents pages, and elsewhere lines of nothing but leader dots."""
    return lines.join(contents_pages(lines), ["doc", "page"], "left_anti").filter(~dot_leader(F.col("text")))


def without_feet(lines: DataFrame, heights: DataFrame, titles: list[str], standard: str) -> DataFrame:
    """Drops page numbers near the foot, lines with the standard's number, and titles. heights: (doc, page, height)."""
    rows = lines.join(heights, ["doc", "page"])
    number = (F.col("y0") > F.col("height") - FOOT) & F.trim("text").rlike(PAGE_NUMBER)
    return rows.filter(~(number | F.contains("text", F.lit(standard)) | F.trim("text").isin(titles))).drop("height")


def without_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Drops lines whose box meets a table's (doc, page, tx0, ty0, tx1, ty1)."""
    meets = (F.col("x0") < F.col("tx1")) & (F.col("x1") > F.col("tx0")) & (F.col("y0") < F.col("ty1")) & (F.col("y1") > F.col("ty0"))
    t = tables.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), "tx0", "ty0", "tx1", "ty1")
    return lines.join(t, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & meets, "left_anti")


def without_repeats(lines: DataFrame) -> DataFrame:
    """Drops short lines, but for bare numbers, that stand on three pages or more of a document."""
    short = (F.char_length("text") <= SHORT_LINE) & ~F.col("text").rlike(r"^[\d.\s]+$")
    common = lines.filter(short).groupBy("doc", "text").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= REPEATED_PAGES)
    return lines.join(common.select("doc", "text"), ["doc", "text"], "left_anti")


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds row and place: lines whose tops lie within the gap of their row's first line are one row, read by x.
    The row is a fold over the page's lines by y, so each page is one array."""
    item = F.struct("y0", "x0", "text")
    pages = lines.groupBy("doc", "page").agg(F.array_sort(F.collect_list(item)).alias("_lines"))
    kind = "array<struct<row:int,x0:double,y0:double,text:string>>"
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("row"), F.array().cast(kind).alias("out"))

    def step(s: Column, line: Column) -> Column:
        new = s["top"].isNull() | (line["y0"] - s["top"] > ROW_GAP)
        row = F.when(new, s["row"] + 1).otherwise(s["row"])
        placed = F.struct(row.alias("row"), line["x0"].cast("double").alias("x0"), line["y0"].cast("double").alias("y0"), line["text"].alias("text"))
        return F.struct(F.when(new, line["y0"].cast("double")).otherwise(s["top"]).alias("top"), row.alias("row"), F.concat(s["out"], F.array(placed)).alias("out"))

    placed = F.array_sort(F.aggregate("_lines", start, step, lambda s: s["out"]))
    return pages.select("doc", "page", F.posexplode(placed).alias("place", "_l")).select("doc", "page", "place", F.col("_l.row").alias("row"), F.col("_l.text").alias("text"))


def events(lines: DataFrame) -> DataFrame:
    """(doc, pos, kind, no, rest, level) of a document's lines (doc, pos, text) from its first chapter up to its
    list of references. Number fragments on lines of their own join the leaf that follows them."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = lines.withColumn("_on", F.max(F.col("text").rlike(CHAPTER)).over(w)).withColumn("_off", F.max((F.trim("text") == REFERENCES) & F.col("_on")).over(w))
    body = body.filter("_on AND NOT _off")
    fragment = F.regexp_extract("text", FRAGMENT, 1)
    # A run of fragments counts for the line right behind it, if that is a leaf.
    body = body.withColumn("_f", fragment).withColumn("_run", F.sum((fragment == "").cast("int")).over(w))
    runs = body.filter("_f <> ''").groupBy("doc", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_f"))), lambda x: x["_f"]), ".").alias("_prefix"))
    rows = body.filter("_f = ''").withColumn("_before", F.col("_run") - 1).join(runs.select("doc", F.col("_run").alias("_before"), "_prefix"), ["doc", "_before"], "left")
    leaf, number, chapter = F.col("text").rlike(LEAF) & F.col("_prefix").isNotNull(), F.col("text").rlike(NUMBERED), F.col("text").rlike(CHAPTER)
    no = F.when(leaf, F.concat_ws(".", "_prefix", F.regexp_extract("text", LEAF, 1))).when(number, F.regexp_extract("text", NUMBERED, 1)).when(chapter, F.regexp_extract("text", CHAPTER, 1))
    rest = F.when(leaf, F.regexp_extract("text", LEAF, 2)).when(number, F.regexp_extract("text", NUMBERED, 2)).when(chapter, clean_title(F.regexp_extract("text", CHAPTER, 2))).otherwise(F.col("text"))
    rows = rows.withColumns({"no": no, "rest": stripped(rest), "kind": F.when(no.isNotNull(), "heading").otherwise("text")}).filter("kind = 'heading' OR text <> ''")
    return rows.select("doc", "pos", "kind", "no", "rest", F.when(F.col("no").isNotNull(), level(F.col("no"))).alias("level"))


def outline_articles(rows: DataFrame) -> DataFrame:
    """(doc, article_no, section_header, text) of events: headings without a deeper one right behind them, with the
    text up to the next heading; chapters only head."""
    w = Window.partitionBy("doc").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    heads = rows.filter("kind = 'heading'").withColumn("_parent", F.coalesce(F.lead("level").over(w) > F.col("level"), F.lit(False)))
    heads = heads.withColumn("_chapter", F.last(F.when(F.col("level") == 1, F.concat_ws(" ", "no", "rest")), True).over(upto))
    heads = heads.select("doc", "pos", "no", "level", "rest", "_parent", F.when(F.col("level") == 1, "").otherwise(F.coalesce("_chapter", F.lit(""))).alias("section_header"))
    text = rows.withColumn("_head", F.last(F.when(F.col("kind") == "heading", F.col("pos")), True).over(upto)).filter("kind = 'text' AND _head IS NOT NULL")
    text = text.groupBy("doc", F.col("_head").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("rest").alias("t")))), lambda x: x["t"]), "\n").alias("_body"))
    own = F.concat_ws("\n", F.when((F.col("level") > 1) & (F.col("rest") != ""), F.col("rest")), "_body")
    out = heads.join(text, ["doc", "pos"], "left").filter("NOT _parent").select("doc", "pos", F.col("no").alias("article_no"), "section_header", own.alias("text"))
    return out.filter(F.trim("text") != "")


def body_lines(rows: DataFrame, titles: list[str], standard: str) -> DataFrame:
    """(doc, pos, text) of PDF rows (as ``files.pdf_rows`` gives them): page furniture, tables, contents and repeated
    lines go, the rest comes in reading order."""
    lines = rows.filter("kind = 'line'").withColumn("text", glyphs(stripped(F.col("text")))).filter("text <> ''")
    heights = rows.filter("kind <> 'error'").groupBy("doc", "page").agg(F.max("height").alias("height"))
    boxes = rows.filter("kind = 'table'").select("doc", "page", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    kept = without_tables(without_feet(lines.drop("height", "kind", "cells", "error"), heights, titles, standard), boxes)
    placed = without_repeats(without_contents(reading_order(kept)))
    order = Window.partitionBy("doc").orderBy("page", "place")
    return placed.select("doc", (F.row_number().over(order) - 1).alias("pos"), "text")


#: The word that refers to a table, and where a table stands that no chapter holds.
TABLE, APPENDIX = "表", "附表"


def last_chapters(outline: DataFrame) -> DataFrame:
    """(doc, _chapter): the last first-level heading of each document's events."""
    return outline.filter("kind = 'heading' AND level = 1").groupBy("doc").agg(F.max_by(F.concat_ws(" ", "no", "rest"), "pos").alias("_chapter"))


def with_tables(articles: DataFrame, rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc, pos, article_no, section_header, text): the articles, of which the k-th that refers to a table gets the
    document's k-th table, and each table given so as a chunk of its own behind them, under its article's section, else
    the document's last chapter, else the word for an appendix. chapters: as ``last_chapters`` gives them."""
    order = Window.partitionBy("doc").orderBy("page", "line")
    tables = rows.filter("kind = 'table' AND size(cells) > 0").select("doc", F.row_number().over(order).alias("_k"), table_text(F.col("cells")).alias("_table"))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = articles.withColumn("_refers", F.contains("text", F.lit(TABLE))).withColumn("_k", F.when(F.col("_refers"), F.sum(F.col("_refers").cast("int")).over(w)))
    both = named.join(tables, ["doc", "_k"], "left")
    own = both.select("doc", "pos", "article_no", "section_header", F.concat_ws("\n", "text", "_table").alias("text"))
    number = F.concat(F.lit(TABLE), F.col("_k").cast("string"))
    header = F.coalesce(F.nullif("section_header", F.lit("")), F.nullif("_chapter", F.lit("")), F.lit(APPENDIX))
    alone = both.filter("_table IS NOT NULL").join(chapters, "doc", "left").select("doc", (F.lit(1 << 30) + F.col("_k")).alias("pos"), number.alias("article_no"), header.alias("section_header"), F.concat_ws("\n", number, "_table").alias("text"))
    return own.unionByName(alone)


def pdf_articles(rows: DataFrame, titles: list[str], standard: str) -> DataFrame:
    outline = events(body_lines(rows, titles, standard))
    return with_tables(outline_articles(outline), rows, last_chapters(outline))

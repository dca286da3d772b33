"""Queries over documents that are written as files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans import fixtures as fx
from quarryline.registry import query
from quarryline.sources import uploads
from quarryline.staging import new_path

#: One in so many Word files is cut off.
BROKEN = 11


def form_feed_pages(content: bytes) -> list[str]:
    """The stand-in for a PDF library: pages of plain text end with form feeds."""
    return content.decode().split("\f")


def recognized(content: bytes) -> list[str]:
    """The stand-in for OCR: how much there was to look at."""
    return ["", f" {len(content)} bytes "]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, text, content): every document as a file of one of seven kinds, by its number."""
    number = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    word = uploads.docx("x")[:100]
    content = (
        F.when((number % 7 == 0) & (number % BROKEN == 0), F.lit(word))
        .when(number % 7 == 1, F.encode(F.concat(text, F.lit("\f"), text), "utf-8"))
        .when(number % 7 == 2, F.encode(F.concat(text, F.repeat(F.lit("\fpage"), 50)), "utf-8"))
        .when(number % 7 == 3, F.encode(F.substring(text, 1, 10), "utf-8"))
        .when(number % 7 > 3, F.encode(text, "utf-8"))
    )
    kinds = F.array(*map(F.lit, ["docx", "pdf", "PDF", "pdf", "png", "exe", "txt"]))
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat_ws(".", number, F.get(kinds, number % 7)))
    return fx.spread(fx.table(spark, sf_dir, "documents")).select(name.alias("name"), "text", content.alias("content"))


_LINES = """list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"""
_TEXT = f"array_to_string({_LINES.format('t')}, chr(10))"


@query("s2_docx_corpus", f"SELECT doc_id, false AS failed, md5(array_to_string({_LINES.format('text')}, chr(10))) AS text_md5 FROM documents")
def docx_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Word file below its source's folder, read back by its paragraphs."""
    path = new_path(spark, "docx")
    docs = fx.spread(fx.table(spark, sf_dir, "documents"))
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat("doc_id", F.lit(".docx")))
    uploads.write(docs.select(name.alias("name"), "text", F.lit(None).alias("content")), path)
    found = uploads.parsed(spark, path)
    return found.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("error").isNotNull().alias("failed"), F.md5("text").alias("text_md5"))


@query("s5_parsed_uploads", f"""WITH d AS (SELECT doc_id, doc_id % 7 AS kind, coalesce(text, '') AS t FROM documents),
own AS (SELECT *, {_TEXT} AS lines, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS page FROM d),
r AS (SELECT *, CASE kind WHEN 0 THEN 'docx' WHEN 1 THEN CASE WHEN length(page || CASE WHEN page <> '' THEN chr(10) ELSE '' END || page) < 20 THEN 'ocr' ELSE 'pdf' END
  WHEN 2 THEN 'rejected: too many pages' WHEN 3 THEN 'ocr' WHEN 4 THEN 'ocr' ELSE 'rejected: unsupported' END AS route FROM own)
SELECT doc_id, route, kind = 0 AND doc_id % {BROKEN} = 0 AS failed,
  md5(CASE WHEN kind = 0 AND doc_id % {BROKEN} = 0 THEN NULL WHEN route = 'docx' THEN lines WHEN route = 'pdf' THEN page || chr(10) || page
    WHEN route = 'ocr' THEN CASE kind WHEN 1 THEN 2 * strlen(t) + 1 WHEN 3 THEN strlen(t[1:10]) ELSE strlen(t) END || ' bytes' END) AS text_md5 FROM r""")  # fmt: skip
def parsed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads are parsed, and go by what they hold: too many pages, too little text, broken, unknown."""
    path = new_path(spark, "uploads")
    uploads.write(corpus(spark, sf_dir), path)
    found = uploads.parsed(spark, path, recognized, pdf=f"{__name__}:form_feed_pages")
    return found.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("doc_id"), "route", F.col("error").isNotNull().alias("failed"), F.md5("text").alias("text_md5"))

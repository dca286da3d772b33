"""File scans, document readers, session imports, line sinks and configuration.

Readers of binary formats are small helpers over ``binaryFile`` rows; the rules on what they give are plans.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import category, source_name

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What uploads may be.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp")
MOST_PAGES, LEAST_CHARS = 50, 20


def scan(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, category, source, file_hash, content) of all files of a kind below a folder. The category is the folder
    right above a file, none at the root."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    below = F.substring_index("path", root.split(":", 1)[-1].strip("/") + "/", -1)
    return rows.select("path", category(below).alias("category"), source_name(stem).alias("source"), F.sha2("content", 256).alias("file_hash"), "content")


def docx_paragraphs(content: bytes) -> list[str]:
    """Text of each paragraph of a document; raises if it isn't one."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in body.iter(f"{W}p")]


#: Characters of paragraphs that a task holds before it hands them on.
HELD = 4_000_000


def paragraphs(files: DataFrame, reader: Callable[[bytes], list[str]] = docx_paragraphs) -> DataFrame:
    """(doc, pos, text, error): a file that can't be read gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "pos", "text", "error"]
        for frame in frames:
            out, held = [], 0
            for doc, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    new = [(doc, i, t, None) for i, t in enumerate(reader(bytes(content)))]
                except Exception as e:  # noqa: BLE001  the error is the file's row
                    new = [(doc, 0, None, f"{type(e).__name__}: {e}")]
                out += new
                held += sum(len(t or "") for _, _, t, _ in new)
                if held >= HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, "doc string, pos int, text string, error string")


#: A page: its height, its lines (x0, y0, x1, y1, text) and its tables (x0, y0, x1, y1, rows of cells).
Page = tuple[float, list[tuple[float, float, float, float, str]], list[tuple[float, float, float, float, list[list[str | None]]]]]


def pymupdf_pages(content: bytes) -> list[Page]:
    """Pages by the pymupdf library, which has to be installed where the tasks run."""
    import pymupdf

    out = []
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            lines = [(*line["bbox"], "".join(s["text"] for s in line["spans"])) for block in page.get_text("dict")["blocks"] if block.get("type") == 0 for line in block["lines"]]
            out.append((page.rect.height, lines, [(*t.bbox, t.extract()) for t in page.find_tables()]))
    return out


PDF_ROWS = "doc string, page int, line int, kind string, height double, x0 double, y0 double, x1 double, y1 double, text string, cells array<array<string>>, error string"


def pdf_rows(files: DataFrame, reader: Callable[[bytes], list[Page]] = pymupdf_pages) -> DataFrame:
    """Lines and tables of each page (kind line or table); a file that can't be read gives one row with its error."""
    names = [c.split()[0] for c in PDF_ROWS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    for number, (height, lines, tables) in enumerate(reader(bytes(content)), 1):
                        out += [(doc, number, i, "line", height, *box, text, None, None) for i, (*box, text) in enumerate(lines)]
                        out += [(doc, number, i, "table", height, *box, None, rows, None) for i, (*box, rows) in enumerate(tables)]
                except Exception as e:  # noqa: BLE001  the error is the file's row
                    out.append((doc, 0, 0, "error", *[None] * 7, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, PDF_ROWS)


def routed(uploads: DataFrame) -> DataFrame:
    """Adds route to uploads (name, pages, text): how each is to be read, or why it isn't. Scanned documents, which
    have next to no text, go to the OCR provider."""
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    thin = F.char_length(F.trim(F.coalesce("text", F.lit("")))) < LEAST_CHARS
    route = (
        F.when(suffix == "docx", "docx")
        .when((suffix == "pdf") & (F.col("pages") > MOST_PAGES), "rejected: too many pages")
        .when((suffix == "pdf") & thin, "ocr")
        .when(suffix == "pdf", "pdf")
        .when(suffix.isin(*IMAGES), "ocr")
        .otherwise("rejected: unsupported")
    )
    return uploads.withColumn("route", route)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions from a folder of JSON files; broken files and those without an id are left out."""
    schema = "id string, title string, updated_at string, messages array<struct<role: string, content: string, attachments: array<struct<name: string, type: string, url: string>>>>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*.json")
    return rows.filter("_corrupt IS NULL AND coalesce(id, '') <> ''").drop("_corrupt")


def append_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line, appended."""
    rows.write.mode("append").json(path)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines; attributes stay a map of strings."""
    return spark.read.schema("trace_id string, name string, started_at string, duration_ms double, attributes map<string,string>").json(path)


def policy(spark: SparkSession, path: str) -> dict:
    """A policy file: one JSON object, read by Spark from wherever it lies."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Expansion rules of a policy as (pos, triggers, requires, enhancement)."""
    rows = [(i, list(r["triggers"]), list(r.get("requires") or []), r["enhancement"]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "pos int, triggers array<string>, requires array<string>, enhancement string")


def intent_table(spark: SparkSession, rules: dict) -> DataFrame:
    rows = [(i, name, list(r.get("keywords") or []), list(r.get("patterns") or [])) for i, (name, r) in enumerate(rules.items())]
    return spark.createDataFrame(rows, "pos int, intent string, keywords array<string>, patterns array<string>")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of lines ``word [freq] [kind]``; ``#`` starts a comment."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).filter("line <> ''")
    parts = F.split("line", r"\s+")
    return rows.select(parts[0].alias("word"), F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999")).cast("long").alias("freq"))


#: One line of a trace log: its attributes are whatever a step has recorded, of any shape.
LINES = "kind string, trace_id string, span_id string, parent_id string, name string, start string, duration_ms double, status string, attributes variant"


def append_records(rows: DataFrame, path: str) -> None:
    """Appends trace records as JSON lines; ``attributes`` is a variant or JSON text, which must be well formed."""
    kind = rows.schema["attributes"].dataType.typeName()
    attributes = F.col("attributes") if kind == "variant" else F.parse_json("attributes")
    rows.withColumn("attributes", attributes).write.mode("append").json(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Trace records with their attributes as variants: numbers, texts, lists and nested objects stay what they are."""
    return spark.read.schema(LINES).json(path)


def attribute(path: str, kind: str, attributes: str = "attributes") -> Column:
    """The attribute at a path like ``$.user.tags[1]``; null where it is missing or isn't of that kind."""
    return F.try_variant_get(F.col(attributes), path, kind)


def attribute_kinds(rows: DataFrame, attributes: str = "attributes") -> DataFrame:
    """(attribute, kind, n): how often each top-level attribute occurs with each kind of value."""
    each = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(attributes).outer()))
    return each.filter("key IS NOT NULL").groupBy(F.col("key").alias("attribute"), F.schema_of_variant("value").alias("kind")).agg(F.count("*").alias("n"))

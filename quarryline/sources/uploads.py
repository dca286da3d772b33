"""Documents as files: a Python data source that reads Word and PDF files as rows of text, and writes Word files.

Read, a partition is a group of files of bounded size, found below ``path`` at any depth, and its rows come as Arrow
batches: (path, pages, pos, text, error), a row for each paragraph or page. A file that can't be read, that unpacks to
more than ``MOST_UNPACKED`` or that is of another kind gives one row, with an error or without text. Written, a row
(name, text, content) is a file below ``path``: its content as it is, or where that is null a Word file with a paragraph
for each line of its text. Characters that XML has no way to write become U+FFFD. A file is moved to its name once it
is whole, so a task that runs again writes the same files.

Options: ``path``; of a read ``bytes``, what a partition holds at most, a larger file alone, and ``pdf``, a function
``module:name`` from bytes to the texts of all pages.
"""

from __future__ import annotations

import importlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quarryline.functions.text import stripped
from quarryline.sources.commits import resolved
from quarryline.sources.files import MOST_PAGES, W, routed
from quarryline.staging import stage

NAME = "quarryline_documents"
ROWS = "path string, pages int, pos int, text string, error string"
MOST_UNPACKED = 256 << 20
BATCH = 4096
#: What XML 1.0 can't hold.
FORBIDDEN = re.compile(f"[^\\t\\n\\r{chr(0x20)}-{chr(0xD7FF)}{chr(0xE000)}-{chr(0xFFFD)}{chr(0x10000)}-{chr(0x10FFFF)}]")


def body_paragraphs(content: bytes) -> list[str]:
    """Paragraphs of a Word file's body, those in tables left out; tabs and line breaks are characters."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        if packed.getinfo("word/document.xml").file_size > MOST_UNPACKED:
            raise ValueError(f"unpacks to more than {MOST_UNPACKED} bytes")
        body = ElementTree.fromstring(packed.read("word/document.xml")).find(f"{W}body")
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    # Tabs below a paragraph's settings are tab stops, not text.
    text = lambda p: "".join(e.text or "" if e.tag == f"{W}t" else marks.get(e.tag, "") for r in p.iter(f"{W}r") for e in r)
    return [text(p) for p in ([] if body is None else body.findall(f"{W}p"))]


def docx(text: str) -> bytes:
    """The smallest Word file with a paragraph for each line."""
    clean = lambda s: escape(FORBIDDEN.sub("\N{REPLACEMENT CHARACTER}", s), {"\r": "&#13;"})
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{clean(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    kinds = "application/vnd.openxmlformats-"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="{kinds}package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kinds}officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{lines}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for name, part in parts.items():
            # A fixed date: the same text gives the same bytes.
            packed.writestr(zipfile.ZipInfo(name), head + part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pymupdf_texts(content: bytes) -> Sequence[str]:
    """Texts of all pages by the pymupdf library, which has to be installed where the tasks run; each is made as it is asked for."""
    import pymupdf

    doc = pymupdf.open(stream=content, filetype="pdf")

    class Pages(Sequence):
        def __len__(self) -> int:
            return len(doc)

        def __getitem__(self, i: int) -> str:
            return doc[i].get_text()

    return Pages()


class Group(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes, self.pdf = options["path"], int(options.get("bytes", 32 << 20)), options.get("pdf", f"{__name__}:pymupdf_texts")

    def partitions(self) -> list[Group]:
        """Files in the order of their paths, as many to a group as ``bytes`` hold."""
        store, root = resolved(self.path)
        found = sorted((f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        groups, held = [], 0
        for path, size in found:
            if not groups or held + size > self.bytes:
                groups.append(Group([]))
                held = 0
            groups[-1].paths.append(path)
            held += size
        return groups or [Group([])]

    def _rows(self, store: fs.FileSystem, path: str, pdf: Callable[[bytes], Sequence[str]]) -> Iterator[tuple]:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind not in ("docx", "pdf"):
            yield path, None, None, None, None
            return
        try:
            with store.open_input_stream(path) as f:
                content = f.read()
            parts = body_paragraphs(content) if kind == "docx" else pdf(content)
            pages = len(parts) if kind == "pdf" else None
            # Of a file with too many pages nothing but their number is read.
            texts = [] if kind == "pdf" and pages > MOST_PAGES else list(parts)
        except Exception as e:  # noqa: BLE001  the error is the file's row
            yield path, None, None, None, f"{type(e).__name__}: {e}"
            return
        yield from ((path, pages, i, text, None) for i, text in enumerate(texts))
        if not texts:
            yield path, pages, None, None, None

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, _ = resolved(self.path)
        module, name = self.pdf.split(":")
        pdf = getattr(importlib.import_module(module), name)
        schema = pa.schema([("path", pa.string()), ("pages", pa.int32()), ("pos", pa.int32()), ("text", pa.string()), ("error", pa.string())])
        rows = []
        for path in partition.paths:
            for row in self._rows(store, path, pdf):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = resolved(self.path.rstrip("/"))
        store.create_dir(root, recursive=True)
        made = {root}
        for batch in iterator:
            for row in batch.to_pylist():
                content = docx(row["text"] or "") if row["content"] is None else row["content"]
                path, own = f"{root}/{row['name']}", f"{root}/.{uuid.uuid4().hex}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(own) as f:
                    f.write(content)
                store.move(own, path)
        return WriterCommitMessage()


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def write(rows: DataFrame, path: str) -> None:
    """Writes rows (name, text, content), as the module says; names are distinct."""
    rows.sparkSession.dataSource.register(Documents)
    rows.select(F.col("name").cast("string"), F.col("text").cast("string"), F.col("content").cast("binary")).write.format(NAME).mode("append").save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(Documents)
    return spark.read.format(NAME).options(**options).load(path)


def parsed(spark: SparkSession, path: str, ocr: Callable[[bytes], list[str]] | None = None, **options: str) -> DataFrame:
    """(path, name, route, text, error) of each uploaded file: how it was read, or why it wasn't, and its paragraphs or
    pages without blanks around them, empty ones left out. Images, and PDF files with next to no text, are read by
    ``ocr``, which gives lines; without it they have an error."""
    rows = read(spark, path, **options)
    rows = rows.withColumn("text", stripped(F.col("text")))
    lines = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text"))))
    each = rows.groupBy("path").agg(F.max("pages").alias("pages"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.max("error").alias("error"))
    # Files are opened once, and once more for ``ocr``: both sides of the join below would read them all.
    told = stage(routed(each.withColumn("name", F.substring_index("path", "/", -1))), "parsed")
    scans = told.filter("route = 'ocr' AND error IS NULL").select("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = resolved(path)
        for frame in frames:
            out = []
            for own in frame["path"]:
                try:
                    if ocr is None:
                        raise ValueError("no OCR provider")
                    with store.open_input_stream(own) as f:
                        lines = ocr(f.read())
                    out.append((own, "\n".join(s for s in (line.strip() for line in lines) if s), None))
                except Exception as e:  # noqa: BLE001  the error is the file's row
                    out.append((own, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "seen", "failed"])

    seen = scans.mapInPandas(run, "path string, seen string, failed string")
    text = F.when(F.col("route").startswith("rejected"), F.lit(None).cast("string")).when(F.col("route") == "ocr", F.col("seen")).when(F.col("error").isNull(), F.col("text"))
    return told.join(seen, "path", "left").select("path", "name", "route", text.alias("text"), F.coalesce("error", "failed").alias("error"))

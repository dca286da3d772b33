"""Incremental ingest: files to a published index. Only files that are new or have changed are read.

Files come as (path, category, source, file_hash, content), so a scan of a folder and a table of contents serve alike.
A file that can't be read, or that holds nothing, fails the run before anything is published: what was published
before stays, and the next run starts from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.ids import unique_ids
from quarryline.functions.text import parent_number
from quarryline.operators import chunking, layout, rerank
from quarryline.operators import index_maintenance as index
from quarryline.sources import files as sources
from quarryline.sources import providers
from quarryline.sources.commits import Conflict
from quarryline.staging import stage

KEY = ["category", "source"]
CHUNKS = "chunk_id string, category string, source string, hierarchy string, section_header string, article_no string, parent_article_no string, chunk_type string, role string, penalty_context string, text string, embedding array<float>"
MANIFEST = "category string, source string, file_hash string, schema_version int, article_count long"


def read_articles(files: DataFrame, docx: Callable = sources.docx_paragraphs, pdf: Callable = sources.pymupdf_pages, ocr: Callable[[bytes], list[str]] | None = None, titles: list[str] | None = None, standard: str = "GB19522") -> tuple[DataFrame, DataFrame]:
    """(doc, pos, article_no, section_header, text) of all files, and (doc, error) of those that can't be read. PDF files
    without a line that can be told go to ``ocr``, which gives lines."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    told = stage(sources.paragraphs(files.filter(suffix == "docx"), docx), "docx-paragraphs")
    rows = stage(sources.pdf_rows(files.filter(suffix == "pdf"), pdf), "pdf-rows")
    found = [chunking.articles(told.filter("error IS NULL")).withColumnRenamed("ordinal", "pos"), stage(layout.pdf_articles(rows, titles or [], standard), "pdf-articles")]
    errors = told.filter("error IS NOT NULL").select("doc", "error").unionByName(rows.filter("error IS NOT NULL").select("doc", "error"))
    if ocr is not None:
        silent = files.filter(suffix == "pdf").join(found[1].select(F.col("doc").alias("path")).distinct(), "path", "left_anti")
        lines = sources.paragraphs(silent.join(errors.select(F.col("doc").alias("path")), "path", "left_anti"), ocr)
        read = stage(lines, "ocr-lines")
        found.append(layout.outline_articles(layout.events(read.filter("error IS NULL"))))
        errors = errors.unionByName(read.filter("error IS NOT NULL").select("doc", "error"))
    known = suffix.isin("docx", "pdf")
    errors = errors.unionByName(files.filter(~known).select(F.col("path").alias("doc"), F.lit("unsupported kind of file").alias("error")))
    names = ["doc", "pos", "article_no", "section_header", "text"]
    all_rows = None
    for f in found:
        own = f.select("doc", F.col("pos").cast("long").alias("pos"), *names[2:])
        all_rows = own if all_rows is None else all_rows.unionByName(own)
    return all_rows, errors


def chunk_rows(articles: DataFrame, files: DataFrame, hierarchy: Column, roles: dict[str, list[str]], embedder: providers.Embedder) -> DataFrame:
    """The chunk records of articles: articles and their clauses, with ids, roles and vectors."""
    rows = chunking.clauses(articles.join(files.select(F.col("path").alias("doc"), *KEY), "doc"))
    rows = rows.withColumn("parent_article_no", parent_number(F.col("article_no")))
    kind = F.when(F.col("article_no") == F.col("parent_article_no"), "article").otherwise("clause")
    rows = rows.withColumns({"chunk_type": kind, "hierarchy": hierarchy, "role": rerank.role(F.col("section_header"), roles)})
    rows = unique_ids(rows, ["category", "pos", "clause_pos"])
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return providers.embedded(rows, "text", embedder).select(*names)


def ingest(spark: SparkSession, files: DataFrame, root: str, hierarchy: Column, roles: dict[str, list[str]], embedder: providers.Embedder = providers.hashed_embedder, version: int = index.SCHEMA_VERSION, within: Column | None = None, attempts: int = 5, **readers) -> DataFrame:
    """Brings the index below ``root`` up to date with the files, publishes it and gives the counters (total, added,
    updated, removed, skipped), one row. An index whose vectors have another length is built anew. ``within``, a
    condition on category and source, says which part of the index the files are all of; others stay as they are.
    A run that finds another's version published meanwhile goes by that one and tries again."""
    for attempt in range(attempts):
        try:
            return _ingest(spark, files, root, hierarchy, roles, embedder, version, within, readers)
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise ValueError("attempts must be 1 at least")


def _ingest(spark: SparkSession, files: DataFrame, root: str, hierarchy: Column, roles: dict[str, list[str]], embedder: providers.Embedder, version: int, within: Column | None, readers: dict) -> DataFrame:
    base = index.version(root)
    before, manifest = index.current(spark, root, at=base), index.current(spark, root, "manifest", at=base)
    rebuilt = before is not None and not index.same_dimension(before, len(embedder(["x"])[0]))
    if rebuilt and within is not None:
        raise ValueError("vectors of another length: the whole index must be built anew")
    if before is None or rebuilt:
        before, manifest = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], MANIFEST)
    within = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    # What the files are made from is worked out twice: for their hashes, and for those that are read.
    there = stage(files.select(*KEY, "file_hash", F.lit(version).alias("schema_version")), "ingest-files")
    changes = stage(index.diff(manifest.filter(within), there), "ingest-changes")
    changed = stage(files.join(changes.filter("change IN ('added', 'updated')"), KEY, "left_semi"), "ingest-changed")
    articles, errors = read_articles(changed, **readers)
    failed = errors.orderBy("doc").first()
    if failed is not None:
        raise ValueError(f"can't ingest {failed.doc}: {failed.error}")
    new = stage(chunk_rows(articles, changed, hierarchy, roles, embedder), "ingest-chunks")
    counts = new.groupBy(*KEY).agg(F.count("*").alias("article_count"))
    empty = changed.join(counts, KEY, "left_anti").select("path").first()
    if empty is not None:
        raise ValueError(f"can't ingest {empty.path}: it holds nothing")
    # What of changed and removed files was there goes, as do rows whose ids come anew.
    touched = before.join(changes.filter("change IN ('updated', 'removed')"), KEY, "left_semi").select("chunk_id")
    gone = touched.unionByName(before.select("chunk_id").join(new.select("chunk_id"), "chunk_id", "left_semi"))
    kept = manifest.join(changes.filter("change = 'skipped'"), KEY, "left_semi").select(*KEY, "article_count")
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    listed = there.join(counts.unionByName(kept), KEY).select(*names).unionByName(manifest.filter(~within).select(*names))
    listed = stage(listed, "ingest-manifest")
    number = index.publish(new, root, listed, None if rebuilt or not base else gone, base)
    return index.counters(changes, manifest, listed, before.select(*KEY, "chunk_id"), index.current(spark, root, at=number))

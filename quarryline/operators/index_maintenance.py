"""Keeping an index: manifest diff, upsert, purge, versioned publishing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.commits import Commits

SCHEMA_VERSION = 8
#: Segments of a version beyond which its chunks are written anew as one.
MOST_SEGMENTS = 8


def manifest(files: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """(category, source, file_hash, article_count, schema_version) of files (category, source, content, article_count)."""
    return files.select("category", "source", F.sha2("content", 256).alias("file_hash"), F.col("article_count").cast("long").alias("article_count"), F.lit(version).alias("schema_version"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category, source, change): added, updated (another hash or schema version), skipped or removed."""
    a = old.select("category", "source", F.col("file_hash").alias("_h"), F.col("schema_version").alias("_v"), F.lit(True).alias("_old"))
    b = new.select("category", "source", "file_hash", "schema_version", F.lit(True).alias("_new"))
    same = (F.col("_h") == F.col("file_hash")) & (F.col("_v") == F.col("schema_version"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "skipped").otherwise("updated")
    return a.join(b, ["category", "source"], "full_outer").select("category", "source", change.alias("change"))


def counters(changes: DataFrame, old: DataFrame, new: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: articles of added and updated files by the new manifest and of skipped ones by the old, stored chunks
    (category, source, chunk_id) of removed files, and all chunks after the run."""
    key = ["category", "source"]
    counts = changes.join(old.select(*key, F.col("article_count").alias("_old")), key, "left").join(new.select(*key, F.col("article_count").alias("_new")), key, "left")
    gone = changes.filter("change = 'removed'").join(before.groupBy(*key).agg(F.count("*").alias("_n")), key)
    number = lambda change, column: F.coalesce(F.sum(F.when(F.col("change") == change, F.col(column))), F.lit(0)).alias(change)
    made = counts.agg(number("added", "_new"), number("updated", "_new"), number("skipped", "_old"))
    rest = gone.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("removed"))
    # Three rows of one line each.
    return made.join(rest).join(after.agg(F.count("*").alias("total"))).select("total", "added", "updated", "removed", "skipped")


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The old rows that no new row replaces, and the new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def purged(chunks: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.join(gone.select(key), key, "left_anti")


def stale(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """chunk_ids to purge: of removed sources, and of updated ones what the new version lacks."""
    touched = changes.filter("change IN ('updated', 'removed')").select("source")
    return old.join(touched, "source", "left_semi").select("chunk_id").join(new.select("chunk_id"), "chunk_id", "left_anti")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Overwrites by key: rows whose key comes anew go, and the new ones stand for them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def publish(new: DataFrame, root: str, manifest: DataFrame | None = None, gone: DataFrame | None = None, base: int | None = None) -> int:
    """Publishes the next version and gives its number: the chunks of version ``base`` less those whose chunk_id is in
    ``gone``, and the new ones. Only these and the manifest are written, as a segment; the version's commit names the
    segments that make it up, and is the last thing written, so a failed run leaves what was there. Without ``gone``
    the new chunks are all there are. Raises ``Conflict`` if another writer has published after ``base``, which is the
    last version by default."""
    log, spark = Commits(root), new.sparkSession
    base = log.latest() if base is None else base
    before = log.read(base)["segments"] if base and gone is not None else []
    own = uuid.uuid4().hex
    new.write.parquet(f"{root}/segments/{own}/chunks")
    if manifest is not None:
        manifest.write.parquet(f"{root}/segments/{own}/manifest")
    if before:
        gone.select("chunk_id").distinct().write.parquet(f"{root}/segments/{own}/gone")
    segments = [*before, own]
    if len(segments) > MOST_SEGMENTS:
        folded = uuid.uuid4().hex
        alive(spark, root, segments).write.parquet(f"{root}/segments/{folded}/chunks")
        if manifest is not None:
            spark.read.parquet(f"{root}/segments/{own}/manifest").write.parquet(f"{root}/segments/{folded}/manifest")
        segments = [folded]
    log.create(base + 1, {"segments": segments})
    return base + 1


def alive(spark: SparkSession, root: str, segments: list[str]) -> DataFrame:
    """The chunks of some segments, in their order, that no later segment has as gone."""
    parts = [spark.read.parquet(f"{root}/segments/{s}/chunks").withColumn("_s", F.lit(i)) for i, s in enumerate(segments)]
    rows = reduce(DataFrame.unionByName, parts)
    if len(segments) == 1:
        return rows.drop("_s")
    gone = [spark.read.parquet(f"{root}/segments/{s}/gone").withColumn("_g", F.lit(i)) for i, s in enumerate(segments) if i]
    last = reduce(DataFrame.unionByName, gone).groupBy("chunk_id").agg(F.max("_g").alias("_g"))
    return rows.join(last, "chunk_id", "left").filter("_g IS NULL OR _g <= _s").drop("_s", "_g").select(*parts[0].drop("_s").columns)


def version(root: str) -> int:
    """The last published version, 0 if there is none."""
    return Commits(root).latest()


def current(spark: SparkSession, root: str, part: str = "chunks", at: int | None = None) -> DataFrame | None:
    """The chunks (or manifest) of a version, the last by default; None if nothing has been published. A version stays
    what it is whatever is published later, until ``vacuum``."""
    log = Commits(root)
    number = log.latest() if at is None else at
    if not number:
        return None
    segments = log.read(number)["segments"]
    try:
        return alive(spark, root, segments) if part == "chunks" else spark.read.parquet(f"{root}/segments/{segments[-1]}/{part}")
    except AnalysisException as e:
        raise ValueError(f"version {number} of {root} has been vacuumed") from e


def vacuum(root: str, keep: int = 2) -> int:
    """Deletes the segments that only versions before the last ``keep`` have, and says how many. Segments of no
    version stay, as a writer may be at work on them."""
    log = Commits(root)
    numbers = log.numbers()
    used = {s for n in numbers[-keep:] for s in log.read(n)["segments"]}
    old = {s for n in numbers[:-keep] for s in log.read(n)["segments"]} - used
    there = [s for s in old if log.store.get_file_info(f"{log.root}/segments/{s}").type != fs.FileType.NotFound]
    for s in there:
        log.store.delete_dir(f"{log.root}/segments/{s}")
    return len(there)


def same_dimension(chunks: DataFrame, expected: int) -> bool:
    """Whether the stored vectors have the expected length; otherwise the index must be built anew."""
    found = chunks.agg(F.max(F.size("embedding")).alias("high"), F.min(F.size("embedding")).alias("low")).first()
    return found.high is None or found.high == found.low == expected

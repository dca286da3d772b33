"""An inverted index in immutable segments: what a run adds is tokenized and counted once, nothing else is read again.

A segment holds ``postings`` (term, chunk_id, tf, dl), ``docs`` (chunk_id, dl; also documents without a word) and
``terms`` (term, df; a term's rows add up). Tables are dealt by how many rows they have, whatever the session's number
of partitions. A run that replaces or removes documents writes ``gone`` (segment, chunk_id) and what that takes
from the counts, ``lost`` (segment, term, df). A numbered commit names the segments and the gone parts of a version, with
their documents and tokens, so that the corpus' numbers are sums over the commit, and document frequencies are sums over
``terms`` and ``lost``. Segments of one size tier are merged once there are ``FAN`` of them, so a version has a number
of segments that grows with the logarithm of the corpus, and a posting is written again once a tier.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import lexical
from quarryline.sources.commits import Commits, Conflict
from quarryline.staging import SMALL_ROWS, parts

#: Segments of a tier that become one of the next, and gone parts that become one.
FAN = 4
#: Documents, postings and terms that a task takes; a posting in a sort takes some 140 bytes.
DOCS, POSTINGS, TERMS = 20_000, 1_000_000, 500_000


def tier(docs: int) -> int:
    """The power of ``FAN`` that a segment of so many documents reaches."""
    found = 0
    while docs >= FAN:
        docs, found = docs // FAN, found + 1
    return found


def _read(spark: SparkSession, root: str, segments: list[dict], part: str) -> DataFrame | None:
    found = [spark.read.parquet(f"{root}/segments/{s['id']}/{part}").withColumn("segment", F.lit(s["id"])) for s in segments]
    return reduce(DataFrame.unionByName, found) if found else None


def _gone(spark: SparkSession, root: str, record: dict, part: str, ids: list[str]) -> DataFrame | None:
    """Rows of the gone parts that name one of the segments ``ids``."""
    found = [spark.read.parquet(f"{root}/gone/{g['id']}/{part}") for g in record["gone"] if set(g["of"]) & set(ids)]
    return reduce(DataFrame.unionByName, found).filter(F.col("segment").isin(ids)) if found else None


def _met(rows: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """The rows (segment, chunk_id, others) that are among ``docs`` or not: few documents go to all tasks, else both are
    dealt out."""
    key, docs = ["segment", "chunk_id"], docs.select("segment", "chunk_id")
    if docs.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(docs), key, how)
    n = parts(rows.sparkSession, rows.count(), POSTINGS)
    return rows.repartition(n, *key).join(docs.repartition(n, *key), key, how)


def _alive(spark: SparkSession, root: str, record: dict, segments: list[dict], part: str) -> DataFrame | None:
    """``postings`` or ``docs`` of some segments of a version, without documents that are gone."""
    rows = _read(spark, root, segments, part)
    gone = _gone(spark, root, record, "docs", [s["id"] for s in segments])
    return rows if gone is None else _met(rows, gone, "left_anti")


def _write_segment(root: str, counts: DataFrame | None, docs: DataFrame) -> dict:
    """Writes a segment from postings and documents, and gives its entry. Postings lie in ranges of terms, those of a
    frequent term in several by chunk_id."""
    spark, own = docs.sparkSession, uuid.uuid4().hex
    path = f"{root}/segments/{own}"
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "df"])

    counts = counts.select("term", "chunk_id", "tf", "dl")
    counts.repartitionByRange(parts(spark, counts.count(), POSTINGS), "term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{path}/postings")
    docs.select("chunk_id", "dl").write.parquet(f"{path}/docs")
    # Postings are sorted, so what each batch counts is few rows more than there are terms.
    spark.read.parquet(f"{path}/postings").select("term").mapInArrow(run, "term string, df long").write.parquet(f"{path}/terms")
    n, tokens = spark.read.parquet(f"{path}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"id": own, "docs": n, "tokens": tokens}


def _write_gone(spark: SparkSession, root: str, docs: DataFrame, lost: DataFrame) -> dict | None:
    """Writes a gone part from (segment, chunk_id, dl) and (segment, term, df); None if no document goes."""
    own = uuid.uuid4().hex
    docs.select("segment", "chunk_id", "dl").write.parquet(f"{root}/gone/{own}/docs")
    written = spark.read.parquet(f"{root}/gone/{own}/docs")
    # One row a segment, of which a version has few.
    of = {r.segment: [r.n, r.tokens] for r in written.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()}
    if not of:
        return None
    lost.select("segment", "term", "df").write.parquet(f"{root}/gone/{own}/lost")
    return {"id": own, "of": of}


def _removed(spark: SparkSession, root: str, record: dict, keys: DataFrame) -> dict | None:
    """The gone part that takes ``keys`` out of a version; postings are read of the segments that have such documents."""
    if not record["segments"]:
        return None
    own = uuid.uuid4().hex
    docs = _alive(spark, root, record, record["segments"], "docs").join(keys, "chunk_id", "left_semi")
    docs.select("segment", "chunk_id", "dl").write.parquet(f"{root}/gone/{own}/found")
    found = spark.read.parquet(f"{root}/gone/{own}/found")
    held = {r.segment for r in found.select("segment").distinct().collect()}
    if not held:
        return None
    rows = _read(spark, root, [s for s in record["segments"] if s["id"] in held], "postings").select("segment", "chunk_id", "term")
    lost = _met(rows, found, "left_semi").groupBy("segment", "term").agg(F.count("*").alias("df"))
    return _write_gone(spark, root, found, lost)


def _merged(spark: SparkSession, root: str, record: dict) -> dict:
    """The version with segments of full tiers merged, and gone parts that name no segment any more left out."""
    while True:
        tiers: dict[int, list[dict]] = {}
        for s in record["segments"]:
            tiers.setdefault(tier(s["docs"]), []).append(s)
        full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), None)
        if full is None:
            break
        one = _write_segment(root, _alive(spark, root, record, full, "postings"), _alive(spark, root, record, full, "docs"))
        old = {s["id"] for s in full}
        kept = [s for s in record["segments"] if s["id"] not in old] + [one]
        gone = [{"id": g["id"], "of": {s: n for s, n in g["of"].items() if s not in old}} for g in record["gone"]]
        record = {"segments": kept, "gone": [g for g in gone if g["of"]]}
    if len(record["gone"]) >= FAN:
        ids = [s["id"] for s in record["segments"]]
        lost = _gone(spark, root, record, "lost", ids).groupBy("segment", "term").agg(F.sum("df").alias("df"))
        record = record | {"gone": [_write_gone(spark, root, _gone(spark, root, record, "docs", ids), lost)]}
    return record


def update(new: DataFrame, root: str, gone: DataFrame | None = None, dictionary: list[str] | None = None, attempts: int = 5) -> int:
    """Publishes the next version and gives its number: the documents ``new`` (chunk_id, text) stand for those that had
    their ids, and the ids in ``gone`` go. A null text is a document without words, a null id is dropped, and of rows
    with one id the least text stays. The new texts are read once, whatever other writers do: one who finds another's
    version published meanwhile takes out its ids from that one. A failed run leaves the last version as it was."""
    spark, log = new.sparkSession, Commits(root)
    rows = new.filter("chunk_id IS NOT NULL")
    rows = rows.repartition(parts(spark, rows.count(), DOCS), "chunk_id").groupBy("chunk_id").agg(F.min("text").alias("text"))
    counts = lexical.postings(lexical.counted(rows, dictionary=dictionary))
    own = uuid.uuid4().hex
    counts.write.parquet(f"{root}/new/{own}/postings")
    rows.select("chunk_id").write.parquet(f"{root}/new/{own}/ids")
    counts, ids = (spark.read.parquet(f"{root}/new/{own}/{part}") for part in ("postings", "ids"))
    lengths = counts.groupBy("chunk_id").agg(F.sum("tf").alias("dl"))
    segment = _write_segment(root, counts, ids.join(lengths, "chunk_id", "left").select("chunk_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl")))
    keys = ids if gone is None else ids.unionByName(gone.select("chunk_id")).distinct()
    for attempt in range(attempts):
        base = log.latest()
        record = log.read(base) if base else {"segments": [], "gone": []}
        out = _removed(spark, root, record, keys)
        record = {"segments": [*record["segments"], segment] if segment["docs"] else record["segments"], "gone": record["gone"] + ([out] if out else [])}
        try:
            log.create(base + 1, _merged(spark, root, record) | {"first": segment["id"]})
        except Conflict:
            if attempt == attempts - 1:
                raise
            continue
        log.store.delete_dir(f"{log.root}/new/{own}")
        return base + 1
    raise ValueError("attempts must be 1 at least")


def index(spark: SparkSession, root: str, at: int | None = None) -> lexical.Index:
    """A version, the last by default, as ``lexical.scores`` takes it; no text is read. Raises ``LookupError`` if
    nothing has been published. A version without documents has empty tables."""
    log = Commits(root)
    number = log.latest() if at is None else at
    if not number:
        raise LookupError(f"no version of {root}")
    record = log.read(number)
    ids = [s["id"] for s in record["segments"]]
    total = lambda i, name: sum(s[name] for s in record["segments"]) - sum(n[i] for g in record["gone"] for n in g["of"].values())
    n, tokens = total(0, "docs"), total(1, "tokens")
    try:
        # The first segment of a version stands for its columns where none has documents.
        segments = record["segments"] or [{"id": record["first"]}]
        postings = _alive(spark, root, record, segments, "postings").select("term", "chunk_id", "tf", "dl")
        terms = _read(spark, root, segments, "terms").select("term", "df")
        lost = _gone(spark, root, record, "lost", ids)
    except AnalysisException as e:
        raise ValueError(f"version {number} of {root} has been vacuumed") from e
    if lost is not None:
        terms = terms.unionByName(lost.select("term", (-F.col("df")).alias("df")))
    found = terms.repartition(parts(spark, terms.count(), TERMS), "term").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return lexical.Index(postings, lexical.idf(found, n), n, tokens / n if n else 0.0)


def vacuum(root: str, keep: int = 2) -> int:
    """Deletes the segments and gone parts that only versions before the last ``keep`` name, and says how many."""
    log = Commits(root)
    numbers = log.numbers()
    parts = lambda n: {f"segments/{s['id']}" for s in log.read(n)["segments"]} | {f"segments/{log.read(n)['first']}"} | {f"gone/{g['id']}" for g in log.read(n)["gone"]}
    used = {p for n in numbers[-keep:] for p in parts(n)}
    old = {p for n in numbers[:-keep] for p in parts(n)} - used
    there = [p for p in old if log.store.get_file_info(f"{log.root}/{p}").type != fs.FileType.NotFound]
    for p in there:
        log.store.delete_dir(f"{log.root}/{p}")
    return len(there)

"""Tables that change by transactions: a Python data source whose writes are commits, and whose rows are a stream.

A ledger is a folder of Parquet files and numbered commits (``commits``). A write's tasks each write one file of their
own; the driver's one commit record makes all of them visible together. A write that fails leaves no record, and its
files are deleted; files that a lost task leaves behind belong to no commit, so no reader sees them.

Options of a write: ``path``, ``op`` and, for keyed ones, ``key``:

* ``append``: rows in their order (partition, then place), numbered from 0 over the whole ledger;
* ``replace``: rows that stand for all earlier ones of their key;
* ``update``: columns that aren't null overwrite those of rows that are there; other keys are left alone;
* ``add``: numbers that are added to those of rows that are there.

``state`` reads a keyed ledger as of a commit. Of one key's rows in one commit the last by all columns counts (``add``
takes them all). As a stream (``readStream``), an appended ledger gives its rows from ``cursor`` on: offsets are row
numbers, batches are slices of files, and the checkpoint keeps the place.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quarryline.sources.commits import Commits, resolved

NAME = "quarryline_ledger"
OPS = ("append", "replace", "update", "add")


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.op, self.schema = options["path"], options.get("op", "append"), schema.json()
        self.key = [k for k in options.get("key", "").split(",") if k]
        if self.op not in OPS or (self.op != "append" and not self.key):
            raise ValueError(f"op is one of {OPS}, all but append with a key")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = resolved(self.root)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        store.create_dir(f"{root}/data", recursive=True)
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=store, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{root}/data/{name}")
            raise
        return Written(TaskContext.get().partitionId(), name if out is not None else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        files = [[m.file, m.rows] for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.part)]
        log = Commits(self.root)

        def record(number: int) -> dict:
            first = log.read(number - 1)["end"] if number > 1 else 0
            size = sum(rows for _, rows in files) if self.op == "append" else 0
            return {"op": self.op, "key": self.key, "files": files, "schema": self.schema, "start": first, "end": first + size}

        log.append(record)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = resolved(self.root)
        for m in messages:
            if m and m.file:
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(f"{root}/data/{m.file}")


class Slice(InputPartition):
    def __init__(self, file: str, low: int, high: int, number: int):
        self.file, self.low, self.high, self.number = file, low, high, number


class Replay(DataSourceStreamReader):
    """Rows by their numbers. A slice is rows low .. high of a file, and ``number`` is what the first of them has."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.cursor, self.columns = options["path"], int(options.get("cursor", "0")), schema.fieldNames()
        #: Rows behind a commit, as far as they have been read: a stream that runs on lists only new commits.
        self.known: list[dict] = []

    def _commits(self) -> list[dict]:
        log = Commits(self.root)
        self.known += [log.read(n) for n in log.numbers()[len(self.known) :]]
        return self.known

    def initialOffset(self) -> dict:
        return {"row": self.cursor}

    def latestOffset(self) -> dict:
        found = self._commits()
        return {"row": max(found[-1]["end"] if found else 0, self.cursor)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for commit in self._commits():
            at = commit["start"]
            if commit["op"] != "append" or commit["end"] <= start["row"] or at >= end["row"]:
                continue
            for file, rows in commit["files"]:
                low, high = max(start["row"], at), min(end["row"], at + rows)
                if low < high:
                    out.append(Slice(file, low - at, high - at, low))
                at += rows
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, root = resolved(self.root)
        at, number = 0, partition.number
        with store.open_input_file(f"{root}/data/{partition.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000):
                low, high = max(partition.low - at, 0), min(partition.high - at, batch.num_rows)
                at += batch.num_rows
                if low < high:
                    own = batch.slice(low, high - low)
                    numbers = pa.array(range(number, number + own.num_rows), pa.int64())
                    number += own.num_rows
                    yield pa.RecordBatch.from_arrays([numbers if c == "row_number" else own.column(c) for c in self.columns], names=self.columns)
                if at >= partition.high:
                    return

    def commit(self, end: dict) -> None:
        """Nothing to do: the ledger keeps its rows, and the checkpoint the place."""


class Ledger(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """The rows of an appended ledger, and their numbers."""
        log = Commits(self.options["path"])
        fields = json.loads(log.read(log.numbers()[0])["schema"])
        return StructType.fromJson(fields).add("row_number", "long")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a ledger is never overwritten; write in mode append, with op replace")
        return Writer(self.options, schema)

    def streamReader(self, schema: StructType) -> Replay:
        return Replay(self.options, schema)


def write(rows: DataFrame, root: str, op: str, key: list[str] | None = None) -> None:
    """One transaction."""
    rows.sparkSession.dataSource.register(Ledger)
    rows.write.format(NAME).mode("append").option("path", root).option("op", op).option("key", ",".join(key or [])).save()


def replay(spark: SparkSession, root: str, cursor: int = 0) -> DataFrame:
    """The rows of an appended ledger from row ``cursor`` on, as a stream, with their ``row_number``."""
    spark.dataSource.register(Ledger)
    return spark.readStream.format(NAME).option("path", root).option("cursor", str(cursor)).load()


def state(spark: SparkSession, root: str, schema: str, key: list[str], version: int | None = None) -> DataFrame:
    """The rows of a keyed ledger as of a commit (the last by default), as ``schema`` has them. Commits are read as a
    table, so their number and that of their files may grow; keys meet once for each kind of write."""
    plain = f"file://{resolved(root)[1]}" if root.startswith(("/", "file:")) else root
    records = spark.read.schema("op string, files array<array<string>>").json(f"{plain}/_commits/*.json")
    number = F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long")
    files = records.select("op", number.alias("_n"), F.explode("files").alias("f")).select("op", "_n", F.col("f")[0].alias("_file"))
    if version is not None:
        files = files.filter(F.col("_n") <= version)
    rows = spark.read.schema(schema).parquet(f"{plain}/data").withColumn("_file", F.element_at(F.split("_metadata.file_path", "/"), -1)).join(files, "_file").drop("_file")
    values = [c for c in rows.columns if c not in (*key, "op", "_n")]
    order = F.struct("_n", *values)
    whole = rows.filter("op = 'replace'").groupBy(*key).agg(F.max(order).alias("_base"))
    base = whole.select(*key, "_base.*")
    changed = rows.filter("op = 'update'").groupBy(*key).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("_n", c))).alias(f"_u_{c}") for c in values])
    known = base.join(changed, key, "left")
    numeric = [c for c in values if rows.schema[c].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or rows.schema[c].dataType.typeName().startswith("decimal")]
    # What is added counts from the row's replacement, or its column's update, on.
    since = known.select(*key, *[F.greatest("_n", F.col(f"_u_{c}")["_n"]).alias(f"_s_{c}") for c in numeric])
    more = rows.filter("op = 'add'").select(*key, F.col("_n").alias("_at"), *[F.col(c).alias(f"_d_{c}") for c in numeric])
    sums = [F.sum(F.when(F.col("_at") > F.col(f"_s_{c}"), F.col(f"_d_{c}"))).alias(f"_a_{c}") for c in numeric] or [F.count("*")]
    met = known.join(more.join(since, key).groupBy(*key).agg(*sums), key, "left")
    out = []
    for c in values:
        update = F.col(f"_u_{c}")
        value = F.when(update["_n"] > F.col("_n"), update[c]).otherwise(F.col(c))
        if c in numeric:
            value = F.when(F.col(f"_a_{c}").isNull(), value).otherwise(F.coalesce(value, F.lit(0)) + F.col(f"_a_{c}")).cast(rows.schema[c].dataType)
        out.append(value.alias(c))
    return met.select(*key, *out)

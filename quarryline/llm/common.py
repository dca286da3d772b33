"""What the corpus operators share: shared-folder staging and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline import staging

#: Bytes of text that one numpy pass handles; a longer single text makes its own pass.
PASS_BYTES = 1_000_000

ASCII_SPACE = bytes([9, 10, 11, 12, 13, 32])


def small_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches that Python workers get to a size that suits texts: whole documents come by the
    thousand, not by the ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``staging.stage`` whose rows then come to Python workers in small batches."""
    small_batches(df.sparkSession)
    return staging.stage(df, name)


def stage_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Cuts the lineage like ``stage``, but as a table in buckets by ``key``, one for each shuffle partition: a later
    join by the key alone leaves these rows where they are. Its files lie in the shared folder as well."""
    spark = df.sparkSession
    small_batches(spark)
    table = staging.new_table(spark, name)
    df.write.format("parquet").option("compression", "zstd").option("path", staging.new_path(spark, name)).bucketBy(shuffle_width(spark), key).saveAsTable(table)
    return spark.table(table)


def below(key: Column, share: float) -> Column:
    """Whether a 64-bit hash of the key lies in the lowest ``share`` of all; a share of any size is told apart."""
    return F.xxhash64(key) <= F.lit(-(1 << 63) + min(int(share * 2.0**64), (1 << 64) - 1))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as bytes and n + 1 offsets into them; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def passes(batch: pa.RecordBatch, text: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes, at least one row each."""
    if not batch.num_rows:
        return
    _, offs = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's root and of its inverse, modulo 2^64."""
    if len(_power["up"]) < n:
        size = 1 << max(n, PASS_BYTES).bit_length()
        for name, root in (("up", _ROOT), ("down", _BACK)):
            steps = np.full(size, root, np.uint64)
            steps[0] = 1
            _power[name] = np.cumprod(steps, dtype=np.uint64)
    return _power["up"][:n], _power["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums; span(h, s, e) hashes data[s:e] from them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_table(bytes_in_words: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(bytes_in_words)] = True
    return table


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over UTF-8 bytes, the latter after lower-casing A-Z.
NOT_SPACE = word_table(bytes(b for b in range(256) if b not in ASCII_SPACE))
ALNUM = word_table(bytes(b for b in range(256) if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789"))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and n + 1 offsets of the texts' words among them; no word crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offs[:-1][offs[:-1] < len(data)]
    begins[first] = inside[first]
    last = offs[1:][offs[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offs)


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; valid where k words follow in the same text."""
    n = max(0, len(word_hash) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word_hash[j : j + n]
    return mix(out)


def gram_rows(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each k-gram inside a text: its first word's number overall, and its text's number."""
    counts = np.maximum(np.diff(word_offs) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(word_offs[:-1], counts), text


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch's own columns in order, and new ones; a new name replaces a clashing old one."""
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(columns.values()), names=names + list(columns))

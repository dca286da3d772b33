"""Token-id output in plane-shuffled files, and its reader.

Texts are range-partitioned by doc_id, so that shards and the units within them follow ascending ids. A unit holds
whole documents, about UNIT_IDS ids. Its content is one binary image:

    8 bytes   magic "QLTOKEN1"
    24 bytes  three little-endian 64-bit integers: documents, ids, ids per block
    documents x (1 byte null flag, 8 bytes doc_id, 8 bytes number of ids), as three columns
    blocks x 4 x 2 x 8 bytes: the chunk index, offset and length of each byte plane of each block
    the planes, each compressed by zstandard

Block b holds ids b * size .. (b + 1) * size - 1 as 32-bit integers, transposed so that byte p of every id stands
in plane p; the upper planes of small ids shrink to almost nothing. The images are rows of a Parquet table
(shard, unit, n_docs, n_ids, content), whose committed write survives lost tasks and which any store can hold.

A null text counts as empty; every document ends with the end id, so it has at least one id. Equal ids order by a
hash of the text; a null doc_id comes first. Repeated rows are written, and read, once each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.llm.common import mix, passes, prefix_hash, shuffle_width, span, utf8
from quarryline.llm.unit_cache import HashedUnits

MAGIC = b"QLTOKEN1"
BLOCK_IDS = 65_536
UNIT_IDS = 1_000_000
END_ID = 0
#: Goes before the unit that starts a text; no text holds it. Units that the library gets as one text.
HEAD = "\ud800"
TOGETHER = 300
#: Bytes of a unit up to which its ids are kept under its hashes (long strings can be made to collide), the values of
#: bytes in the second hash, and what sets units apart that start a text.
LASTING = 256
SECOND = mix(np.arange(1, 257, dtype=np.uint64))
FIRST = np.uint64(0x5DEECE66D1234567)
END = np.array([END_ID], np.uint32)


def packed(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """The image of one unit."""
    squeeze = zstandard.ZstdCompressor(level=3)
    ids = ids.astype("<u4")
    planes, index, at = [], [], 0
    for b in range(0, len(ids), block):
        for plane in ids[b : b + block].view(np.uint8).reshape(-1, 4).T:
            planes.append(squeeze.compress(np.ascontiguousarray(plane).tobytes()))
            index += [at, len(planes[-1])]
            at += len(planes[-1])
    flags = bytes(d is None for d in doc_ids)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(counts, "<i8").tobytes()
    return MAGIC + struct.pack("<3q", len(doc_ids), len(ids), block) + flags + table + np.array(index, "<i8").tobytes() + b"".join(planes)


def unpacked(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids of a unit's image."""
    if image[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, total, block = struct.unpack_from("<3q", image, 8)
    at = 32
    flags = image[at : at + docs]
    doc_ids = np.frombuffer(image, "<i8", docs, at + docs)
    counts = np.frombuffer(image, "<i8", docs, at + 9 * docs)
    blocks = -(-total // block)
    index = np.frombuffer(image, "<i8", blocks * 8, at + 17 * docs).reshape(blocks, 4, 2)
    body = at + 17 * docs + blocks * 64
    ids = np.zeros((total, 4), np.uint8)
    expand = zstandard.ZstdDecompressor()
    for b in range(blocks):
        for p, (start, size) in enumerate(index[b]):
            plane = expand.decompress(image[body + start : body + start + size])
            ids[b * block : b * block + len(plane), p] = np.frombuffer(plane, np.uint8)
    return [None if f else int(d) for f, d in zip(flags, doc_ids, strict=True)], counts, ids.view("<u4").reshape(-1)


class Encoder:
    """Byte-level BPE by the tokenizers library as its file sets it up, without special tokens around the texts. No
    token of its pattern crosses from a character that isn't white space to a space before such a character, so
    texts are cut at spaces and each distinct unit is encoded once (known again by 128 bits of hashes). A text with other white space beside a space,
    with white space at its end, or with the text of an added token (``<|endoftext|>``) is encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        # Each character of a byte-level token stands for one byte.
        self.length = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.cache = HashedUnits(self._units)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has: none if it is empty or has white space at an end,
        as its text can't be cut there. HEAD goes before a unit that starts a text, a space before every other."""
        heads, tails = [], []
        for i, u in enumerate(units):
            own = u[1:] if u[:1] == HEAD else u
            if own and not own[0].isspace() and not own[-1].isspace():
                (tails if own is u else heads).append(i)
        counts, ids = [], []
        for own in self._whole([units[i][1:] for i in heads]):
            counts.append([len(own)])
            ids.append(own)
        for at in range(0, len(tails), TOGETHER):
            text = " " + " ".join([units[i] for i in tails[at : at + TOGETHER]])
            own = np.array(self._whole([text])[0], np.int64)
            raw = np.frombuffer(text.encode(), np.uint8)
            starts = np.searchsorted(np.cumsum(self.length[own]), np.flatnonzero(raw == 32), "right")
            counts.append(np.diff(starts, append=len(own)))
            ids.append(own)
        if not ids:
            return np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        at, ids, own = np.array(heads + tails), np.concatenate(ids), np.concatenate(counts)
        order = np.argsort(at, kind="stable")
        first = (np.cumsum(own) - own)[order]
        out = np.zeros(len(units), np.int64)
        out[at] = own
        own = own[order]
        return ids[np.arange(len(ids)) + np.repeat(first - (np.cumsum(own) - own), own)], out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the texts' numbers of ids."""
        data, offs = utf8(texts)
        image = data.tobytes()
        special = np.zeros(len(texts), bool)
        for added in self.added:
            at = image.find(added)
            while at >= 0:
                text = int(np.searchsorted(offs, at, "right")) - 1
                special[text] |= at + len(added) <= offs[text + 1]
                at = image.find(added, at + 1)
        # The first unit of each text that isn't empty, and one behind every space.
        spaces = np.flatnonzero(data == 32)
        full = np.flatnonzero(np.diff(offs) > 0)
        head = np.searchsorted(spaces, offs[full])
        start, end = np.insert(spaces + 1, head, offs[full]), np.insert(spaces, np.searchsorted(spaces, offs[full + 1]), offs[full + 1])
        head += np.arange(len(full))
        first = np.zeros(len(start), bool)
        first[head] = True
        sizes = np.zeros(len(texts), np.int64)
        sizes[full] = np.diff(np.append(head, len(start)))

        def text_of(at: np.ndarray) -> list[str]:
            return [(HEAD if f else "") + image[s:e].decode() for s, e, f in zip(start[at].tolist(), end[at].tolist(), first[at].tolist(), strict=True)]

        one = span(prefix_hash(data), start, end) ^ np.where(first, FIRST, np.uint64(0))
        two = span(prefix_hash(SECOND[data]), start, end)
        ids, counts = self.cache.lookup(one, two, end - start <= LASTING, text_of) if len(start) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(counts)])[upto]
        odd = np.flatnonzero((np.diff(np.concatenate([[0], np.cumsum(counts == 0)])[upto]) > 0) | special).tolist()
        whole = dict(zip(odd, self._whole([image[offs[i] : offs[i + 1]].decode() for i in odd]), strict=True))
        parts, totals = [], []
        for i in range(len(texts)):
            own = whole[i] if i in whole else ids[ends[i] : ends[i + 1]]
            parts += [np.asarray(own, np.uint32), END]
            totals.append(len(own) + 1)
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32), np.array(totals, np.int64)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, unit_ids: int = UNIT_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Encodes and writes the token files. ``tokenizer`` is a file that every executor has at that place."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order).drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, unit = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            image = packed(doc_ids, np.concatenate(counts), np.concatenate(ids), block_ids)
            n = sum(map(len, ids))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([unit], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([n], pa.int64()), pa.array([image], pa.binary())], names=["shard", "unit", "n_docs", "n_ids", "content"])

        for batch in batches:
            for part in passes(batch, "text", 500_000):
                found, n = code.encode(part.column("text"))
                doc_ids += part.column("doc_id").to_pylist()
                counts.append(n)
                ids.append(found)
                if sum(map(len, ids)) >= unit_ids:
                    yield done()
                    doc_ids, counts, ids, unit = [], [], [], unit + 1
        if doc_ids:
            yield done()

    rows.mapInArrow(run, "shard long, unit long, n_docs long, n_ids long, content binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(shard, unit, doc_id, before, n_tokens, ids_crc32) of every document in the files; before counts the ids of
    its unit that come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                doc_ids, counts, ids = unpacked(row.column("content")[0].as_py())
                ends = np.cumsum(counts)
                crc = [zlib.crc32(memoryview(ids[e - n : e])) for e, n in zip(ends, counts, strict=True)]
                same = [pa.array([row.column(c)[0].as_py()] * len(doc_ids), pa.int64()) for c in ("shard", "unit")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(doc_ids, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["shard", "unit", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path).select("shard", "unit", "content")
    return files.mapInArrow(run, "shard long, unit long, doc_id long, before long, n_tokens long, ids_crc32 long")


def unit_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, unit, first): the ids before each unit. Units add up within their shard; only shard sums meet."""
    units = spark.read.parquet(path).select("shard", "unit", "n_ids")
    before = (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("unit").rowsBetween(*before)), F.lit(0))
    shards = units.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0))
    return units.withColumn("inside", inside).join(shards.select("shard", base.alias("base")), "shard").select("shard", "unit", (F.col("base") + F.col("inside")).alias("first"))


def tokens_of(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens and ids_crc32 per document."""
    write_tokens(docs, tokenizer, path)
    spark = docs.sparkSession
    rows = read_documents(spark, path).join(unit_starts(spark, path), ["shard", "unit"])
    return rows.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

"""Document fingerprints: threshold-scaled sketches.

A sketch retains every hash of a text's shingles (five lower-cased words) that lies below a fixed fraction of the
hash space, so sketches of texts of any length can be merged by union and compared for containment.

The fraction is the whole hash space unless a smaller one is asked for, so likeness is exact by default; at a smaller
one, a text none of whose hashes lies below it retains its smallest hash.

A text of fewer than five words, but with one, has one shingle: all its words. A text without words, or null, has
an empty sketch, and no other has; two empty sketches are alike (1.0), and an empty sketch is unlike (0.0) every other. The next document is by ascending doc_id, null first; rows with equal ids order by a hash of the text.
Repeated rows each get a row. A single document is its own successor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import ALNUM, LOWER, PASS_BYTES, gram_rows, grams, passes, prefix_hash, shuffle_width, span, utf8, words

SHINGLE = 5
#: The retained fraction of the hash space is 1 / SCALED.
SCALED = 1


def sketches(texts: list[str], k: int = SHINGLE, scaled: int = SCALED) -> list[tuple[int, np.ndarray]]:
    """For each text: its number of shingles, and its retained hashes, sorted and distinct; one at least if it has a shingle."""
    out = []
    table = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    limit = np.uint64((1 << 64) // scaled - 1)
    for part in passes(table, "text"):
        data, offs = utf8(part.column("text"))
        data = LOWER[data]
        start, end, word_offs = words(data, offs, ALNUM)
        hashes = span(prefix_hash(data), start, end)
        at, text = gram_rows(word_offs, k)
        value = grams(hashes, k)[at]
        counts = np.bincount(text, minlength=len(offs) - 1)
        low = value <= limit
        starts = np.flatnonzero(counts)
        if len(starts):
            least = np.minimum.reduceat(value, np.searchsorted(text, starts))
            low |= value == np.repeat(least, counts[starts])
        bounds = np.searchsorted(text[low], np.arange(len(offs)))
        value = value[low]
        for i in range(len(offs) - 1):
            n = int(word_offs[i + 1] - word_offs[i])
            if 0 < n < k:
                one = grams(hashes[word_offs[i] : word_offs[i + 1]], n)
                out.append((1, one))
            else:
                out.append((int(counts[i]), np.unique(value[bounds[i] : bounds[i + 1]])))
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Containment of the smaller sketch in the larger."""
    small = min(len(a[1]), len(b[1]))
    if not small:
        return float(len(a[1]) == len(b[1]))
    return len(np.intersect1d(a[1], b[1], assume_unique=True)) / small


def written(sketch: tuple[int, np.ndarray], k: int = SHINGLE, scaled: int = SCALED) -> str:
    """shingle length, scale and shingle count, then the hashes as little-endian 64-bit integers in base64."""
    return f"{k}.{scaled}.{sketch[0]}." + base64.b64encode(sketch[1].astype("<u8").tobytes()).decode()


def with_next(docs: DataFrame) -> DataFrame:
    """Buckets of consecutive documents: (bucket, tail, doc_id, text, tie). Each bucket also has a tail row, the
    first document of the following bucket (the last bucket's: the very first document), for its last document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    n = 4 * shuffle_width(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n))).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.searchsorted(cuts, ids.fillna(0).to_numpy().astype(np.int64), "right")
        return pd.Series(np.where(known, at, 0))

    own = docs.withColumn("bucket", bucket_of("doc_id")).withColumn("tail", F.lit(False))
    heads = docs.filter(F.col("doc_id").isin([int(c) for c in cuts])).withColumn("bucket", bucket_of("doc_id") - 1).withColumn("tail", F.lit(True))
    first = docs.orderBy(F.col("doc_id").asc_nulls_first(), "tie").limit(1).withColumn("bucket", F.lit(len(cuts)).cast("long")).withColumn("tail", F.lit(True))
    rows = own.unionByName(heads).unionByName(first)
    order = ["bucket", "tail", F.col("doc_id").asc_nulls_first(), "tie"]
    return rows.repartition(shuffle_width(docs.sparkSession), "bucket").sortWithinPartitions(*order)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likeness and the next document's."""

    def one_pass(rows: list[tuple]) -> pa.RecordBatch:
        """rows: consecutive documents and, last, the one that only follows."""
        texts = [r[3] for r in rows]
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in pairs]
        own, changed = sketches(texts), sketches(edited)
        columns: list[list] = [[] for _ in range(7)]
        for (i, j), text, sketch in zip(pairs, edited, changed, strict=True):
            row = (rows[i][2], len(texts[i]), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), written(own[i]), written(sketch), likeness(own[i], sketch), likeness(own[i], own[j]))
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in passes(batch, "text"):
                held += zip(*(part.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True)
                if sum(len(r[3]) for r in held) >= PASS_BYTES // 2:
                    yield one_pass(held)
                    held = held[-1:]
        if held:
            yield one_pass(held)

    return with_next(docs).mapInArrow(run, OUT)

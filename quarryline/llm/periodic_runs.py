"""Periodic runs of words: stretches that repeat a period at least three times, found by power-of-two names.

After Karp, Miller and Rosenberg: level 0 names each word of a text, level k + 1 each window of 2^(k + 1) words by the
names of its two halves, so that two windows of one level are equal where their names are. Names are numbers from
sorted pairs; nothing is hashed, and words get theirs from their bytes in the same way, eight bytes at a time. Levels
end where a text repeats no window. How far two places agree then adds up over the levels from the top down.

A run of period q and length >= max(24, 3 q) holds a place i on a grid of step max(2 q, 24 - q), counted from the text's
first word, with i + q inside the run, too. So for every q all grid places are candidates: where the words at i and
i + q agree, the stretch extends to both sides as far as they do. One stretch found under several periods has the
smallest as its own, since a multiple of the period fits as well.

A text of n words has about n / 2 * ln(n) candidates; they, and the texts, are handled in slices, so memory grows with
the longest text's words alone, not with its candidates.

Rows: one per document, whatever repeats. A null or wordless text has no runs and collapses to the empty text. Other
columns aren't looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import NOT_SPACE, passes, utf8, words

SHORTEST = 24
TURNS = 3
#: Candidates that one slice holds.
SLICE = 500_000


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and how often each key occurs."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names.astype(np.int64), counts


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word; equal words have equal ones. Words are cut into eight bytes, which are named, then
    neighbouring names are named as pairs until one is left."""
    size = end - start
    pieces = (size + 7) // 8
    first = np.cumsum(pieces) - pieces
    padded = np.zeros(int(pieces.sum()) * 8, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    padded[np.repeat(first * 8, size) + inside] = data[np.repeat(start, size) + inside]
    names, _ = named(padded.view("<u8"))
    while len(pieces) and pieces.max() > 1:
        halves = (pieces + 1) // 2
        at = np.arange(int(halves.sum())) - np.repeat(np.cumsum(halves) - halves, halves)
        left = np.repeat(first, halves) + 2 * at
        lonely = 2 * at + 1 >= np.repeat(pieces, halves)
        right = np.where(lonely, 0, names[np.minimum(left + 1, len(names) - 1)] + 1)
        names, _ = named(names[left] * (len(names) + 2) + right)
        pieces, first = halves, np.cumsum(halves) - halves
    # The last piece is filled up with zeros, so the length belongs to the name.
    return named(names * (int(size.max(initial=0)) + 1) + size)[0]


def levels_of(names: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of windows by level, and where each text starts; texts are set apart by a name of their own, and no
    window's name occurs in two texts."""
    n = np.diff(offs)
    text = np.repeat(np.arange(len(n)), n)
    base = offs[:-1] + np.arange(len(n))
    x = np.full(len(names) + len(n), -1, np.int64)
    at = np.arange(len(names)) + text
    x[at] = text * (int(names.max(initial=0)) + 1) + names
    x[base + n] = x.max(initial=0) + 1 + np.arange(len(n))
    own, counts = named(x)
    levels, repeated = [own], counts[own] > 1
    while repeated.any():
        width = 1 << (len(levels) - 1)
        last = levels[-1]
        size = len(last) - width
        if size <= 0:
            break
        # A window occurs twice only if both its halves do; any other gets a name of its own at once.
        again = np.flatnonzero(repeated[:size] & repeated[width : width + size])
        found, counts = named(last[again] * (len(last) + 1) + last[again + width])
        twice = counts[found] > 1 if len(again) else np.zeros(0, bool)
        if not twice.any():
            break
        name = len(counts) + np.arange(size)
        name[again] = found
        repeated = np.zeros(size, bool)
        repeated[again] = twice
        # Names stay below the number of windows, as the next level multiplies them.
        levels.append(named(name)[0])
    return levels, base


def agree_right(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For how many words from i and from j on, i < j, the texts agree."""
    at = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        inside = j + at < len(names)
        a, b = np.where(inside, i + at, 0), np.where(inside, j + at, 0)
        at += np.where(inside & (names[a] == names[b]), 1 << k, 0)
    return at


def agree_left(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For how many words before i and before j, i < j, the texts agree."""
    at = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - at - (1 << k), j - at - (1 << k)
        inside = a >= 0
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        at += np.where(inside & (levels[k][a] == levels[k][b]), 1 << k, 0)
    return at


def candidates(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of all grid places, slice by slice."""
    periods = np.where(n >= SHORTEST, n // TURNS, 0)
    ends = np.cumsum(periods)
    for low in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        pair = np.arange(low, min(low + SLICE, int(ends[-1])))
        text = np.searchsorted(ends, pair, "right")
        q = pair - (ends - periods)[text] + 1
        step = np.maximum(2 * q, SHORTEST - q)
        count = -(-(n[text] - q) // step)
        upto = np.cumsum(count)
        at = 0
        while at < len(pair):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            c = count[at:end]
            place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(text[at:end], c), np.repeat(q[at:end], c), place * np.repeat(step[at:end], c)
            at = end


def runs_of(names: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Columns text, start, length, period of all runs, by text, start and period; starts count from 0 in each text."""
    n = np.diff(offs)
    levels, base = levels_of(names, offs)
    found = [np.zeros((4, 0), np.int64)]
    for text, q, place in candidates(n):
        i = base[text] + place
        same = np.flatnonzero(levels[0][i] == levels[0][i + q])
        text, q, i = text[same], q[same], i[same]
        left = agree_left(levels, i, i + q)
        length = left + q + agree_right(levels, i, i + q)
        long = np.flatnonzero(length >= np.maximum(SHORTEST, TURNS * q))
        found.append(first_of(np.stack([text, i - left - base[text], length, q])[:, long]))
    runs = first_of(np.concatenate(found, 1))
    return runs[:, np.lexsort((runs[3], runs[1], runs[0]))]


def first_of(runs: np.ndarray) -> np.ndarray:
    """Of one stretch's periods the smallest."""
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(0)
    return runs[:, new]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: a run's words behind its first period go."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
OUT = f"doc_id bigint, runs {RUNS}, collapsed string"


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, all runs of the text by start and period, and the text without their repetitions: the words that stay,
    joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                data, offs = utf8(part.column("text"))
                start, end, word_offs = words(data, offs, NOT_SPACE)
                text, first, length, period = runs_of(word_names(data, start, end), word_offs)
                edges = np.searchsorted(text, np.arange(part.num_rows + 1))
                image = data.tobytes()
                out = []
                for i, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    # Without an argument, bytes are split at the very white space that words leave out.
                    own = image[offs[i] : offs[i + 1]].split()
                    if low < high:
                        stays = kept_words(len(own), first[low:high], length[low:high], period[low:high])
                        own = [own[j] for j in np.flatnonzero(stays)]
                    out.append(b" ".join(own))
                runs = pa.StructArray.from_arrays([pa.array(c) for c in (first, length, period)], fields=fields)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, OUT)


def planted(docs: DataFrame) -> DataFrame:
    """Texts of which about a tenth, by their doc_id, turn periodic: with h = crc32 of the decimal doc_id and g = h // 10,
    where h % 10 = 0, word i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8). A null
    doc_id has no decimal form, so its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("w", F.when(h % 10 == 0, found)).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), turned), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared by products; of equals the first by start, then period."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def report(docs: DataFrame) -> DataFrame:
    """The planted texts' runs in figures and digests."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = collapse(planted(docs)).withColumn("best", strongest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Words of text without blanks, by a dictionary with frequencies: of all ways to cut a stretch into words, the most
probable one.

A stretch is a lattice: an edge for each dictionary word at each place, and one for each single character, which counts
once if the dictionary lacks it. A word's probability is its share of all frequencies, and the best path comes by dynamic
programming from the end. A dictionary of checked size is sent to all tasks; one beyond it lies in the shared folder,
from where each worker reads it once into arrays of some 64 bytes a word. There the stretches of many rows go together:
substrings of one length are looked up at once by rolling hashes, as far as some longer word begins alike, and compared by
their characters; then all stretches take one step of the programming at a time. Both give the same words, and shuffle
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources.commits import resolved
from quarryline.staging import new_path

#: Characters that the lattice cuts, by default; runs of other letters and digits are words as they stand.
HAN = r"\p{IsHan}"
#: Words up to which the dictionary is sent to all tasks, as many as some tens of megabytes.
MOST_WORDS = 500_000
#: Characters of the texts and of the stretches that go together, unless one alone has more; places that are looked up at
#: once; bits of the largest table of prefixes, a byte each.
TEXTS, TOGETHER, BLOCK, TABLE_BITS = 4_000_000, 1_000_000, 1 << 17, 26


def learned(texts: Column, rows: DataFrame) -> DataFrame:
    """(word, freq) of the words, arrays of strings, in a table; they are counted where they lie, then summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = pc.value_counts(batch.column(0).flatten()).flatten()
            yield pa.RecordBatch.from_arrays([words, times], names=["word", "freq"])

    return rows.select(texts.alias("words")).mapInArrow(run, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


def usable(words: DataFrame) -> DataFrame:
    """(word, freq) in lower case, one row a word with its highest frequency; nulls, empty words and frequencies below 1
    are left out, as a probability of 0 would be."""
    rows = words.select(F.lower("word").alias("word"), F.col("freq").cast("long").alias("freq")).filter("word <> '' AND freq >= 1")
    return rows.groupBy("word").agg(F.max("freq").alias("freq"))


def best_path(stretch: str, logs: Mapping[str, float], unknown: float, longest: int) -> list[str]:
    """The words of the most probable path; of equal ones, that with the longer word at the first place they differ."""
    n = len(stretch)
    score, step = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best, size = logs.get(stretch[i], unknown) + score[i + 1], 1
        for m in range(2, min(longest, n - i) + 1):
            own = logs.get(stretch[i : i + m])
            if own is not None and own + score[i + m] >= best:
                best, size = own + score[i + m], m
        score[i], step[i] = best, size
    out, i = [], 0
    while i < n:
        out.append(stretch[i : i + step[i]])
        i += step[i]
    return out


def stretches(text: Column, within: str = HAN) -> Column:
    """(s, cut) in order: runs of characters that the lattice cuts, and of other letters and digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:{within})+|(?:(?!{within})[\p{{L}}\p{{N}}])+"), F.lit(0))
    return F.transform(runs, lambda s: F.struct(s.alias("s"), s.rlike(f"^(?:{within})").alias("cut")))


def segmented(rows: DataFrame, key: str, text: str, words: DataFrame, within: str = HAN, most: int = MOST_WORDS, keep: tuple[str, ...] = (), then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """(key, words, those to keep) of rows with distinct keys: the words of each text, in order; none for a null text.
    ``words`` has word and freq, for which see ``usable``; with an empty one each character is a word. ``then`` makes
    other columns of a batch of these, with their types, in the task that cut it, so that words needn't leave it."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "dictionary")
    usable(words).write.parquet(path)
    listed = spark.read.schema("word string, freq long").parquet(path)
    n, total, longest = listed.agg(F.count("*"), F.coalesce(F.sum("freq"), F.lit(1)), F.coalesce(F.max(F.char_length("word")), F.lit(1))).first()
    unknown = -math.log(total)
    own = rows.select(key, *keep, stretches(F.coalesce(F.col(text), F.lit("")), within).alias("_runs"))
    types = dict(own.dtypes)
    out = ", ".join([f"`{key}` {types[key]}", "words array<string>", *(f"`{c}` {types[c]}" for c in keep)])
    done, out = then or ((lambda batch: batch), out)
    if n > most:
        return own.mapInArrow(_held(path, total, key, keep, done), out)
    logs = spark.sparkContext.broadcast({r.word: math.log(r.freq) + unknown for r in listed.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = logs.value
        for batch in batches:
            found = [[w for r in runs for w in (best_path(r["s"], known, unknown, longest) if r["cut"] else [r["s"]])] for runs in batch.column("_runs").to_pylist()]
            yield done(pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.string())), *(batch.column(c) for c in keep)], names=[key, "words", *keep]))

    return own.mapInArrow(run, out)


#: The base of hashes that grow by a character; what spreads a character's bits.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: What a slot of the table says: a word has this hash, or the beginning of a longer one.
WORD, MORE = np.uint8(1), np.uint8(2)


def mixed(points: np.ndarray) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(31))) * MIX
    return (x ^ (x >> np.uint64(29))) * BASE


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Dictionary:
    """Words as arrays, by length: hashes in order, where those of equal first bits begin, logarithms of shares, and
    characters."""

    def __init__(self, files: list[str], store: fs.FileSystem, total: int):
        self.unknown, parts = -math.log(total), {}
        for file in files:
            with store.open_input_file(file) as source:
                for batch in pq.ParquetFile(source).iter_batches(columns=["word", "freq"]):
                    sizes = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
                    own = batch.take(pa.array(np.argsort(sizes, kind="stable")))
                    letters = code_points("".join(own.column("word").to_pylist()))
                    letters = letters.astype(np.min_scalar_type(letters.max(initial=0)))
                    found, back = np.unique(own.column("freq").to_numpy(), return_inverse=True)
                    logs, at, low = np.array([math.log(f) for f in found.tolist()])[back] + self.unknown, 0, 0
                    for m, n in zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True):
                        parts.setdefault(m, []).append((letters[low : low + n * m].reshape(n, m).T, logs[at : at + n]))
                        at, low = at + n, low + n * m
        self.words, n = {}, sum(x.size for p in parts.values() for x, _ in p)
        self.shift = np.uint64(64 - min(max(n.bit_length(), 8), TABLE_BITS))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.uint8)
        self.longest = max(parts, default=1)
        for m in sorted(parts):
            letters, logs = (np.concatenate(c, axis=-1) for c in zip(*parts.pop(m), strict=True))
            key, bits = np.zeros(len(logs), np.uint64), len(logs).bit_length()
            for i in range(m):
                key = key * BASE + mixed(letters[i])
                self.table[key >> self.shift] |= MORE if i + 1 < m else WORD
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
            # Behind the last hash stands the largest of all.
            self.words[m] = np.append(key, np.uint64(2**64 - 1)), first, np.uint64(64 - bits), logs[order], letters[:, order]

    def found(self, text: np.ndarray, at: np.ndarray, key: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places those where a word of this length begins, and its logarithm."""
        keys, first, shift, logs, letters = self.words[m]
        low = first[key >> shift].astype(np.int64)
        behind = np.flatnonzero(keys[low] < key)
        while len(behind):
            low[behind] += 1
            behind = behind[keys[low[behind]] < key[behind]]
        places, values = [], []
        # Words of one hash lie side by side; characters decide.
        while len(at):
            same = (keys[low] == key) & (low < len(logs))
            at, low, key = at[same], low[same], key[same]
            equal = np.ones(len(at), bool)
            for i in range(m):
                equal &= letters[i][low] == text[at + i]
            places.append(at[equal])
            values.append(logs[low[equal]])
            at, low, key = at[~equal], low[~equal] + 1, key[~equal]
        return (np.concatenate(places), np.concatenate(values)) if places else (at, np.zeros(0))

    def edges(self, text: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, places and logarithms of the words in a text; those of one place come by length. ``left`` says how many
        characters a word may take."""
        n = len(text)
        spread = np.concatenate([mixed(text), np.zeros(self.longest, np.uint64)])
        for block in range(0, n, BLOCK):
            at = np.arange(block, min(block + BLOCK, n))
            key = np.zeros(len(at), np.uint64)
            for m in range(1, self.longest + 1):
                key *= BASE
                key += spread[at + (m - 1)]
                says = self.table[key >> self.shift]
                if m in self.words:
                    likely = np.flatnonzero(says & WORD)
                    likely = likely[left[at[likely]] >= m]
                    if len(likely):
                        yield m, *self.found(text, at[likely], key[likely], m)
                on = np.flatnonzero(says & MORE)
                if not len(on):
                    break
                at, key = at[on], key[on]


def best_paths(text: np.ndarray, sizes: np.ndarray, words: Dictionary) -> tuple[list[int], list[int]]:
    """What ``best_path`` gives for stretches that lie in a text one behind the other, longest first: the lengths of all
    words, and how many words each stretch has. A step takes the places that are equally far from their stretches' ends:
    of all stretches together they are numbered by that distance, then by stretch."""
    starts = np.cumsum(sizes) - sizes
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(text))
    width = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) + 1))
    width[0] = len(sizes)
    begins = np.cumsum(width) - width
    number = begins[left] + stretch
    distance = np.repeat(np.arange(len(width)), width)
    found = list(words.edges(text, left))
    count = np.ones(len(text) + len(sizes), np.int64)
    count[: len(sizes)] = 0
    for m, at, _ in found:
        if m > 1:
            count[number[at]] += 1
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    value, to = np.full(first[-1], words.unknown), np.zeros(first[-1], np.int32)
    to[first[number]] = begins[left - 1] + stretch
    free = first[:-1] + 1
    for m, at, logs in found:
        place = number[at]
        slot = first[place] if m == 1 else free[place]
        value[slot] = logs
        if m > 1:
            to[slot] = begins[left[at] - m] + stretch[at]
            free[place] += 1
    del found
    score = np.zeros(len(count))
    bounds, edge = begins.tolist() + [len(count)], first[np.append(begins, len(count))].tolist()
    for k in range(1, len(width)):
        low, high = bounds[k], bounds[k + 1]
        a, b = edge[k], edge[k + 1]
        np.maximum.reduceat(value[a:b] + score[to[a:b]], first[low:high] - a, out=score[low:high])
    # Of the best edges of a place the last is the longest.
    best = np.flatnonzero(value + score[to] == np.repeat(score, count))
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)[best]
    chosen = np.zeros(len(count), np.int64)
    chosen[owner] = best
    step = (left - distance[to[chosen[number]]]).tolist()
    out, each, i = [], [], 0
    for end in (starts + sizes).tolist():
        before = len(out)
        while i < end:
            m = step[i]
            out.append(m)
            i += m
        each.append(len(out) - before)
    return out, each


def _cut(runs: pa.ListArray, words: Dictionary) -> pa.ListArray:
    """Lists of (s, cut) to lists of words."""
    offsets = runs.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    texts, cut = (runs.flatten().field(c) for c in ("s", "cut"))
    sizes, cut = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), cut.to_numpy(zero_copy_only=False)
    data = "".join(texts.to_pylist())
    points, starts = code_points(data), np.cumsum(sizes) - sizes
    lengths: list = [[n] for n in sizes.tolist()]
    # Stretches by length, so that those which go together end together.
    order = np.flatnonzero(cut)
    order = order[np.argsort(-sizes[order], kind="stable")]
    together = (np.cumsum(sizes[order]) - 1) // TOGETHER
    for part in np.split(order, np.flatnonzero(np.diff(together)) + 1):
        if len(part):
            text = np.concatenate([points[starts[i] : starts[i] + sizes[i]] for i in part])
            out, each = best_paths(text, sizes[part], words)
            at = 0
            for i, n in zip(part.tolist(), each, strict=True):
                lengths[i] = out[at : at + n]
                at += n
    number = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in lengths], dtype=np.int64)])
    ends = np.cumsum(np.fromiter(chain.from_iterable(lengths), np.int64, number[-1]))
    at, encoded = np.concatenate([np.zeros(1, np.int64), ends]), data.encode()
    if len(encoded) > len(points):
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(width, dtype=np.int64)])[at]
    found = pa.StringArray.from_buffers(len(ends), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(encoded))
    return pa.ListArray.from_arrays(pa.array(number[offsets].astype(np.int32)), found)


#: The dictionary that this worker has read last, by its folder.
_read: dict[str, Dictionary] = {}


def _held(path: str, total: int, key: str, keep: tuple[str, ...], done: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same by a dictionary that workers read from the shared folder; it doesn't pass through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _read:
            store, root = resolved(path)
            _read.clear()
            _read[path] = Dictionary([f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".parquet")], store, total)
        for batch in batches:
            runs = batch.column("_runs")
            sizes = np.concatenate([[0], np.cumsum(pc.utf8_length(runs.flatten().field("s")).to_numpy(zero_copy_only=False), dtype=np.int64)])
            ends = sizes[runs.offsets.to_numpy()[1:] - runs.offsets[0].as_py()]
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXTS, "right")))
                part, low = batch.slice(low, high - low), high
                yield done(pa.RecordBatch.from_arrays([part.column(key), _cut(part.column("_runs"), _read[path]), *(part.column(c) for c in keep)], names=[key, "words", *keep]))

    return run

"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Removes each byte that lies in a string of LENGTH bytes which also starts earlier (a smaller doc_id, or the same
document and an earlier start), judged on the input. Which strings repeat is decided at anchors:

1. In every string of LENGTH bytes the smallest hash among its GRAM-byte substrings is an anchor, so equal strings
   have equal anchors at equal places. Anchors whose substring occurs once in the corpus are dropped: tasks send
   one row per substring and task to the substring's bucket.
2. At the remaining anchors each task sorts the suffixes (LENGTH bytes), splits its run at sampled splitters and
   sends it front-coded. A loser tree, which keeps for each run the prefix it shares with the last output and
   compares only behind it, merges the runs of a range into one suffix array with common-prefix lengths.
3. Strings that start o bytes before an anchor agree iff their suffixes share LENGTH - o bytes, a stretch of the
   suffix array, and the o bytes before agree. The earliest of each such class stays; the others are covered.

Hashes only propose classes: their members' bytes are compared, and where two strings have one hash the strings
themselves name the classes. Equal contexts meet within a task first, so a passage that fills the corpus costs one row per task. A substring
that holds more than HOT times a range's share of the sample, in ever different contexts, would still fill one
range: its anchors send every string around them as a suffix of its own, dealt by hash.

A null or short text is left whole; a null doc_id is smaller than any other. Rows that share an id but not a text
order by a hash of the text. Rows repeated whole count as one document and get equal results. Kept bytes
may end inside a character; ``deduplicated`` drops such fragments when it writes texts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import gram_rows, mix, passes, prefix_hash, powers, shuffle_width, span, stage, stage_buckets, utf8

LENGTH = 100
GRAM = 40
#: Anchors sampled for the splitters (expected number; at least so many, and so many a range), anchors that a range
#: holds at most on average, and the share of a range from which a substring is dealt by hash.
SAMPLE, SAMPLE_PER_RANGE, RANGE_ANCHORS, HOT = 20_000, 10, 400_000, 3.0
RUN_RECORDS = 60_000
NULL_ID = -(1 << 63)


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors in ``data``, their texts and the hashes of their substrings."""
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    prefix = prefix_hash(data)
    value = mix((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][: len(prefix) - gram])
    bits = np.uint64((1 << max(20, len(value).bit_length())) - 1)
    key = (value & ~bits) | np.arange(len(value), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    start, _ = gram_rows(offs, length)
    least = np.minimum(after[start], upto[start + width - 1]) & bits
    place = least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64) if len(least) else none
    return place, np.searchsorted(offs, place, "right") - 1, value[place]


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def bucketwise(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other, from batches sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repeated_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, pos) of the anchors whose substring occurs more than once."""
    n = shuffle_width(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", 500_000):
                data, offs = utf8(part.column("text"))
                place, text, value = anchors(data, offs, length, gram)
                if not len(place):
                    continue
                doc, pos = ids_of(part)[text], (place - offs[text]).astype(np.int32)
                order = np.argsort(value, kind="stable")
                new = np.concatenate([[True], value[order][1:] != value[order][:-1]])
                counts = np.diff(np.concatenate([np.flatnonzero(new), [len(new)]]))
                first, others = order[new], order[~new]
                bucket = (value[first] % np.uint64(n)).astype(np.int64)
                sent = np.lexsort((first, bucket))
                first, bucket, many = first[sent], bucket[sent], (counts > 1)[sent]
                cuts = np.searchsorted(bucket, np.arange(n + 1))
                used = [b for b in range(n) if cuts[b] < cuts[b + 1]]
                pick = [slice(cuts[b], cuts[b + 1]) for b in used]
                columns = [
                    [value[first[s]].tobytes() for s in pick], [many[s].tobytes() for s in pick],
                    [doc[first[s]].tobytes() for s in pick], [pos[first[s]].tobytes() for s in pick],
                ]
                if len(others):  # known to be repeated: they only travel along, dealt out evenly
                    others.sort()
                    used.append(int(value[0] % np.uint64(n)))
                    for c, v in zip(columns, (b"", b"", doc[others].tobytes(), pos[others].tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "keys", "many", "docs", "pos"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucketwise(batches):
            own = [r for r in rows if r["keys"]]
            key, many, doc, pos = (np.concatenate([np.frombuffer(r[c], t) for r in own] or [np.zeros(0, t)]) for c, t in (("keys", np.uint64), ("many", bool), ("docs", np.int64), ("pos", np.int32)))
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
            counts = np.diff(np.concatenate([np.flatnonzero(new), [len(new)]]))
            keep = order[(np.repeat(counts, counts) > 1) | many[order]]
            known = [r for r in rows if not r["keys"]]
            docs_out = np.concatenate([doc[keep], *(np.frombuffer(r["docs"], np.int64) for r in known)])
            pos_out = np.concatenate([pos[keep], *(np.frombuffer(r["pos"], np.int32) for r in known)])
            for at in range(0, len(docs_out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(docs_out[at : at + 50_000]), pa.array(pos_out[at : at + 50_000])], names=["doc_id", "pos"])

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket int, keys binary, many binary, docs binary, pos binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id long, pos int")


class Records:
    """Anchors with their contexts, as columns; suffix and before are matrices of bytes, the latter nearest first."""

    COLUMNS = ("suffix", "suffix_size", "before", "before_size", "doc", "tag", "pos", "context")

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.pos)

    def take(self, at: np.ndarray) -> Records:
        return Records(**{c: getattr(self, c)[at] for c in self.COLUMNS})

    @classmethod
    def joined(cls, parts: list[Records]) -> Records:
        return cls(**{c: np.concatenate([getattr(p, c) for p in parts]) for c in cls.COLUMNS})

    def plain(self) -> Records:
        """Only the strings that start at the places: nothing before them counts."""
        self.before, self.before_size = np.zeros_like(self.before), np.zeros_like(self.before_size)
        self.context = mix(string_hash(self.suffix))
        return self

    @classmethod
    def at(cls, data: np.ndarray, offs: np.ndarray, place: np.ndarray, text: np.ndarray, doc: np.ndarray, tag: np.ndarray, length: int, before: int) -> Records:
        low, high = np.maximum(offs[text], place - before), np.minimum(offs[text + 1], place + length)
        ahead = place[:, None] + np.arange(length)
        behind = place[:, None] - 1 - np.arange(before)
        suffix = np.where(ahead < high[:, None], data[np.minimum(ahead, len(data) - 1)], 0).astype(np.uint8)
        back = np.where(behind >= low[:, None], data[np.maximum(behind, 0)], 0).astype(np.uint8)
        context = mix(span(prefix_hash(data), low, high) + ((place - low) * 1_000_003 + (high - place)).astype(np.uint64))
        sizes = (high - place).astype(np.uint8), (place - low).astype(np.uint8)
        return cls(suffix=suffix, suffix_size=sizes[0], before=back, before_size=sizes[1], doc=doc[text], tag=tag[text], pos=(place - offs[text]).astype(np.int32), context=context)


def ranks(r: Records) -> np.ndarray:
    """Order by document and place; equal for rows repeated whole."""
    order = np.lexsort((r.pos, r.tag, r.doc))
    same = np.ones(len(r), bool)
    for c in (r.doc, r.tag, r.pos):
        same[1:] &= c[order][1:] == c[order][:-1]
    out = np.zeros(len(r), np.int64)
    out[order] = np.cumsum(~same[: len(r)]) if len(r) else 0
    return out


def later_copies(key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each key by rank, those that come after it, and for each of those the first."""
    order = np.lexsort((rank, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = order[new]
    heads = np.repeat(first, np.diff(np.concatenate([np.flatnonzero(new), [len(key)]])))
    later = rank[order] > rank[heads]
    return first, order[later], heads[later]


def covered_rows(r: Records, least: np.ndarray, most: np.ndarray, length: int) -> pa.RecordBatch:
    """(doc_id, tag, low, high): the bytes in strings that start least .. most bytes before each anchor. Neighbouring
    anchors' rows merge where they touch."""
    low, high = r.pos.astype(np.int64) - most, r.pos.astype(np.int64) - least + length
    order = np.lexsort((low, r.tag, r.doc))
    doc, tag, low, high = r.doc[order], r.tag[order], low[order], high[order]
    if len(low):
        new = np.ones(len(low), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (low[1:] > high[:-1])
        at = np.flatnonzero(new)
        high = np.maximum.reduceat(high, at)
        doc, tag, low = doc[at], tag[at], low[at]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(low), pa.array(high), *[pa.nulls(len(doc), t) for t in (pa.int32(), pa.binary())]], names=["doc_id", "tag", "low", "high", "bucket", "run"])


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def front_coded(r: Records) -> bytes:
    """A sorted run: each suffix without what it shares with the one before."""
    shared = shared_prefix(r.suffix).astype(np.uint8)
    rest = r.suffix[np.arange(r.suffix.shape[1])[None, :] >= shared[:, None]]
    columns = (shared, rest, r.suffix_size, r.before, r.before_size, r.doc, r.tag, r.pos)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<qq", len(r), len(rest)) + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def decoded(image: bytes, length: int, before: int) -> tuple[Records, np.ndarray]:
    image = zstandard.ZstdDecompressor().decompress(image)
    n, size = struct.unpack_from("<qq", image)
    at = 16

    def take(dtype: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, dtype, count, at)
        at += out.nbytes
        return out

    shared, rest = take(np.uint8, n).astype(np.int64), take(np.uint8, size).tobytes()
    suffix_size, back, before_size = take(np.uint8, n), take(np.uint8, n * before).reshape(n, before), take(np.uint8, n)
    doc, tag, pos = take(np.int64, n), take(np.int64, n), take(np.int32, n)
    rows, last, place = [], b"", 0
    for s in shared.tolist():
        last = last[:s] + rest[place : place + length - s]
        place += length - s
        rows.append(last)
    suffix = np.frombuffer(b"".join(rows), np.uint8).reshape(n, length)
    return Records(suffix=suffix, suffix_size=suffix_size, before=back, before_size=before_size, doc=doc, tag=tag, pos=pos, context=np.zeros(n, np.uint64)), shared


def merged_runs(runs: list[tuple[list[bytes], list[int]]], length: int) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs of strings of one length, given with each string's prefix shared with the one before.
    Returns for each output its run, its place in the run and the prefix it shares with the output before.

    A loser tree. shared[r] is what the head of run r shares with the last string that beat it, so of two heads
    that lost to the same string the one that shares more is smaller, and only equal lengths need a comparison,
    which starts behind what both share."""
    size = 1
    while size < len(runs):
        size *= 2
    strings = [r[0] for r in runs] + [[]] * (size - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (size - len(runs))
    head = [0] * size
    shared = [0 if s else -1 for s in strings]  # -1: exhausted

    def beats(a: int, b: int) -> bool:
        """Whether a's head comes before b's; the loser learns what it shares with the winner."""
        have = shared[a]
        if have != shared[b]:
            return have > shared[b]
        if have < 0:
            return True
        x, y = strings[a][head[a]], strings[b][head[b]]
        gap = int.from_bytes(x[have:], "big") ^ int.from_bytes(y[have:], "big")
        if not gap:
            shared[max(a, b)] = length
            return a < b
        meet = length - (gap.bit_length() + 7) // 8
        won = x[meet] < y[meet]
        shared[b if won else a] = meet
        return won

    loser = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        won = beats(a, b)
        loser[node] = b if won else a
        return a if won else b

    winner = play(1)
    run, index, common = [], [], []
    while shared[winner] >= 0:
        run.append(winner)
        index.append(head[winner])
        common.append(shared[winner])
        head[winner] += 1
        shared[winner] = prefixes[winner][head[winner]] if head[winner] < len(strings[winner]) else -1
        node = (winner + size) // 2
        while node:
            other = loser[node]
            if beats(other, winner):
                loser[node], winner = winner, other
            node //= 2
    return run, index, common


def repeated_strings(r: Records, shared: np.ndarray, length: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over a suffix array: the records with a later copy of a string around them, and the least and the most bytes
    before the anchor at which such strings start. (All between them are bytes of such strings, too: the strings
    are longer than the places are apart.)"""
    n = len(r)
    rank = ranks(r)
    least, most = np.full(n, length + 1, np.int64), np.full(n, -1, np.int64)
    behind = np.zeros(n, np.uint64)
    for o in range(before + 1):
        if o:
            behind = mix(behind + r.before[:, o - 1].astype(np.uint64) + np.uint64(o * 257))
        need = length - o
        same = shared >= need
        near = same.copy()
        near[:-1] |= same[1:]
        at = np.flatnonzero(near & (r.before_size >= o) & (r.suffix_size >= need))
        if len(at):
            stretch = np.cumsum(~same)
            _, later, heads = later_copies(mix(behind[at] + stretch[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), rank[at])
            later, heads = at[later], at[heads]
            if (stretch[later] != stretch[heads]).any() or (r.before[later, :o] != r.before[heads, :o]).any():
                # Different strings with one hash: name the classes by the strings themselves.
                strings = np.concatenate([stretch[at].astype(">i8").view(np.uint8).reshape(len(at), 8), r.before[at, :o]], 1)
                later = at[later_copies(np.unique(strings, axis=0, return_inverse=True)[1].ravel(), rank[at])[1]]
            least[later] = np.minimum(least[later], o)
            most[later] = np.maximum(most[later], o)
    hit = np.flatnonzero(most >= 0)
    return hit, least[hit], most[hit]


def string_view(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def splitters(marked: DataFrame, least: int, gram: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many ranges of suffixes there are (as many as hold RANGE_ANCHORS each, ``least`` at least), the bounds
    between them, and hashes of the substrings too frequent for one range."""
    total = marked.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(least, -(-total // RANGE_ANCHORS))
    wanted = max(SAMPLE, SAMPLE_PER_RANGE * parts)
    limit = np.uint64((1 << 64) - 1 if total <= wanted else (wanted << 64) // total)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", 500_000):
                data, offs = utf8(part.column("text"))
                place, text = places(part, offs)
                pick = mix(mix(ids_of(part)[text].astype(np.uint64)) + (place - offs[text]).astype(np.uint64)) <= limit
                place = place[pick]
                rows = data[place[:, None] + np.arange(gram)] if len(place) else np.zeros((0, gram), np.uint8)
                hashes = span(prefix_hash(data), place, place + gram).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(hashes)], names=["gram", "hash"])

    rows = marked.select("doc_id", "text", "places").mapInArrow(sample, "gram binary, hash long").collect()
    if not rows:
        return parts, np.zeros(0, f"S{gram}"), np.zeros(0, np.int64)
    hashes, counts = np.unique(np.array([r.hash for r in rows], np.int64), return_counts=True)
    hot = hashes[counts > max(20, HOT * len(rows) / parts)]
    own = np.sort(string_view(np.frombuffer(b"".join(bytes(r.gram) for r in rows), np.uint8).reshape(-1, gram)))
    return parts, np.unique(own[np.arange(1, parts) * len(own) // parts]), hot


def places(part: pa.RecordBatch, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    column = part.column("places")
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(part.num_rows), counts)
    return offs[text] + column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), text


def covered(marked: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tag, low, high): stretches of repeated bytes, possibly overlapping. ``marked`` has doc_id, tag,
    text and places, the repeated anchors."""
    if length > 255:
        raise ValueError("strings of over 255 bytes don't fit the records' sizes")
    before = length - gram
    parts, bounds, hot = splitters(marked, shuffle_width(marked.sparkSession), gram)
    schema = "doc_id long, tag long, low long, high long, bucket int, run binary"

    def flush(held: list[Records], exploded: bool) -> Iterator[pa.RecordBatch]:
        r = Records.joined(held)
        first, later, heads = later_copies(r.context, ranks(r))
        same = (r.suffix[later] == r.suffix[heads]).all(1) & (r.before[later] == r.before[heads]).all(1)
        same &= (r.suffix_size[later] == r.suffix_size[heads]) & (r.before_size[later] == r.before_size[heads])
        # Other contexts with one hash go on as records of their own.
        first, later = np.concatenate([first, later[~same]]), later[same]
        copies = r.take(later)
        least = np.maximum(0, length - copies.suffix_size.astype(np.int64))
        most = copies.before_size.astype(np.int64)
        fits = least <= most
        yield covered_rows(copies.take(np.flatnonzero(fits)), least[fits], most[fits], length)
        r = r.take(first)
        r = r.take(np.argsort(string_view(r.suffix), kind="stable"))
        if exploded:
            bucket = (r.context % np.uint64(parts)).astype(np.int64) + parts
        else:
            bucket = np.searchsorted(bounds, string_view(r.suffix[:, :gram]), "right")
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(2 * parts + 1))
        used = [b for b in range(2 * parts) if cuts[b] < cuts[b + 1]]
        runs = [front_coded(r.take(order[cuts[b] : cuts[b + 1]])) for b in used]
        empty = [pa.nulls(len(used), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), pa.array(runs, pa.binary())], names=["doc_id", "tag", "low", "high", "bucket", "run"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Records] = []
        hot_held: list[Records] = []
        for batch in batches:
            for part in passes(batch, "text", 250_000):
                data, offs = utf8(part.column("text"))
                place, text = places(part, offs)
                if not len(place):
                    continue
                doc, tag = ids_of(part), part.column("tag").to_numpy(zero_copy_only=False)
                busy = np.isin(span(prefix_hash(data), place, place + gram).view(np.int64), hot)
                if busy.any():
                    start = (place[busy][:, None] - np.arange(before + 1)).ravel()
                    owner = np.repeat(text[busy], before + 1)
                    inside = (start >= offs[owner]) & (start + length <= offs[owner + 1])
                    start, at = np.unique(start[inside], return_index=True)
                    owner = owner[inside][at]
                    for i in range(0, len(start), 4000):
                        hot_held.append(Records.at(data, offs, start[i : i + 4000], owner[i : i + 4000], doc, tag, length, before).plain())
                        if sum(map(len, hot_held)) >= RUN_RECORDS:
                            yield from flush(hot_held, True)
                            hot_held = []
                held.append(Records.at(data, offs, place[~busy], text[~busy], doc, tag, length, before))
                if sum(map(len, held)) >= RUN_RECORDS:
                    yield from flush(held, False)
                    held = []
        if held:
            yield from flush(held, False)
        if hot_held:
            yield from flush(hot_held, True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucketwise(batches):
            runs = [decoded(x["run"], length, before) for x in rows]
            r = Records.joined([x for x, _ in runs])
            first = np.cumsum([0, *(len(x) for x, _ in runs)])
            strings = [string_list(x.suffix) for x, _ in runs]
            run, index, common = merged_runs([(s, c.tolist()) for s, (_, c) in zip(strings, runs, strict=True)], length)
            r = r.take(first[np.array(run, np.int64)] + np.array(index, np.int64))
            hit, least, most = repeated_strings(r, np.array(common, np.int64), length, before)
            if len(hit):
                yield covered_rows(r.take(hit), least, most, length)

    sent = stage(marked.select("doc_id", "tag", "text", "places").mapInArrow(send, schema), "suffix-runs")
    local = sent.filter("run IS NULL").select("doc_id", "tag", "low", "high")
    runs = sent.filter("run IS NOT NULL").select("bucket", "run").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return local.unionByName(runs.mapInArrow(meet, schema).select("doc_id", "tag", "low", "high"))


def string_list(rows: np.ndarray) -> list[bytes]:
    image, n = rows.tobytes(), rows.shape[1]
    return [image[i : i + n] for i in range(0, len(image), n)]


def string_hash(rows: np.ndarray) -> np.ndarray:
    value = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        value = value * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64) + np.uint64(1)
    return value


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id long, text string, perhaps _others) in two parts: those with repeated anchors,
    with ``stretches``, an array of (low, high) byte offsets of repeated text, possibly overlapping, or null; and
    the rest, which repeat nothing. Unless ``whole``, the rest come without text but with n_bytes and sha256.

    The texts are shuffled once, to the places of their anchors, and kept in buckets by id: the stretches, which
    are small, come to them there."""
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumns({"tag": F.xxhash64(text), "_key": F.coalesce("doc_id", F.lit(NULL_ID))})
    found = repeated_anchors(docs, length, gram).groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    joined = docs.join(found.withColumnRenamed("doc_id", "_key"), "_key", "left")
    fits = F.filter("places", lambda p: p + gram <= F.octet_length(text))  # another text with the same id may have more
    joined = joined.withColumn("places", F.when(F.size(fits) > 0, fits))
    if not whole:
        clean = F.col("places").isNull()
        joined = joined.withColumns({"n_bytes": F.octet_length(text).cast("long"), "sha256": F.when(clean, F.sha2(text, 256)), "text": F.when(~clean, F.col("text"))})
    joined = stage_buckets(joined, "suffix_marked", "_key")
    marked = joined.filter("places IS NOT NULL")
    item = F.struct("tag", "low", "high")
    spans = covered(marked, length, gram).groupBy(F.col("doc_id").alias("_key")).agg(F.collect_list(item).alias("_all"))
    hit = marked.join(spans, "_key", "left").withColumn("stretches", F.filter("_all", lambda x: x["tag"] == F.col("tag")))
    rest = joined.filter("places IS NULL")
    return hit.select(*names, "stretches"), rest.select(*names) if whole else rest.select("doc_id", "n_bytes", "sha256")


def cut(raw: bytes, stretches: list[dict] | None) -> tuple[bytes, int]:
    """What remains of a text, and how many maximal runs went."""
    kept, at, runs, upto = [], 0, 0, -1
    for s in sorted(stretches or [], key=lambda s: s["low"]):
        if s["low"] > upto:
            kept.append(raw[at : s["low"]])
            runs += 1
        upto = max(upto, s["high"])
        at = upto
    return b"".join([*kept, raw[at:]]), runs


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                out = [cut(t, s) for t, s in zip(raw, part.column("stretches").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array([len(t) - len(k) for t, (k, _) in zip(raw, out, strict=True)], pa.int64()),
                    pa.array([n for _, n in out], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in out]),
                ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    hit, rest = with_spans(docs, length, gram, whole=False)
    none = F.lit(0).cast("long")
    clean = rest.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    return hit.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(clean)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` with repeated bytes cut from their texts, and n_chars, if there, set anew. Pieces of
    characters that a cut leaves go, too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # The other columns travel as one, so that their names clash with none of those used here.
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("_others"))
    hit, rest = with_spans(packed, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                texts = [t if t is None or not s else cut(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(part.column("text").to_pylist(), part.column("stretches").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("_others")], names=["doc_id", "text", "_others"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    out = hit.mapInArrow(run, schema).unionByName(rest)
    columns = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in others else {}
    return out.select(*[columns.get(c, F.col(c) if c in ("doc_id", "text") else F.col("_others").getField(c)).alias(c) for c in docs.columns])

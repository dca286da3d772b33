"""Byte-level BPE encoding and decoding as a monoid: trees of joins.

A rank file gives each string of bytes that is a token its rank. Each match of the splitting pattern is encoded by
itself: from its bytes on, the adjacent pair whose join has the lowest rank (the leftmost of equals) is joined, until
no pair's join is a token. Here that result is made by a tree reduction: both halves of the bytes are encoded
recursively and joined. A join keeps both halves' tokens where the two at the seam stay apart when encoded together
alone; else it encodes a window around the seam anew, and doubles the window at each side until the window's outer
token and its neighbour stay apart, too.

Why the tokens outside are then final: let t1..tn be tokens of which each neighbouring pair, encoded alone, gives just
that pair. Were some merge of the whole string to cross a token's border, take the first that does, between ti and
ti+1. Until then all merges lay within tokens, those of ti and ti+1 in the order in which the pair alone makes them,
and the crossing one is lowest among the pair's own, so the pair alone would cross, too. Hence none does. Within one
encoding all neighbours stay apart by the same argument, so only the seams need a look. This holds for any ranks.

Texts are cut at single spaces between characters that aren't white space, which no match crosses; each distinct unit
between cuts is encoded once per worker (known again by 128 bits of hashes). A text with white space beside a space or
at an end is split by the pattern itself, in stretches that end at such a cut.

Decoding maps each id to its bytes and concatenates, halves by halves.

Rows: one per document. A null text counts as empty: no ids, and the hash of nothing. Repeated rows, null or repeated
ids each give a row of their own; other columns aren't looked at, whatever their names. Any length of text: a unit, a
match and their trees are bounded only by the text itself. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import mix, passes, prefix_hash, span, utf8
from quarryline.llm.unit_cache import HashedUnits

#: Bytes of a string up to which its encoding is remembered, and entries of a memo until it starts afresh.
SHORT = 8
MEMO = 600_000
#: Bytes of a window up to which the lowest pair is found by looking at all; beyond, by a heap.
SCAN = 64
#: Ids that one leaf of the decoding tree holds, and characters that one stretch of a text holds at least.
LEAF = 4096
STRETCH = 1 << 16
NEVER = 1 << 62
#: Goes before the unit that starts a text; no text holds it.
HEAD = "\ud800"
#: Bytes of a unit up to which its ids are kept under its hashes, and what the hashes are made of.
LASTING = 256
SECOND = mix(np.arange(1, 257, dtype=np.uint64))
FIRST = np.uint64(0x5DEECE66D1234567)
#: Between two characters that aren't white space; the match after a cut starts with the space.
CUT = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Tree:
    """Encoding of one match by joining the encodings of its halves."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.short: dict[bytes, list[int]] = {}
        #: What two tokens give when encoded together alone, or None if they stay apart.
        self.pair: dict[int, list[int] | None] = {}

    def lowest_first(self, data: bytes) -> list[int]:
        """The definition itself, for the windows at seams."""
        if len(data) > SCAN:
            return self._by_heap(data)
        rank = self.rank
        parts = [data[i : i + 1] for i in range(len(data))]
        joins = [rank.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while joins:
            low = min(joins)
            if low == NEVER:
                break
            i = joins.index(low)
            parts[i] += parts.pop(i + 1)
            joins.pop(i)
            if i:
                joins[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
            if i < len(joins):
                joins[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        return [rank[p] for p in parts]

    def _by_heap(self, data: bytes) -> list[int]:
        rank, n = self.rank, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joins = [(rank[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in rank]
        heapq.heapify(joins)
        while joins:
            _, i, upto = heapq.heappop(joins)
            middle = end[i]
            # An entry counts only while both its parts are as they were when it was made.
            if middle < 0 or middle >= upto or end[middle] != upto:
                continue
            end[i], end[middle] = upto, -1
            if upto < n:
                before[upto] = i
                low = rank.get(data[i : end[upto]])
                if low is not None:
                    heapq.heappush(joins, (low, i, end[upto]))
            if i:
                low = rank.get(data[before[i] : upto])
                if low is not None:
                    heapq.heappush(joins, (low, before[i], upto))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : end[i]]])
            i = end[i]
        return out

    def together(self, a: int, b: int) -> list[int] | None:
        key = a << 32 | b
        found = self.pair.get(key, self)
        if found is self:
            if len(self.pair) >= MEMO:
                self.pair.clear()
            made = self.lowest_first(self.token[a] + self.token[b])
            found = self.pair[key] = None if made == [a, b] else made
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        made = self.together(left[-1], right[0])
        if made is None:
            return left + right
        i, j = len(left) - 1, 1
        while True:
            fits_left = i == 0 or self.together(left[i - 1], made[0]) is None
            fits_right = j == len(right) or self.together(made[-1], right[j]) is None
            if fits_left and fits_right:
                return left[:i] + made + right[j:]
            if not fits_left:
                i = max(0, 2 * i - len(left))
            if not fits_right:
                j = min(len(right), 2 * j)
            made = self.lowest_first(b"".join([self.token[t] for t in left[i:] + right[:j]]))

    def tree(self, data: bytes) -> list[int]:
        found = self.short.get(data)
        if found is not None:
            return found
        half = len(data) // 2
        out = self.join(self.tree(data[:half]), self.tree(data[half:])) if half else [self.rank[data]]
        if len(data) <= SHORT:
            if len(self.short) >= MEMO:
                self.short.clear()
            self.short[data] = out
        return out

    def encode(self, match: bytes) -> list[int]:
        """A match that is a token stays whole, whatever its merges would give."""
        whole = self.rank.get(match)
        return self.tree(match) if whole is None else [whole]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.tree = Tree(read_ranks(path))
        self.matches = regex.compile(pattern).findall
        self.cache = HashedUnits(self._units)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has: none if it is empty or has white space at an end,
        as its text can't be cut there. HEAD goes before a unit that starts a text, a space before every other."""
        ids: list[int] = []
        counts = np.zeros(len(units), np.int64)
        encode, matches = self.tree.encode, self.matches
        for i, unit in enumerate(units):
            own = unit[1:] if unit[:1] == HEAD else unit
            if own and not own[0].isspace() and not own[-1].isspace():
                before = len(ids)
                for match in matches(own if own is not unit else " " + unit):
                    ids += encode(match.encode())
                counts[i] = len(ids) - before
        return np.array(ids, np.int64), counts

    def whole(self, text: str) -> list[int]:
        """A text by the pattern itself, stretch by stretch."""
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            for match in self.matches(text[at:end]):
                ids += self.tree.encode(match.encode())
            at = end
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        data, offs = utf8(texts)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        image = data.tobytes()
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
        ids, counts = self.cache.lookup(one, two, end - start <= LASTING, text_of)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(counts)])[upto]
        odd = np.diff(np.concatenate([[0], np.cumsum(counts == 0)])[upto]) > 0
        return [np.array(self.whole(image[offs[i] : offs[i + 1]].decode()), np.uint32) if odd[i] else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]


@lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


OUT = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, the ids of each whole text, their number and hash, and the hash of what they decode to. ``ranks`` is a
    file that every executor has at that place."""
    names = [f.split()[0] for f in OUT.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks, pattern)
        for batch in batches:
            for part in passes(batch, "text", 500_000):
                ids = code.encode(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                hashes = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
                decoded = [hashlib.sha256(code.tree.decode(i.tolist())).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array(hashes), pa.array(decoded)], names=names)

    return rows.mapInArrow(run, OUT)

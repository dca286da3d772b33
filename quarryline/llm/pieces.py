"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Words of equal length are rows of one matrix and advance together. Hashes of all substrings probe the sorted piece
keys, every end of a word takes the best of the pieces that end there, and backpointers give the path.

What a path may contain differs by the model. A unigram model adds up its pieces' scores. A BPE model's scores order
its merges and are no log-probabilities; there a step is open (0) or closed (minus infinity): a piece may follow
another iff the merges of both together leave them apart, which undoing the merges on either side of the seam, the
latest first, decides. Exactly one piece then ends the encoding of each prefix, so the path that stays open is the
model's own encoding. Characters without a piece become bytes.

A null or empty text has no ids and decodes to the empty text. Texts of any length are cut before each space (and,
where long, between characters that no piece holds side by side), which no piece crosses. Repeated rows each get a row;
columns other than the id and the text are not read. Models with pieces of other kinds than normal, byte, unknown
and control, or with normalization, are refused.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import mix, passes
from quarryline.llm.unit_cache import UnitCache

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Units over this length are cut between characters that no piece holds side by side.
LONG = 48
#: Answers about seams that a worker keeps, and entries into the sorted piece keys: 2 to these powers.
SEAM_BITS, ENTRY_BITS = 19, 18
#: Brings all bits of a substring's hash into its leading ones; odd, so that no two hashes become one.
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.int64)


def extended(value: np.ndarray, char: np.ndarray) -> np.ndarray:
    return value * np.uint64(0x9E3779B97F4A7C15) + char


class Pieces:
    """The pieces, scores and kinds of a model, with the tables that the batched encoders probe."""

    def __init__(self, pieces: list[tuple[str, float, int]], model_type: int, dummy_prefix: bool = True):
        self.kind, self.dummy_prefix = model_type, dummy_prefix
        self.text = [p for p, _, _ in pieces]
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = np.array([s for _, s, _ in pieces])
        self.byte = np.full(256, -1)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(p[3:5], 16)] = i
        out = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k == NORMAL else b"" for p, _, k in pieces]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_ends = np.concatenate([[0], np.cumsum([len(b) for b in out])])
        # Characters get symbols: a piece of one character is its own; others follow after the pieces.
        letters = sorted({c for p in normal for c in p})
        self.char_keys = np.array([ord(c) for c in letters], np.int64)
        extra = iter(range(len(pieces), len(pieces) + len(letters)))
        self.char_symbols = np.array([normal[c] if c in normal else next(extra) for c in letters], np.int64)
        symbol = dict(zip(letters, self.char_symbols.tolist(), strict=True)) | normal
        self.width = len(pieces) + len(letters) + 1
        self.char_of = {int(s): c for c, s in zip(letters, self.char_symbols, strict=True)}
        pairs = [(symbol[p[:i]] * self.width + symbol[p[i:]], k) for p, k in normal.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_piece = np.array([k for _, k in pairs], np.int64)
        self.beside = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self.longest = max(map(len, normal), default=1)
        by_length = defaultdict(list)
        for p, i in normal.items():
            by_length[len(p)].append((p, i))
        keys, ids = [], []
        for own in by_length.values():
            keys.append(self.substring_hash(codes([p for p, _ in own])))
            ids.append(np.array([i for _, i in own]))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        # One key more, which no substring has, ends the sorted ones.
        self.piece_keys, self.piece_ids = np.append(keys[order], np.uint64(0)), np.append(ids[order], -1).astype(np.int32)
        lead = (keys[order] >> np.uint64(64 - ENTRY_BITS)).astype(np.int64)
        self.piece_entry = np.searchsorted(lead, np.arange(1 << ENTRY_BITS)).astype(np.int32)
        self.piece_crowd = int(np.bincount(lead, minlength=1).max()) if len(lead) else 1
        self._merges(normal)
        self.seam_keys, self.seam_open = np.full(1 << SEAM_BITS, -1), np.zeros(1 << SEAM_BITS, bool)
        self.cache = UnitCache(self.units)

    @staticmethod
    def substring_hash(rows: np.ndarray) -> np.ndarray:
        """Hash of each row, as ``substrings`` makes it a character at a time."""
        value = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            value = extended(value, rows[:, j].astype(np.uint64) + np.uint64(1))
        return value * SPREAD

    def _probe(self, key: np.ndarray) -> np.ndarray:
        """The piece of each key or -1. The sorted keys are entered at the first one with a key's leading bits."""
        at = self.piece_entry[key >> np.uint64(64 - ENTRY_BITS)]
        out = np.where(self.piece_keys[at] == key, self.piece_ids[at], -1)
        for step in range(1, self.piece_crowd):
            more = np.flatnonzero(self.piece_keys[at] < key)
            more = more[at[more] + step < len(self.piece_ids)]
            hit = self.piece_keys[at[more] + step] == key[more]
            out[more[hit]] = self.piece_ids[at[more[hit]] + step]
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols merge into; -1 where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_piece[at], -1) if len(self.pair_keys) else np.full(len(key), -1)

    def _merges(self, normal: dict[str, int]) -> None:
        """For each symbol the rank of the merge that makes it (-1: a character), the two symbols it is made of, and
        whether merging its own characters gives it at all. Ranks follow the scores, best first; equal scores, equal ranks."""
        rank = np.full(self.width + 1, self.width)  # the last one stands for no piece
        own = np.array(list(normal.values()), np.int64)
        rank[own] = np.unique(-self.scores[own], return_inverse=True)[1]
        self.pair_rank = rank
        self.made, self.first_part, self.last_part = np.full(self.width, -1), np.full(self.width, -1), np.full(self.width, -1)
        self.whole = np.zeros(len(self.text), bool)
        if self.kind != BPE:
            return
        by_length = defaultdict(list)
        for p, i in normal.items():
            by_length[len(p)].append((p, i))
        for length, own in by_length.items():
            ids = np.array([i for _, i in own])
            if length == 1:
                self.whole[ids] = True
                continue
            chars = codes([p for p, _ in own])
            row = self.char_symbols[np.searchsorted(self.char_keys, chars)]
            left = right = np.full(len(own), -1)
            for size in range(length, 1, -1):  # each round merges every row's best pair
                piece = np.stack([self._pair(row[:, j], row[:, j + 1]) for j in range(size - 1)], 1)
                best = rank[piece].argmin(1)
                found = piece[np.arange(len(row)), best]
                ids, row, best, found = ids[found >= 0], row[found >= 0], best[found >= 0], found[found >= 0]
                left, right = row[np.arange(len(row)), best], row[np.arange(len(row)), best + 1]
                row = np.delete(row.ravel(), np.arange(len(row)) * size + best + 1).reshape(len(row), size - 1)
                row[np.arange(len(row)), best] = found
            self.whole[ids] = True
            self.made[ids], self.first_part[ids], self.last_part[ids] = rank[ids], left, right

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges of two symbols' characters, put side by side, end in these two symbols. While the
        seam lies between two symbols, they would merge if their piece's rank came before the merge that ended that
        state; that merge is the later one of the two that made the symbols at the seam. Of merges with one rank
        the left one goes first."""
        ok = np.ones(len(left), bool)
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), self.width)
        at = np.arange(len(left))
        while len(at):
            x, y = left[at], right[at]
            closed = self.pair_rank[self._pair(x, y)] < limit[at]
            ok[at[closed]] = False
            a, b = self.made[x], self.made[y]
            going = ~closed & (np.maximum(a, b) >= 0)
            at, x, y, a, b = at[going], x[going], y[going], a[going], b[going]
            undo = a > b
            left[at] = np.where(undo, self.last_part[x], x)
            right[at] = np.where(undo, y, self.first_part[y])
            limit[at] = np.where(undo, a, b + 1)
        return ok

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``apart`` behind a table of answers, where a new pair takes the place of the one before it."""
        key = left * self.width + right
        slot = (mix(key.astype(np.uint64)) >> np.uint64(64 - SEAM_BITS)).astype(np.int64)
        new = np.flatnonzero(self.seam_keys[slot] != key)
        out = self.seam_open[slot]
        if len(new):
            pairs, at = np.unique(key[new], return_inverse=True)
            answers = self.apart(pairs // self.width, pairs % self.width)
            out[new] = answers[at]
            slot = (mix(pairs.astype(np.uint64)) >> np.uint64(64 - SEAM_BITS)).astype(np.int64)
            _, last = np.unique(slot, return_index=True)  # of pairs with one slot, one is kept
            self.seam_keys[slot[last]], self.seam_open[slot[last]] = pairs[last], answers[last]
        return out

    def substrings(self, chars: np.ndarray) -> np.ndarray:
        """[end, length - 1, word]: the piece that ends there, or -1. chars: [place, word]."""
        length, n = chars.shape
        most = min(length, self.longest)
        found = np.full((length + 1, most, n), -1, np.int32)
        plus = chars.astype(np.uint64) + np.uint64(1)
        value = np.zeros((length + 1, n), np.uint64)
        for size in range(1, most + 1):  # all substrings of one size, by their starts
            value = extended(value[:-1], plus[size - 1 :])
            found[size:, size - 1] = self._probe((value * SPREAD).ravel()).reshape(value.shape)
        return found

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best path of words of one length: symbols (negative: a code point without any) and how many each row
        has. In a unigram model a character without a piece costs more than any path; in BPE it stands alone."""
        chars = np.ascontiguousarray(codes(words).T)
        length, n = chars.shape
        found = self.substrings(chars)
        alone = np.full((length, n), self.width - 1)
        if len(self.char_keys):
            at = np.minimum(np.searchsorted(self.char_keys, chars), len(self.char_keys) - 1)
            alone = np.where(self.char_keys[at] == chars, self.char_symbols[at], self.width - 1)
        unknown = float(self.scores[self.piece_ids[:-1]].min()) - 10.0 if len(self.piece_ids) > 1 else -10.0
        best = np.zeros((length + 1, n))
        back, symbol = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int64)
        columns = np.arange(n)
        for end in range(1, length + 1):
            sizes = np.arange(1, min(end, found.shape[1]) + 1)
            own = found[end, : len(sizes)]
            if self.kind == BPE:
                value = (own >= 0) & self.whole[own]
                own[0], value[0] = alone[end - 1], True
                seams = len(sizes) - (sizes[-1] == end)  # a piece from the word's start has none
                at, word = np.nonzero(value[:seams])
                value[at, word] = self._apart(symbol[end - 1 - at, word], own[at, word].astype(np.int64))
            else:
                value = np.where(own >= 0, best[end - sizes] + self.scores[own], -np.inf)
                none = own[0] < 0
                value[0, none] = best[end - 1, none] + unknown
                own[0, none] = alone[end - 1, none]
            pick = value.argmax(0)
            best[end] = value[pick, columns]
            back[end], symbol[end] = end - sizes[pick], own[pick, columns]
            if self.kind == BPE and not best[end].all():
                raise ValueError("this model's merges leave a word without a path")
        symbol[1:] = np.where(symbol[1:] == self.width - 1, -1 - chars, symbol[1:])
        out, count = np.zeros((n, length), np.int64), np.zeros(n, np.int64)
        place = np.full(n, length)
        going = columns
        while len(going):
            out[going, length - 1 - count[going]] = symbol[place[going], going]
            count[going] += 1
            place[going] = back[place[going], going]
            going = going[place[going] > 0]
        return np.take_along_axis(out, np.minimum(np.arange(length)[None, :] + (length - count)[:, None], length - 1), 1), count

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has."""
        parts: list[str] = []
        owner: list[int] = []
        for i, unit in enumerate(units):
            own = [unit] if len(unit) <= LONG else self.cut(unit)
            parts += own
            owner += [i] * len(own)
        by_length = defaultdict(list)
        for i, part in enumerate(parts):
            by_length[len(part)].append(i)
        flat: list = [None] * len(parts)
        for length, own in by_length.items():
            for at in range(0, len(own), max(1, 200_000 // length)):
                some = own[at : at + max(1, 200_000 // length)]
                row, count = self.viterbi([parts[i] for i in some])
                odd = (row >= len(self.text)) | (row < 0)
                odd &= np.arange(row.shape[1])[None, :] < count[:, None]
                for j, i in enumerate(some):
                    flat[i] = row[j, : count[j]]
                for j in np.flatnonzero(odd.any(1)):
                    flat[some[j]] = self.with_bytes(flat[some[j]])
        counts = np.bincount(np.array(owner), [len(f) for f in flat], len(units)).astype(np.int64)
        return np.concatenate(flat), counts

    def with_bytes(self, symbols: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for s in symbols.tolist():
            if 0 <= s < len(self.text):
                out.append(s)
            else:
                char = chr(-1 - s) if s < 0 else self.char_of[s]
                out += [int(i) for i in self.byte[list(char.encode("utf-8", "surrogatepass"))]]
        return np.array(out, np.int64)

    def cut(self, unit: str) -> list[str]:
        ends = [i + 1 for i in range(len(unit) - 1) if unit[i : i + 2] not in self.beside]
        return [unit[a:b] for a, b in zip([0, *ends], [*ends, len(unit)], strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each has."""
        units: list[str] = []
        sizes = []
        for text in texts:
            own = ((SPACE if self.dummy_prefix else "") + text).replace(" ", SPACE).split(SPACE) if text else []
            if own and not own[0]:
                del own[0]
                own = [SPACE + u for u in own]
            elif own:
                own = [own[0], *(SPACE + u for u in own[1:])]
            if SPACE in own:  # a run of spaces belongs to the word after it
                joined, run = [], ""
                for u in own:
                    if u == SPACE:
                        run += u
                    else:
                        joined.append(run + u)
                        run = ""
                own = joined + [run] * bool(run)
            units += own
            sizes.append(len(own))
        if not units:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ids, counts = self.cache.lookup(units)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        size = self.out_ends[ids + 1] - self.out_ends[ids]
        at = np.arange(int(size.sum())) + np.repeat(self.out_ends[ids] - (np.cumsum(size) - size), size)
        text = self.out_bytes[at].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(1)
def pieces(path: str) -> Pieces:
    """Reads a model file (of the worker's own disk)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave texts as they are can be read")
    if model.trainer_spec.model_type not in (UNIGRAM, BPE) or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
        raise ValueError("only unigram and BPE models of normal, byte, unknown and control pieces can be read")
    return Pieces([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, model.normalizer_spec.add_dummy_prefix)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian 32-bit), ids_crc32, and whether decoding
    the ids gives the text again (a text that holds U+2581 itself decodes to a space there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pieces(model)
        for batch in batches:
            for part in passes(batch, "text", 500_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, counts = code.encode(texts)
                ends = np.cumsum(counts)
                own = [ids[e - n : e] for e, n in zip(ends, counts, strict=True)]
                images = [i.astype("<u4").tobytes() for i in own]
                same = [code.decode(i.astype(np.int64)) == t for i, t in zip(own, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(images, pa.binary()), pa.array([zlib.crc32(i) for i in images], pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_crc32 long, round_trip boolean")

"""Which texts contain which patterns, by q-grams instead of by comparing all with all.

Every pattern of q characters or more is looked for by one of its q-grams, the one that the fewest texts have: texts
and patterns meet by equality on that gram, and only those pairs are compared. A pattern one of whose grams no text has
is nowhere. Shorter patterns meet the texts' substrings of their own length, where equality says all.

Grams come from one linear pass of a pattern with a lookahead, so long texts cost no more than their length. How many
texts have a gram is counted for the patterns' grams alone, and after partial aggregation a task sends one row a gram.
A gram that most texts have meets patterns only if all their grams are as frequent; Spark's skew join splits it.

Patterns that are few enough to be sent to all tasks (``FEW``) do without rows for grams: a task turns the grams of its
texts into numbers of ``BITS`` bits, and counts those that patterns have; a second pass compares texts with the patterns
whose rarest number they have. Numbers that two grams share cost a comparison, no match. Nothing is shuffled but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
Q = 4
#: Patterns that are sent to all tasks at most; bits of a gram's number; characters that are looked at together.
FEW, BITS, TOGETHER = 100_000, 22, 1_000_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def numbers(points: np.ndarray, q: int) -> np.ndarray:
    """A number for the q characters from each place on; equal grams have equal ones."""
    n = max(len(points) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = (out + points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of bounded length, one at least: with all characters of their texts, and where each text ends."""
    ends = np.cumsum(pc.utf8_length(batch.column("_text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + TOGETHER, "right")))
        part = batch.slice(at, to - at)
        yield part, codes("".join(part.column("_text").to_pylist())), ends[at:to] - base
        at = to


def holding(points: np.ndarray, ends: np.ndarray, begin: np.ndarray, which: np.ndarray, flat: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, pattern), once each, of the pairs of a place and a pattern that stands there, whole and in one text. flat:
    all patterns' characters; spans: where each begins and the last one ends."""
    length = np.diff(spans)
    inside = begin >= 0
    begin, which = begin[inside], which[inside]
    row = np.searchsorted(ends, begin, "right")
    inside = begin + length[which] <= ends[row]
    begin, which, row = begin[inside], which[inside], row[inside]
    kept, i = [], 0
    while len(begin):
        whole = length[which] == i
        kept.append(row[whole] * len(length) + which[whole])
        same = ~whole
        same[same] = points[begin[same] + i] == flat[spans[which[same]] + i]
        begin, which, row, i = begin[same], which[same], row[same], i + 1
    return np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *kept])), max(len(length), 1))


def among_few(texts: DataFrame, patterns: list[str], q: int) -> DataFrame:
    """``containing`` for texts (key..., _text), none null, and patterns that all tasks hold."""
    # A pattern is looked for by the numbers of its grams, or by its own if it is shorter.
    sizes = sorted({min(len(p), q) for p in patterns} - {0})
    own = {p: np.unique(numbers(codes(p), min(len(p), q))) for p in patterns if p}
    wanted = {size: np.unique(np.concatenate([v for p, v in own.items() if min(len(p), q) == size])) for size in sizes}

    def table(known: np.ndarray) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[known] = np.arange(len(known))
        return out

    def places(points: np.ndarray, ends: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a gram whose number the table knows begins, and the number's place; none reaches into the next text."""
        found = known[numbers(points, size)]
        at = np.flatnonzero(found >= 0)
        at = at[at + size <= ends[np.searchsorted(ends, at, "right")]]
        return at, found[at]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = {size: table(wanted[size]) for size in sizes}, {size: np.zeros(len(wanted[size]), np.int64) for size in sizes}
        for batch in batches:
            for _, points, ends in slices(batch):
                for size in sizes:
                    total[size] += np.bincount(places(points, ends, size, known[size])[1], minlength=len(wanted[size]))
        for size in sizes:
            at = np.flatnonzero(total[size])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(wanted[size][at]), pa.array(total[size][at])], names=["size", "number", "n"])

    # A row for each number that patterns have, at most.
    seen = {(r.size, r.number): r.n for r in texts.select("_text").mapInArrow(counts, "size int, number long, n long").groupBy("size", "number").agg(F.sum("n").alias("n")).collect()}
    asked: dict[int, dict[int, list[tuple[int, int]]]] = {size: {} for size in sizes}
    for i, p in enumerate(patterns):
        if p:
            size = min(len(p), q)
            n, number = min((seen.get((size, int(v)), 0), int(v)) for v in own[p])
            # A pattern one of whose grams no text has is nowhere.
            if n:
                asked[size].setdefault(number, []).append((i, int(np.flatnonzero(numbers(codes(p), size) == number)[0])))
    everywhere = np.array([i for i, p in enumerate(patterns) if not p], np.int64)
    anchors = {size: np.array(sorted(asked[size]), np.int64) for size in sizes}
    # Of each anchor the patterns, and how far into each it stands.
    lists = {size: [asked[size][int(a)] for a in anchors[size]] for size in sizes}
    sent = {size: (np.array([i for own in lists[size] for i, _ in own], np.int64), np.array([s for own in lists[size] for _, s in own], np.int64), np.array([len(own) for own in lists[size]], np.int64)) for size in sizes}
    key = [c for c in texts.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = pa.array(patterns, pa.string()), {size: table(anchors[size]) for size in sizes}
        flat, spans = codes("".join(patterns)), np.concatenate([[0], np.cumsum([len(p) for p in patterns])]).astype(np.int64)
        for batch in batches:
            for part, points, ends in slices(batch):
                rows, found = [np.repeat(np.arange(len(ends)), len(everywhere))], [np.tile(everywhere, len(ends))]
                for size in sizes:
                    at, anchor = places(points, ends, size, known[size])
                    which, shift, n = sent[size]
                    many = n[anchor]
                    # The patterns of an anchor stand together.
                    own = np.repeat(np.cumsum(n)[anchor] - np.cumsum(many), many) + np.arange(many.sum())
                    for out, column in zip((rows, found), holding(points, ends, np.repeat(at, many) - shift[own], which[own], flat, spans), strict=True):
                        out.append(column)
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in key], names.take(pa.array(np.concatenate(found)))], names=[*key, "pattern"])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in key], "pattern string"]))


def grams(text: Column, q: int) -> Column:
    """The distinct substrings of q characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def with_anchors(patterns: DataFrame, text_grams: DataFrame, q: int) -> DataFrame:
    """(pattern, gram): for each pattern that may occur its rarest gram. patterns: (pattern), distinct, of q characters
    at least; text_grams: (_text, gram)."""
    own = patterns.select("pattern", F.explode(grams(F.col("pattern"), q)).alias("gram"))
    wanted = own.select("gram").distinct()
    counts = text_grams.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    rated = own.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    return rated.groupBy("pattern").agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.min("texts").alias("texts")).filter("texts > 0").drop("texts")


def containing(texts: DataFrame, patterns: DataFrame, key: list[str], text: str = "text", pattern: str = "pattern", q: int = Q) -> DataFrame:
    """(key..., pattern): every text with every distinct pattern that it contains, once each. ``key`` tells texts
    apart; rows equal in it count as one text each, so it must be unique. Null texts contain nothing, null patterns
    are nowhere, and the empty pattern is in every text."""
    patterns = patterns.select(F.col(pattern).cast("string").alias("pattern")).filter("pattern IS NOT NULL").distinct()
    texts = texts.select(*key, F.col(text).cast("string").alias("_text")).filter("_text IS NOT NULL")
    few = patterns.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return among_few(texts, sorted(r.pattern for r in few), q)
    long = patterns.filter(F.char_length("pattern") >= q)
    found = texts.select(*key, F.explode(grams(F.col("_text"), q)).alias("gram"))
    pairs = found.join(with_anchors(long, found, q), "gram").drop("gram")
    met = F.lit(True)
    for k in key:
        met = met & F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}"))
    out = texts.alias("t").join(pairs.alias("p"), met).filter(F.contains(F.col("t._text"), F.col("p.pattern"))).select(*[F.col(f"p.{k}").alias(k) for k in key], "p.pattern")
    short = patterns.filter(F.char_length("pattern") < q)
    here = texts.select(*key, F.explode(F.concat(F.array(F.lit("")), *[grams(F.col("_text"), size) for size in range(1, q)])).alias("pattern"))
    return out.unionByName(here.join(short, "pattern", "left_semi").select(*key, "pattern"))

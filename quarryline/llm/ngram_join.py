"""N-gram Jaccard join by signature trees.

Documents whose sets of word K-grams have a Jaccard similarity of at least PERCENT / 100 are linked; the result is
one row per document with the class that its links span and the number of documents that it is linked with. Exact:
no pair that qualifies is missed, none is guessed (but equal sets are known by a 64-bit hash of the set).

1. Equal sets are one node, so copies cost nothing further; a node weighs as many documents as share its set.
2. Tokens get one order for all documents, rare ones first by a counting sketch of fixed size. Qualifying sets must
   share l tokens among the first n - ceil(t n) + l of each, l being a small part of n. These first tokens travel to
   their buckets as packed arrays, and nodes that share fewer than l of them with any others drop out. The first
   tokens of those left meet again. Of a group with a common token, one over FEW gathers under its smallest node, its
   leader; a smaller one counts its pairs instead, and only the pairs that may share enough first tokens in all go
   on, under a leader of their own. Tokens too frequent for one bucket find their leaders by an aggregate.
3. The nodes under one leader are a cluster. Sorted by size and least hash, clusters are cut into blocks of bounded
   size, and every block is searched by a dual traversal of signature trees: inner nodes hold OR-combined token
   bitmaps and size ranges, and pairs of nodes are pruned by the largest overlap they allow. The sets of the pairs
   of leaves that are left are compared exactly.
4. Of a cluster with several blocks, first the blocks' bitmaps and size ranges alone meet, in a tree of further levels
   that is traversed in the same way as joins of its levels; sets travel only for the pairs of blocks that are left.
5. A pair that meets under several leaders counts under the smallest. A search returns the links of every node, as a
   number, and a star per class, never all pairs; the stars meet in a min-label propagation over staged tables.

A text without words, or null, has an empty set and is linked with nothing, not even its like. A text of fewer than
K words has its whole sequence as the one element. Repeated rows are copies, and linked. A null doc_id is smaller
than any other when classes are named. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.llm.common import LOWER, NOT_SPACE, gram_rows, grams, mix, passes, prefix_hash, shuffle_width, span, stage, utf8, words
from quarryline.llm.suffix_dedup import bucketwise

K = 3
PERCENT = 90
#: Counters of the sketch that orders tokens; its size doesn't depend on the data.
COUNTERS = 1 << 16
#: A counter is too frequent for one bucket from this part of a bucket's share of all tokens, and this many times
#: a counter's.
HOT_BUCKET, HOT_COUNTER = 0.25, 32
#: Nodes with a common token up to which their pairs are counted before they may form clusters.
FEW = 8
#: Tokens in a block, members of a tree's leaf, children of a node above the blocks, bits of a block's bitmap.
BLOCK_TOKENS, LEAF, FAN, BLOCK_BITS = 400_000, 32, 64, 1 << 14
#: Nodes (three integers each) up to which their ids go to the texts; beyond, the texts are shuffled to the ids.
BROADCAST_NODES = 1_000_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = K, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted within the text, and n + 1 offsets. With ``rank`` (a place for
    each counter) hashes are renamed, one to one, so that their order is by rank."""
    data = LOWER[data]
    start, end, word_offs = words(data, offs, NOT_SPACE)
    hashes = span(prefix_hash(data), start, end)
    at, text = gram_rows(word_offs, k)
    value = grams(hashes, k)[at]
    for n in range(1, k):
        short = np.flatnonzero(np.diff(word_offs) == n)
        if len(short):
            value = np.concatenate([value, grams(hashes, n)[word_offs[short]]])
            text = np.concatenate([text, short])
    if rank is not None:
        value = (rank[value & np.uint64(COUNTERS - 1)] << np.uint64(48)) | (value >> np.uint64(16))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(offs)))


def set_ids(value: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each set, from sums over its (not renamed) elements."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(value))])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    low, high = offs[:-1], offs[1:]
    return mix(mix(one[high] - one[low]) ^ ((two[high] - two[low]) * np.uint64(0x9E3779B97F4A7C15)) + (high - low).astype(np.uint64)).view(np.int64)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of sets of sizes a and b that qualifies."""
    return -((-percent * (a + b)) // (100 + percent))


def shared_first(n: np.ndarray, percent: int) -> np.ndarray:
    """First tokens that sets must share if the smaller has n elements."""
    return 1 + n * (100 - percent) // 400


def rest(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements of a set after its first tokens."""
    return np.maximum(0, -((-percent * n) // 100) - shared_first(n, percent))


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, text_hash, n, sid) of documents, and rows (counter, n) of the sketch, told apart by a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.int64)
        names = ["doc_id", "text_hash", "n", "sid", "counter"]
        for batch in batches:
            for part in passes(batch, "text"):
                value, offs = shingle_sets(*utf8(part.column("text")), k)
                sketch += np.bincount((value & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                n = np.diff(offs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n), pa.array(set_ids(value, offs), mask=n == 0), pa.nulls(len(n), pa.int32())], names=names)
        at = np.flatnonzero(sketch)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(sketch[at]), pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32))], names=names)

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, sid long, counter int")


def token_ranks(sets: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each counter's place when they are sorted by count, and which are hot. At most COUNTERS rows reach the driver."""
    counts = np.zeros(COUNTERS, np.int64)
    for r in sets.filter("counter IS NOT NULL").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.counter] = r.n
    rank = np.zeros(COUNTERS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(COUNTERS, dtype=np.uint64)
    hot = counts > counts.sum() * max(HOT_BUCKET / buckets, HOT_COUNTER / COUNTERS)
    return rank, np.isin(np.arange(COUNTERS), rank[hot])


def counted(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of the first two columns, with the others' values, and how often each occurs."""
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    first = np.flatnonzero(new)
    return [*(c[first] for c in columns), np.diff(np.append(first, len(order)))]


def summed(key: np.ndarray, other: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, their other values, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)])
    sums = np.add.reduceat(value[order], first) if len(first) else value
    return [key[order][first], other[order][first], sums]


def grouped(token: np.ndarray, sid: np.ndarray, size: np.ndarray, percent: int, few: int) -> tuple[list[np.ndarray], ...]:
    """Of the nodes that have a first token in common with another: (leader, sid, n, shared) in groups over ``few``,
    and the pairs (a, b, na, nb, shared) in smaller ones."""
    order = np.lexsort((sid, size, token))
    token, sid, size = token[order], sid[order], size[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    token, sid, size = token[new], sid[new], size[new]
    # Sorted by size, a group falls apart where the sizes of neighbours can't qualify.
    apart = np.ones(len(token), bool)
    apart[1:] = (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])
    group = np.cumsum(apart) - 1
    count = np.bincount(group)[group] if len(group) else group
    leader = np.minimum.reduceat(sid, np.flatnonzero(apart))[group] if len(group) else sid
    large, minor = count > few, (count > 1) & (count <= few)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, few):
        i = np.flatnonzero(minor[:-d] & (group[:-d] == group[d:])) if len(group) > d else np.zeros(0, np.int64)
        i = i[100 * size[i] >= percent * size[i + d]]
        swap = sid[i] > sid[i + d]
        left.append(np.where(swap, i + d, i))
        right.append(np.where(swap, i, i + d))
    a, b = np.concatenate(left), np.concatenate(right)
    return counted(leader[large], sid[large], size[large]), counted(sid[a], sid[b], size[a], size[b])


PACKED = "bucket int, tokens binary, sids binary, sizes binary"


def packed(token: np.ndarray, sid: np.ndarray, size: np.ndarray, n: int, hot: np.ndarray) -> pa.RecordBatch:
    """Tokens with their nodes, as arrays by bucket; those of hot counters have none, -1."""
    busy = hot[(token >> np.uint64(48)).astype(np.int64)]
    bucket = np.where(busy, -1, (mix(token) % np.uint64(n)).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(-1, n + 1))
    used = [b for b in range(-1, n) if cuts[b + 1] < cuts[b + 2]]
    pick = [order[cuts[b + 1] : cuts[b + 2]] for b in used]
    columns = [[token[p].tobytes() for p in pick], [sid[p].tobytes() for p in pick], [size[p].astype(np.int32).tobytes() for p in pick]]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "tokens", "sids", "sizes"])


def unpacked(rows: list[dict]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("tokens", np.uint64), ("sids", np.int64), ("sizes", np.int32))]


def first_of(offs: np.ndarray, which: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first tokens of some sets (cut at offs), and the set of each."""
    sizes = np.diff(offs)[which]
    length = sizes - rest(sizes, percent)
    at = np.arange(int(length.sum())) + np.repeat(offs[which] - (np.cumsum(length) - length), length)
    return at, np.repeat(which, length)


def tokens_of_documents(docs: DataFrame, rank: np.ndarray, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    n = shuffle_width(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                data, text_offs = utf8(part.column("text"))
                plain, offs = shingle_sets(data, text_offs, k)
                sids, sizes = set_ids(plain, offs), np.diff(offs)
                value, offs = shingle_sets(data, text_offs, k, rank)
                _, first = np.unique(sids, return_index=True)
                at, owner = first_of(offs, first[sizes[first] > 0], percent)
                yield packed(value[at], sids[owner], sizes[owner], n, hot)

    return docs.mapInArrow(send, PACKED)


def tokens_of_nodes(nodes: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    n = shuffle_width(nodes.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
                sids = batch.column("sid").to_numpy(zero_copy_only=False)
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                at, owner = first_of(offs, np.arange(len(sets)), percent)
                yield packed(np.concatenate(sets)[at], sids[owner], np.diff(offs)[owner], n, hot)

    return nodes.select("sid", "tokens").mapInArrow(send, PACKED)


def dealt(sent: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
    """Packed rows, but those of hot counters, at the task of their bucket."""
    n = shuffle_width(sent.sparkSession)
    return sent.filter("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def hot_groups(sent: DataFrame, percent: int) -> DataFrame:
    """(leader, sid, n, shared): the nodes that tokens of hot counters join. Sizes that qualify lie in one band or in
    neighbouring ones, so a node is in its own group and in the next."""

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.log(100 / percent) if percent < 100 else 1e-9
        for batch in batches:
            if batch.num_rows:
                token, sid, size = unpacked(batch.to_pylist())
                band = np.floor(np.log(size) / step).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(sid), pa.array(size.astype(np.int64)), pa.array(band)], names=["token", "sid", "n", "band"])

    rows = sent.filter("bucket < 0").mapInArrow(loose, "token long, sid long, n long, band long").distinct()
    rows = rows.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    groups = rows.groupBy("token", "band").agg(F.min("sid").alias("leader"), F.max("sid").alias("last")).filter("leader < last").drop("last")
    return rows.join(groups, ["token", "band"]).groupBy("leader", "sid", "n").agg(F.count("*").alias("shared"))


COUNTS = "bucket int, sids binary, sizes binary, shares binary"


def packed_counts(sid: np.ndarray, size: np.ndarray, shared: np.ndarray, n: int) -> pa.RecordBatch:
    bucket = (mix(sid.view(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    used = [b for b in range(n) if cuts[b] < cuts[b + 1]]
    columns = [[v[order[cuts[b] : cuts[b + 1]]].astype(np.int64).tobytes() for b in used] for v in (sid, size, shared)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "sids", "sizes", "shares"])


def alive_nodes(sent: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """(sid): the nodes that share enough first tokens with any others whose sizes may qualify. The counts of the
    tokens' buckets travel packed, too."""
    n = shuffle_width(sent.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucketwise(batches):
            _, sid, size, shared = grouped(*unpacked(rows), percent, 1)[0]  # every group is a large one
            yield packed_counts(*summed(sid, size, shared), n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed_counts(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "n", "shared")), n)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucketwise(batches):
            sid, size, shared = summed(*(np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("sids", "sizes", "shares")))
            yield pa.RecordBatch.from_arrays([pa.array(sid[shared >= shared_first(-((-percent * size) // 100), percent)])], names=["sid"])

    if hot.any():
        sent = stage(sent, "jaccard-first-tokens")
    counts = dealt(sent, count, COUNTS)
    if hot.any():
        counts = counts.unionByName(hot_groups(sent, percent).select("sid", "n", "shared").mapInArrow(pack, COUNTS))
    return dealt(counts, total, "sid long")


def grouped_nodes(sent: DataFrame, hot: np.ndarray, percent: int, few: int) -> DataFrame:
    """(leader, sid, shared) of nodes in groups over ``few``, and (a, b, na, nb, shared) of pairs in smaller ones."""
    names = ["leader", "sid", "a", "b", "na", "nb", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bucketwise(batches):
            (leader, sid, _, shared), pairs = grouped(*unpacked(rows), percent, few)
            for found in ({"leader": leader, "sid": sid, "shared": shared}, dict(zip(("a", "b", "na", "nb", "shared"), pairs, strict=True))):
                for i in range(0, len(found["shared"]), 50_000):
                    own = {c: f[i : i + 50_000] for c, f in found.items()}
                    size = len(own["shared"])
                    yield pa.RecordBatch.from_arrays([pa.array(own[c]) if c in own else pa.nulls(size, pa.int64()) for c in names], names=names)

    schema = ", ".join(f"{c} long" for c in names)
    if not hot.any():
        return dealt(sent, run, schema)
    sent = stage(sent, "jaccard-first-tokens")
    return dealt(sent, run, schema).unionByName(hot_groups(sent, percent).drop("n"), allowMissingColumns=True)


def clusters(met: DataFrame, percent: int) -> DataFrame:
    """(sid, leaders): the clusters of every node that may have a partner in one. met: its rows of groups and pairs."""
    own = lambda n: 1 + F.floor(n * (100 - percent) / 400)
    behind = lambda n: F.greatest(F.lit(0), F.ceil(percent * n / 100) - own(n))
    nodes = met.filter("sid IS NOT NULL").groupBy("sid").agg(F.sum("shared").alias("large"), F.collect_set("leader").alias("leaders"))
    nodes = stage(nodes, "jaccard-large")
    pairs = met.filter("b IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("c"))
    # What a pair's small groups don't show, its large ones may.
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("sid").alias(side), F.col("large").alias(f"large_{side}")), side, "left")
    most = F.col("c") + F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    need = F.ceil((percent * (F.col("na") + F.col("nb"))) / (100 + percent)) - F.greatest(behind(F.col("na")), behind(F.col("nb")))
    pairs = stage(pairs.filter((most >= need) & (most >= own(F.least("na", "nb")))).select("a", "b"), "jaccard-pairs")
    # Two nodes with one least partner meet under it, as most of a group of near copies do; others under the smaller.
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    for side in ("a", "b"):
        pairs = pairs.join(least.select(F.col("a").alias(side), F.col("least").alias(f"least_{side}")), side)
    leader = F.when(F.col("least_a") == F.col("least_b"), F.col("least_a")).otherwise(F.col("a"))
    small = pairs.select(F.explode(F.array("a", "b")).alias("sid"), leader.alias("leader"))
    members = nodes.select("sid", F.explode("leaders").alias("leader")).unionByName(small).distinct()
    sizes = members.groupBy("leader").agg(F.count("*").alias("size")).filter("size > 1")
    return members.join(sizes, "leader").groupBy("sid").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))


def node_sets(docs: DataFrame, wanted: DataFrame, rank: np.ndarray, k: int) -> DataFrame:
    """(sid, weight, least, tokens): the sets of the wanted nodes, each from its smallest document (from several, if
    rows repeat), and the least hash of each. wanted: (sid, doc_id, weight)."""
    few = wanted.count() <= BROADCAST_NODES
    wanted = wanted.select("sid", "weight", F.col("doc_id").alias("_doc"))
    picked = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("sid", "weight", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                data, text_offs = utf8(part.column("text"))
                plain, offs = shingle_sets(data, text_offs, k)
                # Another text with the same doc_id is another node.
                own = np.flatnonzero(set_ids(plain, offs) == part.column("sid").to_numpy(zero_copy_only=False))
                value, offs = shingle_sets(data, text_offs, k, rank)
                sets = [value[offs[i] : offs[i + 1]] for i in own]
                least = np.array([mix(s).min() for s in sets], np.uint64).view(np.int64)
                kept = [part.column(c).take(pa.array(own)) for c in ("sid", "weight")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(least), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "weight", "least", "tokens"])

    return picked.mapInArrow(run, "sid long, weight long, least long, tokens binary")


class Tree:
    """Members in the order of their block; level 0 holds leaves of LEAF members, each level above halves the nodes."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.levels = []
        pad = -len(sizes) % LEAF
        low = np.concatenate([sizes, np.full(pad, sizes[-1])]).reshape(-1, LEAF)
        spare = sizes - np.bitwise_count(maps).sum(1)  # tokens beyond the bits they set
        extra = np.concatenate([spare, np.zeros(pad, spare.dtype)]).reshape(-1, LEAF).max(1)
        bits = np.bitwise_or.reduce(np.concatenate([maps, np.zeros((pad, maps.shape[1]), np.uint64)]).reshape(-1, LEAF, maps.shape[1]), 1)
        level = (low.min(1), low.max(1), extra, bits)
        while True:
            self.levels.append(level)
            if len(level[0]) == 1:
                break
            odd = len(level[0]) % 2
            both = [np.concatenate([x, x[-1:]]) if odd else x for x in level]
            level = (np.minimum(both[0][::2], both[0][1::2]), np.maximum(both[1][::2], both[1][1::2]), np.maximum(both[2][::2], both[2][1::2]), both[3][::2] | both[3][1::2])


def leaf_pairs(x: Tree, y: Tree, same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Dual traversal: the pairs of leaves that may hold a qualifying pair."""
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        i, a, j, b = stack.pop()
        low_a, high_a, extra_a, bits_a = (v[a] for v in x.levels[i])
        low_b, high_b, extra_b, bits_b = (v[b] for v in y.levels[j])
        if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
            continue
        most = min(int(np.bitwise_count(bits_a & bits_b).sum()) + min(extra_a, extra_b), high_a, high_b)
        if most < least_overlap(low_a, low_b, percent):
            continue
        if i == 0 and j == 0:
            if not same or a <= b:
                yield a, b
        elif i >= j:
            stack += [(i - 1, c, j, b) for c in (2 * a, 2 * a + 1) if c < len(x.levels[i - 1][0])]
        else:
            stack += [(i, a, j - 1, c) for c in (2 * b, 2 * b + 1) if c < len(y.levels[j - 1][0])]


class Block:
    """Nodes of one cluster: their sids, weights, sets (tokens, cut at offs), and the smaller leaders that each also
    has (leads, cut at lead_offs)."""

    def __init__(self, sid: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], leads: list[np.ndarray]):
        cut = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.sid, self.weight = sid.astype(np.int64), weight.astype(np.int64)
        self.offs, self.tokens = cut(sets), np.concatenate(sets)
        self.lead_offs, self.leads = cut(leads), np.concatenate(leads)
        self.size = np.diff(self.offs)

    COLUMNS = (("sid", np.int64), ("weight", np.int64), ("offs", np.int64), ("lead_offs", np.int64), ("tokens", np.uint64), ("leads", np.int64))

    def image(self) -> bytes:
        arrays = [getattr(self, c) for c, _ in self.COLUMNS]
        return struct.pack(f"<{len(arrays)}q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def read(cls, image: bytes) -> Block:
        out, at = cls.__new__(cls), 8 * len(cls.COLUMNS)
        for (name, kind), n in zip(cls.COLUMNS, struct.unpack_from(f"<{len(cls.COLUMNS)}q", image), strict=True):
            setattr(out, name, np.frombuffer(image, kind, n, at))
            at += 8 * n
        out.size = np.diff(out.offs)
        return out

    def maps(self, bits: int) -> np.ndarray:
        """A bitmap of each set's tokens."""
        out = np.zeros((len(self.size), bits // 64), np.uint64)
        at = mix(self.tokens) % np.uint64(bits)
        np.bitwise_or.at(out, (np.repeat(np.arange(len(self.size)), self.size), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        return out

    def summary(self, bits: int = BLOCK_BITS) -> tuple[int, int, int, bytes]:
        """Size range, tokens that a member may have beyond the bits it sets, and the OR of the members' bitmaps."""
        at = (mix(self.tokens) % np.uint64(bits)).astype(np.int64)
        row = np.repeat(np.arange(len(self.size)), self.size)
        distinct = np.unique(row * bits + at)
        spare = self.size - np.bincount(distinct // bits, minlength=len(self.size))
        whole = np.zeros(bits, bool)
        whole[at] = True
        return int(self.size.min()), int(self.size.max()), int(spare.max()), np.packbits(whole).tobytes()


def common(a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray) -> np.ndarray:
    """How many elements each of some sets (a, cut at a_offs) shares with each of others: products of their
    incidence matrices over slices of the elements."""
    universe = np.unique(a)
    rows = [np.repeat(np.arange(len(o) - 1), np.diff(o)) for o in (a_offs, b_offs)]
    at_a = np.searchsorted(universe, a)
    at_b = np.minimum(np.searchsorted(universe, b), max(0, len(universe) - 1))
    hit = universe[at_b] == b if len(universe) else np.zeros(len(b), bool)
    out = np.zeros((len(a_offs) - 1, len(b_offs) - 1), np.float32)
    for low in range(0, len(universe), 1 << 15):
        width = min(1 << 15, len(universe) - low)
        x, y = (np.zeros((len(o) - 1, width), np.float32) for o in (a_offs, b_offs))
        own = (at_a >= low) & (at_a < low + width)
        x[rows[0][own], at_a[own] - low] = 1
        own = hit & (at_b >= low) & (at_b < low + width)
        y[rows[1][own], at_b[own] - low] = 1
        out += x @ y.T
    return out


def cut_out(flat: np.ndarray, offs: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    return flat[offs[low] : offs[high]], offs[low : high + 1] - offs[low]


def linked(x: Block, y: Block | None, percent: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Links within one block (y is None) or between two of a cluster: for either block its sids and the documents
    that each is linked with, and stars, the smallest node of each class with each other member."""
    same = y is None
    y = x if same else y
    bits = 1 << max(6, min(14, int(4 * max(x.size.max(), y.size.max()) - 1).bit_length()))
    map_x = x.maps(bits)
    map_y = map_x if same else y.maps(bits)
    tree_x = Tree(x.size, map_x)
    tree_y = tree_x if same else Tree(y.size, map_y)
    shift = 0 if same else len(x.size)
    sid = x.sid if same else np.concatenate([x.sid, y.sid])
    links = np.zeros(len(sid), np.int64)
    parent = np.arange(len(sid))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for p, q in leaf_pairs(tree_x, tree_y, same, percent):
        a, b = (p * LEAF, min((p + 1) * LEAF, len(x.size))), (q * LEAF, min((q + 1) * LEAF, len(y.size)))
        na, nb = x.size[slice(*a)][:, None], y.size[slice(*b)][None, :]
        need = least_overlap(na, nb, percent)
        lost_a = np.bitwise_count(map_x[slice(*a)][:, None] & ~map_y[slice(*b)][None, :]).sum(2)
        lost_b = np.bitwise_count(~map_x[slice(*a)][:, None] & map_y[slice(*b)][None, :]).sum(2)
        fits = np.minimum(na - lost_a, nb - lost_b) >= need
        if same and p == q:
            fits &= np.arange(len(na))[:, None] < np.arange(nb.shape[1])[None, :]
        if fits.any() and len(x.leads) and len(y.leads):  # pairs that a smaller leader has are its
            fits &= common(*cut_out(x.leads, x.lead_offs, *a), *cut_out(y.leads, y.lead_offs, *b)) == 0
        if not fits.any():
            continue
        fits &= common(*cut_out(x.tokens, x.offs, *a), *cut_out(y.tokens, y.offs, *b)) >= need
        links[slice(*a)] += fits @ y.weight[slice(*b)]
        links[shift + b[0] : shift + b[1]] += x.weight[slice(*a)] @ fits
        for i, j in np.argwhere(fits):
            u, v = root(a[0] + i), root(shift + b[0] + j)
            if u != v:
                parent[max(u, v)] = min(u, v)
    roots = np.array([root(i) for i in range(len(sid))])
    least = np.full(len(sid), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, sid)
    star = np.flatnonzero(least[roots] != sid)
    own = [(x.sid, links[: len(x.sid)])] + ([] if same else [(y.sid, links[shift:])])
    return own, least[roots][star], sid[star]


FOUND = "sid long, links long, a long, b long, leader long, block long, low long, high long, extra long, bits binary, body binary"
FOUND_NAMES = [f.split()[0] for f in FOUND.split(", ")]


def found_rows(**columns: list | np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(FOUND_NAMES, kinds, strict=True)], names=FOUND_NAMES)


def link_rows(x: Block, y: Block | None, percent: int) -> Iterator[pa.RecordBatch]:
    own, near, far = linked(x, y, percent)
    for sid, links in own:
        some = np.flatnonzero(links)
        if len(some):
            yield found_rows(sid=sid[some], links=links[some])
    if len(near):
        yield found_rows(a=near, b=far)


def block_links(members: DataFrame, percent: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Cuts clusters into blocks and searches each. members: (leader, sid, leads, weight, least, tokens). Rows are
    links of a node (sid, links), star edges (a, b), or blocks (leader, block and so on) of clusters that may have
    several: those that end by their size or at a partition's edge."""
    order = ["leader", "band", "least", "sid"]
    step = float(np.log(100 / percent)) if percent < 100 else 1e-9
    rows = members.withColumn("band", F.floor(F.log(F.octet_length("tokens") / 8) / F.lit(step)))
    rows = rows.repartitionByRange(shuffle_width(members.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        leader, total, number, partition, part_of_more = None, 0, 0, TaskContext.get().partitionId(), True

        def closed(more: bool) -> Iterator[pa.RecordBatch]:
            """Searches the rows held; ``more``: others of their cluster may lie in other blocks."""
            sid, weight, leads, tokens = zip(*held, strict=True)
            block = Block(np.array(sid), np.array(weight), [np.frombuffer(t, np.uint64) for t in tokens], [np.array(v, np.int64) for v in leads])
            if len(sid) > 1:
                yield from link_rows(block, None, percent)
            if more:
                low, high, extra, bits = block.summary()
                yield found_rows(leader=[leader], block=[(partition << 32) + number], low=[low], high=[high], extra=[extra], bits=[bits], body=[block.image()])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("leader", "sid", "weight", "leads", "tokens")]
            for new, sid, weight, leads, tokens in zip(*columns, strict=True):
                if held and (new != leader or total >= block_tokens):
                    cut = new == leader
                    yield from closed(part_of_more or cut)
                    # The first cluster may begin in the partition before; a cut one goes on.
                    part_of_more, held, total, number = cut, [], 0, number + 1
                leader = new
                if not held or held[-1][0] != sid:  # a set that came twice
                    held.append((sid, weight, leads, tokens))
                    total += len(tokens) // 8
        if held:
            yield from closed(True)

    return rows.select("leader", "sid", "weight", "leads", "tokens").mapInArrow(run, FOUND)


def surviving(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (leader, x, y: structs of a node's number and summary) whose members may qualify, as (leader, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sides = [batch.column(c).to_pylist() for c in ("x", "y")]
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                if 100 * x["high"] < percent * y["low"] or 100 * y["high"] < percent * x["low"]:
                    continue
                met = np.bitwise_count(np.frombuffer(x["bits"], np.uint64) & np.frombuffer(y["bits"], np.uint64)).sum()
                if min(int(met) + min(x["extra"], y["extra"]), x["high"], y["high"]) >= least_overlap(np.int64(x["low"]), np.int64(y["low"]), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            numbers = [pa.array([s[i]["node"] for i in keep], pa.int64()) for s in sides]
            yield pa.RecordBatch.from_arrays([batch.column("leader").take(at), *numbers], names=["leader", "a", "b"])

    return pairs.select("leader", "x", "y").mapInArrow(run, "leader long, a long, b long")


def level_above(level: DataFrame, fan: int) -> DataFrame:
    """Nodes over ``fan`` neighbours each: their size range, spare tokens and OR."""

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bits = np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint64) for r in rows]).tobytes()
        made = {"leader": rows[0]["leader"], "node": rows[0]["node"] // fan, "low": min(r["low"] for r in rows), "high": max(r["high"] for r in rows), "extra": max(r["extra"] for r in rows), "bits": bits}
        return pa.Table.from_pylist([made], schema=table.schema)

    rows = level.withColumn("_up", F.floor(F.col("node") / fan))
    return rows.groupBy("leader", "_up").applyInArrow(lambda t: one(t.drop_columns(["_up"])), "leader long, node long, low long, high long, extra long, bits binary")


def cross_links(blocks: DataFrame, percent: int, fan: int = FAN) -> DataFrame | None:
    """The links between blocks of one cluster, as rows like those of ``block_links``; None if no cluster has two."""
    many = blocks.groupBy("leader").count().filter("count > 1")
    most = many.agg(F.max("count")).first()[0]
    if most is None:
        return None
    number = F.row_number().over(Window.partitionBy("leader").orderBy("block")) - 1
    numbered = stage(blocks.join(many, "leader", "left_semi").drop("body").withColumn("node", number.cast("long")), "jaccard-blocks")
    levels = [numbered.select("leader", "node", "low", "high", "extra", "bits")]
    while most > fan:
        levels.append(stage(level_above(levels[-1], fan), "jaccard-blocks"))
        most = -(-most // fan)
    side = lambda level, name: level.select("leader", F.struct("node", "low", "high", "extra", "bits").alias(name))
    pairs = None
    for level in reversed(levels):
        x, y = side(level, "x"), side(level, "y")
        if pairs is not None:
            up = lambda c: F.floor(F.col(f"{c}.node") / fan).alias(f"_{c}")
            x = pairs.join(x.select("leader", "x", up("x")), (pairs["leader"] == x["leader"]) & (F.col("a") == F.col("_x"))).select(pairs["leader"], "b", "x")
            met = x.join(y.select("leader", "y", up("y")), ["leader"]).filter(F.col("b") == F.col("_y"))
        else:
            met = x.join(y, "leader")
        # A block's own search is done.
        met = met.filter(F.col("x.node") < F.col("y.node") if level is levels[0] else F.col("x.node") <= F.col("y.node"))
        pairs = stage(surviving(met.repartition(shuffle_width(blocks.sparkSession)), percent), "jaccard-block-pairs")
    names = numbered.select("leader", "node", "block")
    bodies = blocks.select("block", "body")
    rows = pairs.join(names.select("leader", F.col("node").alias("a"), F.col("block").alias("block_a")), ["leader", "a"])
    rows = rows.join(names.select("leader", F.col("node").alias("b"), F.col("block").alias("block_b")), ["leader", "b"])
    rows = rows.join(bodies.select(F.col("block").alias("block_a"), F.col("body").alias("x")), "block_a")
    rows = rows.join(bodies.select(F.col("block").alias("block_b"), F.col("body").alias("y")), "block_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                yield from link_rows(Block.read(x.as_py()), Block.read(y.as_py()), percent)

    return rows.select("x", "y").mapInArrow(run, FOUND)


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label of each node's class. edges (a, b); labels (node, label) of their nodes.
    Every round takes the neighbours' smallest label and then the label of the node so named; one number a round
    reaches the driver."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "component-edges")
    state = stage(labels.select("node", "label", F.col("label").alias("own")), "component-labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = state.join(near, F.col("node") == F.col("a"), "left").select("node", "own", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("own").alias("_own"), F.col("label").alias("_label"))
        step = step.join(jump, F.col("label") == F.col("_own"), "left")
        step = stage(step.select("node", "own", F.least("label", "_label").alias("label"), "was"), "component-labels")
        changed = step.filter("label < was").limit(1).count()
        state = step.drop("was")
        if not changed:
            return state.select("node", "label")


def classes(docs: DataFrame, k: int, percent: int, few: int = FEW, block_tokens: int = BLOCK_TOKENS, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, sid (of its set; null if that is empty), class (the
    smallest sid reachable by links), component_id and n_links. docs: (doc_id, text, text_hash)."""
    none = F.lit(-(1 << 63))
    sets = stage(document_sets(docs, k), "jaccard-sets")
    docs = docs.drop("text_hash")
    rank, hot = token_ranks(sets, shuffle_width(docs.sparkSession))
    named = sets.filter("counter IS NULL").select("doc_id", "text_hash", "n", "sid")
    smallest = named.filter("sid IS NOT NULL").groupBy("sid").agg(F.min_by("doc_id", F.coalesce("doc_id", none)).alias("doc_id"), F.count("*").alias("weight"))
    alive = stage(alive_nodes(tokens_of_documents(docs, rank, hot, k, percent), hot, percent), "jaccard-alive")
    nodes = stage(node_sets(docs, smallest.join(alive, "sid", "left_semi"), rank, k), "jaccard-nodes")
    groups = stage(grouped_nodes(tokens_of_nodes(nodes, hot, percent), hot, percent, few), "jaccard-groups")
    kept = stage(clusters(groups, percent), "jaccard-members")
    # Each member knows which smaller leaders it has.
    members = kept.join(nodes, "sid").select("sid", "weight", "least", "tokens", F.posexplode("leaders").alias("_at", "leader"), "leaders")
    members = members.withColumn("leads", F.slice("leaders", F.lit(1), F.col("_at"))).drop("leaders", "_at")
    found = stage(block_links(members, percent, block_tokens), "jaccard-found")
    across = cross_links(found.filter("block IS NOT NULL").select("leader", "block", "low", "high", "extra", "bits", "body"), percent, fan)
    if across is not None:
        found = found.filter("block IS NULL").unionByName(stage(across, "jaccard-across"))
    edges = found.filter("a IS NOT NULL").select("a", "b").distinct()
    links = found.filter("sid IS NOT NULL").groupBy("sid").agg(F.sum("links").alias("links"))
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    # Sets are told apart by their hashes, since one doc_id may have texts in two classes.
    linked_sets = components(edges, ends.select("node", F.col("node").alias("label"))).select(F.col("node").alias("sid"), F.col("label").alias("class"))
    least = linked_sets.join(smallest, "sid").groupBy("class").agg(F.min(F.coalesce("doc_id", none)).alias("least"))
    own = smallest.join(linked_sets.join(least, "class"), "sid", "left").join(links, "sid", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).when(F.col("least") > none, F.col("least"))
    own = own.select("sid", F.coalesce("class", "sid").alias("class"), component.alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    whole = named.filter("sid IS NOT NULL").join(own, "sid").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "sid", "class", "component_id", "n_links")
    none = F.lit(None).cast("long")
    alone = named.filter("sid IS NULL").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "sid", none.alias("class"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return whole.unionByName(alone)


def jaccard_classes(docs: DataFrame, k: int = K, percent: int = PERCENT, few: int = FEW, block_tokens: int = BLOCK_TOKENS, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and n_links
    (the other documents that it is linked with). The last three options change the way, not the result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("text_hash"))
    return classes(docs, k, percent, few, block_tokens, fan).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of each class, with all columns of ``docs``, whatever their names: the one with the smallest doc_id
    (null first), of rows with one id the one whose text has the smallest hash, of rows equal in both any one. A row
    without words is linked with nothing, so each stays."""
    text_hash = F.xxhash64(F.col("text").cast("string"))
    found = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash.alias("text_hash")), k, percent)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash")
    texts = found.filter("class IS NOT NULL").groupBy("class", "doc_id", "text_hash").count()
    first = texts.groupBy("class").agg(F.min_by(F.struct("doc_id", "text_hash", "count"), order).alias("f")).select("f.*")
    empty = found.filter("class IS NULL").select("doc_id", "text_hash", F.lit(1).cast("long").alias("count")).distinct()
    keep = stage(first.unionByName(empty), "jaccard-kept").select(F.col("doc_id").alias("kept"), F.col("text_hash").alias("kept_hash"), F.col("count") > 1)
    keep = keep.toDF("kept", "kept_hash", "repeated")
    # The columns travel under numbers, so that their names clash with none of those used here.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash.alias("hash"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    met = F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash"))
    # Only rows that are there twice need dealing by their key.
    single = rows.join(keep.filter(~F.col("repeated")), met, "left_semi")
    double = rows.join(keep.filter("repeated"), met, "left_semi").dropDuplicates(["id", "hash"])
    return single.unionByName(double).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

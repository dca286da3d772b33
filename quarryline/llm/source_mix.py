"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, packed into blocks of one fixed length per source. The targets share a
multiple of all words by weight; none may pass a multiple of its source. Every output shard draws its slots'
sources from the multinomial of the targets; the t-th slot that a source gets is block t of the source's
pseudorandom permutation of the epoch t / blocks, and slots and blocks are joined by index. What a source draws
beyond its target is void and what it lacks goes to further shards, so each target is met to within a block.

Counts come before places: documents fall into hash buckets of bounded size, bucket sums give the buckets' places
in the stream and a window within the bucket gives the document's. Sums over buckets, and over a source's shards,
run in two levels, so no task holds a whole source; what is one row per source is planned in one task.

A null text has size 0; a null source is a source of its own, last in order; a null doc_id is a document like any
other. Repeated rows are counted first, then numbered: each is a document of its own, falls into a bucket of its own
and gets a row. Documents without words take nothing. An
empty table gives an empty result. Equal input gives equal output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.llm.common import shuffle_width, stage

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it, the first one also with what stands before it.
STRETCH = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that a bucket of the stream holds on average, and rows that one window of a running sum takes.
BUCKET, WINDOW = 500, 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text, with the number of rows that have them all."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size, F.xxhash64(text).alias("text_hash"))
    return rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies"))


def sum_before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a source that come first by ``order`` (whole numbers from 0), in two
    levels: the sums of WINDOW neighbouring numbers each, then within them."""
    before = (Window.unboundedPreceding, -1)
    rows = rows.withColumn("_group", F.floor(F.col(order) / WINDOW))
    sums = rows.groupBy("source", "_group").agg(F.sum(value).alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_group").rowsBetween(*before)), F.lit(0))
    sums = sums.select(F.col("source").alias("_source"), F.col("_group").alias("_of"), base.alias("_base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("source", "_group").orderBy(order).rowsBetween(*before)), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_of")))
    return rows.withColumn(name, F.col("_base") + F.col("_inside")).drop("_group", "_source", "_of", "_base", "_inside")


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to the same with weight and target. The targets are min(cap * source_size, level *
    weight); resharing what the capped leave, until none is above, ends at the one level that spends the share."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = per_source.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.when(F.col("left") / F.col("open") <= F.col("most") / F.col("weight"), F.col("left") / F.col("open")))
    level = F.max("level").over(everything)
    return rows.select("source", "source_size", "weight", F.coalesce(F.least(F.col("most"), F.col("weight") * level), F.col("most")).alias("target"))


def permuted(index: Column, size: Column, key: Column, rounds: int = 16) -> Column:
    """A pseudorandom permutation of 0 .. size - 1: swap-or-not rounds, each an involution on pairs."""

    def one(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, i), size) + size - x, size)
        return F.when(F.xxhash64(key, i, F.greatest(x, partner), F.lit(1)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, one)


def plan_sources(sized: DataFrame, block: int, weights: tuple, share: float, cap: float) -> DataFrame:
    """Per source: its target, its block length and count, the whole slots it fills and the words of a cut last one."""
    per_source = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, cap)
    blocks = F.ceil(F.col("source_size") / block)
    rows = per_source.withColumn("n_blocks", blocks).withColumn("block", F.when(blocks > 0, F.ceil(F.col("source_size") / blocks)).otherwise(1))
    rows = rows.withColumn("whole", F.floor(F.col("target") / F.col("block")))
    rows = rows.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("block")))
    return rows.withColumn("slots", F.when(F.col("n_blocks") > 0, F.col("whole") + (F.col("rest") > 0).cast("long")).otherwise(F.lit(0)))


def draw(sources: DataFrame, seed: int, shard_slots: int, slices: int = 1024) -> DataFrame:
    """(source, shard, first, n): the multinomial counts of each shard and the ordinal of its first slot among its
    source's slots, cut at what the source may fill; what is lacking comes in shards of their own."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("slots").over(order)
    # Each source owns a stretch of 0 .. total; a slot's number falls into one stretch, found through the slices
    # that the stretch touches, so that the join is by equality.
    width = F.lit(max(1, -(-total // slices)))
    stretch = sources.filter("slots > 0").select("source", (upto - F.col("slots")).alias("low"), upto.alias("high"))
    stretch = stretch.withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    drawn = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("at"))
    drawn = drawn.withColumn("slice", F.floor(F.col("at") / width))
    hit = drawn.join(stretch, "slice").filter("at >= low AND at < high")
    counts = hit.groupBy("source", "shard").agg(F.count("*").alias("n"))
    counts = sum_before(counts, "shard", "n", "first")
    joined = counts.join(sources.select(F.col("source").alias("s"), "slots"), F.col("source").eqNullSafe(F.col("s")), "inner")
    held = joined.filter("first < slots").select("source", "shard", "first", F.least(F.col("n"), F.col("slots") - F.col("first")).alias("n"))
    got = counts.groupBy("source").agg(F.sum("n").alias("got"))
    lack = sources.select(F.col("source").alias("s"), "slots").join(got, F.col("s").eqNullSafe(F.col("source")), "left")
    lack = lack.select(F.col("s").alias("source"), F.coalesce("got", F.lit(0)).alias("got"), "slots").filter("got < slots")
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - F.col("got") - 1) / shard_slots)))
    lack = lack.withColumn("part", parts).withColumn("first", F.col("got") + F.col("part") * shard_slots)
    extra = lack.select("source", (F.lit(-(-total // shard_slots)) + F.col("part")).alias("shard"), "first", F.least(F.lit(shard_slots), F.col("slots") - F.col("first")).alias("n"))
    return held.unionByName(extra)


def slots(sources: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """(source, shard, slot, epoch, block_index, take): each slot's block, and how many of its words it takes."""
    own = sources.select(F.col("source").alias("s"), "n_blocks", "block", "whole", "rest")
    rows = draws.join(own, F.col("source").eqNullSafe(F.col("s")), "inner")
    rows = rows.repartition(shuffle_width(rows.sparkSession), "source", "shard")  # a row becomes thousands: deal them out first
    rows = rows.withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    epoch = F.floor(F.col("slot") / F.col("n_blocks"))
    key = F.xxhash64(F.lit(seed), F.col("source"), epoch)
    index = permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), key)
    take = F.when(F.col("slot") < F.col("whole"), F.col("block")).otherwise(F.col("rest"))
    return rows.select("source", "shard", "slot", epoch.alias("epoch"), index.alias("block_index"), take.alias("take"))


def placed(sized: DataFrame, n_docs: int) -> DataFrame:
    """Each document's first word in its source's stream. Buckets order by hash, documents within a bucket by id."""
    n_buckets = max(1, -(-n_docs // BUCKET))
    rows = sized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(n_buckets)))
    sums = sum_before(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket", "words", "base")
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "inner")
    return rows.select("doc_id", "text_hash", "source", "size", "bucket", "copy", (F.col("base") + F.col("offset")).alias("start"))


def mix_parts(docs: DataFrame, block: int = 128, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, shard_slots: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed documents, the sources' plan and the pieces: which words of which document each slot takes."""
    sized = stage(sizes(docs), "mix-sizes")
    sources = stage(plan_sources(sized, block, weights, share, cap), "mix-sources")
    n_docs = sized.agg(F.sum("copies")).first()[0] or 0
    places = stage(placed(sized, n_docs), "mix-places")
    taken = slots(sources, draw(sources, seed, shard_slots), seed)
    own = sources.select(F.col("source").alias("s"), F.col("block").alias("length"))
    pieces = places.filter("size > 0").join(own, F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
    pieces = pieces.withColumn("block_index", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")))
    low = F.greatest(F.col("start"), F.col("block_index") * F.col("length"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block_index") + 1) * F.col("length"))
    pieces = pieces.select("doc_id", "text_hash", "source", "bucket", "copy", "start", F.col("block_index"), (low - F.col("start")).alias("first_word"), (low - F.col("block_index") * F.col("length")).alias("from"), (high - F.col("block_index") * F.col("length")).alias("to"))
    taken = taken.select(F.col("source").alias("s"), F.col("block_index").alias("i"), "shard", "slot", "epoch", "take")
    # The slots grow with the input, but only after the last shuffle of their plan, so Spark would take them for small.
    both = pieces.join(taken.hint("merge"), (F.col("block_index") == F.col("i")) & F.col("source").eqNullSafe(F.col("s")), "inner")
    both = both.withColumn("words", F.greatest(F.lit(0), F.least("to", "take") - F.col("from"))).filter("words > 0").drop("s", "i")
    return places, sources, both


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size and target of its source, taken words and epochs that take any."""
    places, sources, pieces = mix_parts(docs, **options)
    key = ["doc_id", "source", "text_hash", "bucket", "copy"]
    sums = pieces.groupBy(*key).agg(F.sum("words").alias("taken"), F.count_distinct("epoch").alias("epochs"))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in key], "taken", "epochs")
    same = (F.col("bucket") == F.col("_bucket")) & (F.col("copy") == F.col("_copy")) & (F.col("text_hash") == F.col("_text_hash")) & F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    rows = places.join(sums, same, "left").drop(*[f"_{k}" for k in key])
    own = sources.select(F.col("source").alias("s"), "source_size", "target")
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("s")), "inner")
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("epochs", F.lit(0)).cast("int").alias("epochs"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as texts: a row of ``docs`` for each stretch of a document that a slot takes, with the stretch's words
    and the white space behind them as text, and n_chars, if there, set anew. A source's rows have the words that the
    mix gives it, no more; the stretches of a whole document make up its text."""
    _, _, pieces = mix_parts(docs, **options)

    def key(text_hash: Column) -> Column:
        parts = [text_hash.cast("string"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))]
        return F.concat_ws("|", *parts)

    # Rows equal in id, source and text are told apart by a number; either side is dealt out by the key alone.
    found = pieces.select(key(F.col("text_hash")).alias("key"), "copy", F.struct("first_word", "words").alias("taken")).repartition("key")
    found = found.groupBy("key", "copy").agg(F.collect_list("taken").alias("taken"))
    # Among rows with one key the other columns order; maps have no order. The columns travel under numbers, so that
    # their names clash with none of those used here.
    others = [f"_{i}" for i, (c, kind) in enumerate(docs.dtypes) if c != "text" and "map<" not in kind and "variant" not in kind]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key(F.xxhash64(text)).alias("key"), text.alias("whole"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(*others)).cast("long"))
    rows = rows.join(found, ["key", "copy"])
    # The words are an argument, so that a text is split once and not once a stretch.
    cut = lambda w: F.transform("taken", lambda p: F.array_join(F.slice(w, (p["first_word"] + 1).cast("int"), p["words"].cast("int")), ""))
    rows = rows.withColumn("stretch", F.explode(F.flatten(F.transform(F.array(F.regexp_extract_all("whole", F.lit(STRETCH), F.lit(0))), cut))))
    columns = {"text": F.col("stretch"), "n_chars": F.char_length("stretch").cast("long")}
    return rows.select(*[columns.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])

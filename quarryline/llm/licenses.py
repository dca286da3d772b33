"""License scans by diagonal voting.

Every rolling hash of K words of every text is joined with the templates' hashes by Spark. Hits vote for their
diagonal (place in the text less place in the template), neighbouring diagonals merge into one candidate span, and
a span stands if its words, compared as words, cover enough of the template. Of spans that start at one place, give
or take DRIFT words, the one that covers most of its template stands.

Base phrases are templates too, but count only where all their words stand consecutively (one full diagonal).
A null text counts as empty. Repeated rows each get a row, with equal results; rows that share an id but not the
text are told apart by a hash of the text. Documents without hits get empty labels and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.llm.common import ALNUM, LOWER, gram_rows, grams, passes, prefix_hash, span, utf8, words

K = 3
#: Share of a template's K-grams that a span must match, and how far apart diagonals of one span may lie.
COVERAGE, DRIFT = 0.8, 3
#: Rows up to which the template side gets a broadcast hint; beyond, Spark chooses by size.
BROADCAST_ROWS = 50_000

BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Notices as their licences' authors publish them, in lower case and without punctuation.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
]

#: A hash no K-gram row has: the row that carries a text's word count.
HEAD = -1


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, start and end of words, word offsets; K-gram hashes, their first words and their texts."""
    data, offs = utf8(texts)
    data = LOWER[data]
    start, end, word_offs = words(data, offs, ALNUM)
    at, text = gram_rows(word_offs, K)
    value = grams(span(prefix_hash(data), start, end), K)[at].view(np.int64)
    return data, start, end, word_offs, np.where(value == HEAD, 0, value), at, text


def gram_text(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: int) -> bytes:
    return b" ".join(data[start[i] : end[i]].tobytes() for i in range(at, at + K))


def templates(base: dict[str, str], notices: list[tuple[str, str]]) -> list[tuple]:
    """(hash, template, place, words, label, base, grams) of every K-gram of every template."""
    rows = [(HEAD, -1, 0, None, None, False, 0)]
    for t, (label, text, is_base) in enumerate([*((k, v, True) for k, v in base.items()), *((k, v, False) for k, v in notices)]):
        data, start, end, _, value, at, _ = hashed(pa.array([text]))
        if not len(value):
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(int(h), t, i, gram_text(data, start, end, int(at[i])), label, is_base, len(value)) for i, h in enumerate(value)]
    return rows


def rolling(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, pos, gram, gram_words): every K-gram of every text, with its words where a template has
    its hash; and a row per text that carries the word count."""
    known = np.sort(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", 1_000_000):
                data, start, end, word_offs, value, at, text = hashed(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                _, offs = utf8(part.column("text"))
                whole = span(prefix_hash(data), offs[:-1], offs[1:]).view(np.int64)
                at_known = np.searchsorted(known, value)
                hits = np.flatnonzero(known[np.minimum(at_known, len(known) - 1)] == value)
                said = np.full(len(value), None, object)
                for i in hits:
                    said[i] = gram_text(data, start, end, int(at[i]))
                n = len(ids)
                doc = np.concatenate([np.arange(n), text])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(doc)), pa.array(whole[doc]),
                    pa.array(np.concatenate([np.diff(word_offs), at - word_offs[text]]).astype(np.int64)),
                    pa.array(np.concatenate([np.full(n, HEAD, np.int64), value])),
                    pa.array([None] * n + said.tolist(), pa.binary()),
                ], names=["doc_id", "text_hash", "pos", "gram", "gram_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_hash long, pos long, gram long, gram_words binary")


def spans(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per text and candidate span (template t >= 0: label, start, coverage, exact), and one per text with
    t = -1, its word count as start and its repetitions as copies."""
    spark: SparkSession = docs.sparkSession
    rows = templates(base, notices)
    known = spark.createDataFrame(rows, "gram long, t int, tpos int, words binary, label string, base boolean, n_grams int")
    if len(rows) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    hits = rolling(docs, np.array([r[0] for r in rows], np.int64)).join(known, "gram")
    hits = hits.filter(F.col("gram_words").eqNullSafe(F.col("words")))
    fixed = ["doc_id", "text_hash", "t", "label", "base", "n_grams"]
    hits = hits.withColumn("diagonal", F.when(F.col("t") >= 0, F.col("pos") - F.col("tpos")).otherwise(0))
    votes = hits.groupBy(*fixed, "diagonal").agg(F.collect_set("tpos").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("copies"))
    votes = votes.withColumn("exact", F.size("places") == F.col("n_grams"))
    w = Window.partitionBy("doc_id", "text_hash", "t").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT) | F.col("base")
    votes = votes.withColumn("cluster", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(w))
    return votes.groupBy(*fixed, "cluster").agg(
        F.min("low").alias("start"), F.max("high").alias("end"), F.max("copies").alias("copies"), F.max("exact").alias("exact"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.greatest(F.col("n_grams"), F.lit(1))).alias("coverage"),
    )


def scan(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: list[tuple[str, str]] = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(docs, base, notices)
    # Notices of kin licences differ by a word or two: of those that start at one place the best covered one counts.
    beside = Window.partitionBy("doc_id", "text_hash", "base", F.col("t") < 0).orderBy("start").rangeBetween(-DRIFT, DRIFT)
    found = found.withColumn("beaten", ~F.col("base") & (F.col("coverage") < F.max("coverage").over(beside)))
    place = F.when(F.col("base") & F.col("exact"), F.col("start"))
    label = F.when(F.col("base") & F.col("exact"), F.col("label"))
    any_label = F.when(F.when(F.col("base"), F.col("exact")).otherwise((F.col("coverage") >= coverage) & ~F.col("beaten")) & (F.col("t") >= 0), F.col("label"))
    out = found.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(F.col("t") < 0, F.col("start"))).alias("n_words"), F.max(F.when(F.col("t") < 0, F.col("copies"))).alias("copies"),
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(any_label)), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("t") >= 0, F.when(~F.col("base") | F.col("exact"), F.col("coverage")))), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

"""A training corpus in five stages, each an operator of ``quarryline.llm``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes and reads again as the next
one's documents. Stages pass on the columns of documents; the last gives token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import language_id, ngram_join, pieces, source_mix, suffix_dedup
from quarryline.llm.common import load, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that has half of their words, go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 100 bytes that occur earlier go; documents that lose all their text go with it."""
    out = suffix_dedup.deduplicated(docs)
    return out.filter("text IS NOT NULL AND text <> ''")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stretches of documents that the mix takes, as often as it takes them."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_strings),
    ("source mix", mix),
    ("sentencepiece", encode),
]

#: Language ID learns from the documents, and the mix draws pseudorandom numbers: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

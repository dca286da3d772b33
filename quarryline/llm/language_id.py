"""Language ID by multilingual mixture inference.

Byte trigrams, counted by Spark over a bounded sample per language, give each word its likelihood under each
language. Expectation-maximisation then estimates a document's language proportions from its words, for all
documents of a batch at once; nested sets of its likeliest languages compete by likelihood less a penalty for
each language, and the largest proportion of the winning set is the prediction.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing can be learned
(an empty table, or no language given). A null doc_id counts as held out. Repeated rows each get a row. Only the
text goes into a prediction; other columns pass through ``identify`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import LOWER, below, passes, utf8, with_columns, word_table, words

#: Trigram buckets, and documents per language that training reads (expected number under hash sampling).
BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 2000
ROUNDS = 10
#: Proportion under which a language is left out of the nested sets, and the penalty's factor.
LEAST_SHARE, PENALTY = 0.02, 2.0

LETTERS = word_table(bytes(b for b in range(256) if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz"))


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter byte, the words' first trigrams, and n + 1 offsets of the texts'
    words and of their trigrams."""
    low = LOWER[data]
    start, end, word_offs = words(low, offs, LETTERS)
    inside = LETTERS[low]
    plain = np.where(inside, low, 32).astype(np.uint32)
    before, after = np.full(len(plain), 32, np.uint32), np.full(len(plain), 32, np.uint32)
    before[1:], after[:-1] = plain[:-1], plain[1:]
    before[start], after[end - 1] = 32, 32
    at = np.flatnonzero(inside)
    bucket = (before[at] * np.uint32(0x9E3779B1) + plain[at] * np.uint32(0x85EBCA77) + after[at] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    return bucket, ends[:-1], word_offs, ends[word_offs]


@dataclass
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # bucket by language


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from documents that aren't held out and name a language. The sample takes the rows of a language
    whose id hash is low enough, about ``sample`` rows each; what reaches the driver is a count per language and
    bucket."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    totals = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not totals:
        return Model([], np.zeros((BUCKETS, 0)))
    picks = F.lit(False)
    for lang, n in totals.items():
        picks = picks | ((F.col("lang") == lang) & below(F.col("doc_id"), sample / n))
    picked = usable.filter(picks).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in passes(batch, "text"):
                bucket, _, _, gram_offs = trigrams(*utf8(part.column("text")))
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    own = bucket[gram_offs[i] : gram_offs[i + 1]]
                    found[lang] = found.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    languages = sorted(totals)
    counts = np.zeros((BUCKETS, len(languages)))
    for r in picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.bucket, languages.index(r.lang)] = r.n
    if not counts.any() and picked.filter("text IS NOT NULL").isEmpty() and not usable.filter("text IS NOT NULL").isEmpty():
        raise ValueError("the sample has no document")
    smooth = counts + 0.5
    return Model(languages, np.log(smooth / smooth.sum(0)).astype(np.float32))


def mixture(likelihood: np.ndarray, word_offs: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text, whose words' likelihoods by language are given; every text has
    a word. ``allowed`` says which languages a text may mix."""
    doc = np.repeat(np.arange(len(word_offs) - 1), np.diff(word_offs))
    n = np.diff(word_offs)[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = likelihood * share[doc]
        joint /= joint.sum(1, keepdims=True) + 1e-300
        share = np.add.reduceat(joint, word_offs[:-1], axis=0) / n
    total = (likelihood * share[doc]).sum(1) + 1e-300
    return share, np.add.reduceat(np.log(total), word_offs[:-1])


def infer(data: np.ndarray, offs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the prediction's index (-1: none), its proportion and how many languages it mixes."""
    n, languages = len(offs) - 1, len(model.languages)
    best, score, kinds = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    bucket, first, word_offs, _ = trigrams(data, offs)
    full = np.flatnonzero(np.diff(word_offs) > 0)
    if not languages or not len(full):
        return best, score, kinds
    log_word = np.add.reduceat(model.log_likelihood[bucket], first, axis=0)
    peak = log_word.max(1, keepdims=True)
    likelihood = np.exp(log_word - peak).astype(np.float64)
    offsets = np.concatenate([word_offs[full], word_offs[-1:]])
    share, _ = mixture(likelihood, offsets, np.ones((len(full), languages)))
    alone = np.add.reduceat(np.maximum(log_word - peak, -600.0).astype(np.float64), offsets[:-1], axis=0)
    length = np.log(np.diff(offsets) + 1.0)
    value, pick = alone.max(1) - PENALTY * length, alone.argmax(1)
    top, size = share[np.arange(len(full)), pick].copy(), np.ones(len(full), np.int64)
    ranked = np.argsort(-share, axis=1, kind="stable")
    for k in range(2, languages + 1):
        again = np.flatnonzero(share[np.arange(len(full)), ranked[:, k - 1]] >= LEAST_SHARE)
        if not len(again):
            break
        allowed = np.zeros((len(again), languages))
        np.put_along_axis(allowed, ranked[again, :k], 1.0, axis=1)
        counts = np.diff(offsets)[again]
        own = np.concatenate([[0], np.cumsum(counts)])
        rows = np.arange(own[-1]) + np.repeat(offsets[again] - own[:-1], counts)
        mixed, fit = mixture(likelihood[rows], own, allowed)
        better = fit - PENALTY * k * length[again] > value[again]
        won = again[better]
        value[won] = (fit - PENALTY * k * length[again])[better]
        pick[won], top[won], size[won] = mixed[better].argmax(1), mixed[better].max(1), k
    best[full], score[full], kinds[full] = pick, np.clip(top, 0.0, 1.0), size
    return best, score, kinds


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and n_languages."""
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                best, score, kinds = infer(*utf8(part.column("text")), model)
                for i in np.flatnonzero(best >= 0):
                    text = part.column("text")[int(i)].as_py()
                    if not any(c.isalpha() for c in text):  # stops at the first letter
                        best[i], score[i], kinds[i] = -1, 0.0, 0
                yield with_columns(part, lang_pred=pa.array(names[best].tolist(), pa.string()), score=pa.array(score), n_languages=pa.array(kinds))

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "n_languages")]
    rows = docs.select(*[F.col(c).cast("string") if c == "text" else F.col(c) for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, n_languages long")


def predict(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score and n_languages."""
    out = identify(docs.select("doc_id", "text"), train(docs, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_languages")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents in which one language has at least ``least`` of the words; the columns of ``docs``, whatever
    their names."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = identify(packed, train(docs))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")

"""Models behind interfaces, with deterministic offline defaults: embedder, reranker, rewriter, chat, OCR, titles.

A provider is a picklable function over a batch; plans call it with batches of bounded size, with the order of its
input kept. ``called`` and ``reranked`` are for services: answers come in any order, calls fail and are tried again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from string import Formatter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Embedder = Callable[[list[str]], np.ndarray]
#: A service that embeds texts: (index, vector) for each, in any order.
Service = Callable[[list[str]], list[tuple[int, list[float]]]]
#: A service that scores documents for a question: (index, relevance) for each, in any order.
RerankService = Callable[[str, list[str]], list[tuple[int, float]]]


@lru_cache(1 << 16)
def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def hashed_embedder(texts: list[str], size: int = 64) -> np.ndarray:
    """Signed word hashes, normalised; a text without words is the zero vector."""
    words = [(text or "").lower().split() for text in texts]
    hashes = np.array([word_hash(w) for own in words for w in own], np.uint64)
    row = np.repeat(np.arange(len(texts)), np.array([len(own) for own in words], np.int64))
    place = row * size + (hashes % np.uint64(size)).astype(np.int64)
    out = np.bincount(place, np.where(hashes >> np.uint64(63), 1.0, -1.0), len(texts) * size).astype(np.float32).reshape(len(texts), size)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def embedded(rows: DataFrame, text: str, embedder: Embedder = hashed_embedder, batch: int = 32) -> DataFrame:
    """Adds embedding; the provider sees ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            parts = [embedder(column.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(column), batch)]
            yield pd.Series([list(map(float, v)) for p in parts for v in p], dtype=object)

    return rows.withColumn("embedding", run(text))


def answered(service: Callable[[list], list[tuple[int, object]]], items: list, attempts: int, pause: float) -> list[tuple[object, str | None]]:
    """(answer, error) for each item, in their order. A call that fails, or that doesn't answer each index once, is made
    up to ``attempts`` times, after ``pause``, twice and four times ``pause`` seconds and so on; then its halves are
    called, so that in the end an error stays with the items that cause it."""
    if not items:
        return []
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            found = list(service(items))
            by_index = dict(found)
            if len(found) != len(items) or set(by_index) != set(range(len(items))):
                raise ValueError(f"{len(items)} asked, answers have the indices {sorted(i for i, _ in found)[:10]}")
            return [(by_index[i], None) for i in range(len(items))]
        except Exception as e:  # noqa: BLE001  whatever a service raises is its items' error
            error = f"{type(e).__name__}: {e}"
    if len(items) == 1:
        return [(None, error)]
    middle = len(items) // 2
    return answered(service, items[:middle], attempts, pause) + answered(service, items[middle:], attempts, pause)


def called(rows: DataFrame, text: str, service: Service, size: int = 10, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """Adds embedding, of length 1 unless it is zero, and embedding_error, one of which is null. Calls hold ``size``
    texts, the last one of a task fewer, however rows come in batches; a null text is embedded as an empty one. Columns
    of these names are replaced."""
    kept = rows.drop("embedding", "embedding_error")
    at = kept.columns.index(text)

    def vectors(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        out = []
        for vector, error in answered(service, texts, attempts, pause):
            if error is None:
                own = np.asarray(vector, np.float64)
                length = np.linalg.norm(own)
                vector = (own / length if length else own).astype(np.float32)
            out.append((vector, error))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for t in table.column(at).to_pylist()]
            out = [v for i in range(0, len(texts), size) for v in vectors(texts[i : i + size])]
            columns = [*table.columns, pa.array([v for v, _ in out], pa.list_(pa.float32())), pa.array([e for _, e in out], pa.string())]
            yield from pa.table(columns, names=[*table.column_names, "embedding", "embedding_error"]).combine_chunks().to_batches()

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= size:
                table, whole = pa.Table.from_batches(waiting), n // size * size
                yield from made(table.slice(0, whole))
                waiting, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield from made(pa.Table.from_batches(waiting))

    schema = T.StructType([*kept.schema, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_error", T.StringType())])
    return kept.mapInArrow(run, schema)


def reranked(candidates: DataFrame, service: RerankService, most: int = 500, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """(query_id, pos, relevance_score, error, place) for candidates (query_id, query, pos, text), whose pos counts from 0
    within a query. A call takes at most ``most`` documents of one query; those beyond go in further calls, and ``place``
    ranks all of a query's by score, ties by pos; documents whose call failed come last, with their error. A null text or
    query is an empty one. Candidates of equal pos are answered one by one; those without pos are dropped."""
    kinds = dict(candidates.select("query_id", "pos").dtypes)
    rows = candidates.select("query_id", "query", "pos", "text").filter("pos IS NOT NULL").withColumn("_call", F.floor(F.col("pos") / most))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", kind="stable")
        query, texts, out = frame["query"].iloc[0], frame["text"].fillna("").tolist(), []
        query = "" if query is None else query
        for i in range(0, len(texts), most):
            out += answered(lambda own: service(query, own), texts[i : i + most], attempts, pause)
        scored = frame[["query_id", "pos"]].reset_index(drop=True)
        return scored.assign(relevance_score=[None if e else float(s) for s, e in out], error=[e for _, e in out])

    scored = rows.groupBy("query_id", "_call").applyInPandas(run, f"query_id {kinds['query_id']}, pos {kinds['pos']}, relevance_score double, error string")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc_nulls_last(), "pos")) - 1
    return scored.withColumn("relevance_score", F.nanvl("relevance_score", F.lit(None).cast("double"))).withColumn("place", place)


def cosine_reranker(candidates: DataFrame, most: int = 500) -> DataFrame:
    """(query_id, index, relevance_score) for candidates (query_id, pos, cosine): the stand-in for a rerank service,
    which takes ``most`` documents a call."""
    return candidates.filter(F.col("pos") < most).select("query_id", F.col("pos").alias("index"), F.col("cosine").alias("relevance_score"))


def no_rewrites(queries: DataFrame) -> DataFrame:
    """(question_id, pos, text), empty: what a rewriter that fails gives."""
    return queries.select("question_id", F.lit(0).alias("pos"), "text").limit(0)


def echo_chat(prompt: Column) -> Column:
    return F.concat(F.lit("echo: "), F.substring(prompt, 1, 80))


def rendered(template: str, **values: str) -> str:
    """A template with its variables set; the error names all that are missing, sorted."""
    missing = sorted({name for _, name, _, _ in Formatter().parse(template) if name} - set(values))
    if missing:
        raise KeyError(f"missing variables: {', '.join(missing)}")
    return template.format(**values)

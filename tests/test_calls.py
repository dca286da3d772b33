"""Calls of services: sizes, order, retries, failures."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.plans import calls as plans
from quarryline.sources import providers

SF = "/root/testdata/sf0.001"


def test_answers_in_order():
    rng, sizes = random.Random(1), []

    def service(items):
        sizes.append(len(items))
        out = [(i, x * 2) for i, x in enumerate(items)]
        rng.shuffle(out)
        return out

    assert providers.answered(service, list(range(20)), 3, 0.0) == [(2 * x, None) for x in range(20)] and sizes == [20]
    assert providers.answered(service, [], 3, 0.0) == [] and sizes == [20]


def test_failures_stay_with_their_items():
    """A call is tried as often as said, then halved; only the item that fails has the error."""
    calls = Counter()

    def service(items):
        calls[tuple(items)] += 1
        if 5 in items:
            raise ValueError("five")
        return [(i, x) for i, x in enumerate(items)]

    got = providers.answered(service, list(range(8)), 2, 0.0)
    assert [x for x, _ in got] == [0, 1, 2, 3, 4, None, 6, 7] and [e for _, e in got] == [None] * 5 + ["ValueError: five"] + [None] * 2
    assert max(calls.values()) == 2 and calls[(0, 1, 2, 3)] == 1 and calls[(5,)] == 2


@pytest.mark.parametrize("answer", [[(0, 1)], [(0, 1), (0, 2)], [(0, 1), (2, 2)], [(0, 1), (1, 2), (1, 3)]])
def test_wrong_indices_are_failures(answer):
    got = providers.answered(lambda items: answer if len(items) == 2 else [(0, items[0])], ["a", "b"], 1, 0.0)
    assert got == [("a", None), ("b", None)], "the halves answer rightly"


def test_call_sizes_across_batches(spark):
    """Calls are full but a task's last one, though Arrow batches hold three rows."""

    def service(texts):
        assert len(texts) <= 10
        return [(i, [float(len(texts)), 0.0]) for i in reversed(range(len(texts)))] if len(texts) in (10, 5) else [(99, [])]

    rows = spark.range(25).coalesce(1).select(F.col("id").cast("string").alias("text"), F.lit("old").alias("embedding"), F.lit(1).alias("index"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = providers.called(rows, "text", service, attempts=1, pause=0.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.text for r in found] == [str(i) for i in range(25)] and all(r.embedding == [1.0, 0.0] and r.embedding_error is None and r["index"] == 1 for r in found)


def test_nulls_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id long, text string")
    found = {r.id: r for r in providers.called(rows, "text", lambda texts: [(i, [3.0 * len(t), 4.0 * len(t)]) for i, t in enumerate(texts)], pause=0.0).collect()}
    assert found[1].embedding == [0.0, 0.0] and found[2].embedding == pytest.approx([0.6, 0.8]) and found[1].text is None
    assert providers.called(rows.limit(0), "text", lambda texts: [], pause=0.0).collect() == []


def test_reranked_over_calls(spark):
    """Order holds over all calls of a query; ties go by pos, failed ones come last."""

    def service(query, texts):
        assert len(texts) <= 4
        if "bad" in texts:
            raise ValueError("bad")
        return [(i, float(t)) for i, t in reversed(list(enumerate(texts)))]

    texts = ["1", "5", "3", "bad", "5", "2", "9", None, "0"]
    rows = [("a", "q", i, t or "7") for i, t in enumerate(texts)] + [("b", None, 0, "1"), ("b", None, None, "1")]
    got = providers.reranked(spark.createDataFrame(rows, "query_id string, query string, pos int, text string"), service, most=4, attempts=1, pause=0.0)
    places = [(r.pos, r.relevance_score) for r in got.filter("query_id = 'a'").orderBy("place").collect()]
    assert places == [(6, 9.0), (7, 7.0), (1, 5.0), (4, 5.0), (2, 3.0), (5, 2.0), (0, 1.0), (8, 0.0), (3, None)]
    assert [(r.pos, r.place) for r in got.filter("query_id = 'b'").collect()] == [(0, 0)]
    assert got.filter("error IS NOT NULL").select("pos", "error").collect() == [(3, "ValueError: bad")]


def test_hashed_embedder(monkeypatch):
    """Each word's signed place, as they are defined one by one; a repeated word is hashed once."""
    import hashlib

    made, texts = [], ["a b a", None, "", "A\u00e9 b", "x " * 50]
    blake = hashlib.blake2b
    want = np.zeros((len(texts), 16), np.float32)
    for row, t in zip(want, texts, strict=True):
        for word in (t or "").lower().split():
            h = int.from_bytes(blake(word.encode(), digest_size=8).digest(), "little")
            row[h % 16] += 1 if h >> 63 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    providers.word_hash.cache_clear()
    monkeypatch.setattr(providers.hashlib, "blake2b", lambda *a, **k: made.append(a) or blake(*a, **k))
    assert np.allclose(providers.hashed_embedder(texts, 16), want) and len(made) == 4
    assert providers.hashed_embedder([], 16).shape == (0, 16)


def test_candidates_are_numbered_before_they_meet_questions(spark):
    """No window goes by question but the one over scores: texts aren't sorted once a question."""
    plan = plans.rerank_calls(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(query_id") == 1

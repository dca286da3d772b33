"""The segmented inverted index against one that is built anew."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryline.operators import lexical, postings
from quarryline.sources.commits import Commits

ROWS = "chunk_id long, text string"
WORDS = ["the", "law", "of", "roads", "applies", "to", "drivers", "and", "vehicles", "酒后驾驶"]


def text(rng):
    return None if rng.random() < 0.05 else " ".join(rng.choices(WORDS, k=rng.randrange(9)))


def terms(index):
    return {(r.term, r.df, round(r.idf, 9)) for r in index.terms.collect()}


def rows(index):
    return sorted((r.term, r.chunk_id, r.tf, r.dl) for r in index.postings.select("term", "chunk_id", "tf", "dl").collect())


def same(spark, root, corpus, at=None):
    """A version has the postings, the frequencies and the numbers of an index over the texts."""
    got, want = postings.index(spark, root, at), lexical.build(spark.createDataFrame(sorted(corpus.items()), ROWS))
    assert rows(got) == rows(want) and terms(got) == terms(want)
    assert got.n == want.n and got.mean_length == pytest.approx(want.mean_length)


@pytest.mark.parametrize("seed", range(2))
def test_random_rounds(spark, tmp_path, seed):
    """Documents come, change and go; each version equals an index built anew, later ones don't change it, and merges
    keep the segments few."""
    rng, root, corpus, past = random.Random(seed), str(tmp_path), {}, []
    for size in (40, 3, 2, 5, 3, 2, 4):
        new = {rng.randrange(60): text(rng) for _ in range(size)}
        gone = rng.sample(range(70), 4)
        postings.update(spark.createDataFrame(list(new.items()), ROWS), root, spark.createDataFrame([(k,) for k in gone], "chunk_id long"))
        corpus = {k: v for k, v in corpus.items() if k not in gone} | new
        past.append(dict(corpus))
    same(spark, root, corpus)
    same(spark, root, past[2], at=3)
    record = Commits(root).read(7)
    assert len(record["segments"]) <= 6 and len(record["gone"]) < postings.FAN
    assert postings.vacuum(root, keep=1) > 0
    same(spark, root, corpus)


def test_scores(spark, tmp_path):
    root = str(tmp_path)
    postings.update(spark.createDataFrame([(1, "the law of roads"), (2, "the vehicles"), (3, "law law")], ROWS), root)
    postings.update(spark.createDataFrame([(2, "roads of law")], ROWS), root, spark.createDataFrame([(3,)], "chunk_id long"))
    asked = spark.createDataFrame([(7, "roads law law"), (8, "vehicles")], "query_id long, text string")
    want = lexical.scores(lexical.build(spark.createDataFrame([(1, "the law of roads"), (2, "roads of law")], ROWS)), asked)
    plain = lambda df: sorted((r.query_id, r.chunk_id, round(r.bm25, 9)) for r in df.collect())
    assert plain(lexical.scores(postings.index(spark, root), asked)) == plain(want)


def test_odd_rows(spark, tmp_path):
    """Null ids go, of one id the least text stays, extra columns do no harm, an empty version has no rows."""
    root = str(tmp_path)
    with pytest.raises(LookupError):
        postings.index(spark, root)
    odd = spark.createDataFrame([(None, "x"), (1, "b b"), (1, "a"), (2, None)], ROWS).withColumns({"tf": F.lit(1), "segment": F.lit("s"), "dl": F.lit(0)})
    postings.update(odd, root)
    found = postings.index(spark, root)
    assert rows(found) == [("a", 1, 1, 1)] and found.n == 2 and found.mean_length == 0.5
    assert postings.update(odd.limit(0), root, spark.createDataFrame([(1,), (2,)], "chunk_id long")) == 2
    found = postings.index(spark, root)
    assert rows(found) == [] and terms(found) == set() and found.n == 0
    postings.update(odd.limit(0), str(tmp_path / "new"))
    assert rows(postings.index(spark, str(tmp_path / "new"))) == []


def test_two_writers(spark, tmp_path):
    """Both get in, and a text that both have is there once."""
    root = str(tmp_path)
    sides = [{i: f"law {WORDS[i % 9]}" for i in range(12)}, {i: f"law {WORDS[i % 9]}" for i in range(8, 20)}]
    with ThreadPoolExecutor(2) as pool:
        numbers = list(pool.map(lambda side: postings.update(spark.createDataFrame(list(side.items()), ROWS), root), sides))
    assert sorted(numbers) == [1, 2]
    same(spark, root, sides[0] | sides[1])
    assert not list(Path(tmp_path, "new").iterdir())


def test_tables_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    """A task's part doesn't grow with the table where the session's number of partitions stays."""
    monkeypatch.setattr(postings, "POSTINGS", 20)
    monkeypatch.setattr(postings, "SMALL_ROWS", 3)
    root, corpus = str(tmp_path), {i: " ".join(WORDS[i % 5 :]) for i in range(100)}
    postings.update(spark.createDataFrame(list(corpus.items()), ROWS), root)
    own = Commits(root).read(1)["segments"][0]["id"]
    files = [spark.read.parquet(str(f)).count() for f in (tmp_path / "segments" / own / "postings").glob("*.parquet")]
    assert sum(files) == 800 and len(files) > 30 and max(files) <= 40
    gone = [i for i in corpus if i % 10 == 5]
    postings.update(spark.createDataFrame([], ROWS), root, spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
    same(spark, root, {i: t for i, t in corpus.items() if i not in gone})

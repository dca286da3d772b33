"""The most probable words, against all ways to cut."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quarryline.functions.text import cjk_tokens
from quarryline.operators import segmentation as seg
from quarryline.plans import catalog

SF = "/root/testdata/sf0.001"


def brute(stretch, freq):
    """The best of all cuts whose parts are words or single characters; of equal ones the first by its longer words."""
    total = sum(freq.values()) or 1

    def cuts(s):
        if not s:
            yield []
        for m in range(1, len(s) + 1):
            if m == 1 or s[:m] in freq:
                for rest in cuts(s[m:]):
                    yield [s[:m], *rest]

    def score(words):
        out = 0.0
        for w in reversed(words):
            out = math.log(freq.get(w, 1)) - math.log(total) + out
        return out

    return max(cuts(stretch), key=lambda words: (round(score(words), 9), [len(w) for w in words]))


@pytest.mark.parametrize("seed", range(60))
def test_best_path(seed):
    rng = random.Random(seed)
    freq = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): rng.choice([1, 2, 7, 50, 1000]) for _ in range(rng.randrange(12))}
    total, s = sum(freq.values()) or 1, "".join(rng.choices("abcd", k=11))
    logs = {w: math.log(f) - math.log(total) for w, f in freq.items()}
    got, want = seg.best_path(s, logs, -math.log(total), max(map(len, freq), default=1)), brute(s, freq)
    value = lambda words: sum(logs.get(w, -math.log(total)) for w in words)
    assert "".join(got) == s and value(got) == pytest.approx(value(want), abs=1e-9)
    assert all(len(w) == 1 or w in freq for w in got)


WORDS = [("研究", 100), ("研究生", 50), ("生命", 100), ("起源", 100), ("命", 5), ("驾驶", 40), ("酒后驾驶", 20)]


def words(found):
    return {r.id: r.words for r in found.collect()}


@pytest.mark.parametrize("most", [100, 0])
def test_frequencies_beat_greedy_matching(spark, most):
    rows = spark.createDataFrame([(1, "研究生命起源 ABC12，酒后驾驶"), (2, None), (3, ""), (4, "。！"), (5, "驾x驾驶" + "起源" * 3000)], "id long, text string").withColumn("word", F.lit("w"))
    listed = spark.createDataFrame([*WORDS, (None, 3), ("", 9), ("生命", 7), ("零", 0)], "word string, freq long")
    got = words(seg.segmented(rows, "id", "text", listed, most=most))
    assert got[1] == ["研究", "生命", "起源", "abc12", "酒后驾驶"] and got[2] == got[3] == got[4] == []
    assert got[5] == ["驾", "x", "驾驶", *["起源"] * 3000]
    greedy = rows.filter("id = 1").select(cjk_tokens(F.col("text"), [w for w, _ in WORDS]).alias("w")).first().w
    assert greedy[:2] == ["研究生", "命"]
    assert words(seg.segmented(rows.filter("id = 1"), "id", "text", listed.limit(0), most=most))[1][:3] == ["研", "究", "生"]
    assert words(seg.segmented(rows.limit(0), "id", "text", listed, most=most)) == {}


def test_both_ways_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.translate(F.substring("text", 1, 200), " ", "").alias("text"))
    listed = seg.learned(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), spark.read.parquet(f"{SF}/documents.parquet"))
    one, two = ({r.doc_id: r.words for r in seg.segmented(docs, "doc_id", "text", listed, r"[\p{L}\p{N}]", most).collect()} for most in (10**6, 0))
    assert one == two and len(one) == docs.count()


def test_query_against_its_parts(spark):
    """The query's counts from its own words by plain sets; most boundaries come back."""
    rows = catalog.QUERIES["c18_segmented_words"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == n and all(0 <= r.n_right <= min(r.n_words, r.n_found) for r in rows)
    assert sum(r.n_right for r in rows) / sum(r.n_words for r in rows) > 0.8


def test_large_dictionaries_expand_no_text(spark):
    """Beyond the size that is sent, no substring becomes a row and nothing is shuffled."""
    rows = spark.createDataFrame([(1, "abab" * 50), (2, None), (3, "")], "id long, text string")
    found = seg.segmented(rows, "id", "text", spark.createDataFrame([("ab", 3), ("aba", 1), ("b", 2)], "word string, freq long"), "[a-z]", most=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan
    assert {r.id: r.words for r in found.collect()} == {1: ["ab"] * 100, 2: [], 3: []}


def dictionary(path, freq):
    pq.write_table(pa.table({"word": pa.array(list(freq), pa.string()), "freq": pa.array(list(freq.values()), pa.int64())}), f"{path}/words.parquet")
    return seg.Dictionary([f"{path}/words.parquet"], fs.LocalFileSystem(), sum(freq.values()) or 1)


@pytest.mark.parametrize("seed", range(20))
def test_stretches_together(seed, tmp_path, monkeypatch):
    """Stretches of many rows in bundles and blocks of few characters: each has the words that it has alone, also in
    letters of two to four bytes, with words of one hash, and in rows that are a slice."""
    rng = random.Random(seed)
    monkeypatch.setattr(seg, "TOGETHER", rng.choice([1, 40, 10**6]))
    monkeypatch.setattr(seg, "BLOCK", rng.choice([3, 1 << 16]))
    monkeypatch.setattr(seg, "TABLE_BITS", rng.choice([1, 26]))
    if seed % 4 == 0:
        monkeypatch.setattr(seg, "MIX", np.uint64(0))
    letters = rng.choice(["ab", "aé研", "ab𠀀ꀀ"])
    freq = {"".join(rng.choices(letters, k=rng.randrange(1, 9))): rng.choice([1, 2, 2, 50]) for _ in range(rng.randrange(40))}
    words = dictionary(tmp_path, freq)
    logs = {w: math.log(f) + words.unknown for w, f in freq.items()}
    rows = [[{"s": "".join(rng.choices(letters + "x", k=rng.choice([1, 2, 9, 60]))), "cut": rng.random() < 0.8} for _ in range(rng.randrange(4))] for _ in range(30)]
    runs = pa.array(rows, pa.list_(pa.struct([("s", pa.string()), ("cut", pa.bool_())])))
    want = [[w for r in own for w in (seg.best_path(r["s"], logs, words.unknown, max(map(len, freq), default=1)) if r["cut"] else [r["s"]])] for own in rows]
    assert seg._cut(runs, words).to_pylist() == want and seg._cut(runs.slice(7, 9), words).to_pylist() == want[7:16]
    assert seg._cut(runs.slice(0, 0), words).to_pylist() == []


def test_long_words_cost_only_where_they_begin(tmp_path):
    """Substrings are looked up as far as a word begins like them, not up to the longest word everywhere."""
    words, looked, n = dictionary(tmp_path, {"zq" * m: 1 for m in range(1, 41)}), [], 8_000

    class Table(np.ndarray):
        def __getitem__(self, slots):
            looked.append(len(slots))
            return self.view(np.ndarray)[slots]

    words.table = words.table.view(Table)
    found = list(words.edges(seg.code_points("abcdefgh" * (n // 8 - 10) + "zq" * 40), np.arange(n, 0, -1)))
    assert sum(looked) < 5 * n and sum(len(at) for _, at, _ in found) == 40 * 41 // 2


def test_query_joins_no_texts(spark):
    """Words there were go along with the text; they aren't joined to those found."""
    plan = catalog.QUERIES["c18_segmented_words"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_kept_columns(spark):
    """What is kept goes along, by both ways, also where keys repeat."""
    rows = spark.createDataFrame([(1, "生命起源", [1]), (1, "起源", None), (None, None, [])], "id long, text string, own array<int>")
    listed = spark.createDataFrame([("生命", 3), ("起源", 2)], "word string, freq long")
    for most in (100, 0):
        got = seg.segmented(rows, "id", "text", listed, most=most, keep=("own",)).collect()
        assert sorted(((r.id, r.words, r.own) for r in got), key=repr) == [(1, ["生命", "起源"], [1]), (1, ["起源"], None), (None, [], [])]


def test_agreement_of_a_slice():
    """Numbers of words, and of ends that agree, of rows that are part of a batch; a text without words has none."""
    from quarryline.plans.texts import agreement

    own, words = ["a b", None, "ab c d", "éa b"], [["ab"], [], ["a", "bc", "d"], ["éa", "b"]]
    rows = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array(words, pa.list_(pa.string())), pa.array(own, pa.string())], names=["doc_id", "words", "own"])
    got = [[r["doc_id"], r["n_words"], r["n_found"], r["n_right"]] for r in agreement(rows.slice(1)).to_pylist()]
    assert got == [[1, 0, 0, 0], [2, 3, 3, 2], [3, 2, 2, 2]]
    assert [r["words_md5"] for r in agreement(rows).to_pylist()] == [hashlib.md5(" ".join(w).encode()).hexdigest() for w in words]

"""Runs of words against a search that compares words one by one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarryline.llm import periodic_runs

ODD = [None, "", " ", "\n\n", "word", "same " * 400, "a b " * 12, "a b " * 11 + "a", " ".join("x" * 23), " ".join("x" * 24), "\x00 \x00\x00 " * 30, "ü ü " * 40, "12345678 123456789 " * 20, "w" * 9000 + " " + "w" * 9001]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute_runs(words):
    """Every stretch that no neighbour extends, with the smallest period that fits it."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text):
    words = split(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts(seed, count):
    """Random words of small and large vocabularies, with stretches repeated, nested and cut."""
    rng = random.Random(seed)
    for _ in range(count):
        letters = rng.choice(["ab", "abc", "abcdefghijklmnop"])
        words: list[str] = []
        for _ in range(rng.randint(1, 6)):
            block = [rng.choice(letters) * rng.choice([1, 1, 9]) for _ in range(rng.randint(1, 14))]
            times = rng.choice([1, 1, 3, 8, 25])
            words += (block * times)[: rng.randint(1, len(block) * times)]
        yield rng.choice([" ", "\n", "  \t"]).join(words)


def test_report(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, *texts(1, 150)])]
    rows += [(None, "a b c " * 20, "x"), (4, "same id", "x"), (5, ODD[5], "x"), (5, ODD[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.report(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_row(doc_id, text) for doc_id, text, _ in rows]
    assert sum(r[1] > 0 for r in want) > 40 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert periodic_runs.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [7, 100, 500_000])
def test_slices_change_nothing(size, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE", size)
    lists = [split(t) for t in texts(2, 60)]
    vocabulary = sorted({w for words in lists for w in words})
    names = np.array([vocabulary.index(w) for words in lists for w in words])
    got = periodic_runs.runs_of(names, np.concatenate([[0], np.cumsum([len(words) for words in lists])]))
    want = [(t, *r) for t, words in enumerate(lists) for r in sorted(brute_runs(words), key=lambda r: (r[0], r[2]))]
    assert [tuple(r) for r in got.T.tolist()] == want


def test_names_are_exact():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"\x00ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 40]))) for _ in range(3000)]
    words += [b"\x00" * k for k in range(1, 30)] * 2
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    names = periodic_runs.word_names(np.frombuffer(b"".join(words), np.uint8), end - size, end)
    assert len(set(zip(words, names.tolist(), strict=True))) == len(set(words)) == len(set(names.tolist()))

"""Encoding and decoding by trees of joins, against the library and against the definition."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from quarryline.llm import bpe_tree

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\n", "word", "Über größe … 漢字 word", "two words", " lead", "trail ", "two  spaces", "tab\t x", "it's we're", "\x1c x", "x \x1cy", "a　 b", "x" * 3000, " " * 500, "=" * 3001, "ab " * 2000, "1 234 5,6\r\n\r\n z"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_tree.read_ranks(PATH), special_tokens={})


def test_documents(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "no id", 2), (3, "again", 3), (3, "again", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(bpe_tree.encoded(docs, PATH, PATTERN).collect(), key=repr)
    assert len(got) == len(rows)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert bpe_tree.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_random_texts_equal_the_library(library):
    rng = random.Random(5)
    code = bpe_tree.encoder(PATH, PATTERN)
    for _ in range(600):
        letters = rng.choice(["ab", "abc ", "ae t", "xyz\n  ", "éa  ", "0123=", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(20))])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(200)))
        want = library.encode_ordinary(text)
        assert code.whole(text) == want and code.encode(pa.array([text]))[0].tolist() == want, text
        assert code.tree.decode(want) == text.encode()


def plain(ranks, data):
    """The lowest pair first, the leftmost of equals."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_any_ranks(seed, monkeypatch):
    """Joins are exact for ranks that no training would give: random strings in random order, parts missing."""
    rng = random.Random(seed)
    monkeypatch.setattr(bpe_tree, "SCAN", rng.choice([2, 8, 64]))
    tokens = [b"a", b"b", b"c"]
    tokens += list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)})
    numbers = list(range(len(tokens)))
    rng.shuffle(numbers)
    ranks = dict(zip(tokens, numbers, strict=True))
    tree = bpe_tree.Tree(ranks)
    for _ in range(60):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
        want = plain(ranks, data)
        assert tree.tree(data) == want and tree.lowest_first(data) == want
        assert tree.decode(want) == data


def test_stretches_end_where_no_match_crosses(library, monkeypatch):
    monkeypatch.setattr(bpe_tree, "STRETCH", 7)
    text = "one  two three\n four's  five 　six seven eight 9 10  "
    assert bpe_tree.encoder(PATH, PATTERN).whole(text) == library.encode_ordinary(text)

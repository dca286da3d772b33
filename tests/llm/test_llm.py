"""The corpus operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quarryline.llm import fingerprints, language_id, licenses, ngram_join, pieces, quality_rules, source_mix, suffix_dedup, token_files, url_filters
from quarryline.llm.common import stage

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " ", "\n\n", "word", "Über\u00a0größe … 漢字 word", "two words", "a b c d e", "x" * 5000, "same same " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    """Varied small documents: odd texts, families of near copies, shared passages; one id and one source are null."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    for i in range(100, 130):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(120)) + ". " + (passage if i % 3 else ""), "fr", f"s{i % 4}"))
    parent = [rng.choice(vocabulary) for _ in range(90)]
    for i in range(200, 260):
        own = list(parent)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append((i, " ".join(own), "de", "hot"))
    rows += [rows[-1], (None, "no id here at all", None, None), (500, rows[12][1], "fr", None)]
    return stage(spark.createDataFrame(rows, DOCS).repartition(4), "test-docs")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_license_places(spark):
    text = "MIT? Released under the MIT License. under the mit license; cc-by-nc CC BY NC, Apache License, Version 2.0"
    rows = [(1, text, None, None), (2, None, None, None), (3, "under the mit", None, None), (1, text, None, None)]
    got = sorted(licenses.scan(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: r.doc_id)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [i for i in range(len(words)) for p in licenses.BASE_PHRASES.values() if words[i : i + len(p.split())] == p.split()]
    assert [r.doc_id for r in got] == [1, 1, 2, 3]
    for r in got[:2]:
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places), max(places))
        assert r.base_labels == "apache-2,cc-by-nc,mit" and r.score == 1.0
    assert (got[2].n_words, got[2].labels, got[2].first_word) == (0, "", None) and got[3].base_labels == ""


def test_license_span_survives_an_edit(spark):
    words = licenses.NOTICES[0][1].split()
    words.insert(15, "new")
    rows = [(1, "before " + " ".join(words) + " after", None, None), (2, " ".join(words[:8]), None, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.8 <= got[1].score < 1
    assert got[2].labels == "" and got[2].score < 0.8


def test_license_empty(spark):
    assert licenses.scan(empty(spark)).count() == 0


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    special = spark.createDataFrame([(600, "a <|endoftext|> b", "en", "s"), (601, "<|endoftext|>", "en", "s"), (602, " x<|endoftext|>", "en", "s")], DOCS)
    docs = docs.unionByName(special)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.tokens_of(docs, path, f"file://{tmp_path}/t").collect())
    want, at = [], 0
    ordered = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in ordered:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_image_round_trip():
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint32)
    back = token_files.unpacked(token_files.packed([None, 7], np.array([400, 600]), ids, block=64))
    assert back[0] == [None, 7] and list(back[1]) == [400, 600] and (back[2] == ids).all()


def test_token_cuts_equal_whole_encoding():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [" lead", "trail ", "two  spaces", "tab\t x", "it's we're", "<|endoftext|> x", "a <|endoftext|> b", "x <|endoftext|", "\x00 nul", "é ü\n\n z", "a\u3000 b", "1 234 5,6"]
    for text in odd:
        assert code.encode(pa.array([text]))[0][:-1].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def brute_targets(rows):
    """Words and targets of each source: share the rest by weight, fix those above their cap, and again."""
    sizes = {}
    for source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(split(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed = {}, set()
    while len(fixed) < len(order):
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in fixed)
        level = left / sum(weight[s] for s in order if s not in fixed)
        target |= {s: level * weight[s] for s in order if s not in fixed}
        over = {s for s in order if s not in fixed and target[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over}
        fixed |= over
        if not over:
            break
    return sizes, target


def test_mix(spark, docs):
    got = source_mix.mix_sources(docs).collect()
    again = source_mix.mix_sources(docs.repartition(7)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    sizes, target = brute_targets([(r.source, r.text) for r in docs.collect()])
    order = list(target)
    assert len(got) == docs.count()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 2 * r.size
    for s in order:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= max(4, 0.02 * target[s])


def test_mix_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(source_mix.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_mixed_documents(spark, docs):
    assert source_mix.mixed_documents(docs).columns == docs.columns
    assert source_mix.mix_sources(empty(spark)).count() == 0


def test_mixed_documents_meet_targets(spark, docs):
    from pyspark.sql import functions as F

    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    mixed = source_mix.mixed_documents(docs, block=16).collect()
    taken, target, emitted, by_doc = {}, {}, {}, {}
    for r in source_mix.mix_sources(docs, block=16).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        by_doc[r.doc_id, r.source] = by_doc.get((r.doc_id, r.source), 0) + r.taken
    own = {(r.doc_id, r.source): r.text for r in docs.collect()}
    for r in mixed:
        assert r.text in own[r.doc_id, r.source] and r.n_chars == len(r.text)
        by_doc[r.doc_id, r.source] -= len(split(r.text))
        emitted[r.source] = emitted.get(r.source, 0) + len(split(r.text))
    assert not any(by_doc.values())
    for s in target:
        assert emitted.get(s, 0) == taken[s] and abs(emitted.get(s, 0) - target[s]) <= max(16, 0.02 * target[s])


def test_fingerprints(spark, docs):
    got = sorted(fingerprints.fingerprint(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    rows = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]

    def sketch(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    for r, (_, text), (_, after) in zip(got, rows, [*rows[1:], rows[0]], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) or edited != text
        a, b = sketch(text), sketch(edited)
        if min(len(a), len(b)) > 60:
            assert abs(r.near_edited - len(a & b) / min(len(a), len(b))) < 0.4
    assert fingerprints.fingerprint(empty(spark)).count() == 0


@pytest.mark.parametrize("scaled", [fingerprints.SCALED, 8])
def test_short_texts_are_told_apart(scaled):
    texts = [" ".join(f"w{n}x{i}x{j}" for j in range(n)) for n in range(1, 13) for i in range(40)]  # no word twice
    own, again = fingerprints.sketches(texts, scaled=scaled), fingerprints.sketches(texts[:], scaled=scaled)
    assert all(fingerprints.likeness(a, b) == 1.0 for a, b in zip(own, again, strict=True))
    assert not any(fingerprints.likeness(a, b) for a, b in itertools.combinations(own, 2))
    assert len({fingerprints.written(s) for s in own}) == len(texts)
    none = fingerprints.sketches(["", " . "], scaled=scaled)
    assert fingerprints.likeness(*none) == 1.0 and not any(fingerprints.likeness(none[0], s) for s in own)


def test_fingerprint_likeness_is_exact(spark, docs):
    def shingles(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    order = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(fingerprints.fingerprint(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r, (_, text), (_, after) in zip(got, order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        for value, other in ((r.near_next, after), (r.near_edited, text[: len(text) - len(text) // 2] + after[: len(text) // 2])):
            a, b = shingles(text), shingles(other)
            want = len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)
            assert abs(value - want) < 1e-9, r.doc_id


def test_sketch_matches_brute_force():
    rng = random.Random(5)
    words = [rng.choice("alpha beta gamma delta eps zeta eta".split()) + str(rng.randrange(50)) for _ in range(800)]
    (n, full), (_, some) = (fingerprints.sketches([" ".join(words)], scaled=s)[0] for s in (1, 8))
    assert n == 796 and len(full) == len({tuple(words[i : i + 5]) for i in range(796)})
    assert set(some) == {h for h in full if h <= (1 << 64) // 8 - 1}
    assert fingerprints.likeness((n, full), (n, full)) == 1.0


def brute_dedup(rows, length):
    seen, out = {}, {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i : i + length], (doc_id, i)) != (doc_id, i):
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(raw, cover, strict=True) if not c)
        out[doc_id] = (len(raw), sum(cover), sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [3.0, -1.0])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # -1: substrings over 20 times in the sample are dealt by hash
    unique = dict(texts(docs))
    want = brute_dedup(sorted(unique.items(), key=lambda r: (r[0] is not None, r[0] or 0)), 100)
    got = suffix_dedup.report(docs).collect()
    assert len(got) == docs.count() and sum(r.n_removed for r in got) > 10_000
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_merged_runs_and_front_coding():
    rng = random.Random(2)
    runs = []
    for _ in range(5):
        own = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(0, 40)))
        shared = [0] + [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in itertools.pairwise(own)]
        runs.append((own, shared))
    run, index, common = suffix_dedup.merged_runs(runs, 12)
    out = [runs[r][0][i] for r, i in zip(run, index, strict=True)]
    assert out == sorted(itertools.chain(*(r[0] for r in runs)))
    assert common[1:] == [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in itertools.pairwise(out)]


def test_deduplicated_keeps_columns(spark, docs):
    from pyspark.sql import functions as F

    clash = docs.withColumns({"tag": F.lit("t"), "places": F.lit(1), "stretches": F.lit(2), "n_chars": F.lit(0).cast("long")})
    out = suffix_dedup.deduplicated(clash)
    assert out.columns == clash.columns and out.filter("tag = 't' AND places = 1 AND stretches = 2").count() == docs.count()
    assert suffix_dedup.report(empty(spark)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language_id.predict(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("share", [1e-9, 1e-7, 0.25, 1.0, 7.0])
def test_samples_of_any_share(spark, share):
    """A sample's threshold has 64 bits, so a share of a billionth still picks about its part."""
    from pyspark.sql import functions as F

    from quarryline.llm.common import below

    n = 100_000_000 if share < 1e-6 else 100_000
    got = spark.range(n).filter(below(F.col("id"), share)).count()
    want = min(share, 1.0) * n
    assert abs(got - want) <= 5 * max(want * (1 - min(share, 1.0)), 0.2) ** 0.5 + 1


def test_language_mixture_and_odd(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(real)
    by = {r.lang: r.text[:3000] for r in real.filter("n_chars > 3000").collect()}
    half = by["en"] + " " + by["de"]
    best, score, kinds = language_id.infer(np.frombuffer(half.encode(), np.uint8), np.array([0, len(half.encode())]), model)
    assert kinds[0] == 2 and 0.35 < score[0] < 0.65
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 3))
    assert language_id.predict(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs.withColumn("lang", docs.lang.substr(9, 1).cast("string"))).collect()}


def brute_classes(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        w = split(lower(text))
        sets[doc_id] = frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    key = lambda d: (d is not None, d or 0)
    for a, b in itertools.combinations(sets, 2):
        if (common := len(sets[a] & sets[b])) and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)), key=key)
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def brute_links(rows, k, percent):
    """For each row the others that it is linked with."""
    sets = []
    for _, text in rows:
        w = split(lower(text))
        sets.append(frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))
    linked = lambda a, b: bool(common := len(a & b)) and 100 * common >= percent * (len(a) + len(b) - common)
    return [(rows[i][0], sum(linked(x, y) for j, y in enumerate(sets) if i != j)) for i, x in enumerate(sets)]


@pytest.mark.parametrize(("k", "percent", "options"), [
    (3, 90, {}), (3, 90, {"few": 1}), (3, 90, {"few": 1, "block_tokens": 500}), (3, 90, {"few": 1, "block_tokens": 100, "fan": 2}), (3, 90, {"few": 30}),
    (5, 80, {}), (5, 80, {"few": 1, "block_tokens": 900, "fan": 3}), (1, 50, {}),
])
def test_jaccard_classes(spark, docs, k, percent, options):
    want = brute_classes(dict(texts(docs)).items(), k, percent)
    got = ngram_join.jaccard_classes(docs, k, percent, **options).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(brute_links(texts(docs), k, percent), key=str)


def test_one_row_of_each_class(spark):
    """By brute force over rows: repeated rows, near copies, and ids with several texts. Rows stay by id, then hash."""
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(60)] for _ in range(8)]
    near = lambda words, i: " ".join([*words[:i], "new", *words[i + 1 :]])
    a, b, c, d, *others = [" ".join(words) for words in base]
    rows = [(1, a), (1, a), (5, near(base[0], 59)), (5, b), (9, b), (7, c), (7, d), (7, near(base[2], 0)), (3, near(base[3], 1)), (None, others[0]), (None, others[0]), (2, others[0]), (4, ""), (4, ""), (6, None), (8, "  ")]
    rows += [(rng.randint(10, 14), rng.choice([near(w, rng.randint(0, 59)) for w in base[5:]])) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, kept long").repartition(3)
    sets = []
    for _, text in rows:
        w = split(lower(text))
        sets.append(frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    from pyspark.sql import functions as F

    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    groups: dict = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row)
    want = [min(g, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])) for g in groups.values()]
    got = ngram_join.one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_hot_tokens_find_their_leaders(spark, docs, monkeypatch):
    """With every counter hot, all first tokens go through the aggregate."""
    monkeypatch.setattr(ngram_join, "HOT_BUCKET", 0.0)
    monkeypatch.setattr(ngram_join, "HOT_COUNTER", 0.0)
    got = ngram_join.jaccard_classes(docs).collect()
    want = brute_classes(dict(texts(docs)).items(), 3, 90)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(brute_links(texts(docs), 3, 90), key=str)


def test_trees_find_every_link():
    """Dual traversal over blocks of random sets against all pairs; within one block and between two."""
    rng = np.random.default_rng(8)
    base = [rng.choice(5000, rng.integers(20, 400), replace=False).astype(np.uint64) for _ in range(12)]
    sets = []
    for i in range(150):
        own = base[i % 12].copy()
        own[rng.random(len(own)) < rng.choice([0, 0.02, 0.08])] = rng.integers(10_000, 20_000)
        sets.append(np.unique(own))
    block = lambda part: ngram_join.Block(np.array([i for i, _ in part]), np.ones(len(part)), [s for _, s in part], [np.zeros(0, np.int64)] * len(part))
    rows = sorted(enumerate(sets), key=lambda r: len(r[1]))
    want = np.zeros(150, np.int64)
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common):
            want[[i, j]] += 1
    ((sid, links),), near, far = ngram_join.linked(block(rows), None, 90)
    assert (want[sid] == links).all() and links.sum() > 100 and len(near)
    halves = rows[:70], rows[70:]
    total = np.zeros(150, np.int64)
    for part in halves:
        ((sid, links),), _, _ = ngram_join.linked(block(part), None, 90)
        total[sid] += links
    for sid, links in ngram_join.linked(block(halves[0]), ngram_join.Block.read(block(halves[1]).image()), 90)[0]:
        total[sid] += links
    assert (total == want).all()


def test_jaccard_empty_and_columns(spark, docs):
    assert ngram_join.jaccard_classes(empty(spark)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 100").count() == 1


@pytest.mark.parametrize("path", ["piece_bpe_32k.model"])
def test_pieces_equal_the_library(spark, docs, path):
    import sentencepiece

    model = public_tokenizers.path(path)
    whole = sentencepiece.SentencePieceProcessor(model_file=model)
    code = pieces.pieces(model)
    sample = [t or "" for _, t in texts(docs)] + ["  two  spaces ", "漢字 🙂\n\nx", "=" * 200 + "abc" * 100]
    ids, counts = code.encode(sample)
    at = 0
    for text, n in zip(sample, counts, strict=True):
        own = ids[at : at + n]
        at += n
        assert own.tolist() == whole.encode(text), text[:50]
        assert code.decode(own.astype(np.int64)) == text
    own = sorted(texts(docs), key=str)
    got = sorted(pieces.encoded(docs, model).collect(), key=lambda r: str((r.doc_id, dict(own).get(r.doc_id))))
    want = sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in own for i in [whole.encode(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want and all(r.round_trip for r in got)
    assert pieces.encoded(empty(spark), model).count() == 0


def test_viterbi_gives_the_merges_of_odd_text():
    """Pieces side by side at random, runs of spaces (whose pieces' scores tie), and characters without a piece."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    whole, code, rng = sentencepiece.SentencePieceProcessor(model_file=model), pieces.pieces(model), random.Random(1)
    parts = [p.replace(pieces.SPACE, " ") for p in code.text if not p.startswith("<")] + ["  ", " " * 17, "é", "漢", "🙂", "a" * 9]
    sample = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    ids, counts = code.encode(sample)
    for text, end, n in zip(sample, np.cumsum(counts), counts, strict=True):
        assert ids[end - n : end].tolist() == whole.encode(text), text


def test_viterbi_is_the_best_path():
    rng = random.Random(4)
    table = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(40)} | {c: -8.0 for c in "abc"}
    bytes_ = [(f"<0x{i:02X}>", 0.0, pieces.BYTE) for i in range(256)]
    code = pieces.Pieces(bytes_ + [(p, s, pieces.NORMAL) for p, s in table.items()], pieces.UNIGRAM, dummy_prefix=False)

    def best(word):
        score = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            score[end] = max(score[s] + table.get(word[s:end], -1e9) for s in range(end))
        return score[-1]

    for length in (1, 3, 9):
        some = ["".join(rng.choice("abc") for _ in range(length)) for _ in range(50)]
        row, count = code.viterbi(some)
        for w, r, n in zip(some, row, count, strict=True):
            assert "".join(code.text[i] for i in r[:n]) == w and abs(sum(code.scores[i] for i in r[:n]) - best(w)) < 1e-9
    assert code.decode(code.encode(["abxc"])[0].astype(np.int64)) == "abxc"


def brute_statistics(text):
    text = text or ""
    w, lines = split(text), [line for line in text.split("\n") if split(line)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    twice = {x for x in windows if counts[x] > 1}
    inside = {i + j for i, x in enumerate(windows) if x in twice for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_base(spark, docs):
    got = quality_rules.quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    own = dict(texts(docs))
    assert len(got) == docs.count()
    for r in got:
        want = brute_statistics(own[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_rules.quality(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    fine = [d for d, q in known.items() if q == 1 and not got[d].base_failed]
    junk = [d for d, q in known.items() if q == 0]
    assert sum(got[d].kept for d in fine) >= 0.99 * len(fine) and sum(not got[d].kept for d in junk) >= 0.9 * len(junk)


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 2)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(2000) > 0).astype(float)
    trees = quality_rules.fit(x, y, [1, -1])
    grid = np.linspace(0, 1, 50, dtype=np.float32)
    for v in (0.2, 0.7):
        assert (np.diff(trees.score(np.stack([grid, np.full(50, v, np.float32)], 1))) >= 0).all()
        assert (np.diff(trees.score(np.stack([np.full(50, v, np.float32), grid], 1))) <= 0).all()


def test_url_rules(spark):
    urls = [
        "http://a.example.net/en/x", "https://EXAMPLE.net/en", "http://example.net/en/", "http://x.example.com/de/a?b", "http://example.com/den/",
        "ftp://y.org/fr/", "http://org/fr", "no scheme", None, "", "http://net?x=/en/", "://net/", "http://b.net:80/", "http://notnet/", "x://a.net/u://b",
    ]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

    def want(url):
        tail = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", tail)[0]
        path = re.match(r"[^?#]*", tail[len(host) :])[0]
        host = lower(host)
        fits = [(len(h + p), h + p, a) for h, p, a in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    got = url_filters.filter_urls(pages, spark.sql(url_filters.DEFAULT_RULES)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want(urls[r.page_id])
    assert url_filters.filter_urls(pages.limit(0), spark.sql(url_filters.DEFAULT_RULES)).count() == 0


def test_suffix_dedup_with_one_hash_for_all(spark, docs, monkeypatch):
    """Hashes only propose: with a hash that is the same for every string, the bytes still decide."""
    rows = spark.createDataFrame([(r.doc_id, r.text, None, None) for r in docs.filter("doc_id >= 200 AND doc_id < 212 OR doc_id = 9").collect()], DOCS).coalesce(1)
    want = brute_dedup(sorted(dict(texts(rows)).items()), 100)

    def patched(key, rank, real=suffix_dedup.later_copies):
        return real(key if key.dtype == np.int64 else np.zeros_like(key), rank)

    monkeypatch.setattr(suffix_dedup, "later_copies", patched)
    data = [(r.text or "").encode() for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
    flat, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    place, text, _ = suffix_dedup.anchors(flat, offs)
    ids, none = np.array(sorted(r.doc_id for r in rows.collect())), np.zeros(len(data), np.int64)
    own = suffix_dedup.Records.at(flat, offs, place, text, ids, none, 100, 60)
    own = own.take(np.argsort(suffix_dedup.string_view(own.suffix), kind="stable"))
    hit, least, most = suffix_dedup.repeated_strings(own, suffix_dedup.shared_prefix(own.suffix), 100, 60)
    cover = {int(d): set() for d in ids}
    for i, low, high in zip(hit, least, most, strict=True):
        cover[int(own.doc[i])] |= set(range(int(own.pos[i] - high), int(own.pos[i] - low) + 100))
    assert {d: len(c) for d, c in cover.items()} == {d: want[d][1] for d in cover}


def test_mixture_is_plain_em():
    """Proportions and likelihood of a batch against expectation-maximisation a text at a time, with the languages
    that may mix given."""
    rng = np.random.default_rng(4)
    likelihood, offs = rng.random((60, 4)) ** 6, np.array([0, 1, 9, 40, 60])
    allowed = np.array([[1, 1, 1, 1], [1, 0, 1, 0], [1, 1, 1, 1], [0, 1, 0, 0]], float)
    share, fit = language_id.mixture(likelihood, offs, allowed, rounds=25)
    for i, (low, high) in enumerate(itertools.pairwise(offs)):
        own = allowed[i] / allowed[i].sum()
        for _ in range(25):
            belief = [[own[k] * likelihood[w, k] for k in range(4)] for w in range(low, high)]
            own = np.mean([np.array(b) / sum(b) for b in belief], axis=0)
        assert np.allclose(own, share[i], atol=1e-9)
        assert abs(sum(np.log(likelihood[w] @ own) for w in range(low, high)) - fit[i]) < 1e-6


def test_license_labels_against_brute_force(spark):
    """Labels of the method: a notice counts where fewer than a fifth of its 3-grams are lost, unless another one fits
    the place better."""
    rng, rows = random.Random(9), []
    for i in range(60):
        label, notice = rng.choice(licenses.NOTICES)
        words = notice.split()
        for _ in range(rng.choice([0, 0, 1, 6])):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, "x y z " * rng.randint(0, 3) + " ".join(words) + " and so on", None, None))

    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    kept = 0
    for i, text, *_ in rows:
        words = lower(text).split()
        base = {k for k, p in licenses.BASE_PHRASES.items() if f" {p} " in f" {' '.join(words)} "}
        found = []
        for label, notice in licenses.NOTICES:  # only substitutions here, so neighbouring diagonals are another notice's
            n = notice.split()
            hits = {(at, j) for at in range(-len(n), len(words)) for j in range(len(n) - 2) if at + j >= 0 and words[at + j : at + j + 3] == n[j : j + 3]}
            for at in {at for at, _ in hits}:  # a span: diagonals up to three apart, one after the other
                chain, edge = {at}, at
                while later := [x for x, _ in hits if edge < x <= edge + licenses.DRIFT]:
                    edge = min(later)
                    chain.add(edge)
                places = [(x, j) for x, j in hits if x in chain]
                found.append((len({j for _, j in places}) / (len(n) - 2), min(x + j for x, j in places), label))
        best = [(c, at, k) for c, at, k in found if not any(d > c and abs(at - x) <= licenses.DRIFT for d, x, _ in found)]
        want = base | {k for c, _, k in best if c >= licenses.COVERAGE}
        assert set(filter(None, got[i].labels.split(","))) == want, (i, text)
        kept += bool(want)
    assert 20 < kept < 60


def test_url_of_any_length(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 3000 + "net/" + "/" * 3000), (2, "http://" + "b" * 9000), (3, "http://.net./en/")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("x.net", "/a/b/c/d", "allow"), ("net.", "/en/", "block"), (None, "/", "block")], "host string, path string, action string")
    keys = url_filters.rule_keys(rules)
    rows = url_filters.expressions(url_filters.split_urls(pages).withColumn("address", pages.page_id), keys)
    assert rows.count() <= 3 * keys.count()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(pages, rules).collect()}
    assert got == {1: ("net/", "block"), 2: (None, "allow"), 3: ("net./en/", "block")}


CLASH = ("row", "key", "copy", "tie", "whole", "taken", "stretch", "id", "kept", "_keep", "_epochs", "score", "lang_pred", "n_languages", "places", "tag", "sid", "leader")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A table of documents with near copies and odd rows, and columns that clash with names used inside."""
    from pyspark.sql import functions as F

    at = tmp_path_factory.mktemp("corpus")
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(9000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, "nothing to see " * 30, "en", None)], DOCS)
    rows = plain.unionByName(odd).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).withColumn("n_chars", F.char_length("text").cast("long"))
    rows.coalesce(3).write.parquet(f"{at}/documents.parquet")
    rows.limit(0).write.parquet(f"{at}/empty/documents.parquet")
    return str(at)


def test_pipeline_stages(spark, corpus):
    """Each stage on its own input against brute force; columns and other values stay."""
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    name, function = corpus_pipeline.STAGES[0]
    known = stage(function(spark, docs, corpus), "test-language")
    judged = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), language_id.train(docs)).collect()}
    assert known.columns == columns and {r.doc_id for r in known.collect()} == {d for d, r in judged.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert known.filter("doc_id < 9000").count() >= 0.95 * docs.filter("doc_id < 9000").count()
    one = stage(corpus_pipeline.STAGES[1][1](spark, known, corpus), "test-one")
    classes = brute_classes(texts(known), 5, 80)
    assert one.columns == columns and sorted((r.doc_id for r in one.collect()), key=str) == sorted((d for d, (_, c) in classes.items() if c == d), key=str)
    assert one.count() < known.count()
    cut = stage(corpus_pipeline.STAGES[2][1](spark, one, corpus), "test-cut")
    want = {}
    seen: dict = {}
    for doc_id, text in sorted(texts(one), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if seen.setdefault(raw[i : i + 100], (doc_id, i)) != (doc_id, i):
                cover[i : i + 100] = b"\1" * 100
        runs = [bytes(x for x, _ in g) for k, g in itertools.groupby(zip(raw, cover, strict=True), key=lambda p: p[1]) if not k]
        want[doc_id] = b"".join(runs).decode("utf-8", "ignore")
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == {d: t for d, t in want.items() if t}
    assert all(r.n_chars == len(r.text) and (r.row, r.leader) == (0, len(CLASH) - 1) for r in cut.collect())
    mixed = stage(corpus_pipeline.STAGES[3][1](spark, cut, corpus), "test-mixed")
    _, target = brute_targets([(r.source, r.text) for r in cut.collect()])
    words: dict = {}
    own = {r.doc_id: r.text for r in cut.collect()}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(split(r.text))
        assert r.text in own[r.doc_id] and r.n_chars == len(r.text)
    assert mixed.columns == columns and set(words) == {s for s, t in target.items() if t}
    assert all(abs(words[s] - t) <= max(128, 0.01 * t) for s, t in target.items() if t)
    whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.STAGES[4][1](spark, mixed, corpus).collect()
    ids = lambda t: np.array(whole.encode(t), "<u4").tobytes()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in out) == sorted((str(r.doc_id), ids(r.text)) for r in mixed.collect())


def test_pipeline_runs(spark, corpus):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, corpus)
    assert out.count() > 100 and set(out.columns) == {"doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"}
    assert corpus_pipeline.run(spark, f"{corpus}/empty").count() == 0


def test_empty_tables(spark, tmp_path):
    assert token_files.tokens_of(empty(spark), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/none").count() == 0
    assert quality_rules.quality(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert source_mix.mixed_documents(empty(spark)).count() == 0 and ngram_join.one_of_each(empty(spark)).count() == 0

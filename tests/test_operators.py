"""Queries and operators without SQL against brute force; odd input."""

from __future__ import annotations

import datetime
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline.operators import chunking, fusion, lexical, rerank, scan
from quarryline.plans import catalog
from quarryline.streaming import events as stream

SF = "/root/testdata/sf0.001"


def brute_merge(events):
    """(at_ms, kind, content) in order to merged (kind, content)."""
    out, kind, text, flushed = [], None, "", None
    for at, new, content in events:
        flushed = at if flushed is None else flushed
        if new not in stream.TEXT_KINDS:
            if kind is not None:
                out.append((kind, text))
            out.append((new, content or ""))
            kind, text, flushed = None, "", at
            continue
        if kind not in (None, new):
            out.append((kind, text))
            text, flushed = "", at
        kind, text = new, text + (content or "")
        if len(text) >= stream.MERGE_CHARS or (text and at - flushed >= stream.MERGE_MS):
            out.append((kind, text))
            kind, text, flushed = None, "", at
    return out + [(kind, text)] * (kind is not None)


def test_merged_events_query(spark):
    from quarryline.plans.texts import _sessions

    want = {r.conv_id: brute_merge([(e.at_ms, e.kind, e.content) for e in r.events]) for r in _sessions(spark, SF).collect()}
    got: dict = {}
    for r in sorted(catalog.QUERIES["x1_merged_events"](spark, SF).collect(), key=lambda r: (r.conv_id, r.pos)):
        got.setdefault(r.conv_id, []).append((r.kind, r.content))
    assert got == want


@pytest.mark.parametrize(
    "events",
    [
        [],
        [(0, "delta", "a"), (1, "delta", "b")],
        [(0, "delta", "a"), (20, "delta", "b"), (21, "delta", None)],
        [(0, "delta", "abcdef"), (1, "reasoning", "x"), (2, "delta", "y"), (3, "done", None)],
        [(5, "progress", "p"), (6, "reasoning", ""), (40, "reasoning", "late"), (41, "delta", "z")],
    ],
)
def test_merged_events_cases(spark, events):
    rows = spark.createDataFrame([(events,)], "events array<struct<at_ms:long,kind:string,content:string>>")
    got = [tuple(e) for e in rows.select(stream.merged_events(F.col("events")).alias("m")).first().m]
    assert got == brute_merge(events)


def test_merged_sessions_are_whole(spark):
    from hashlib import md5

    roles = {"user": "delta", "assistant": "reasoning"}
    want: dict = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        own = want.setdefault(r.conv_id, {"delta": "", "reasoning": "", "progress": ""})
        own[roles.get(r.role, "progress")] += r.text or ""
    assert any(len(t) > 2000 for own in want.values() for t in own.values())
    got = {c: dict.fromkeys(own, "") for c, own in want.items()}
    for r in sorted(catalog.QUERIES["x1_merged_events"](spark, SF).collect(), key=lambda r: (r.conv_id, r.pos)):
        got[r.conv_id][r.kind] += r.content
    assert got == want
    sums = {r.conv_id: (r.deltas, r.reasonings) for r in catalog.QUERIES["x1_concatenation"](spark, SF).collect()}
    assert sums == {c: tuple(md5(own[k].encode()).hexdigest() for k in ("delta", "reasoning")) for c, own in want.items()}


def test_merged_stream(spark, tmp_path):
    """Short texts of two sessions over several batches: buffers outlive a batch, close by size, age, kind and other
    events, and by the timer where a session goes silent."""
    rng, rows = random.Random(6), []
    start = datetime.datetime(2024, 1, 1)
    for session in ("a", "b"):
        at = 0
        for i in range(60):
            at += rng.choice([1, 2, 5, 30])
            kind = rng.choice(["delta", "delta", "reasoning", "reasoning", "done"])
            rows.append((session, start + datetime.timedelta(milliseconds=at), i, kind, rng.choice(["", "x", "yz", "long text"])))
    want = {s: brute_merge([(int(t.replace(tzinfo=datetime.UTC).timestamp() * 1000), k, c) for n, t, _, k, c in rows if n == s]) for s in ("a", "b")}
    rows.append(("end", start + datetime.timedelta(hours=2), 0, "done", "over"))
    schema = "session_id string, ts timestamp, seq long, kind string, content string"
    for i in range(0, len(rows), 20):  # both sessions in turn, in files that come one at a time
        some = [r for r in rows if (r[2] // 20 == i // 20 if r[0] != "end" else i // 20 == 3)]
        if some:
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(0.05)
    spark.createDataFrame([("later", start + datetime.timedelta(hours=4), 0, "done", "over")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = stream.replay(spark, f"{tmp_path}/in", schema, stream.merged_stream, f"{tmp_path}/checkpoint", f"{tmp_path}/out", files_a_batch=1)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = out.collect()
    for s in ("a", "b"):
        assert sorted((r.kind, r.content) for r in got if r.session_id == s) == sorted(want[s])
    assert any(k != "done" and len(c) < stream.MERGE_CHARS for s in want for k, c in want[s])


@pytest.mark.parametrize(("name", "seconds", "delay"), [("x3_stream_windows", 60, 600), ("x4_stream_days", 86_400, 86_400)])
def test_stream_windows(spark, name, seconds, delay):
    """The windows that the watermark has closed, with all their events."""
    sql = f"""WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / {seconds}) * {seconds} AS BIGINT) AS start, count(*) AS n FROM '{SF}/events.parquet' GROUP BY ALL)
      SELECT user_id, start, n FROM e WHERE start + {seconds} <= (SELECT epoch(max(ts)) - {delay} FROM '{SF}/events.parquet')"""
    want = sorted(duckdb.sql(sql).fetchall())
    got = catalog.QUERIES[name](spark, SF).select("user_id", F.col("start").cast("long").alias("start"), "n").collect()
    assert sorted(tuple(r) for r in got) == want and want


def brute_sentences(piece, target):
    out, held = [], ""
    for part in (p for p in re.split("([。！？；])", piece) if p):
        held += part
        if len(held) >= target or held[-1] in "。！？；":
            out.append(held)
            held = ""
    return out + [held] * bool(held)


def brute_chunks(text, target=400, longest=600):
    cut = lambda piece: brute_sentences(piece, target) if len(piece) > longest else [piece]
    done, held = [], ""
    for piece in (c for p in text.split("\n") if p.strip() for c in cut(p.strip())):
        if len(held) + len(piece) < target:
            held = held + "\n" + piece if held else piece
        else:
            done += [held] if held else []
            held = piece
    return [c for p in done + [held] * bool(held) for c in cut(p)]


def test_upload_chunks(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict = {}
    for r in sorted(catalog.QUERIES["c28_upload_chunks"](spark, SF).collect(), key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {d: brute_chunks(t) for d, t in docs.items() if len(t) >= 1500}
    odd = ["一二三。" * 200 + "\n\nshort\n" + "x" * 700, "a\r\n\t\n\u3000\n\x1cb\u2003", "长" * 450 + "。短。" + "尾" * 300, "长" * 399 + "！" + "句" * 500 + "；；", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, None])], "i int, t string").select("i", chunking.upload_chunks(F.col("t")).alias("c")).collect()
    assert [r.c for r in sorted(rows)] == [*map(brute_chunks, odd), None]


def test_upload_retrieval(spark):
    """Every question has up to three places in every document, all of them chunks."""
    chunks = {(r.doc_id, r.pos) for r in catalog.QUERIES["c28_upload_chunks"](spark, SF).collect()}
    items = [r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = catalog.QUERIES["p7_upload_retrieval"](spark, SF).collect()
    places: dict = {}
    for r in got:
        places.setdefault((r.item_id, r.doc_id), []).append(r.place)
    sizes = {d: min(3, sum(1 for x, _ in chunks if x == d)) for d in {d for d, _ in chunks}}
    want = {(i, d): list(range(1, n + 1)) for i in items for d, n in sizes.items()}
    assert {k: sorted(p) for k, p in places.items()} == want and {(r.doc_id, r.pos) for r in got} <= chunks


def test_upload_retrieval_asks_all(spark, monkeypatch):
    from quarryline.functions import text
    from quarryline.operators import upload_search
    from quarryline.sources import providers

    monkeypatch.setattr(upload_search, "BLOCK", 7)
    monkeypatch.setattr(upload_search, "DOCUMENTS", 3)
    got: dict = {}
    for r in catalog.QUERIES["p7_upload_retrieval"](spark, SF).collect():
        got.setdefault((r.item_id, r.doc_id), []).append((r.place, r.pos))
    chunks: dict = {}
    words = text.tokens(F.col("chunk")).alias("words")
    for r in catalog.QUERIES["c28_upload_chunks"](spark, SF).select("doc_id", "pos", "chunk", words).collect():
        chunks.setdefault(r.doc_id, {})[r.pos] = (providers.hashed_embedder([r.chunk])[0].astype(float), set(r.words))
    questions = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text", text.tokens(F.col("text")).alias("words")).collect()
    assert len(questions) > 1
    want = {}
    for q in questions:
        vector = providers.hashed_embedder([q.text])[0].astype(float)
        for doc_id, own in chunks.items():
            near = sorted(own, key=lambda p: (-round(float(own[p][0] @ vector), 9), p))[:8]
            best = sorted(near, key=lambda p: -len(own[p][1] & set(q.words)))[:3]
            want[q.item_id, doc_id] = list(enumerate(best, 1))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_context_gate_judges_all_pairs(spark):
    from quarryline.operators import rules
    from quarryline.plans import fixtures as fx

    chunks = fx.chunks(spark, SF)
    questions = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.chunk_id, r.chunk_type == "clause" and ("license" in r.text or "heit" in r.text)) for r in chunks.collect()]
    want = {(q, c) for q, t in questions for c, stopped in texts if not stopped or "then" in t or "ally" in t}
    got = [tuple(r) for r in catalog.QUERIES["f3_context_gate"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    two = [*fx.GATES, {"required_context_keywords": ["ing"], "blocked_text_keywords": ["tion"], "chunk_types": None}, {"blocked_text_keywords": ["a"]}]
    odd = spark.createDataFrame([(1, "station", None), (2, None, "clause"), (3, "license", "article"), (4, "heit", "clause")], "chunk_id int, text string, chunk_type string")
    asked = spark.createDataFrame([(1, "then"), (2, None), (3, "ring")], "query_id int, text string")
    pairs = odd.crossJoin(asked.select("query_id", F.col("text").alias("query_text")))
    for gates in (two, fx.GATES, []):
        assert {tuple(r) for r in rules.gated_pairs(odd, asked, gates).collect()} == {tuple(r) for r in rules.gated(pairs, gates).select("query_id", "chunk_id").collect()}


def row(chunk_id, role, score, text="", context=""):
    return {"chunk_id": chunk_id, "role": role, "rerank_score": score, "text": text, "penalty_context": context}


def quotas_by_hand(head, beyond, everything, words, kind, top_n):
    """One quota after the other on lists."""
    head = list(head)
    protected = lambda c: c["role"] in rerank.PROTECTED
    rules_ = [protected]
    if words:
        rules_.append(lambda c: protected(c) and kind in c["text"] and any(w in c["text"] for w in words))
        rules_.append(lambda c: c["role"] == "behavior_penalty" and any(w in c["text"] + "|" + c["penalty_context"] for w in words))
    for rule in rules_:
        there = {c["chunk_id"] for c in head}
        found = [c for c in beyond if rule(c)] or [c for c in everything if rule(c) and c["chunk_id"] not in there]
        if found and not any(map(rule, head)):
            best = sorted(found, key=lambda c: (-c["rerank_score"], c["chunk_id"]))[0]
            open_places = [i for i, c in enumerate(head) if not protected(c)] or [len(head) if len(head) < top_n else len(head) - 1]
            head[open_places[-1] : open_places[-1] + 1] = [best]
    return [c["chunk_id"] for c in head]


def test_quota_inserts(spark):
    plain = [row(i, "substantive", 1 - i / 10) for i in range(3)]
    law, fine = row(8, "definition", 0.2, "kinds of road"), row(9, "behavior_penalty", 0.1, "fine", "road")
    cases = [(plain, [law], [law, fine], "nothing"), (plain, [law], [law, fine], "a road"), (plain, [], [], "a road"), ([law], [], [fine], "a road"), ([], [], [fine], "a road")]
    rng = random.Random(6)
    for _ in range(150):
        rows = [row(i, rng.choice(["substantive", "procedural", *rerank.PROTECTED]), rng.choice([0.1, 0.5, rng.random()]), rng.choice(["kinds", "road", "kinds of road", ""]), rng.choice(["", "road", "car"])) for i in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(rows))
        cases.append((rows[: min(cut, 3)], rows[3:cut] if cut > 3 else [], rows, rng.choice(["road", "car or road", "none"])))
    listed, everything, queries = [], [], []
    for q, (head, beyond, scored, text) in enumerate(cases):
        listed += [{"query_id": q, "pos": i, **c} for i, c in enumerate(head)] + [{"query_id": q, "pos": 3 + i, **c} for i, c in enumerate(beyond)]
        everything += [{"query_id": q, **c} for c in scored]
        queries.append((q, text))
    schema = "query_id int, {}chunk_id int, role string, rerank_score double, text string, penalty_context string"
    out = rerank.with_quotas(spark.createDataFrame(listed, schema.format("pos int, ")), spark.createDataFrame(everything, schema.format("")), spark.createDataFrame(queries, "query_id int, text string"), ["road", "car"], "kinds", 3)
    got: dict = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.pos)):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    want = {q: quotas_by_hand(h, b, e, [w for w in ("road", "car") if w in t], "kinds", 3) for q, (h, b, e, t) in enumerate(cases)}
    assert got == {q: ids for q, ids in want.items() if ids}
    assert [want[i] for i in range(4)] == [[0, 1, 8], [0, 9, 8], [0, 1, 2], [8, 9]]


def test_quota_query(spark):
    """Each list has at most TOP_N rows, none twice, and a protected one where any was scored."""
    from quarryline.plans.answers import reranked

    scored = reranked(spark, SF).select("query_id", "chunk_id", "role").collect()
    roles = {(r.query_id, r.chunk_id): r.role for r in scored}
    got: dict = {}
    for r in catalog.QUERIES["p10_quota_inserts"](spark, SF).collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, rows in got.items():
        assert len(rows) == len(set(rows)) <= rerank.TOP_N
        if any(v in rerank.PROTECTED for (k, _), v in roles.items() if k == q):
            assert any(roles[q, c] in rerank.PROTECTED for c in rows)


def test_retrieval_of_nothing(spark):
    chunks = spark.createDataFrame([], "chunk_id long, source string, text string, embedding array<float>")
    queries = spark.createDataFrame([(1, "any words", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    assert scan.routes(scan.scanned(chunks, queries, lexical.build(chunks))).count() == 0
    chunks = spark.createDataFrame([(1, "s", "words", [1.0, 0.0])], chunks.schema)
    assert scan.routes(scan.scanned(chunks, queries.limit(0), lexical.build(chunks))).count() == 0


def test_retrieval_with_nulls_and_ties(spark):
    rows = [(1, "s", "the road", [1.0, 0.0]), (2, "s", None, [0.0, 1.0]), (3, None, "", [0.0, 1.0]), (4, "s", "the road", [1.0, 0.0]), (5, "s", "a way", [0.0, 1.0]), (6, "s", "", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string, embedding array<float>")
    queries = spark.createDataFrame([(1, "road road", [1.0, 0.0]), (2, "", [0.0, 1.0])], "query_id long, text string, embedding array<float>")
    got = fusion.top(fusion.fused(fusion.scored_pairs(chunks, queries, lexical.build(chunks)), "query_id"), 10, "query_id").collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: (r.query_id, r.pos)) if r.query_id == 1][:2] == [1, 4]
    assert len(got) == 12


@pytest.mark.parametrize(("block", "most"), [(2_000, 4_000_000), (2, 4_000_000), (2_000, 5)])
def test_scans_equal_sorting(spark, monkeypatch, block, most):
    """Heads and counted places against ranks over whole partitions: many equal scores, chunks without vectors or
    source, more rows than candidates, queries in blocks, and the way beyond the limit."""
    monkeypatch.setattr(scan, "BLOCK", block)
    monkeypatch.setattr(scan, "MOST", most)
    rng = random.Random(2)
    words = ["road", "way", "law", "fine", "car"]
    rows = []
    for c in range(500):
        vector = rng.choice([None, [1.0, 0.0], [0.0, 1.0], [rng.random(), rng.random()]])
        rows.append((c * 7 % 501, rng.choice(["a", "b", "b", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))), vector))
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(3, "road way", [1.0, 0.0]), (1, "nothing known", [0.0, 1.0]), (9, "law", [0.5, 0.5])], "query_id long, text string, embedding array<float>")
    index = lexical.build(chunks)
    pairs = fusion.scored_pairs(chunks, queries, index)
    scans = scan.scanned(chunks, queries, index)
    got = scan.best(scans, 10, 3).select("scope", "query_id", "source", "chunk_id", "pos", F.round("score", 9)).collect()
    want = [(0, *r) for r in fusion.top(fusion.fused(pairs, "query_id"), 10, "query_id").select("query_id", "source", "chunk_id", "pos", F.round("score", 9)).collect()]
    want += [(1, *r) for r in fusion.top(fusion.fused(pairs, "query_id", "source"), 3, "query_id", "source").select("query_id", "source", "chunk_id", "pos", F.round("score", 9)).collect()]
    assert len(want) == 3 * (10 + 9) and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    columns = ["query_id", "chunk_id", "source", F.round("cosine", 6), F.round("bm25", 6)]
    assert sorted(map(tuple, scan.pairs(scans).select(*columns).collect()), key=repr) == sorted(map(tuple, pairs.select(*columns).collect()), key=repr)


def test_span_depths(spark):
    from quarryline.operators import operations

    chain = [("t", i, i - 1 if i else None) for i in range(40)] + [("u", 1, None), ("u", 2, 1), ("u", 5, 4), ("u", 6, 5)]
    spans = spark.createDataFrame(chain, "trace_id string, span_id long, parent_id long")
    got = {(r.trace_id, r.span_id): r.depth for r in operations.span_depths(spans).collect()}
    assert got == {("t", i): i for i in range(40)} | {("u", 1): 0, ("u", 2): 1}
    with pytest.raises(ValueError, match="own ancestors"):
        operations.span_depths(spark.createDataFrame([("c", 1, 2), ("c", 2, 1)], spans.schema))
    assert operations.span_depths(spans.limit(0)).count() == 0


def _lexical_case(spark):
    rng = random.Random(5)
    words = ["road", "way", "law", "fine", "car"]
    rows = [(c, rng.choice(["a", "b", None]), rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))]), rng.choice(["definition", "behavior_penalty", "procedural"]), rng.choice([None, [1.0, 0.0], [0.0, 1.0]])) for c in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string, role string, embedding array<float>").withColumn("penalty_context", F.substring("text", 1, 3))
    queries = spark.createDataFrame([(4 * n + p, t, [1.0, 0.5], n, p) for n in range(2) for p, t in enumerate(["road way", "law law fine", "nothing", "car"])], "query_id long, text string, embedding array<float>, question_id long, query_pos int")
    return chunks.repartition(4), queries


def test_words_are_counted_without_a_shuffle(spark):
    """Counted terms equal grouped ones, BM25 made up chunk by chunk equals joined postings, and heads equal ranks."""
    chunks, queries = _lexical_case(spark)
    counts = lexical.counted(chunks)
    assert "Exchange" not in lexical.counted(spark.createDataFrame([(1, "a b a")], "chunk_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    got = lexical.postings(counts).select("chunk_id", "term", "dl", "tf").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, lexical.term_counts(chunks).select("chunk_id", "term", "dl", "tf").collect()))
    index = lexical.build(chunks)
    want = lexical.scores(index, queries)
    plain = lambda rows: sorted((r.query_id, r.chunk_id, round(r.bm25, 9)) for r in rows.collect())
    assert plain(scan.scores(index, queries)) == plain(want)
    index.counts = None
    assert plain(scan.scores(index, queries)) == plain(want)
    heads = scan.bm25_heads(scan.scanned(chunks, queries, index), 3)
    ranked = want.withColumn("pos", fusion.rank("bm25", "query_id")).filter("pos < 3")
    assert sorted(map(tuple, heads.select("query_id", "chunk_id", "pos").collect())) == sorted(map(tuple, ranked.select("query_id", "chunk_id", "pos").collect()))


def test_protected_pairs_carry_no_text(spark):
    """The rows that are ranked hold flags instead of texts; the fusion keeps of the protected path what the whole gives."""
    from quarryline.plans import retrieval

    chunks, queries = _lexical_case(spark)
    scans = scan.scanned(chunks, queries, lexical.build(chunks))
    guarded = retrieval.protected(scans, chunks, queries, ["road", "law"], "law", ["fine"])
    plan = guarded._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan[plan.index("Window") : plan.index("MapInArrow")]
    assert "RepartitionByExpression" in ranked and not re.search(r"\b(text|penalty_context)#", ranked)
    assert guarded.count() == len({(r.question_id, r.chunk_id) for r in guarded.collect()}) > 150
    hits = retrieval.question_hits(scans, queries)
    whole = guarded.withColumn("_r", fusion.rank("score", "question_id")).select("question_id", "chunk_id", "role", "_r")
    some = retrieval.protected_path(guarded, hits, 2)
    assert some.exceptAll(whole).count() == 0 and some.count() < whole.count()
    plain = lambda rows: sorted((r.question_id, r.chunk_id, round(r.score, 9), r.floor_pos) for r in rows.collect())
    got = plain(retrieval.fused_candidates(hits, guarded, 2))
    kept = retrieval.protected_path
    retrieval.protected_path = lambda *a: whole
    try:
        assert got == sorted(plain(retrieval.fused_candidates(hits, guarded, 2)))
    finally:
        retrieval.protected_path = kept


def test_nearest_takes_chunks_without_vectors_last(spark):
    """Fewer vectors than asked for: ids fill up the list, as SQL sorts nulls last; ties go by id."""
    rows = [(5, "s", "road", None), (2, "s", "way", [1.0, 0.0]), (1, "s", "law", [1.0, 0.0]), (9, None, None, None), (7, "s", "", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string, embedding array<float>")
    queries = spark.createDataFrame([(3, "road", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    got = scan.nearest(scan.scanned(chunks, queries, lexical.build(chunks)), 4).orderBy("pos").collect()
    assert [(r.query_id, r.chunk_id, r.pos) for r in got] == [(3, 1, 0), (3, 2, 1), (3, 5, 2), (3, 7, 3)]


def test_words_by_bytes(spark):
    """Every character that isn't left to Spark, words at the ends of texts, nulls and other scripts."""
    from quarryline.functions.text import tokens

    texts = [f"Ab{chr(c)}cD {chr(c)} {chr(c)}{chr(c)}9" for c in range(0x250)] + ["", None, "end", "start of", "mid 酒后 ΟΔΟΣ", "İI", "é", "ß÷ × ª²", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(2)
    want = {r.chunk_id: sorted(r.t or []) for r in rows.select("chunk_id", tokens(F.col("text")).alias("t")).collect()}
    counted = lexical.counted(rows).collect()
    assert {r.chunk_id: sorted(w.term for w in r.counts for _ in range(w.tf)) for r in counted} == want
    assert {r.chunk_id: r.dl for r in counted} == {c: len(w) for c, w in want.items()} and len(counted) == len(texts)
    plain = rows.filter(~F.col("text").rlike(lexical.OTHERS))
    assert plain.count() == 0x250 - 1 + 6


def test_words_are_counted_in_bounded_parts(spark, monkeypatch):
    """No more words are counted at once than allowed but for one text's; terms too many for a task to hold are sent on
    the way; the frequencies are those of the whole index, and of a chunk's terms the asked ones alone are kept."""
    chunks, queries = _lexical_case(spark)
    chunks = chunks.unionByName(chunks.filter("chunk_id < 40").withColumns({"chunk_id": F.col("chunk_id") + 1000, "text": F.concat(F.coalesce("text", F.lit("")), F.lit(" 酒后 law"))}))
    whole = lexical.build(chunks)
    for name, most in (("WORDS", 7), ("BYTES", 40), ("HELD", 2), ("ROW", 2)):
        monkeypatch.setattr(lexical, name, most)
    batch = lexical.split(chunks, "chunk_id", "text", None, []).toArrow().combine_chunks().to_batches()[0]
    sizes = [(len(part), len(words.flatten())) for part, words in lexical.parts(batch)]
    assert sum(n for n, _ in sizes) == chunks.count() and all(n == 1 or m <= 20 for n, m in sizes) and len(sizes) > 50
    index = lexical.build_for(queries, chunks, ["source"])
    plain = lambda rows: sorted((r.term, r.df, round(r.idf, 9)) for r in rows.collect())
    assert plain(index.terms) == plain(whole.terms) and (index.n, index.mean_length) == (whole.n, whole.mean_length)
    asked = {"road", "way", "law", "fine", "nothing", "car"}
    got = {r.chunk_id: {index.asked[t]: n for t, n in zip(r.t, r.tf, strict=True)} for r in index.found.collect()}
    assert got == {r.chunk_id: {c.term: c.tf for c in r.counts if c.term in asked} for r in whole.counts.collect()}
    assert set(index.found.columns) == {"chunk_id", "source", "dl", "t", "tf"}
    monkeypatch.setattr(scan, "BLOCK", 3)
    texts, vectors = chunks.select("chunk_id", "source", "text"), chunks.filter("embedding IS NOT NULL").select("chunk_id", "embedding")
    scans = scan.asked_scans(texts, vectors, queries)
    plain = lambda rows: sorted((r.query_id, r.chunk_id, r.source, r.route, round(r.score, 9)) for r in rows.collect())
    assert len(scans) == 3 and plain(scan.routes(scans)) == plain(scan.routes(scan.scanned(chunks, queries, whole)))
    monkeypatch.setattr(lexical, "SMALL_ROWS", 2)
    assert lexical.build_for(queries, chunks).asked is None and plain(scan.routes(scan.asked_scans(texts, vectors, queries))) == plain(scan.routes(scans))

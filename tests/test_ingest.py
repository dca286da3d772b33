"""Files written, read, ingested twice with a change between, published and read back; the other readers and sinks."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarryline.operators import index_maintenance as index
from quarryline.operators import ingest, layout
from quarryline.sources import files, providers
from quarryline.sources.commits import Commits, Conflict
from quarryline.staging import new_path, release, stage

LAW = ["道路法", "第一章 总 则", "第一条 为了安全。", "第二条 有下列行为的，处罚款：", "（一）超速；", "（二）逆行。", "第二章 附则", "第三条 施行。"]
PAGES = [
    (800.0, [(10, 10, 90, 20, "目次"), (10, 30, 90, 40, "1 范围………1"), (10, 50, 90, 60, "2 要求………2"), (10, 70, 90, 80, "3 表………3")], []),
    (800.0, [(10, 10, 90, 20, "标题"), (10, 30, 90, 40, "1 范 围"), (10, 50, 90, 60, "本标准。"), (30, 72, 90, 80, "要求"), (10, 71, 20, 80, "2"), (10, 750, 20, 760, "2")], []),
    (800.0, [(10, 10, 90, 20, "标题"), (10, 30, 90, 40, "2 要求"), (10, 40, 20, 48, "2."), (10, 50, 90, 60, "1 限值见表1"), (10, 300, 90, 310, "in a table")], [(0, 290, 100, 320, [["值", None], ["a", "b"]])]),
    (800.0, [(10, 10, 90, 20, "标题"), (10, 30, 90, 40, "参考文献"), (10, 60, 90, 70, "3 无关")], []),
]


def docx(paragraphs):
    space = files.W[1:-1]
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


#: Stands in for a PDF library: the pages as JSON. (A lambda, as tasks can't import this module.)
pages = lambda content: [(h, [tuple(x) for x in lines], [tuple(t) for t in tables]) for h, lines, tables in json.loads(content)]


def scanned(spark, root):
    return files.scan(spark, str(root), "docx").unionByName(files.scan(spark, str(root), "pdf"))


def run(spark, root, at, **more):
    return ingest.ingest(spark, scanned(spark, root), at, F.lit("法律"), {"definition": ["总则"]}, pdf=pages, **more).first().asDict()


def rows(spark, at):
    return {(r.source, r.article_no): r for r in index.current(spark, at).collect()}


def test_ingest_twice(spark, tmp_path):
    corpus, at = tmp_path / "corpus", new_path(spark, "test-index")
    (corpus / "base" / "deep").mkdir(parents=True)
    (corpus / "base" / "road+law_20210429.docx").write_bytes(docx(LAW))
    (corpus / "base" / "deep" / "old.docx").write_bytes(docx(["第一条 旧。"]))
    (corpus / "GB+1.pdf").write_bytes(json.dumps(PAGES).encode())
    assert run(spark, corpus, at) == {"total": 9, "added": 9, "updated": 0, "removed": 0, "skipped": 0}
    first = rows(spark, at)
    assert {k: r.chunk_type for k, r in first.items() if k[0] == "road law"} == {("road law", n): t for n, t in (("第一条", "article"), ("第二条", "article"), ("第二条第一款", "clause"), ("第二条第二款", "clause"), ("第三条", "article"))}
    one = first["road law", "第二条第二款"]
    assert (one.category, one.parent_article_no, one.penalty_context, one.text, one.role, len(one.embedding)) == ("base", "第二条", "有下列行为的，处罚款：", "（二）逆行。", "definition", 64)
    assert first["old", "第一条"].category == "deep" and first["GB 1", "1"].category == ""
    assert first["GB 1", "2.1"].text == "限值见表1\n值\na | b" and first["GB 1", "表1"].text == "表1\n值\na | b" and first["GB 1", "表1"].section_header == "2 要求"
    assert run(spark, corpus, at) == {"total": 9, "added": 0, "updated": 0, "removed": 0, "skipped": 9}
    (corpus / "base" / "road+law_20210429.docx").write_bytes(docx([*LAW[:3], "第五条 新。"]))
    (corpus / "base" / "deep" / "old.docx").unlink()
    (corpus / "new.docx").write_bytes(docx(["第一条 新法。"]))
    assert run(spark, corpus, at) == {"total": 6, "added": 1, "updated": 2, "removed": 1, "skipped": 3}
    assert {k for k in rows(spark, at) if k[0] != "GB 1"} == {("road law", "第一条"), ("road law", "第五条"), ("new", "第一条")}
    (corpus / "broken.docx").write_bytes(b"no zip")
    with pytest.raises(ValueError, match="broken.docx"):
        run(spark, corpus, at)
    (corpus / "broken.docx").write_bytes(docx(["no article"]))
    with pytest.raises(ValueError, match="holds nothing"):
        run(spark, corpus, at)
    assert len(rows(spark, at)) == 6  # what was published stays
    (corpus / "broken.docx").unlink()
    assert run(spark, corpus, at, embedder=lambda texts: providers.hashed_embedder(texts, 8))["added"] == 6  # other vectors: built anew
    assert {len(r.embedding) for r in rows(spark, at).values()} == {8}


def law(spark, category, numbers):
    """Files of one article each; the stand-in for a reader takes the content's lines."""
    rows = [(f"{category}/{n}.docx", category, f"{category}{n}", str(n), f"第一条 {category} {n}".encode()) for n in numbers]
    return spark.createDataFrame(rows, "path string, category string, source string, file_hash string, content binary")


def ingest_law(spark, at, category, numbers, **more):
    own = F.col("category") == category
    return ingest.ingest(spark, law(spark, category, numbers), at, F.lit("x"), {}, docx=lambda c: c.decode().split("\n"), within=own, **more)


def published(spark, at, version=None):
    return sorted((r.category, r.source) for r in index.current(spark, at, at=version).collect())


def test_a_writer_that_comes_second_rebases(spark, monkeypatch):
    """Another run publishes between a run's reading and its publishing: both stand in the end."""
    at = new_path(spark, "test-conflict")
    ingest_law(spark, at, "a", [1])
    real, calls = index.publish, []

    def late(*args, **kwargs):
        calls.append(args)
        if len(calls) == 1:
            monkeypatch.setattr(index, "publish", real)
            ingest_law(spark, at, "b", [1, 2])
            monkeypatch.setattr(index, "publish", late)
        return real(*args, **kwargs)

    monkeypatch.setattr(index, "publish", late)
    got = ingest_law(spark, at, "a", [1, 3]).first()
    assert len(calls) == 2 and index.version(at) == 3
    assert (got.added, got.skipped, got.total) == (1, 1, 4)
    assert published(spark, at) == [("a", "a1"), ("a", "a3"), ("b", "b1"), ("b", "b2")]
    monkeypatch.setattr(index, "publish", lambda *a, **k: real(*a[:-1], a[-1] - 1))
    with pytest.raises(Conflict):
        ingest_law(spark, at, "a", [4], attempts=2)
    assert published(spark, at) == [("a", "a1"), ("a", "a3"), ("b", "b1"), ("b", "b2")]


def test_versions_segments_and_vacuum(spark, monkeypatch):
    at = new_path(spark, "test-versions")
    monkeypatch.setattr(index, "MOST_SEGMENTS", 3)
    want = {}
    for n, numbers in enumerate([[1, 2], [1, 2, 3], [2, 3], [2, 3, 4], [4]], 1):
        ingest_law(spark, at, "a", numbers)
        want[n] = [("a", f"a{i}") for i in numbers]
    assert all(published(spark, at, n) == rows for n, rows in want.items())
    sizes = [len(Commits(at).read(n)["segments"]) for n in range(1, 6)]
    assert sizes == [1, 2, 3, 1, 2]
    assert index.vacuum(at, keep=2) == 3 and index.vacuum(at, keep=2) == 0
    assert published(spark, at, 4) == want[4] and published(spark, at) == want[5]
    with pytest.raises(ValueError, match="vacuumed"):
        index.current(spark, at, at=2)


def test_scanned_pdf_goes_to_ocr(spark, tmp_path):
    (tmp_path / "scan.pdf").write_bytes(json.dumps([(800.0, [], [])]).encode())
    found, errors = ingest.read_articles(scanned(spark, tmp_path), pdf=pages, ocr=lambda content: ["1 范围", "正文。"])
    assert [(r.article_no, r.text) for r in found.collect()] == [("1", "正文。")] and errors.count() == 0


def test_headers_of_tables(spark):
    """A table behind a first-level leaf stands under the document's last chapter, one of a document without chapters
    in the appendix."""
    box = (0, 290, 100, 320, [["值", "b"]])
    lines = [(10, 30, 90, 40, "1 范围"), (10, 50, 90, 60, "见表1"), (10, 130, 90, 140, "2 结语"), (10, 150, 90, 160, "完。")]
    frame = spark.createDataFrame([("a.pdf", json.dumps([(800.0, lines, [box])]).encode())], "path string, content binary")
    found = {r.article_no: r for r in layout.pdf_articles(stage(files.pdf_rows(frame, pages), "test-pdf"), [], "GB").collect()}
    assert found["1"].section_header == "" and found["1"].text == "见表1\n值 | b" and found["表1"].section_header == "2 结语"
    rows = stage(files.pdf_rows(frame, pages), "test-pdf")
    articles = spark.createDataFrame([("a.pdf", 0, "1", "", "见表1")], "doc string, pos int, article_no string, section_header string, text string")
    none = spark.createDataFrame([], "doc string, _chapter string")
    assert {r.article_no: r.section_header for r in layout.with_tables(articles, rows, none).collect()} == {"1": "", "表1": "附表"}


def test_sessions_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "s1", "title": "t", "messages": [{"role": "user", "content": "hi", "attachments": [{"name": "n", "type": "image", "url": "/u/n.png"}]}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"title": "no id"}))
    got = files.sessions(spark, str(tmp_path)).collect()
    assert [(r.id, r.messages[0].attachments[0].url) for r in got] == [("s1", "/u/n.png")]
    lines = spark.createDataFrame([("t1", "chat", "2024-01-01T00:00:00", 2.5, {"k": "v"})], "trace_id string, name string, started_at string, duration_ms double, attributes map<string,string>")
    for _ in range(2):
        files.append_lines(lines, f"{tmp_path}/traces")
    assert [tuple(r) for r in files.traces(spark, f"{tmp_path}/traces").collect()] == [tuple(r) for r in lines.collect()] * 2


def test_records_keep_what_attributes_are(spark, tmp_path):
    """Numbers, texts, lists, nulls and nested objects come back as they went; what isn't there or is of another kind
    is null."""
    texts = ['{"a": 1, "b": {"c": [1, "x", null]}}', '{"a": "one"}', "{}", '{"a": 1.5, "b": [true]}', None]
    rows = spark.createDataFrame([("span", str(i), t) for i, t in enumerate(texts)], "kind string, span_id string, attributes string")
    files.append_records(rows.filter("span_id < 3"), f"{tmp_path}/log")
    files.append_records(rows.filter("span_id >= 3").withColumn("attributes", F.parse_json("attributes")), f"{tmp_path}/log")
    found = files.records(spark, f"{tmp_path}/log").cache()
    own = {r.span_id: None if r.a is None else json.loads(r.a) for r in found.select("span_id", F.to_json("attributes").alias("a")).collect()}
    assert own == {str(i): t and json.loads(t) for i, t in enumerate(texts)}
    got = {r.span_id: (r.a, r.x, r.t) for r in found.select("span_id", files.attribute("$.a", "int").alias("a"), files.attribute("$.b.c[1]", "string").alias("x"), files.attribute("$.b[0]", "boolean").alias("t")).collect()}
    assert got == {"0": (1, "x", None), "1": (None, None, None), "2": (None, None, None), "3": (1, None, True), "4": (None, None, None)}
    kinds = {(r.attribute, r.kind): r.n for r in files.attribute_kinds(found).collect()}
    assert kinds[("a", "STRING")] == 1 and sum(n for (a, _), n in kinds.items() if a == "a") == 3 and kinds[("b", "ARRAY<BOOLEAN>")] == 1
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.append_records(spark.createDataFrame([("event", "{broken")], "kind string, attributes string"), f"{tmp_path}/other")


def test_policy_and_dictionary(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"rules": [{"triggers": ["a"], "enhancement": "x"}, {"triggers": ["b"], "requires": ["c"], "enhancement": "y"}], "intents": {"penalty": {"keywords": ["fine"]}}}))
    found = files.policy(spark, f"{tmp_path}/p.json")
    assert [tuple(r) for r in files.rule_table(spark, found["rules"]).collect()] == [(0, ["a"], [], "x"), (1, ["b"], ["c"], "y")]
    assert [tuple(r) for r in files.intent_table(spark, found["intents"]).collect()] == [(0, "penalty", ["fine"], [])]
    (tmp_path / "d.txt").write_text("# words\n酒驾 100 n\n毒驾\n\nword x # odd\n")
    assert [tuple(r) for r in files.dictionary(spark, f"{tmp_path}/d.txt").collect()] == [("酒驾", 100), ("毒驾", None), ("word", None)]
    assert providers.rendered("{a}-{b}", a="1", b="2") == "1-2"
    with pytest.raises(KeyError, match="a, c"):
        providers.rendered("{c}{a}{b}", b="2")


def test_release_drops_what_was_staged(spark, tmp_path):
    df = stage(spark.range(3).toDF("x"), "test-release")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert release(spark) >= 1
    import os

    assert not os.path.exists(path)


def test_paragraphs_are_handed_on_in_parts(spark, monkeypatch):
    """A task holds a bounded part of its files' text; rows and errors are the same however it is cut."""
    from quarryline.sources import files

    rows = [(f"f{i}", None if i == 3 else f"a{i}\nbb\n".encode()) for i in range(20)]
    table = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    reader = lambda content: content.decode().split("\n")
    whole = sorted(map(tuple, files.paragraphs(table, reader).collect()), key=repr)
    monkeypatch.setattr(files, "HELD", 8)
    assert sorted(map(tuple, files.paragraphs(table, reader).collect()), key=repr) == whole and len(whole) == 19 * 3 + 1

    class Whole:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    run = files.paragraphs(Whole(), reader)
    frames = list(run([table.toPandas()]))
    assert len(frames) > 5 and max(len(f) for f in frames) <= 9

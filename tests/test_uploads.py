"""Files in and out: kinds, groups, broken files, routes."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from quarryline.sources import uploads

FILES = "name string, text string, content binary"
PDF = "quarryline.plans.uploads:form_feed_pages"


def test_round_trip_of_odd_texts():
    """Lines are paragraphs; blanks, tabs, carriage returns and marks of XML stay, what XML can't hold is replaced."""
    for text in ("", "a\n\nb", "  two  \tthree ", "<a> & \"b\" 'c' ]]>", "x\r", "酒后\U0001f600驾驶", "long " * 50_000):
        assert uploads.body_paragraphs(uploads.docx(text)) == text.split("\n")
    assert uploads.body_paragraphs(uploads.docx("a\x00b\x0bc\ufffe")) == [f"a{chr(0xFFFD)}b{chr(0xFFFD)}c{chr(0xFFFD)}"]
    assert uploads.docx("same") == uploads.docx("same")
    assert uploads.body_paragraphs(uploads.docx(chr(0xE000) + chr(0xFFFD) + chr(0xD7FF))) == [chr(0xE000) + chr(0xFFFD) + chr(0xD7FF)]


def test_only_the_body_counts():
    """Tables' paragraphs are left out, runs join, breaks and tabs are characters, tab stops aren't."""
    w = uploads.W[1:-1]
    run = lambda s: f"<w:r>{s}</w:r>"
    body = f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr>{run('<w:t>a</w:t><w:tab/><w:t>b</w:t>')}{run('<w:t>c</w:t><w:br/>')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('<w:t>cell</w:t>')}</w:p></w:tc></w:tr></w:tbl><w:p/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as packed:
        packed.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert uploads.body_paragraphs(out.getvalue()) == ["a\tbc\n", ""]


def test_groups_by_size(spark, tmp_path):
    """Files go to partitions by size, a large one alone; hidden ones are none."""
    for i, size in enumerate((10, 10, 10, 500, 10)):
        (tmp_path / "deep" / str(i)).mkdir(parents=True)
        (tmp_path / "deep" / str(i) / "f.pdf").write_bytes(b"x" * size)
    (tmp_path / ".hidden.pdf").write_bytes(b"x")
    groups = uploads.Reader({"path": str(tmp_path), "bytes": "25"}).partitions()
    assert [len(g.paths) for g in groups] == [2, 1, 1, 1]
    rows = uploads.read(spark, str(tmp_path), bytes="25", pdf=PDF)
    assert rows.rdd.getNumPartitions() == 4 and sorted(len(r.text) for r in rows.collect()) == [10, 10, 10, 10, 500]
    (tmp_path / "none").mkdir()
    assert uploads.read(spark, str(tmp_path / "none")).collect() == []


def test_routes_and_errors(spark, tmp_path):
    """One row a file, whatever becomes of it; a file written twice is there once."""
    page = b"long enough text for a page"
    rows = [
        ("a/1.docx", " one \n\n two", None),
        ("a/2.docx", None, None),
        ("b/3.docx", None, b"no zip"),
        ("4.pdf", None, page + b"\f" + page),
        ("5.pdf", None, b"\f".join([page] * 51)),
        ("6.pdf", None, b"\f".join([page] * 50)),
        ("7.pdf", None, b" thin "),
        ("8.PNG", None, b"\x00\xff"),
        ("9.exe", None, b""),
        ("10.pdf", None, b"\xff\xfe"),
    ]
    table = spark.createDataFrame(rows, FILES).withColumn("pages", F.lit(1))
    for _ in range(2):
        uploads.write(table, str(tmp_path))
    got = {r.name.split(".")[0]: (r.route, r.text, r.error and r.error.split(":")[0]) for r in uploads.parsed(spark, str(tmp_path), lambda content: [f" {len(content)}", ""], pdf=PDF).collect()}
    text = page.decode()
    assert got["1"] == ("docx", "one\ntwo", None) and got["2"] == ("docx", "", None) and got["3"] == ("docx", None, "BadZipFile")
    assert got["4"] == ("pdf", f"{text}\n{text}", None) and got["5"] == ("rejected: too many pages", None, None) and got["6"][0] == "pdf"
    assert got["7"] == ("ocr", "6", None) and got["8"] == ("ocr", "2", None) and got["9"] == ("rejected: unsupported", None, None)
    assert got["10"][2] == "UnicodeDecodeError" and got["10"][1] is None and len(got) == 10
    missing = {r.name: r.error for r in uploads.parsed(spark, str(tmp_path), pdf=PDF).filter("route = 'ocr'").collect()}
    assert missing["7.pdf"] == missing["8.PNG"] == "ValueError: no OCR provider"


def test_too_much_to_unpack(monkeypatch, spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(uploads.docx("a" * 1000))
    monkeypatch.setattr(uploads, "MOST_UNPACKED", 100)
    rows = list(uploads.Reader({"path": str(tmp_path)}).read(uploads.Group([str(tmp_path / "x.docx")])))
    assert rows[0].column("error")[0].as_py().startswith("ValueError: unpacks")


def test_files_are_read_once(spark, tmp_path):
    """What is found in files and what OCR adds meet without a second scan of the files."""
    uploads.write(spark.createDataFrame([("a/1.docx", "one", None), ("2.png", None, b"xy"), ("a/b/3.docx", "two", None)], FILES), str(tmp_path))
    found = uploads.parsed(spark, str(tmp_path), lambda content: [str(len(content))])
    assert found._jdf.queryExecution().optimizedPlan().toString().count(uploads.NAME) <= 1
    assert {r.name: r.text for r in found.collect()} == {"1.docx": "one", "2.png": "2", "3.docx": "two"}

"""Rules on text by hand-written cases; the queries hold the same rules against the tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as t
from quarryline.operators import chunking, context, operations, rerank, rules
from quarryline.plans import catalog

CASES = {
    "clean_title": (t.clean_title, [("总 则　通用", "总则通用"), ("第 一", "第一"), (" a b ", "ab")]),
    "source_name": (t.source_name, [(" 道路法_20210429", "道路法"), ("a+b_law", "a b_law"), ("《已标》", "《已标》"), ("", "")]),
    "marked_source": (t.marked_source, [(" 道路法_20210429", "《道路法》"), ("a+b_law", "《a b_law》"), ("《已标》", "《已标》"), ("", "")]),
    "category": (t.category, [("traffic/law.docx", "traffic"), ("law.docx", ""), ("a/deep/law.pdf", "deep")]),
    "parent_number": (t.parent_number, [("第九十一条第二款", "第九十一条"), ("第一百二十条之一第十款", "第一百二十条之一"), ("附则", "附则"), ("第五条", "第五条")]),
    "clause_label": (t.clause_label, [("第九十一条第二款", "第二款"), ("第一百二十条之一第十款", "第十款"), ("附则", ""), ("第五条", "")]),
    "numeral": (t.numeral, [("十", 10), ("十一", 11), ("二十", 20), ("九十九", 99), ("一百二十", 120), ("三千零五", 3005), ("五", 5), ("甲", 0), ("", 0)]),
    "glyphs": (t.glyphs, [("６０００ｍｍ", "6000mm"), ("终ꎮ", "终。"), ("«x»￣", "《x》—"), ("3. 1 范围", "3.1 范围"), ("ꀀꀁꎮ", "ꀀꀁꎮ"), ("ꎱꎲ", "12")]),
    "cjk_tokens": (lambda c: F.array_join(t.cjk_tokens(c, ["酒后驾驶"]), "/"), [("酒后驾驶的车 abc，12", "酒后驾驶/的/车/abc/12"), ("驾驶证", "驾/驶/证")]),
    "rewrite_lines": (lambda c: F.array_join(t.rewrite_lines(c, 3), "/"), [('1. first\n- "second"\n\n2、first\nthird\nfourth', "first/second/third")]),
    "sanitized_rewrite": (t.sanitized_rewrite, [('<think>a\nb</think>\nrewrite: "who pays"\nmore', "who pays"), ("<think>x</think>", None), ("long" * 60, None)]),
    "role": (
        lambda c: rerank.role(c, {"behavior_penalty": ["penalty"], "definition": ["terms", "General"], "procedural": ["appeal"]}),
        [("Three / conduct and penalty", "behavior_penalty"), ("General terms", "definition"), ("Review / appeal", "procedural"), ("Roads", "substantive"), ("terms / penalty", "behavior_penalty"), ("", "substantive"), (None, "substantive")],
    ),
    "stripped_negation": (lambda c: t.stripped_negation(c, ["没", "未", "没有", "不"]), [("没有 戴头盔", "戴头盔"), ("未系安全带", "系安全带"), ("停车", "停车")]),
    "trivial": (lambda c: rules.trivial(c, ["ok then", "help"], ["law"]), [(None, True), ("", True), ("x", True), ("12.5", True), ("?! 。", True), ("Help", True), ("ok then", True), ("abcd", True), ("law?", False), ("who pays the fine", False)]),
    "about_conversation": (lambda c: rules.about_conversation(c, ["earlier", "before"], ["said", "asked"]), [("what you said earlier", False), ("earlier you said", True), ("before", False)]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    function, cases = CASES[name]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", function(F.col("c")).alias("r"))
    assert [r.r for r in rows.orderBy("i").collect()] == [want for _, want in cases]


def test_table_text(spark):
    rows = spark.createDataFrame([([["a\n b", "c"], [None, "d"]],)], "cells array<array<string>>")
    assert rows.select(t.table_text(F.col("cells"))).first()[0] == "a b | c\nd"


def test_valid_tokens(spark):
    rows = [(1, "2030-01-01T00:00:00", 0), (2, "2020-01-01T00:00:00", 0), (3, None, 0), (4, None, 1), (5, "never", 0)]
    got = operations.valid_tokens(spark.createDataFrame(rows, "id int, expires_at string, revoked int"), "2026-01-01 00:00:00")
    assert sorted(r.id for r in got.collect()) == [1, 3]


def test_articles(spark):
    """Chapters fill forward, a chapter ends a section, the contents are skipped."""
    lines = ["道路法", "目 录", "第一章 总则", "第一章 总 则", "第一条 为了安全。", "第二条", "有下列行为的，处罚款：", "（一）超速；", "（二）逆行。", "第二章 通行", "第一节 一般", "第三条 靠右。", "第三条之一 补充。", "第三章 附则", "第四条 施行。"]
    rows = spark.createDataFrame([("d", i, line) for i, line in enumerate(lines)], "doc string, pos int, text string")
    got = [(r.article_no, r.section_header, r.text) for r in chunking.articles(rows).orderBy("ordinal").collect()]
    assert got == [
        ("第一条", "第一章 总则", "为了安全。"),
        ("第二条", "第一章 总则", "有下列行为的，处罚款：\n（一）超速；\n（二）逆行。"),
        ("第三条", "第二章 通行 / 第一节 一般", "靠右。"),
        ("第三条之一", "第二章 通行 / 第一节 一般", "补充。"),
        ("第四条", "第三章 附则", "施行。"),
    ]


def test_clause_order(spark):
    rows = [(1, 0, "甲法", "第五条", "第五条第十一款", "later", "h", 10), (1, 1, "甲法", "第五条", "第五条第二款", "early", "h", 11), (1, 2, "乙法", "第一条", "第一条", "alone", "g", 12)]
    label = t.clause_label(F.col("article_no"))
    table = spark.createDataFrame(rows, "query_id int, pos int, source string, parent_article_no string, article_no string, text string, section_header string, chunk_id int")
    got = context.merged_references(table, t.numeral(F.regexp_extract(label, "第(.*)款", 1)), label).orderBy("place").collect()
    assert [(r.source, r.text) for r in got] == [("甲法", "（第二款）\nearly\n\n（第十一款）\nlater"), ("乙法", "alone")]


def test_service_reply(spark):
    """Rule order decides; a long text and one with an excluded word get no reply, nor does a rule without one."""
    asked = [(1, "Hello!"), (2, "help me please, hello again"), (3, "HELP"), (4, "no hello"), (5, "..."), (6, None)]
    listed = spark.createDataFrame([(0, ["Hello", "Never"], ""), (1, ["Hel Lo!"], "greeting"), (2, ["HELP", "?", "ello"], "what I do")], "pos int, keywords array<string>, reply string")
    got = rules.service_reply(spark.createDataFrame(asked, "query_id int, text string"), listed, ["No Hello", "!"])
    assert sorted((r.query_id, r.reply) for r in got.collect()) == [(1, "greeting"), (3, "what I do")]


def test_article_windows_carry_no_text(spark, monkeypatch):
    """Marks alone are ordered document by document; texts are dealt out by paragraph and article, also of one document;
    paragraphs of one place stay apart."""
    monkeypatch.setattr(chunking, "SHARE", 10)
    lines = [("d", 3 * i + k, t) for i in range(60) for k, t in enumerate([f"第{'一二三'[i % 3]}章 c{i}" if i % 5 == 0 else " ", f"第{'一二三'[i % 3]}条 a{i}", f"b{i}"])]
    rows = spark.createDataFrame([*lines, ("e", 1, "第一条 x"), ("e", 2, "y"), ("e", 2, "z")], "doc string, pos long, text string")
    found = chunking.articles(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = next(i for i, line in enumerate(plan) if "Window [" in line)
    last = next(i for i, line in enumerate(plan) if i > first and "Relation" in line)
    assert "text#" not in "".join(plan[first:last]) and "_piece#" not in "".join(plan[first:last])
    got = {(r.doc, r.text): (r.article_no, r.section_header) for r in found.collect()}
    want = {("d", f"a{i}\nb{i}"): (f"第{'一二三'[i % 3]}条", f"第{'一二三'[(i - i % 5) % 3]}章 c{i - i % 5}") for i in range(60)}
    assert {k: v for k, v in got.items() if k[0] == "d"} == want
    assert [sorted(k[1].split("\n")) for k in got if k[0] == "e"] == [["x", "y", "z"]]


def test_articles_of_odd_documents(spark, tmp_path):
    """Null and blank texts, white space of all kinds, odd titles, missing and negative ids: w9_articles equals its SQL."""
    spaces = ["\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\t", "\r\n", " "]
    bodies = [None, "", "  ", "\n\n", "x", "“x”", "无", "第一章 x", "第三条 y", "之一 z", *spaces, *(w + "x" + w + " " + w + "y" + w for w in spaces)]
    rows = [(i, text, "en", "a") for i, text in enumerate(bodies)]
    rows += [(100 + i, "x", lang, "b") for i, lang in enumerate(lang for lang in ["zh CN", " en", "", None, "a\nb", "\u3000x", "50% +"] for _ in range(3))]
    rows += [(-3, "x", "en", "c"), (-2, "y", "en", "c"), (None, "z", "en", "c"), (1, "x", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["w9_articles"](spark, str(tmp_path)).select("article_no", "section_header", "text")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(f"SELECT article_no, section_header, text FROM ({catalog.ORACLES['w9_articles']})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want) and len(want) == len(rows) - 1

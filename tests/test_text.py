"""Text functions, and the tokenizer and ranking against an independent full-text engine."""

import posixpath
import sqlite3

import pytest
from pyspark.sql import functions as F

from shardlore.functions import text as tx
from shardlore.operators import bm25, fusion


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_snippet(spark):
    assert one(spark, "  a\u00a0\t\nb ", tx.snippet) == "a b"
    assert one(spark, "x" * 321, tx.snippet) == "x" * 320 + "…"
    assert one(spark, "x" * 320, tx.snippet) == "x" * 320
    assert one(spark, None, tx.snippet) == ""


def test_citation(spark):
    row = spark.createDataFrame([("p", "a", 1, 2), ("p", "", 1, 2), ("p", None, 3, 3)], "p string, a string, x int, y int").select(tx.citation(*map(F.col, "paxy")).alias("c")).collect()
    assert [r.c for r in row] == ["p#a", "p:1-2", "p:3-3"]


def test_ids():
    assert tx.parse_id("b:3", ["a", "b"]) == ("b", 3) and tx.parse_id(7, ["a", "b"]) == ("a", 7) and tx.parse_id("7", ["a"]) == ("a", 7)
    with pytest.raises(KeyError):
        tx.parse_id("c:1", ["a"])


@pytest.mark.parametrize(("query", "terms"), [("CONFIG_BT* the", [("config_bt", True), ("the", False)]), ("café", [("caf", False)]), ("a OR* b", []), ("NEAR*", [("near", True)]), ("?!", []), ("or*", [("or", True)]), (None, [])])
def test_query_terms(spark, query, terms):
    assert [(t.term, t.is_prefix) for t in one(spark, query, tx.query_terms)] == terms


@pytest.mark.parametrize("path", ["a/b/../c", "./x//y/", "../../z", "a/..", "/../k", "", "/", "a/../../b", "..", "a/./b/.."])
def test_normal_path(spark, path):
    assert one(spark, path, tx.normal_path) == posixpath.normpath(path)


def test_role_links(spark):
    text = ":ref:`T <a>` :ref:`a` :doc:`/x/y` :file:`~f` :ref:` ` :other:`z`"
    assert [(x.kind, x.target) for x in one(spark, text, tx.role_links)] == [("ref", "a"), ("doc", "x/y"), ("file", "f")]


def test_prose_input():
    text = ".. _a:\n\nTitle\n=====\n\n.. toctree::\n   :maxdepth: 1\n\n   x\n\nSee :ref:`words <a>` and ``CONFIG_X`` **now**.\n\n\n\nend"
    assert tx.prose_input(text) == "Title\n\n x\n\nSee words and CONFIG_X now.\n\nend"


def test_code_input(spark):
    assert one(spark, "/*\n * Copyright\n */\nint CONFIG_A;  \n\n\n\nx\n", tx.code_input) == "int CONFIG_A;\n\nx"
    assert one(spark, "// SPDX: x\n// y\nint a;", tx.code_input) == "int a;"
    assert one(spark, "/* plain */ int a;", tx.code_input) == "/* plain */ int a;"


def test_tokens_and_scores_agree_with_sqlite(spark):
    texts = ["Ärger über CONFIG_BT_LE, the the end", "the BT end", "end of_it über", "nothing here", "config_bt_x config_bt_y"]
    try:
        db = sqlite3.connect(":memory:")
        db.execute("CREATE VIRTUAL TABLE f USING fts5(text, header, anchor, tokenize=\"unicode61 tokenchars '_'\")")
    except sqlite3.OperationalError:
        pytest.skip("SQLite has no full-text index here")
    db.executemany("INSERT INTO f(rowid, text, header, anchor) VALUES (?, ?, 'end', '')", list(enumerate(texts)))
    sections = spark.createDataFrame([("c", i, t, "end", "") for i, t in enumerate(texts)], "corpus string, id long, text string, header string, anchor string")
    post, stats = bm25.postings(sections).cache(), bm25.corpus_stats(sections)
    for query, match in [("the end", '"the" OR "end"'), ("config_bt*", "config_bt*"), ("the the BT", '"the" OR "the" OR "BT"'), ("uber", '"uber"')]:
        want = db.execute("SELECT rowid, round(-bm25(f), 6) FROM f WHERE f MATCH ? ORDER BY bm25(f), rowid", (match,)).fetchall()
        got = bm25.bm25(spark.createDataFrame([(1, query)], "qid int, query string"), post, stats).orderBy("rank").collect()
        assert [(r.id, round(r.score, 6)) for r in got] == want, query


def test_ranking_paths_agree(spark, monkeypatch):
    """Stored postings or texts, broadcast terms or shuffled ones: the same ranks."""
    rows = [("a", i, f"tion tional {'word ' * (i % 4)}x{i % 3}", None, "") for i in range(30)] + [("b", 1, "word", "word", ""), ("b", 2, None, None, None)]
    sections = spark.createDataFrame(rows, "corpus string, id long, text string, header string, anchor string")
    queries = spark.createDataFrame([(1, "word x1 tion*"), (2, "x2 word word"), (3, "??"), (4, None)], "qid int, query string")
    stats = bm25.corpus_stats(sections)
    assert {(r.corpus, r.n_docs) for r in stats.collect()} == {("a", 30), ("b", 2)}
    found = []
    for limit in (bm25.BROADCAST_TERMS, 0):
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", limit)
        found += [sorted(map(tuple, bm25.bm25(queries, post, stats).collect())) for post in (bm25.postings(sections), bm25.occurrences(sections))]
    assert found[0] and all(f == found[0] for f in found)


def test_fusion_order_of_lists_only_breaks_ties(spark):
    a = spark.createDataFrame([(1, "c", 10, 1), (1, "c", 20, 2)], "qid int, corpus string, id long, rank int")
    b = spark.createDataFrame([(1, "c", 30, 1), (1, "c", 20, 2)], "qid int, corpus string, id long, rank int")
    ab, ba = (fusion.fuse(x, 8).orderBy("place").collect() for x in ([a, b], [b, a]))
    assert [r.id for r in ab] == [20, 10, 30] and [r.id for r in ba] == [20, 30, 10]
    assert {r.id: r.rrf for r in ab} == {r.id: r.rrf for r in ba}
    assert fusion.clamp_k(0) == 1 and fusion.clamp_k(99) == 50

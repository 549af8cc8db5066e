"""Queries over sources written out here, against rows derived by hand.

The given tables hold no trees, markup or code to parse; these do.  Each query
runs the operator on the workers, as over a large table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.parse import split_c, split_code, split_kconfig, split_md, split_rst, split_windows, whole_file
from .operators import embed, graph, parsing
from .queries import table
from .registry import query
from .sources import trees


def _values(columns: str, rows: list[tuple]) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


SECTION_COLUMNS = "anchor, breadcrumb, header, line_start, line_end"


def _parsed(spark: SparkSession, parser: Callable, source: str, rel: str) -> DataFrame:
    """The parser run on the workers, over a one-row table of the source."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            rows = [(s.anchor, s.breadcrumb, s.header, s.line_start, s.line_end) for text in batch["text"] for s in parser(text, "repo", rel)]
            yield pd.DataFrame(rows, columns=SECTION_COLUMNS.split(", "))

    return spark.createDataFrame([(source,)], "text string").mapInPandas(run, "anchor string, breadcrumb string, header string, line_start int, line_end int")


RST = "lost text\n\n.. _top:\n\nTitle\n=====\n\nIntro :ref:`top`.\n\n.. _part_a:\n\nPart A\n------\n\nBody.\n\nPart B\n------\n\nEnd.\n"
C = '// SPDX: none\n#include "a.h"\n#define LIMIT 10\n\nstruct point {\n\tint x;\n};\n\n/** Adds. */\nint add(int a, int b)\n{\n\treturn a + b;\n}\n\nint later(void);\n'
KCONFIG = 'menu "Options"\n\nconfig FAST\n\tbool "Be fast"\n\thelp\n\t  Speeds up.\n\nconfig SIZE\n\tint\n\tdefault 3\n\nendmenu\n'
MD = "# One\ntext\n```\n# not a heading\n```\n## Two\nmore\n# Three\n"


@query(_values(SECTION_COLUMNS, [("top", "Title", "Title", 3, 8), ("part_a", "Title > Part A", "Part A", 10, 15), ("", "Title > Part B", "Part B", 17, 20)]))
def rst_sections_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, split_rst, RST, "repo/a.rst")


@query(_values(SECTION_COLUMNS, [("", "One", "One", 1, 5), ("", "One > Two", "Two", 6, 7), ("", "Three", "Three", 8, 8)]))
def md_sections_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, split_md, MD, "repo/a.md")


@query(_values(SECTION_COLUMNS, [("", "repo > a.c", "", 2, 2), ("LIMIT", "repo > a.c > LIMIT", "#define LIMIT 10", 3, 3), ("point", "repo > a.c > point", "struct point", 5, 7), ("add", "repo > a.c > add", "int add(int a, int b)", 9, 13), ("", "repo > a.c", "", 15, 15)]))
def c_symbols_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, split_c, C, "a.c")


@query(_values(SECTION_COLUMNS, [("", 'repo > Kconfig > menu "Options"', 'menu "Options"', 1, 1), ("CONFIG_FAST", "repo > Kconfig > CONFIG_FAST", "Be fast", 3, 6), ("CONFIG_SIZE", "repo > Kconfig > CONFIG_SIZE", "SIZE", 8, 10), ("", "repo > Kconfig > endmenu", "endmenu", 12, 12)]))
def kconfig_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, split_kconfig, KCONFIG, "Kconfig")


@query(_values("pos, kind, target", [(0, "ref", "top"), (1, "doc", "guide/a"), (2, "option", "CONFIG_X"), (3, "file", "b.c")]))
def role_links_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "See :ref:`The top <top>`, :doc:`/guide/a`, :option:`CONFIG_X` and :ref:`top`; :file:`~b.c`, :other:`x`."
    links = spark.createDataFrame([(source,)], "text string").select(F.posexplode(tx.role_links(F.col("text"))).alias("pos", "l"))
    return links.select("pos", "l.kind", "l.target")


PATHS = [("a/b/../c", "a/c"), ("./x//y/", "x/y"), ("../../z", "../../z"), ("a/..", "."), ("/../k", "/k"), ("", ".")]


@query(_values("path, normal", PATHS))
def path_normalise_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p, _ in PATHS], "path string").select("path", tx.normal_path(F.col("path")).alias("normal"))


EDGE_TARGETS = [(1, "a/p#x", 1), (2, "b/q#x", 3), (3, "zz#x", 1), (4, "b/q", 3), (5, "b/q#none", None), (6, "a/p#", 1), (7, "nowhere", None)]


@query(_values("src_id, target_raw, resolved_id", EDGE_TARGETS))
def page_edges_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([(1, "a/p", ["x"]), (2, "a/p", ["y"]), (3, "b/q", ["x"])], "id int, docname string, all_anchors array<string>")
    edges = spark.createDataFrame([(s, t) for s, t, _ in EDGE_TARGETS], "src_id int, target_raw string")
    return graph.resolve_pages(edges, *graph.page_maps(pages)).select("src_id", "target_raw", "resolved_id")


DOC_TARGETS = [("k/one.rst", "two", 2), ("k/one.rst", "../m/three", 3), ("k/one.rst", "three", 3), ("k/one.rst", "ext:two", None), ("k/one.rst", "/k/two", 2), ("k/one.rst", "same", None), ("k/one.rst", "/two", 2)]


@query(_values("src_path, target_raw, resolved_id", DOC_TARGETS))
def doc_edges_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("k/one.rst", 1), ("k/two.rst", 2), ("m/three.md", 3), ("m/same.rst", 4), ("n/same.rst", 5)], "file_path string, id int")
    edges = spark.createDataFrame([(p, t) for p, t, _ in DOC_TARGETS], "src_path string, target_raw string")
    return graph.resolve_docs(edges, graph.doc_map(docs)).select("src_path", "target_raw", "resolved_id")


# --- more parsers ------------------------------------------------------------------------

DEVICES = "\n\n/* board */\nuart0: uart@40002000 {\n\tstatus = \"okay\";\n};\n"
PARAGRAPHS = "\n\n".join(f"{k} " + "x" * 798 for k in range(10))
LINES = "\n".join(f"int v{k} = {k};" + " " * 200 for k in range(30))


@query(_values(SECTION_COLUMNS, [("", "repo > a.dts > uart0: uart@40002000 {", "uart0: uart@40002000 {", 1, 4)]))
def windows_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, split_windows, DEVICES, "a.dts")


@query(_values(SECTION_COLUMNS, [("", "b", "b", 1, 12), ("", "b", "b", 13, 19)]))
def paragraphs_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An oversized section without headings: groups of whole paragraphs of at most 1,200 tokens."""
    return _parsed(spark, split_rst, PARAGRAPHS, "repo/b.rst")


@query(_values(SECTION_COLUMNS, [("", "repo > v.c > int v0 = 0;", "int v0 = 0;", 1, 15), ("", "repo > v.c > int v0 = 0;", "int v0 = 0;", 16, 29), ("", "repo > v.c > int v0 = 0;", "int v0 = 0;", 30, 30)]))
def whole_file_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, whole_file, LINES, "v.c")


@query(_values("lane, n, fell_back", [("c", 1, 0), ("kconfig", 1, 0), ("c-empty", 0, 0), ("c-comment", 1, 1)]))
def fallback_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text in which its parser finds nothing becomes line windows."""
    sources = [("c", "c", "int x;\n"), ("kconfig", "kconfig", "config A\n"), ("c-empty", "c", "  \n"), ("c-comment", "c", "/* words only */\n")]

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            rows = [(r.name, len(found), int(fell_back)) for r in batch.itertuples(index=False) for found, fell_back in [split_code(r.text, "repo", "a", r.lane)]]
            yield pd.DataFrame(rows, columns=["lane", "n", "fell_back"])

    return spark.createDataFrame(sources, "name string, lane string, text string").mapInPandas(run, "lane string, n int, fell_back int")


PAGE = """<body><nav>menu</nav><div role="main"><div class="section" id="top"><h1>Top<a class="headerlink" href="#top">#</a></h1>
<p>Intro <a class="reference" href="../b/y.html#part">y</a></p><dl><dt id="c.f">f()</dt><dd>does</dd></dl>
<section id="sub"><h2>Sub</h2><p>Inner <a class="reference" href="https://e.org">out</a></p></section></div></div></body>"""


@query(_values("id, docname, anchor, breadcrumb, anchors, links", [(1, "k/x", "top", "Top", "top,c.f", "b/y#part"), (2, "k/x", "sub", "Top > Sub", "sub", "")]))
def html_sections_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([(["k", "x"], "k", "k/x", PAGE.encode())], "file_key array<string>, docset string, docname string, content binary")
    found = parsing.number(parsing.parse_pages(pages))
    return found.select("id", "docname", "anchor", "breadcrumb", F.array_join("all_anchors", ",").alias("anchors"), F.array_join("raw_links", ",").alias("links"))


# --- scans ---------------------------------------------------------------------------------

TREE = [
    ("core/doc/a.rst", b"A\n=\n"), ("core/doc-b.md", b"# B\n"), ("core/_build/z.rst", b"Z"), ("core/src/x.C", b"int x;"), ("core/src/y.c", b"int \x00;"), ("core/tests/t.c", b"int t;"),
    ("core/Kconfig.board", b"config A\n"), ("core/b.yaml", b"a: 1"), ("core/huge.h", b"/" * 1_500_001), ("core/lib.a", b"x"), ("core/CMakeLists.txt", b"add()"), ("core/build/g.c", b"int g;"), ("fork/f.c", b"int f;"), ("top.md", b"# T"),
    ("core/index.html", b"<p>i</p>"), ("core/search.html", b"<p>s</p>"), ("core/_static/s.html", b"<p>t</p>"),
]


def _tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(rel, len(body), body) for rel, body in TREE], "rel string, length long, content binary")


@query(_values("place, repo, rel", [(1, "core", "core/doc/a.rst"), (2, "core", "core/doc-b.md"), (3, "top.md", "top.md")]))
def prose_scan_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths sort part by part, so ``doc/`` comes before ``doc-b``."""
    found = trees.doc_files(_tree(spark)).withColumn("ord", F.lit(0))
    return parsing.number(found).select(F.col("id").cast("int").alias("place"), "repo", "rel")


@query(_values("repo, rel", [("kernel", "core/doc/a.rst")]))
def scoped_scan_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.scoped_doc_files(_tree(spark), [("core/doc", "kernel"), ("absent", "x")]).select("repo", "rel")


@query(_values("docset, docname", [("core", "core/index")]))
def page_scan_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.page_files(_tree(spark)).select("docset", "docname")


@query(_values("repo, rel, lane", [("k", "core/src/x.C", "c"), ("k", "core/Kconfig.board", "kconfig"), ("k", "core/b.yaml", "window"), ("k", "core/CMakeLists.txt", "window")]))
def code_scan_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No tests, builds, binaries, large files, files with a NUL, or files outside the scope."""
    return trees.code_files(_tree(spark), [("core", "k")], include_tests=False).select("repo", "rel", F.col("lang").alias("lane"))


@query(_values("id, text", [(1, "caf\ufffd!"), (2, "\u00e9"), (3, "")]))
def decode_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(1, b"caf\xe9!"), (2, "é".encode()), (3, b"")], "id int, content binary").select("id", trees.decode(F.col("content")).alias("text"))


# --- citations of pages, ids, embedding input -------------------------------------------------


@query(_values("docset, docname, source_path", [("core", "core/a", "src/doc/a.rst"), ("boot", "boot/c", "loader/c.md")]))
def match_sources_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a suffix that one file has counts: b.rst and b.md are two."""
    pages = spark.createDataFrame([("core", "core/a"), ("core", "core/b"), ("boot", "boot/c"), ("gone", "gone/a")], "docset string, docname string")
    files = spark.createDataFrame([("src/doc/a.rst",), ("src/doc/b.rst",), ("src/doc/b.md",), ("loader/c.md",), ("loader/a.rst",)], "rel string")
    tops = spark.createDataFrame([("core", "src"), ("boot", "loader")], "docset string, top string")
    return graph.match_sources(pages, files, tops)


@query(_values("file_path, anchor, line", [("a.rst", "one-two", 3), ("a.rst", "three", 5)]))
def label_lines_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame([("a.rst", "one-two"), ("a.rst", "three"), ("a.rst", "four"), ("a.rst", "")], "file_path string, anchor string")
    sources = spark.createDataFrame([("a.rst", "x\r\n\n.. _one_two:\n\n.. _three:\n.. _three:\n")], "rel string, text string")
    return graph.label_lines(sections, sources).select("file_path", "anchor", F.col("line").cast("int").alias("line"))


@query(_values("kind, input", [("rst", "Title\n\nSee words and CONFIG_X now."), ("code", "int a;\n\nx"), ("html", " as  it is")]))
def embed_input_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [("rst", ".. _a:\n\nTitle\n=====\n\nSee :ref:`words <a>` and ``CONFIG_X`` **now**.\n"), ("code", "/* SPDX: z */\nint a;  \n\n\n\nx\n"), ("html", " as  it is")]
    return spark.createDataFrame(texts, "kind string, text string").select("kind", tx.embed_input(F.col("kind"), F.col("text")).alias("input"))


@query(_values("id, own, federated, cited", [(7, "7", "docs:7", "p#a"), (8, "8", "docs:8", "q:1-2")]))
def ids_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("docs", 7, "p", "a", 1, 2), ("docs", 8, "q", None, 1, 2)], "corpus string, id int, path string, anchor string, low int, high int")
    corpus, local = F.col("corpus"), F.col("id")
    return rows.select("id", tx.id_text(corpus, local, False).alias("own"), tx.id_text(corpus, local, True).alias("federated"), tx.citation(F.col("path"), F.col("anchor"), F.col("low"), F.col("high")).alias("cited"))


@query(f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(substr(text, 1, {tx.EMBED_CHARS})), '[^\\s]+')) AS w FROM documents),
places AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM words),
sums AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM places GROUP BY ALL HAVING n <> 0)
SELECT doc_id AS id, 64 AS dim, coalesce(string_agg(CASE WHEN n > 0 THEN '+' ELSE '-' END || i, ' ' ORDER BY i), '') AS signs, CAST(count(i) > 0 AS INT) AS length
FROM documents LEFT JOIN sums USING (doc_id) GROUP BY doc_id
""")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plug-in with the hashing stand-in: the size of every text's vector, the signs of its components that aren't 0, and its length."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, tx.EMBED_CHARS).alias("text"))
    vectors = embed.embed_texts(texts, embed.HashingEmbedder)
    signs = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, F.concat(F.lit("+"), i)).when(x < 0, F.concat(F.lit("-"), i))), lambda s: s.isNotNull())
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return vectors.select("id", F.size("embedding").alias("dim"), F.array_join(signs, " ").alias("signs"), F.round(F.sqrt(squares)).cast("int").alias("length"))

"""Builds of small trees, the store, federation and the query calls, end to end."""

import pytest
from pyspark.sql import functions as F

from shardlore.operators import graph
from shardlore.operators.embed import HashingEmbedder, embed_texts
from shardlore.plans import build, search
from shardlore.sources import store, trees
from shardlore.streaming.ingest import prose_stream, write_sections

RST_A = ".. _alpha_label:\n\nAlpha\n=====\n\nSee :ref:`beta_label`, :doc:`b` and :option:`CONFIG_FAST`.\n"
RST_B = ".. _beta_label:\n\nBeta\n====\n\nBack to :ref:`alpha_label`, :ref:`missing`.\n\nPart\n----\n\nsecond part\n"
CODE = "/* Copyright */\n#define LIMIT 3\n\n/** Starts. */\nint start_engine(void)\n{\n\treturn LIMIT;\n}\n"
PAGE = '<body><div role="main"><div class="section" id="alpha-label"><h1>Alpha</h1><p>Rendered <a class="reference" href="b.html#beta-label">b</a></p></div></div></body>'
PAGE_B = '<body><div role="main"><div class="section" id="beta-label"><h1>Beta</h1><p>Page <a class="reference" href="a.html">a</a></p></div></div></body>'


def put(root, files):
    for rel, body in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return f"file://{root}"


@pytest.fixture(scope="module")
def clone(tmp_path_factory):
    root = tmp_path_factory.mktemp("clone tree+1")
    return put(root, {
        "core/doc/a.rst": RST_A, "core/doc/b.rst": RST_B, "core/src/engine.c": CODE, "core/Kconfig": 'config FAST\n\tbool "Be fast"\n', "core/tests/t.c": "int t;\n", "core/build/gen.c": "int g;\n",
        "fork/x.c": "int x;\n", "core/blob.c": b"int a;\x00", "core/huge.h": b"/" * 1_500_001, "core/bad.c": b"int caf\xe9;\n", "core/lib.a": b"x", "core/notes.txt": "no lane", "core/_build/z.rst": "Z\n=\n", "core/doc/readme.md": "# Read me\ntext\n",
    })


SCOPE = [("core", "core"), ("absent", "absent")]


def test_scans(spark, clone):
    files = trees.tree(spark, clone)
    code = {r.rel: (r.repo, r.lang) for r in trees.code_files(files, SCOPE).select("rel", "repo", "lang").collect()}
    assert code == {"core/src/engine.c": ("core", "c"), "core/Kconfig": ("core", "kconfig"), "core/tests/t.c": ("core", "c"), "core/bad.c": ("core", "c")}
    assert "core/tests/t.c" not in {r.rel for r in trees.code_files(files, SCOPE, include_tests=False).collect()}
    assert [r.rel for r in trees.doc_files(files).orderBy("file_key").collect()] == ["core/doc/a.rst", "core/doc/b.rst", "core/doc/readme.md"]
    bad = files.filter(F.col("rel") == "core/bad.c").select(trees.decode(F.col("content")).alias("t")).first().t
    assert bad == "int caf�;\n"


def test_prose_links(spark, clone):
    built = build.build_prose(spark, clone)
    sections = {r.id: r for r in built.sections.collect()}
    assert sorted(sections) == [1, 2, 3, 4] and sections[1].file_path == "core/doc/a.rst" and sections[3].breadcrumb == "Beta > Part"
    links = {(r.src_id, r.kind, r.target_raw): r.resolved_id for r in built.links.collect()}
    assert links == {(1, "ref", "beta_label"): 2, (1, "doc", "b"): 2, (1, "option", "CONFIG_FAST"): None, (2, "ref", "alpha_label"): 1, (2, "ref", "missing"): None}


def test_source_merge(spark, clone):
    built = build.build_source(spark, clone, SCOPE, include_tests=False)
    rows = built.sections.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    assert [r.source_kind for r in rows] == ["rst"] * 4 + ["code"] * (len(rows) - 4)
    assert {"CONFIG_FAST", "LIMIT", "start_engine"} <= {r.anchor for r in rows}
    assert built.inputs.count() == len(rows) and "Copyright" not in " ".join(r.text for r in built.inputs.collect())
    whole = build.build_code(spark, clone, SCOPE, granularity="file").sections.collect()
    assert len(whole) == 4 and all(r.anchor == "" for r in whole)


def test_pages(spark, clone, tmp_path):
    html = put(tmp_path, {"core/a.html": PAGE, "core/b.html": PAGE_B, "gen/c.html": "<body><p>Generated</p></body>", "core/_static/x.html": "<p>no</p>", "core/search.html": "<p>no</p>"})
    built = build.build_pages(spark, html, clone, {"core": "core"})
    rows = {r.docname: r for r in built.sections.collect()}
    assert (rows["core/a"].file_path, rows["core/a"].line_start) == ("core/doc/a.rst", 1)  # alpha-label is .. _alpha_label:
    assert (rows["gen/c"].file_path, rows["gen/c"].line_start) == ("gen/c.html", 0)
    assert {(r.kind, r.target_raw, r.resolved_id is not None) for r in built.links.collect()} == {("ref", "core/b#beta-label", True), ("ref", "core/a", True)}
    assert built.notes == {"mapped_pages": "2"}


@pytest.fixture(scope="module")
def catalog(spark, clone, tmp_path_factory):
    root = tmp_path_factory.mktemp("indexes")
    docs, code = f"file://{root}/kb-docs", f"file://{root}/kb-code"
    build.save(build.build_prose(spark, clone), docs, "docs", "rst", clone)
    build.save(build.build_source(spark, clone, SCOPE, include_tests=False), code, "code", "source", clone)
    with pytest.warns(UserWarning, match="skipping"):
        return store.Catalog.open(spark, [docs, f"file://{root}/kb-gone", code])


def test_federated_search(spark, catalog):
    assert catalog.names == ["docs", "code"] and catalog.federated
    found = search.search_docs(spark, catalog, "start_engine", mode="keyword")
    assert found["results"][0]["anchor"] == "start_engine" and found["results"][0]["id"].startswith("code:") and found["results"][0]["source_kind"] == "code"
    assert search.search_docs(spark, catalog, "CONFIG_FA*", mode="keyword", source=["code"])["results"][0]["anchor"] == "CONFIG_FAST"
    assert all(r["source_kind"] == "rst" for r in search.search_docs(spark, catalog, "alpha beta", source=["rst"])["results"])
    both = search.search_docs(spark, catalog, "second part", k=3)
    assert both["count"] == 3 and both["results"][0]["header"] == "Part" and both["results"][0]["snippet"].startswith("Part")
    assert search.search_docs(spark, catalog, "OR*", mode="keyword")["count"] == 0
    with pytest.raises(ValueError):
        search.search_docs(spark, catalog, "x", mode="other")


def test_points(spark, catalog):
    assert search.get_section(catalog, "docs:1")["text"].startswith(".. _alpha_label:")
    assert search.get_section(catalog, 2)["id"] == "docs:2"  # bare ids go to the first corpus
    assert "error" in search.get_section(catalog, "docs:99") and "error" in search.get_section(catalog, "nope:1") and "error" in search.get_section(catalog, "x")
    doc = search.get_doc(spark, catalog, "core\\doc\\a.rst")
    assert (doc["corpus"], doc["lines"], doc["text"]) == ("docs", RST_A.count("\n") + 1, RST_A)
    for path in ("../../etc/passwd", "/etc/passwd", "core/absent.rst"):
        assert "error" in search.get_doc(spark, catalog, path)
    assert "error" in search.get_doc(spark, catalog, "a", corpus="nope")


def test_related(catalog):
    near = search.related(catalog, "docs:1")
    assert [x["id"] for x in near["outgoing"]] == ["docs:2", "docs:2"] and [x["id"] for x in near["incoming"]] == ["docs:2"]
    assert [x["target"] for x in near["unresolved"]] == ["CONFIG_FAST"]
    assert len(search.related(catalog, "docs:1", limit=1)["outgoing"]) == 1 and "error" in search.related(catalog, "nope:1")


def test_meta_and_single_index(spark, catalog, tmp_path):
    corpus = catalog.corpora["code"]
    meta = corpus.tables["meta"]
    assert store.read_meta(meta, "link_count") == "5" and store.read_meta(meta, "source_kinds").startswith("code:") and store.read_meta(meta, "x", "d") == "d"
    path = f"file://{tmp_path}/meta"
    store.write_meta(spark, path, {"a": "1", "b": "2"})
    store.write_meta(spark, path, {"b": "3", "c": "4"})
    assert {r.key: r.value for r in spark.read.parquet(path).collect()} == {"a": "1", "b": "3", "c": "4"}
    alone = store.Catalog([catalog.corpora["docs"]])
    assert search.search_docs(spark, alone, "alpha", mode="keyword")["results"][0]["id"].isdigit()


def test_old_index_without_kinds(catalog):
    old = catalog.corpora["docs"]
    plain = store.Corpus("old", old.path, old.docs_root, "html", False, "", {**old.tables, "sections": old.tables["sections"].drop("source_kind")})
    assert {r.source_kind for r in plain.sections().collect()} == {"html"}


def test_names():
    assert store.corpus_name("file:///x/kb-docs.parquet", set()) == "docs" and store.corpus_name("/x/kb-docs", {"docs"}) == "kb-docs" and store.corpus_name("/x/plain", set()) == "plain"


def test_embedding_keeps_ids_and_checks_dim(spark, tmp_path):
    texts = spark.createDataFrame([(k, "word " * (50 - k)) for k in range(50)] + [(99, None)], "id long, text string")
    out = {r.id: r.embedding for r in embed_texts(texts, HashingEmbedder).collect()}
    assert len(out) == 51 and all(len(v) == 64 for v in out.values())


def test_neighbour_lists_are_cut_per_direction(spark):
    links = spark.createDataFrame([(1, "ref", f"t{k}", 2 if k % 2 else None, k) for k in range(50)] + [(3, "ref", "x", 99, 100)], "src_id long, kind string, target_raw string, resolved_id long, edge long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = graph.related(links, nodes, nodes, 20).collect()
    assert len([r for r in rows if r.asked_id == 1]) == 40 and not [r for r in rows if r.asked_id == 3]  # 99 is no section


def test_stream(spark, clone, tmp_path):
    folder = clone + "/core/doc"
    write_sections(prose_stream(spark, folder), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


def test_command_line(spark, clone, tmp_path, capsys):
    out = f"file://{tmp_path}/cli-docs"
    with pytest.raises(SystemExit):
        build.main(["--format", "source", "--out", out])
    build.main(["--format", "rst", "--docs", clone, "--out", out])
    search.main([out, "--query", "beta", "--mode", "keyword"])
    assert '"Beta"' in capsys.readouterr().out
    with pytest.raises(SystemExit), pytest.warns(UserWarning):
        search.main([f"file://{tmp_path}/none", "--query", "x"])


def test_neighbours_of_many_queries_go_by_blocks(spark):
    import numpy as np

    from shardlore.operators import knn

    rng = np.random.default_rng(6)
    rows = [("ab"[k % 2], k, [float(x) for x in rng.normal(0, 1, 5)]) for k in range(90)] + [("a", 500, None)]
    vectors = spark.createDataFrame(rows, "corpus string, id long, embedding array<float>")
    queries = vectors.selectExpr("id AS qid", "embedding")
    few, many = (sorted(map(tuple, knn.nearest_batch(vectors, queries, 7, block).collect())) for block in (2048, 20))
    assert few == many and len(few) == 90 * 2 * 7
    assert knn.nearest_batch(vectors, queries.limit(0)).count() == 0


def test_related_has_one_order_for_edges_of_one_number(spark):
    nodes = spark.createDataFrame([(1,)], "id long")
    rows = [(1, "ref", f"t{k:02d}", None, 7) for k in range(30)]
    for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
        links = spark.createDataFrame(order, "src_id long, kind string, target_raw string, resolved_id long, edge long").coalesce(1)
        got = graph.related(links, nodes, nodes, 20).orderBy("pos").collect()
        assert [r.target_raw for r in got] == [f"t{k:02d}" for k in range(20)]


def test_texts_of_one_length_are_dealt(spark):
    # many texts are cut to the same length: they may not all go to one task
    texts = spark.range(4000).select("id", F.lit("word " * 20).alias("text"))
    out = embed_texts(texts, HashingEmbedder).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2500


def test_parsed_in_small_pieces():
    # what a worker holds is bounded by a few files, not by an Arrow batch
    import pyarrow as pa

    from shardlore.operators import parsing

    class Files:
        def mapInArrow(self, run, kind):
            return run

    run = parsing._parsed(Files(), lambda f: iter([([f.rel], 0, "r", f.rel, "", "", "", 1, 1, "t", [], [], "", "rst", False)]))
    batch = pa.RecordBatch.from_pydict({"rel": [f"f{k}" for k in range(1000)]})
    made = list(run(iter([batch])))
    assert max(b.num_rows for b in made) <= 64 and sum((b.column("file_path").to_pylist() for b in made), []) == [f"f{k}" for k in range(1000)]

"""The query calls over a catalog: search, one section, one document, neighbours.

``search`` takes a table of queries, so a batch costs one plan; the wrappers
that answer one question return plain dictionaries.
"""

from __future__ import annotations

import argparse
import json
import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import citation, id_text, parse_id, snippet
from ..operators import bm25, fusion, graph, knn
from ..operators.embed import Embedder, HashingEmbedder, embed_query
from ..sources.store import Catalog
from ..sources.trees import decode

MODES = ("hybrid", "keyword", "semantic")
COLUMNS = ("corpus", "source_kind", "repo", "file_path", "anchor", "breadcrumb", "header", "line_start", "line_end")


def result_columns(federated: bool, full: bool = False) -> list:
    body = F.col("text") if full else snippet(F.col("text")).alias("snippet")
    cited = citation(F.col("file_path"), F.col("anchor"), F.col("line_start"), F.col("line_end")).alias("citation")
    return [id_text(F.col("corpus"), F.col("id"), federated).alias("id"), *map(F.col, COLUMNS), cited, body]


def search(catalog: Catalog, queries: DataFrame, k: int = 8, mode: str = "hybrid", source: list[str] | None = None) -> DataFrame:
    """queries (qid, query[, embedding]) -> (qid, place, id, ..., citation, snippet).

    Each corpus gives its best 50 by BM25, by cosine, or both; the kind filter
    runs on those, then all lists are fused.  Text is fetched after the cut.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    sections = catalog.union("sections")
    order = F.create_map(*[F.lit(x) for i, name in enumerate(catalog.names) for x in (name, 2 * i)])
    lists = []
    if mode != "semantic":
        lists.append((bm25.bm25(queries, catalog.union("postings"), catalog.union("stats")), 0))
    if mode != "keyword":
        lists.append((knn.nearest_batch(catalog.union("vectors"), queries), 1))
    ranked = None
    for one, place in lists:
        one = fusion.keep_kinds(one.select("qid", "corpus", "id", "rank"), sections, source).withColumn("list", order[F.col("corpus")] + place)
        ranked = one if ranked is None else ranked.unionByName(one)
    best = fusion.fuse_ranked(ranked, k)
    found = sections.join(best, ["corpus", "id"])
    return found.select("qid", "place", "rrf", *result_columns(catalog.federated)).orderBy("qid", "place")


def search_docs(spark: SparkSession, catalog: Catalog, query: str, k: int = 8, mode: str = "hybrid", source: list[str] | None = None, embedder: Callable[[], Embedder] = HashingEmbedder) -> dict:
    vector = embed_query(query, embedder) if mode != "keyword" else None
    asked = spark.createDataFrame([(0, query, vector)], "qid long, query string, embedding array<float>")
    rows = [{c: r[c] for c in r.asDict() if c not in ("qid", "place", "rrf")} for r in search(catalog, asked, k, mode, source).collect()]  # at most 50
    return {"query": query, "mode": mode, "count": len(rows), "results": rows}


def get_section(catalog: Catalog, raw_id: str | int) -> dict:
    try:
        corpus, local = parse_id(raw_id, catalog.names)
    except (KeyError, ValueError):
        return {"error": f"unknown id {raw_id}"}
    found = catalog.corpora[corpus].sections().filter(F.col("id") == local).select(*result_columns(catalog.federated, full=True)).first()
    return found.asDict() if found else {"error": f"no section {raw_id}"}


def get_doc(spark: SparkSession, catalog: Catalog, path: str, corpus: str | None = None) -> dict:
    """A file below a corpus' docs root, from the first corpus that has it; paths that leave the root are refused."""
    path = path.replace("\\", "/")
    if corpus is not None and corpus not in catalog.corpora:
        return {"error": f"unknown corpus {corpus}"}
    error = f"no file {path}"
    for name in [corpus] if corpus else catalog.names:
        root = catalog.corpora[name].docs_root
        full = posixpath.normpath(posixpath.join(root, path))
        if not full.startswith(root.rstrip("/") + "/"):
            error = f"{path} is outside the docs root"
            continue
        try:
            row = spark.read.format("binaryFile").load(full.replace("[", "\\[").replace("{", "\\{")).select(decode(F.col("content")).alias("text")).first()
        except Exception as problem:  # noqa: BLE001 - a missing file is an answer, not a failure
            if "PATH_NOT_FOUND" not in str(problem) and "does not exist" not in str(problem):
                raise
            row = None
        if row:
            return {"path": path, "corpus": name, "lines": row["text"].count("\n") + 1, "text": row["text"]}
    return {"error": error}


def related(catalog: Catalog, raw_id: str | int, limit: int = 20) -> dict:
    try:
        name, local = parse_id(raw_id, catalog.names)
    except (KeyError, ValueError):
        return {"error": f"unknown id {raw_id}"}
    corpus = catalog.corpora[name]
    asked = corpus.sections().filter(F.col("id") == local).select("id")
    rows = graph.related(corpus.tables["links"], corpus.sections(), asked, limit).orderBy("direction", "pos").collect()  # at most 3 * limit
    lists: dict[str, list] = {"out": [], "in": [], "unresolved": []}
    for r in rows:
        item = {"kind": r["kind"], "target": r["target_raw"]}
        if r["direction"] != "unresolved":
            item |= {c: r[c] for c in COLUMNS} | {"id": f"{name}:{r['id']}" if catalog.federated else str(r["id"])}
        lists[r["direction"]].append(item)
    return {"id": raw_id, "outgoing": lists["out"], "incoming": lists["in"], "unresolved": lists["unresolved"]}


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(description="Query one or more indexes.")
    cli.add_argument("indexes", nargs="+")
    asked = cli.add_mutually_exclusive_group(required=True)
    asked.add_argument("--query", help="search the indexes")
    asked.add_argument("--section", metavar="ID", help="one section in full")
    asked.add_argument("--doc", metavar="PATH", help="a file below a docs root")
    asked.add_argument("--related", metavar="ID", help="what a section links to, and what links to it")
    cli.add_argument("--corpus", help="the corpus of --doc")
    cli.add_argument("--mode", choices=MODES, default="hybrid")
    cli.add_argument("--source", action="append")
    cli.add_argument("-k", type=int, default=8)
    args = cli.parse_args(argv)
    spark = SparkSession.builder.appName("search").getOrCreate()
    catalog = Catalog.open(spark, args.indexes)
    if not catalog.corpora:
        raise SystemExit("no index could be opened")
    if args.section is not None:
        answer = get_section(catalog, args.section)
    elif args.doc is not None:
        answer = get_doc(spark, catalog, args.doc, args.corpus)
    elif args.related is not None:
        answer = related(catalog, args.related)
    else:
        answer = search_docs(spark, catalog, args.query, args.k, args.mode, args.source)
    print(json.dumps(answer, ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()

"""Index builds: prose, rendered pages, code, or prose and code of one tree.

``python -m shardlore.plans.build --format rst --docs TREE --out INDEX``
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embed_input
from ..operators import graph, parsing
from ..operators.embed import Embedder, HashingEmbedder, embed_texts
from ..sources import trees
from ..sources.store import write_index


@dataclass
class Built:
    """sections (with id), links (src_id, kind, target_raw, resolved_id, edge), inputs (id, text), and notes for the meta table."""

    sections: DataFrame
    links: DataFrame
    inputs: DataFrame
    notes: dict[str, str]


def _edges(links: DataFrame) -> DataFrame:
    """Edges in section-then-position order get one number each, a range of numbers a section."""
    edge = F.col("src_id") * F.lit(1 << 20) + F.col("pos")
    return links.select("src_id", "kind", "target_raw", "resolved_id", edge.cast("long").alias("edge"))


def _built(sections: DataFrame, links: DataFrame, notes: dict[str, str]) -> Built:
    return Built(sections, links, sections.select("id", embed_input(F.col("source_kind"), F.col("text")).alias("text")), notes)


def build_prose(spark: SparkSession, root: str, scope: list[tuple[str, str]] | None = None, include_tests: bool = True) -> Built:
    files = trees.tree(spark, root)
    files = trees.doc_files(files) if scope is None else trees.scoped_doc_files(files, scope, include_tests)
    sections = parsing.number(parsing.parse_prose(files)).persist()
    return _built(sections, _edges(graph.resolve_roles(sections)), {})


def build_pages(spark: SparkSession, root: str, source_root: str | None = None, tops: dict[str, str] | None = None) -> Built:
    """tops maps a docset to the top folder of its sources; pages of others cite themselves."""
    parsed = parsing.parse_pages(trees.page_files(trees.tree(spark, root))).persist()
    mapped = 0
    if source_root and tops:
        table = spark.createDataFrame(list(tops.items()), "docset string, top string")
        sources = trees.source_files(trees.tree(spark, source_root), sorted(set(tops.values())))
        found = graph.match_sources(parsed.select(F.col("repo").alias("docset"), "docname"), sources.select("rel"), table).persist()
        mapped = found.count()
        parsed = parsed.join(found.withColumnRenamed("docset", "repo"), ["repo", "docname"], "left").withColumn("file_path", F.coalesce("source_path", "file_path"))
        texts = sources.join(found.select(F.col("source_path").alias("rel")).distinct(), "rel").select("rel", trees.decode(F.col("content")).alias("text"))
        lines = graph.label_lines(parsed.filter("source_path is not null"), texts)
        parsed = parsed.join(lines, ["file_path", "anchor"], "left")
        line = F.when(F.col("source_path").isNotNull(), F.coalesce("line", F.lit(0))).otherwise(0).cast("int")
        parsed = parsed.withColumn("line_start", line).withColumn("line_end", line).drop("line", "source_path")
    sections = parsing.number(parsed).persist()
    anchors, docs = graph.page_maps(sections)
    edges = sections.select(F.col("id").alias("src_id"), F.posexplode("raw_links").alias("pos", "target_raw"), F.lit("ref").alias("kind"))
    return _built(sections, _edges(graph.resolve_pages(edges, anchors, docs)), {"mapped_pages": str(mapped)})


def build_code(spark: SparkSession, root: str, scope: list[tuple[str, str]], include_tests: bool = True, granularity: str = "symbol", skip: tuple[str, ...] = trees.CODE_SKIP) -> Built:
    files = trees.code_files(trees.tree(spark, root), scope, include_tests, skip)
    sections = parsing.number(parsing.parse_code(files, granularity)).persist()
    fallen = sections.filter("fell_back").select("file_key").distinct().count()
    none = spark.createDataFrame([], "src_id long, kind string, target_raw string, resolved_id long, edge long")
    return _built(sections, none, {"fallback_files": str(fallen), "code_scope": ",".join(f"{d}:{n}" for d, n in scope)})


def build_source(spark: SparkSession, root: str, scope: list[tuple[str, str]], include_tests: bool = True, granularity: str = "symbol") -> Built:
    """Prose and code of one tree; the ids of code go on after those of prose."""
    prose = build_prose(spark, root, scope, include_tests)
    code = build_code(spark, root, scope, include_tests, granularity)
    n = prose.sections.count()
    moved = code.links.withColumn("src_id", F.col("src_id") + n).withColumn("resolved_id", F.col("resolved_id") + n).withColumn("edge", F.col("edge") + n * (1 << 20))
    sections = parsing.offset_union(prose.sections, code.sections)
    inputs = prose.inputs.unionByName(code.inputs.withColumn("id", F.col("id") + n))
    return Built(sections, prose.links.unionByName(moved), inputs, code.notes)


def save(built: Built, path: str, corpus: str, source_format: str, docs_root: str, embedder: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing") -> None:
    vectors = embed_texts(built.inputs, embedder)
    meta = {"source_format": source_format, "docs_root_relative": docs_root, "embed_model": model, **built.notes}
    write_index(path, corpus, built.sections, built.links, vectors, meta, embedder().dim)


def _pairs(text: str) -> tuple[str, str]:
    left, mark, right = text.partition("=")
    return (left, right) if mark else (left, left.rsplit("/", 1)[-1])


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(description="Build a search index of a document or source tree.")
    cli.add_argument("--format", choices=("rst", "html", "source"), default="rst")
    cli.add_argument("--docs", help="root of the prose or page tree")
    cli.add_argument("--source-root", help="tree that rendered pages are cited from")
    cli.add_argument("--code-root", help="tree of prose and code, for --format source; --docs is used without it")
    cli.add_argument("--scope", type=_pairs, action="append", default=[], metavar="DIR[=LABEL]", help="directories to index, for --format source")
    cli.add_argument("--top", type=_pairs, action="append", default=[], metavar="DOCSET=FOLDER", help="source folder of a docset, for --format html")
    cli.add_argument("--no-tests", action="store_true")
    cli.add_argument("--code-granularity", choices=("symbol", "file"), default="symbol")
    cli.add_argument("--threads", type=int, help="cores of a local session")
    cli.add_argument("--corpus", default="docs")
    cli.add_argument("--out", required=True)
    args = cli.parse_args(argv)
    builder = SparkSession.builder.appName("index build")
    spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    root = args.docs
    if args.format == "source":
        root = args.code_root or args.docs
    if not root or args.format == "html" and not args.source_root or args.format == "source" and not args.scope:
        cli.error("--docs is needed, --source-root for html, and --scope for source")
    if args.format == "rst":
        built = build_prose(spark, root)
    elif args.format == "html":
        built, root = build_pages(spark, root, args.source_root, dict(args.top)), args.source_root
    else:
        built = build_source(spark, root, args.scope, not args.no_tests, args.code_granularity)
    save(built, args.out, args.corpus, args.format, root)


if __name__ == "__main__":
    main()

"""The cross-reference graph: building maps, resolving targets, neighbours.

Suffix matches are equi-joins: each key is exploded into its suffixes at ``/``
boundaries (a path has a few), and a suffix resolves only if exactly one key
has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_suffix, join_path, normal_path, parent, role_links


def anchor_map(sections: DataFrame) -> DataFrame:
    """(anchor, id): the first section that has it."""
    return sections.select("id", F.explode("all_anchors").alias("anchor")).groupBy("anchor").agg(F.min("id").alias("id"))


def doc_map(sections: DataFrame) -> DataFrame:
    """(doc, id): the first section of each file, by path without suffix."""
    return sections.groupBy(drop_suffix(F.col("file_path")).alias("doc")).agg(F.min("id").alias("id"))


def suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def unique_suffixes(keys: DataFrame, key: str, value: str, within: list[str] | None = None) -> DataFrame:
    """(suffix, value, *within): suffixes that exactly one key has."""
    within = within or []
    rows = keys.select(*within, F.col(value), F.explode(suffixes(F.col(key))).alias("suffix"))
    return rows.groupBy(*within, "suffix").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")


def role_edges(sections: DataFrame) -> DataFrame:
    """(src_id, src_path, kind, target_raw, pos) of each section's roles."""
    return sections.select(F.col("id").alias("src_id"), F.col("file_path").alias("src_path"), F.posexplode_outer(role_links(F.col("text"))).alias("pos", "l")).filter("l is not null").select("src_id", "src_path", "pos", "l.kind", F.col("l.target").alias("target_raw"))


def doc_candidates(target: Column, source: Column) -> Column:
    """Paths that a doc target may mean, in order."""
    target = F.trim(target)
    bare = F.ltrim(target, F.lit("/"))
    rooted = F.array(bare, F.concat(F.substring_index(source, "/", 1), F.lit("/"), bare))
    relative = F.array(normal_path(join_path(parent(source), target)), target)
    return F.when(target.contains(":"), F.array().cast("array<string>")).when(F.startswith(target, F.lit("/")), rooted).otherwise(relative)


def resolve_docs(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """edges (src_id, src_path, target_raw, ...) with resolved_id: the first candidate that exists, else the only doc with that suffix."""
    keyed = edges.withColumn("edge_key", F.struct("src_path", "target_raw"))
    wanted = keyed.select("edge_key").distinct()
    tried = wanted.select("edge_key", F.posexplode(doc_candidates(F.col("edge_key.target_raw"), F.col("edge_key.src_path"))).alias("n", "doc"))
    direct = tried.join(docs, "doc").groupBy("edge_key").agg(F.min_by("id", "n").alias("direct_id"))
    tail = F.ltrim(F.trim(F.col("edge_key.target_raw")), F.lit("/"))
    by_tail = wanted.filter(~F.col("edge_key.target_raw").contains(":")).select("edge_key", tail.alias("suffix"))
    last = by_tail.join(unique_suffixes(docs, "doc", "id"), "suffix").select("edge_key", F.col("id").alias("suffix_id"))
    out = keyed.join(direct, "edge_key", "left").join(last, "edge_key", "left")
    return out.withColumn("resolved_id", F.coalesce("direct_id", "suffix_id")).drop("direct_id", "suffix_id", "edge_key")


def resolve_roles(sections: DataFrame) -> DataFrame:
    """Edges of prose sections: refs by label, docs by path, options and files unresolved."""
    edges = role_edges(sections)
    labels = anchor_map(sections)
    refs = edges.filter("kind = 'ref'").join(labels, F.col("target_raw") == F.col("anchor"), "left").select("src_id", "pos", "kind", "target_raw", F.col("id").alias("resolved_id"))
    docs = resolve_docs(edges.filter("kind = 'doc'"), doc_map(sections)).select("src_id", "pos", "kind", "target_raw", "resolved_id")
    rest = edges.filter("kind not in ('ref', 'doc')").select("src_id", "pos", "kind", "target_raw", F.lit(None).cast("long").alias("resolved_id"))
    return refs.unionByName(docs).unionByName(rest)


def page_maps(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, id) of ``page#fragment`` and bare fragments, and (docname, id) of pages; first section wins."""
    anchors = sections.select("id", "docname", F.explode("all_anchors").alias("a"))
    both = anchors.select("id", F.concat_ws("#", "docname", "a").alias("target")).union(anchors.select("id", F.col("a").alias("target")))
    return both.groupBy("target").agg(F.min("id").alias("id")), sections.filter("docname <> ''").groupBy("docname").agg(F.min("id").alias("id"))


def resolve_pages(edges: DataFrame, anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """edges (src_id, pos, target_raw) with resolved_id: exact fragment, else the fragment on any page; without one, the page."""
    fragment = F.when(F.col("target_raw").contains("#"), F.regexp_extract("target_raw", "#(.*)$", 1)).otherwise("")
    page = F.substring_index("target_raw", "#", 1)
    rows = edges.withColumn("fragment", fragment).withColumn("page", page)
    exact = anchors.select(F.col("target").alias("t1"), F.col("id").alias("exact_id"))
    loose = anchors.select(F.col("target").alias("t2"), F.col("id").alias("loose_id"))
    whole = docs.select(F.col("docname").alias("t3"), F.col("id").alias("page_id"))
    named = F.col("fragment") != ""
    rows = rows.join(exact, named & (F.col("target_raw") == F.col("t1")), "left").join(loose, named & (F.col("fragment") == F.col("t2")), "left")
    rows = rows.join(whole, ~named & (F.col("page") == F.col("t3")), "left")
    return rows.withColumn("resolved_id", F.coalesce("exact_id", "loose_id", "page_id")).drop("fragment", "page", "t1", "t2", "t3", "exact_id", "loose_id", "page_id")


def match_sources(pages: DataFrame, files: DataFrame, tops: DataFrame) -> DataFrame:
    """(docset, docname, source_path): the only source file below the docset's folder whose path ends in the page's.

    tops: (docset, top), one row a docset; files: (rel) of prose sources.
    """
    sources = files.select(F.substring_index("rel", "/", 1).alias("top"), drop_suffix(F.col("rel")).alias("bare"), "rel")
    unique = unique_suffixes(sources, "bare", "rel", ["top"])
    tail = F.when(F.col("docname").contains("/"), F.regexp_replace("docname", "^[^/]*/", "")).otherwise(F.col("docname"))
    asked = pages.select("docset", "docname").distinct().withColumn("suffix", tail).join(F.broadcast(tops), "docset")  # tops: one row a docset
    return asked.join(unique, ["top", "suffix"]).select("docset", "docname", F.col("rel").alias("source_path"))


def label_lines(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_path, anchor, line): the first line that defines the label, with - and _ alike. sources: (rel, text)."""
    lines = sources.select(F.col("rel").alias("file_path"), F.posexplode_outer(F.split("text", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")).alias("n", "line"))
    labels = lines.select("file_path", (F.col("n") + 1).alias("n"), F.regexp_extract("line", r"^\.\.\s+_(.+):\s*$", 1).alias("label")).filter("label <> ''")
    asked = sections.filter("anchor <> ''").select("file_path", "anchor").distinct()
    forms = asked.select("file_path", "anchor", F.explode(F.array_distinct(F.array("anchor", F.translate("anchor", "-", "_"), F.translate("anchor", "_", "-")))).alias("label"))
    return forms.join(labels, ["file_path", "label"]).groupBy("file_path", "anchor").agg(F.min("n").alias("line"))


def related(links: DataFrame, sections: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """(asked_id, direction, pos, kind, target_raw, id, ...section columns) of each asked section's neighbours.

    direction: out (resolved), in, or unresolved; each list has its first ``limit`` edges, by edge number.
    """
    near = asked.select(F.col("id").alias("asked_id")).distinct()
    out = links.join(near, links["src_id"] == near["asked_id"])
    into = links.filter("resolved_id is not null").join(near, F.col("resolved_id") == F.col("asked_id"))
    rows = out.filter("resolved_id is not null").select("asked_id", F.lit("out").alias("direction"), "edge", "kind", "target_raw", F.col("resolved_id").alias("other"))
    rows = rows.union(into.select("asked_id", F.lit("in").alias("direction"), "edge", "kind", "target_raw", F.col("src_id").alias("other")))
    rows = rows.union(out.filter("resolved_id is null").select("asked_id", F.lit("unresolved").alias("direction"), "edge", "kind", "target_raw", F.lit(None).cast("long").alias("other")))
    pos = F.row_number().over(Window.partitionBy("asked_id", "direction").orderBy("edge", "target_raw", "other"))  # a total order, should edges share a number
    rows = rows.withColumn("pos", pos).filter(F.col("pos") <= limit).drop("edge")
    known = sections.select(F.col("id").alias("sid"), *[c for c in sections.columns if c not in ("id", "text", "kind")])
    rows = rows.join(known, F.col("other") == F.col("sid"), "left")
    return rows.filter((F.col("direction") == "unresolved") | F.col("sid").isNotNull()).drop("sid").withColumnRenamed("other", "id")

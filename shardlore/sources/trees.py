"""Scans of document and source trees with Spark's binaryFile reader.

Paths are listed by Spark, so a tree may lie in any store it can read.  Only
``path`` and ``length`` are read until a text is needed; ``content`` is decoded
with malformed bytes replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that are left out, suffixes by kind, and size limits.
DOC_SKIP = ("_build", "_doxygen", ".git", "__pycache__")
PAGE_SKIP = ("_static", "_sources", "_images", "_downloads", "__pycache__")
PAGE_SKIP_NAMES = ("genindex.html", "search.html", "py-modindex.html", "objects.inv")
SOURCE_SKIP = ("__pycache__", "build", "_doxygen", "_build", ".git")
CODE_SKIP = (".git", ".github", "_build", "_doxygen", "build", "__pycache__")
#: Suffixes that never hold searchable text.
BINARY = tuple("7z a bin bmp bz2 d dll dylib elf eot exe gif gz hex ico img jar jpeg jpg lib map o obj out pdf png pyc pyd so svg tar tgz ttf webp woff woff2 xz zip".split())
C_LIKE = ("c", "cc", "cpp", "cppm", "cxx", "h", "hpp", "hxx")
WINDOWED = ("asm", "cmake", "conf", "dts", "dtsi", "ld", "overlay", "s", "yaml", "yml")
MAX_BYTES, PROBE_BYTES = 1_500_000, 8192


def relative(root: str) -> Column:
    """The reader's path column, relative to root."""
    base = re.sub("^[a-z0-9]+:/*|^/+", "", root.rstrip("/"))
    return F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), len(base) + 2, 1 << 30)


def tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, rel, length, content) of all files below root; rel is relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root)
    return files.select("path", relative(root).alias("rel"), "length", "content")


def decode(content: Column) -> Column:
    """UTF-8 with malformed bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def parts(rel: Column) -> Column:
    """Path parts: arrays sort part by part, as paths do."""
    return F.split(rel, "/")


def _clear(rel: Column, skip: tuple[str, ...]) -> Column:
    return ~F.arrays_overlap(parts(rel), F.array(*[F.lit(s) for s in skip]))


def suffix_of(rel: Column) -> Column:
    return F.lower(F.regexp_extract(rel, r"[^/]\.([^./]+)$", 1))


def doc_files(files: DataFrame) -> DataFrame:
    """(file_key, repo, rel, content) of prose below a tree; the repo is the first path part."""
    kept = files.filter(suffix_of(F.col("rel")).isin("rst", "md") & _clear(F.col("rel"), DOC_SKIP))
    return kept.select(parts(F.col("rel")).alias("file_key"), parts(F.col("rel"))[0].alias("repo"), "rel", "content")


def in_scope(files: DataFrame, scope: list[tuple[str, str]], skip: tuple[str, ...], include_tests: bool = True) -> DataFrame:
    """Files below the (directory, label) pairs, labelled, in the order of the pairs; a file in two pairs is two rows."""
    spark = files.sparkSession
    table = spark.createDataFrame([(f"{k:06d}", d.strip("/") + "/", label) for k, (d, label) in enumerate(scope)], "place string, dir string, repo string")
    # the scope is a handful of directories given by the caller
    found = files.join(F.broadcast(table), F.expr("startswith(rel, dir)")).withColumn("below", F.expr("substr(rel, length(dir) + 1)"))
    dirs = F.expr("slice(split(below, '/'), 1, size(split(below, '/')) - 1)")
    banned = [*skip, *([] if include_tests else ["tests"])]
    found = found.filter(~F.arrays_overlap(dirs, F.array(*[F.lit(b) for b in banned])))
    return found.withColumn("file_key", F.concat(F.array("place"), parts(F.col("rel"))))


def scoped_doc_files(files: DataFrame, scope: list[tuple[str, str]], include_tests: bool = True) -> DataFrame:
    kept = in_scope(files.filter(suffix_of(F.col("rel")).isin("rst", "md")), scope, DOC_SKIP, include_tests)
    return kept.select("file_key", "repo", "rel", "content")


def page_files(files: DataFrame) -> DataFrame:
    """(file_key, docset, docname, rel, content) of rendered pages."""
    rel = F.col("rel")
    name = F.element_at(parts(rel), -1)
    kept = files.filter(F.endswith(rel, F.lit(".html")) & ~name.isin(*PAGE_SKIP_NAMES) & _clear(rel, PAGE_SKIP))
    docname = F.regexp_replace(rel, r"\.html$", "")
    return kept.select(parts(rel).alias("file_key"), parts(docname)[0].alias("docset"), docname.alias("docname"), "rel", "content")


def lane(rel: Column) -> Column:
    """kconfig, c or window by file name; null for files that aren't indexed."""
    name, suffix = F.lower(F.element_at(parts(rel), -1)), suffix_of(rel)
    return F.when(F.startswith(name, F.lit("kconfig")), "kconfig").when(suffix.isin(*C_LIKE), "c").when(suffix.isin(*WINDOWED) | (name == "cmakelists.txt"), "window")


def code_files(files: DataFrame, scope: list[tuple[str, str]], include_tests: bool = True, skip: tuple[str, ...] = CODE_SKIP) -> DataFrame:
    """(file_key, repo, rel, lang, content): no binaries, no file over MAX_BYTES or with a NUL in its first PROBE_BYTES."""
    named = files.withColumn("lang", lane(F.col("rel"))).filter(F.col("lang").isNotNull() & ~suffix_of(F.col("rel")).isin(*BINARY) & (F.col("length") <= MAX_BYTES))
    named = in_scope(named, scope, skip, include_tests)
    head = F.substring(F.col("content"), 1, PROBE_BYTES)
    return named.filter(~F.contains(head, F.lit(b"\x00"))).select("file_key", "repo", "rel", "lang", "content")


def source_files(files: DataFrame, tops: list[str]) -> DataFrame:
    """(rel, content) of prose sources below the given top folders."""
    rel = F.col("rel")
    return files.filter(parts(rel)[0].isin(*tops) & suffix_of(rel).isin("rst", "md") & _clear(rel, SOURCE_SKIP)).select("rel", "content")

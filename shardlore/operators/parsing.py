"""Parsers as Spark operators, and ids for what they yield.

One file is one row; the parsers run in mapInArrow batches, ``FILES`` files at a
time, so a file is never split and neither the driver nor a worker holds many.  Ids are 1..N in file-then-section order: a
prefix sum over one row per file, not over the sections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.html_tree import split_html
from ..functions.parse import Section, WINDOW_LINES, WINDOW_OVERLAP, split_code, split_prose
from ..schema import PARSED
from ..sources.scratch import written
from ..sources.trees import decode

#: Files that are parsed at once.
FILES = 64


def _rows(file_key: list[str], sections: list[Section], kind: str, fell_back: bool = False) -> Iterator[tuple]:
    for k, s in enumerate(sections):
        yield list(file_key), k, s.repo, s.file_path, s.anchor, s.breadcrumb, s.header, s.line_start, s.line_end, s.text, s.all_anchors, s.raw_links, s.docname, kind, fell_back


def _parsed(files: DataFrame, parse: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """The rows that parse makes of each file. What is made of a few files is handed on before the next."""
    kind = to_arrow_schema(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, FILES):
                rows = [r for f in batch.slice(k, FILES).to_pandas().itertuples(index=False) for r in parse(f)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return files.mapInArrow(run, PARSED)


def parse_prose(files: DataFrame) -> DataFrame:
    """(file_key, repo, rel, content) -> sections of RST and Markdown."""
    return _parsed(files.select("file_key", "repo", "rel", decode(F.col("content")).alias("text")), lambda f: _rows(f.file_key, split_prose(f.text, f.repo, f.rel), "rst"))


def parse_pages(files: DataFrame) -> DataFrame:
    """(file_key, docset, docname, content) -> sections of rendered pages."""
    return _parsed(files.select("file_key", "docset", "docname", decode(F.col("content")).alias("text")), lambda f: _rows(f.file_key, split_html(f.text or "", f.docset, f.docname), "html"))


def parse_code(files: DataFrame, granularity: str = "symbol") -> DataFrame:
    """(file_key, repo, rel, lang, content) -> sections of code, by symbol or by file."""
    if granularity not in ("symbol", "file"):
        raise ValueError(f"granularity is symbol or file, not {granularity}")

    def parse(f: tuple) -> Iterator[tuple]:
        found, fell_back = split_code(f.text, f.repo, f.rel, "file" if granularity == "file" else f.lang)
        return _rows(f.file_key, found, "code", fell_back and granularity == "symbol")

    return _parsed(files.select("file_key", "repo", "rel", "lang", decode(F.col("content")).alias("text")), parse)


def number(parsed: DataFrame, first: int = 1) -> DataFrame:
    """parsed with contiguous ids in file-then-section order.

    One row a file is range-sorted and written with its range's number; the
    prefix sums are one over the ranges and one within each, so no task sees
    all files.
    """
    sizes = parsed.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.repartitionByRange("file_key").withColumn("range", F.spark_partition_id()), "file-sizes")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("size")).select("range", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy("file_key").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ranges), "range")  # as many rows as shuffles have partitions
    offsets = offsets.select("file_key", (F.col("ahead") + F.col("inside") + first).alias("offset"))
    return parsed.join(offsets, "file_key").withColumn("id", (F.col("offset") + F.col("ord")).cast("long")).drop("offset")


def offset_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two numbered tables; the second's ids go on after the first's."""
    n = first.count()
    return first.unionByName(second.withColumn("id", F.col("id") + F.lit(n)), allowMissingColumns=True)


# --- the line operators as plain SQL, for tables of texts -----------------------


def line_windows(texts: DataFrame, size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """(id, text) -> (id, line_start, line_end, window_text): overlapping windows, the first that reaches the end is the last."""
    step = size - overlap
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = texts.select("id", lines.alias("lines")).withColumn("off", F.explode_outer(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(step))))
    rows = rows.filter((F.col("off") == 0) | (F.col("off") - step + size < F.size("lines")))
    part = F.slice("lines", F.col("off") + 1, F.lit(size))
    rows = rows.select("id", "off", part.alias("part")).filter(F.exists("part", lambda x: F.trim(x) != ""))
    return rows.select("id", (F.col("off") + 1).cast("long").alias("line_start"), (F.col("off") + F.size("part")).cast("long").alias("line_end"), F.array_join("part", "\n").alias("window_text"))


def packed_lines(text: Column, limit: int, target: int) -> Column:
    """Array of (line_start, line_end, body): an oversized text packed greedily by lines, as a fold."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    cost = lambda x: F.greatest(F.lit(1), F.floor(F.char_length(x) / 4)).cast("int") + 1
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("load"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        over = (acc["n"] == 0) | (acc["load"] + cost(line) > target)
        return F.struct(F.when(over, F.concat(acc["cuts"], F.array(acc["n"]))).otherwise(acc["cuts"]).alias("cuts"), F.when(over, cost(line)).otherwise(acc["load"] + cost(line)).alias("load"), (acc["n"] + 1).alias("n"))

    small = F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)) <= limit
    cuts = F.when(small, F.array(F.lit(0))).otherwise(F.aggregate(lines, start, step)["cuts"])
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(F.size(lines)))
    return F.transform(F.arrays_zip(cuts, ends), lambda p: F.struct((p["0"] + 1).cast("long").alias("line_start"), p["1"].cast("long").alias("line_end"), F.array_join(F.slice(lines, p["0"] + 1, p["1"] - p["0"]), "\n").alias("body")))

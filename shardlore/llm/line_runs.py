r"""Line dedup over levelled sorted runs of line hashes.

A *run* is a table ``(h1, h2, n_docs, top_doc)`` in buckets of a 128-bit line
hash, one file a bucket, sorted by the hash: in how many documents of its batch
a line occurs, and the largest id among them.  All runs have the same buckets, so runs
meet batches and each other in merge joins bucket by bucket, without a shuffle.

:meth:`LineRuns.add` takes one batch of documents: its lines meet every run in
a merge join that tells apart those that a run holds.  What no run holds (the
anti-join) becomes a level-0 run of its own, so each line is in exactly one
run.  What some run holds already is a repeat, and goes to the (far smaller)
repeats with the batch's count and largest id.
``fanout`` runs of a level are merged into one of the next, so a store of n
batches keeps O(fanout * log n) runs.  :meth:`LineRuns.repeated` adds the
repeats to the runs' own counts.

:func:`drop_repeated` deals a whole table into batches, adds them one after the
other, and drops each repeated line from all but the largest document.

Line key: the line with ``[\x20\x09-\x0D]`` stripped at both ends and A-Z
lower-cased.  Only keys of ``min_chars`` code points or more are looked at.

Edge cases: a null or empty text is one empty line.  A null doc_id counts as
one document below all others.  Repeated rows of one doc_id are one document
for the counts, and each row is rewritten.  An empty table gives an empty
result.  Extra columns are carried by :func:`drop_repeated` in ``row``, whatever
their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, drop_path, read_table, scratch, staged, staged_path, whole_row

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 6
FANOUT = 2
NO_ID = -(2**63)
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key's 16-byte hash, or None for a key that is too short."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(number, doc, h1, h2) of the lines that can repeat, one row per row of docs and key; number: a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = [], []
            for text in binary_column(batch, "text"):
                found = {h for line in (text or b"").split(b"\n") if (h := line_key(line, min_chars))}
                digests.extend(found)
                sizes.append(len(found))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["number", "doc", "h1", "h2"])

    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc")
    return docs.select(row_number_of(id_col, text_col).alias("number"), ids, F.col(text_col).alias("text")).mapInArrow(run, "number long, doc long, h1 long, h2 long")


def row_number_of(id_col: str, text_col: str) -> F.Column:
    """What a row's drop list is joined by. A collision only adds lines to the lists that the other text doesn't have, but for lines of both."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


class LineRuns:
    """A store of levelled runs in the shared folder, as bucketed tables of the session's catalog; close it to drop them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, max(2, fanout)
        #: As many buckets as shuffles have partitions, so that an aggregation of a batch lands in the runs' buckets.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        #: The newest run, which is merged with others only when the next one comes or at compact().
        self.newest: str | None = None
        self.batches: list[str] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level] + ([self.newest] if self.newest else [])

    def compact(self) -> None:
        """Put the newest run to its level, which merges the level if that is full."""
        if self.newest:
            newest, self.newest = self.newest, None
            self._file(newest, 0)

    def _write(self, run: DataFrame, tag: str, *parts: str) -> str:
        """A bucketed, sorted table of run, whose rows are in their buckets' tasks already."""
        name, path = f"line_runs_{uuid.uuid4().hex}", staged_path(self.spark, tag)
        writer = run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd")
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        self.paths[name] = path
        return name

    def run(self, name: str) -> DataFrame:
        """The rows of a run; those of a batch's table that earlier runs held are left out where they are stored."""
        table = self.spark.table(name)
        return (table.filter("not known") if "known" in table.columns else table).select(*RUN)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)

    def _file(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, *others = self.levels[level]
            self.levels[level] = []
            for other in others:
                old = (merged, other)
                merged = self._write(self.merged(self.run(merged), self.run(other)), f"line-run-l{level + 1}")
                for name in old:
                    if name not in self.batches:  # these also hold repeats
                        self._drop(name)
            self._file(merged, level + 1)

    def merged(self, one: DataFrame, other: DataFrame, how: str = "full") -> DataFrame:
        """Two runs as one, merged bucket by bucket; how: left keeps the lines of the first."""
        right = other.select("h1", "h2", F.col("n_docs").alias("n"), F.col("top_doc").alias("top"))
        both = one.join(right.hint("merge"), ["h1", "h2"], how)
        return both.select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("top_doc", "top").alias("top_doc"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (doc, h1, h2), whose documents are in no other batch. Returns (h1, h2, n_docs, top_doc) of the lines that no earlier batch had."""
        self.compact()
        batch = lines.select("doc", "h1", "h2").dropDuplicates().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("top_doc")).withColumn("known", F.lit(False))
        for name in self.runs():
            held = self.run(name).select("h1", "h2", F.lit(True).alias("held"))
            batch = batch.join(held.hint("merge"), ["h1", "h2"], "left").select(*RUN, (F.col("known") | F.coalesce("held", F.lit(False))).alias("known"))
        self.newest = self._write(batch, "line-batch", "known")
        self.batches.append(self.newest)
        return self.run(self.newest)

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, top_doc) of the lines of at least min_docs documents of all batches, staged."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, top_doc long")
        schema = "h1 long, h2 long, n_docs long, top_doc long, known boolean"
        again = reduce(DataFrame.union, [self.spark.read.schema(schema).parquet(self.paths[name]) for name in self.batches]).filter("known")
        again = self._write(again.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc")), "line-repeats")
        # a line is in one run, so each run is joined alone
        found = [self.merged(self.run(name), self.run(again), "left").filter(F.col("n_docs") >= min_docs).select("h1", "h2", "top_doc") for name in self.runs()]
        out = staged(reduce(DataFrame.union, found), "line-repeated")
        self._drop(again)
        return out


RUN = ("h1", "h2", "n_docs", "top_doc")


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with repeated lines removed, plus n_lines, n_dropped and kept_sha256.

    The text is shuffled once, to meet its drop list; the hashes are dealt by
    their own bits, counts are pre-aggregated, and AQE splits the join
    partition of a line that very many documents hold.
    """
    spark = docs.sparkSession
    with scratch(spark):
        own = line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", F.expr(f"pmod(xxhash64(doc), {int(batches)})").cast("int"))
        hashes = staged(own, "line-hashes", ["batch"])
        store = LineRuns(spark, fanout)
        for k in range(batches):
            store.add(hashes.filter(F.col("batch") == k))
        many = store.repeated(min_docs)
        store.close()
        drops = hashes.join(many, ["h1", "h2"]).filter(F.col("doc") < F.col("top_doc"))
        # one text's lines: never more than it has
        drops = staged(drops.groupBy("number").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")), "line-drops", keep=True)
    keyed = docs.select(row_number_of(id_col, text_col).alias("number"), whole_row(docs))
    joined = keyed.join(drops, "number", "left").select("row", "gone", F.col(f"row.`{text_col}`").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made: list[tuple] = []
            for text, gone in zip(binary_column(part, "text"), part.column(1).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                if gone:
                    listed = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in gone}
                    stay = [x for x in lines if line_key(x, min_chars) not in listed]
                else:
                    stay = lines
                kept = b"\n".join(stay)
                made.append((len(lines), len(lines) - len(stay), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            n_lines, n_dropped, sha, kept_text = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
                schema=pa.schema([part.schema.field(0), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]),
            )

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, n_lines long, n_dropped long, kept_sha256 string, kept_text string")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines taken out; a document left without any word goes.

    A document that had no words before the stage stays as it is.
    """
    out = drop_repeated(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    emptied = (F.col("n_dropped") > 0) & (F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) == "")
    names = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    out = out.filter(~emptied).select(*names)
    return out.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else out


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), many AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, many.k IS NOT NULL AND l.doc_id < many.top AS gone FROM lines l LEFT JOIN many ON l.k = many.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

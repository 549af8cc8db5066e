r"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document.  Each *segment* holds the whole documents of
about ``segment_words`` words: a sorted term dictionary (64-bit hashes) and,
for each term, the ascending positions in the segment's token stream.
Documents are ``GAP`` positions apart, so no phrase crosses two of them.
Building shuffles nothing, segments have a bounded size however common a word
is, and a lost executor only costs its own segments.

Phrase search starts from the rarest term of each test phrase in the segment,
shifts its postings by the term's offset, and intersects with the shifted
postings of the next rarest, until every term has agreed.  Matching is exact
but for 64-bit term hashes.  Proximity search starts from the rarest term and
looks for every other term within ``slop`` words.

Words: A-Z lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.

The test phrases are a table as well: distinct windows are dealt by hash to
block files of about ``block_windows`` (about 10 MB each) in the shared folder.  A
worker maps one block after the other, so neither the driver nor a worker
holds the whole benchmark.

Edge cases: null or wordless documents have no words and no hits; null or
wordless items have no windows.  Repeated rows are judged one by one; rows of
one item_id are one item.  Items without an item_id are together one item
without a name: their windows count as hits and as one of the items, and
items_sha256 leaves them out.  Empty tables give empty results or no hits.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, read_table, scratch, staged, staged_path, text_batches
from .files import map_arrays, write_arrays

WINDOW = 8
SEGMENT_WORDS = 1_000_000
BLOCK_WINDOWS = 100_000
MIN_ITEMS = 2
#: Free positions between two documents; phrases may not be longer.
GAP = 64
CANDIDATES = 2_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SEGMENT = "docs binary, starts binary, lengths binary, terms binary, offsets binary, positions binary"


def match_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per segment; write it to keep it."""

    def pack(ids: list, streams: list[np.ndarray]) -> list:
        lengths = np.array([len(s) for s in streams], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + GAP)[:-1])).astype(np.int64)
        words = np.concatenate(streams)
        where = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(words))
        order = np.argsort(words, kind="stable")
        terms, first = np.unique(words[order], return_index=True)
        positions = where[order]
        gaps = np.diff(positions, prepend=0)
        gaps[first] = positions[first]  # each list starts anew
        return [np.array([-1 if i is None else i for i in ids], np.int64).tobytes() + np.array([i is None for i in ids], np.uint8).tobytes(), starts.tobytes(), lengths.tobytes(), terms.tobytes(), np.append(first, len(words)).astype(np.int64).tobytes(), gaps.astype(np.uint32).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, streams, n = WordHashes(), [], [], 0
        names = [x.split()[0] for x in SEGMENT.split(", ")]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in pack(ids, streams)], names)

        for keys, texts in text_batches(batches, "id", "text"):
            for key, text in zip(keys, texts, strict=True):
                ids.append(key)
                streams.append(hashes.array(match_words(text)))
                n += len(streams[-1]) + 1
                if n >= segment_words:
                    yield out()
                    ids, streams, n = [], [], 0
        if ids:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SEGMENT)


class Segment:
    """One segment, unpacked for searching."""

    def __init__(self, row: dict) -> None:
        self.starts = np.frombuffer(row["starts"], np.int64)
        n = len(self.starts)
        self.ids = np.frombuffer(row["docs"][: 8 * n], np.int64)
        self.null = np.frombuffer(row["docs"][8 * n :], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.first = np.frombuffer(row["offsets"], np.int64)
        gaps = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
        sums = np.cumsum(gaps)
        heads = self.first[:-1]
        base = np.repeat(sums[heads] - gaps[heads], np.diff(self.first)) if len(heads) else sums
        self.positions = sums - base
        self.size = int(self.starts[-1] + self.lengths[-1] + GAP) if n else 0
        # (term, position) is sorted: one binary search tests a posting
        self.postings = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * self.size + self.positions

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and document frequencies (in postings); -1 and 0 where absent."""
        if not len(self.terms):
            return np.full(words.shape, -1), np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        found = self.terms[at] == words
        return np.where(found, at, -1), np.where(found, np.diff(self.first)[at], 0)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.size + position
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return (position >= 0) & (position < self.size) & (self.postings[at] == key)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of each term: which of the terms, and the position."""
        count = self.first[term + 1] - self.first[term]
        owner = np.repeat(np.arange(len(term)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.positions[self.first[term][owner] + inner]

    def phrases(self, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) of every occurrence. words: a row per phrase, padded to the right."""
        if not len(self.terms) or not len(words):
            return
        inside = np.arange(words.shape[1]) < sizes[:, None]
        term, freq = self.lookup(words)
        alive = np.flatnonzero(((term >= 0) | ~inside).all(axis=1) & (sizes > 0))
        order = np.argsort(np.where(inside, freq, np.iinfo(np.int64).max)[alive], axis=1, kind="stable")
        loads = np.take_along_axis(freq[alive], order[:, :1], axis=1)[:, 0]
        cuts = np.searchsorted(np.cumsum(loads), np.arange(CANDIDATES, loads.sum() + CANDIDATES, CANDIDATES))
        for part in np.split(np.arange(len(alive)), np.unique(np.minimum(cuts + 1, len(alive)))):
            if not len(part):
                continue
            owner, position = self.spread(term[alive[part], order[part, 0]])
            owner = part[owner]
            start = position - order[owner, 0]
            for step in range(1, words.shape[1]):
                phrase = alive[owner]
                checked = sizes[phrase] > step
                offset = order[owner, step]
                good = ~checked | self.has(np.maximum(term[phrase, offset], 0), start + offset)
                owner, start = owner[good], start[good]
            yield alive[owner], start

    def near(self, words: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest word from which every other word is within slop, in one document."""
        term, freq = self.lookup(words)
        if not len(words) or (term < 0).any():
            return np.zeros(0, np.int64)
        order = np.argsort(freq, kind="stable")
        at = self.positions[self.first[term[order[0]]] : self.first[term[order[0]] + 1]]
        doc = self.doc_of(at)
        for k in order[1:]:
            other = self.positions[self.first[term[k]] : self.first[term[k] + 1]]
            low = np.maximum(at - slop, self.starts[doc])
            high = np.minimum(at + slop, self.starts[doc] + self.lengths[doc] - 1)
            own = int(term[k] == term[order[0]])  # the word itself doesn't count twice
            good = np.searchsorted(other, high, "right") - np.searchsorted(other, low, "left") > own
            at, doc = at[good], doc[good]
        return at

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def store_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Write the distinct (window, item) as block files; returns their folder and (block, windows, pairs, bytes of names) of each."""
    spark = items.sparkSession
    base = staged_path(spark, "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            owners, sizes, pieces = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                stream = hashes.array(match_words(text))
                found = {stream[k : k + window].tobytes() for k in range(max(1, len(stream) - window + 1) if len(stream) else 0)}
                pieces += found
                owners += [item] * len(found)
                sizes += [min(len(stream), window)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(sizes, pa.int32()), pa.array(pieces, pa.binary())], ["item", "size", "words"])

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, "item string, size int, words binary")
    chars = items.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * block_windows)))  # a word and what follows it have 4 signs or more on average

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        every, owner = np.unique(frame["words"].to_numpy(object), return_inverse=True)
        words = np.stack([np.frombuffer(w.ljust(8 * window, b"\0"), np.uint64) for w in every])
        sizes = np.array([len(w) // 8 for w in every], np.int64)
        names = frame["item"].to_numpy(object)
        order = np.argsort(owner, kind="stable")
        encoded = [b"\0" if names[k] is None else b"\1" + names[k].encode() for k in order]
        write_arrays(base, f"block-{block}", [words, sizes, np.searchsorted(owner[order], np.arange(len(every) + 1)), np.cumsum([0, *map(len, encoded)]), np.frombuffer(b"".join(encoded), np.uint8)])
        return pd.DataFrame({"block": [block], "n": [len(every)], "pairs": [len(order)], "bytes": [sum(map(len, encoded))]})

    dealt = rows.dropDuplicates().withColumn("block", F.expr(f"pmod(xxhash64(words), {blocks})"))
    made = staged(dealt.groupBy("block").applyInPandas(write, "block long, n long, pairs long, bytes long"), "windows-blocks")
    return base, sorted(tuple(r) for r in made.collect())  # a row of four numbers a block


class WindowBlock:
    """A block of phrases: hashed words, sizes, and the items of each."""

    def __init__(self, base: str, block: int, n: int, pairs: int, size: int, window: int) -> None:
        words, self.sizes, self.first, self.ends, self.names = map_arrays(base, f"block-{block}", [("<u8", n * window), ("<i8", n), ("<i8", n + 1), ("<i8", pairs + 1), ("u1", size)])
        self.words = words.reshape(n, window)

    def items(self, phrase: int) -> Iterator[str | None]:
        for k in range(self.first[phrase], self.first[phrase + 1]):
            name = self.names[self.ends[k] : self.ends[k + 1]].tobytes()
            yield name[1:].decode() if name[0] else None


def contamination(index: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per indexed document: n_words, n_hit, n_items, items_sha256, contaminated, and the item ids."""
    if window > GAP:
        raise ValueError(f"a window has at most {GAP} words")
    base, blocks = store_windows(items, window=window, block_windows=block_windows)

    def judge(row: dict) -> list[tuple]:
        seg = Segment(row)
        edge = np.zeros(seg.size + 1, np.int32)
        found: dict[int, set[str | None]] = {}
        for numbers in blocks:
            block = WindowBlock(base, *numbers, window)
            for phrase, start in seg.phrases(block.words, block.sizes):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + block.sizes[phrase], -1)
                pairs = np.unique(np.stack([seg.doc_of(start), phrase]), axis=1)
                for doc, k in pairs.T.tolist():
                    found.setdefault(doc, set()).update(block.items(k))
        hits = np.concatenate(([0], np.cumsum(np.cumsum(edge) > 0)))
        n_hit = hits[seg.starts + seg.lengths] - hits[seg.starts]
        out = []
        for k in range(len(seg.ids)):
            items = sorted(x for x in found.get(k, ()) if x is not None)
            n_items = len(found.get(k, ()))
            out.append((None if seg.null[k] else int(seg.ids[k]), int(seg.lengths[k]), int(n_hit[k]), n_items, hashlib.sha256(",".join(items).encode()).hexdigest(), n_items >= min_items, items))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                if made := judge(row):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)

    return index.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def proximity(index: DataFrame, words: list[str], slop: int) -> DataFrame:
    """(doc_id, position) of the rarest of the words wherever all the others are within slop words."""
    hashes = WordHashes()
    wanted = hashes.array([w.encode() for w in dict.fromkeys(words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seg = Segment({name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)})
                at = seg.near(wanted, slop)
                doc = seg.doc_of(at)
                yield pa.RecordBatch.from_arrays([pa.array(seg.ids[doc], mask=seg.null[doc]), pa.array(at - seg.starts[doc])], ["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        index = staged(build_index(read_table(spark, sf_dir, "documents")), "positional-index")
        return staged(contamination(index, read_table(spark, sf_dir, "benchmark")).drop("items"), "positional-result", keep=True)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: one goes as soon as WINDOW of its words lie in windows of any item.

    One leaked passage is enough here; ``contaminated`` of the query is about
    several items.  An item shorter than a window is no passage on its own.
    Each row is judged by its own text: verdicts go by a 64-bit hash of id and
    text.
    """
    number = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    with scratch(spark):
        index = staged(build_index(docs.select(number.alias("doc_id"), "text")), "positional-index")
        bad = contamination(index, read_table(spark, sf_dir, "benchmark")).filter(F.col("n_hit") >= WINDOW).select(F.col("doc_id").alias("bad")).distinct()
        # written, so that its size is known before the join: texts are shuffled only if it is large
        bad = staged(bad, "positional-bad", keep=True)
    return docs.join(bad, number == bad["bad"], "left_anti").select(*[f"`{c}`" for c in docs.columns])


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, item_id, places.n, i FROM places JOIN windows ON places.p = windows.p AND places.n = windows.n
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words LEFT JOIN hits ON words.doc_id = hits.doc_id LEFT JOIN names ON words.doc_id = names.doc_id
"""

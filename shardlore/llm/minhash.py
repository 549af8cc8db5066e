r"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

1. *Sets.* A-Z lower-cased words ``[^\x20\x09-\x0D]+``; a document's set holds
   the hashes of its distinct 5-word shingles (with fewer words, of the whole
   sequence).  Documents with equal sets form a class and only its smallest id
   goes on, so thousands of exact copies cost one row.
2. *Signatures.* SuperMinHash (Ertl, 2017): each element walks a random
   permutation of the slots and offers ``rank + fraction``; the walk stops when
   no slot can still fall.  Slots of one document are negatively correlated,
   so estimates vary less than with independent hashes.
3. *Banding.* ``bands`` bands of ``rows`` slots.  A bucket links each member to
   its smallest id only, never all its pairs: at most ``bands`` rows a document.
   A pair at similarity s shares no bucket with probability
   (1 - s^rows)^bands: 5e-11 at 0.85 for 32 bands of 4 (of 128 slots).
4. *Verification.* Each link is confirmed on the full sets.
5. *The rest.* Bucket links join documents to candidate groups.  Where a group
   falls into several verified components, all its documents outside the
   largest component are compared with all of the group, in blocks of
   ``block`` documents, so that no pair in a common bucket goes unchecked.
6. *Union-find* (see components.py) labels the components.

No join here may be broadcast: Spark judges a staged table by its compressed
files, and what it holds once unpacked, on the driver, grows with the corpus.

Edge cases: null or wordless texts have an empty set and no links.  Rows of
one doc_id must be equal texts (repeated rows); each gets the id's result.
A null doc_id is its own component and is kept by :func:`near_duplicates`;
:func:`dedup_stage` also groups rows without an id.  Empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, chain64, mix64, once_each, read_table, scratch, space_words, staged, text_batches, whole_row
from .components import UnionFind, components

SHINGLE = 5
BANDS = 32
ROWS = 4
PERCENT = 85
#: Similarity of near-duplicates in the pipeline.
STAGE_PERCENT = 80
BLOCK = 256
#: Elements whose permutations are held at once (one byte a slot).
WALK = 40_000


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a stream of word hashes."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = mix64(words[:n])
    for k in range(1, size):
        h = chain64(h, words[k : k + n])
    return np.unique(h)


def superminhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """(n_docs, slots) signatures; owner: the document number of each element, ascending.

    All documents walk in step.  After step j a document whose slots all hold
    values below j + 1 is done, since later offers are larger: the early stop.
    """
    sig = np.full((n_docs, slots), np.inf)
    if not len(elements):
        return sig
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    lo = 0
    while lo < n_docs:  # in pieces whose permutations fit; a long document is a piece of its own
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + WALK, "right")) - 1)
        hi = min(hi, n_docs)
        part = sig[lo:hi]
        _walk(elements[bounds[lo] : bounds[hi]], owner[bounds[lo] : bounds[hi]] - lo, part, slots)
        lo = hi
    return sig


def _walk(elements: np.ndarray, owner: np.ndarray, sig: np.ndarray, slots: int) -> None:
    flat = sig.reshape(-1)
    perm: np.ndarray | None = None
    used: list[np.ndarray] = []
    for j in range(slots):
        if not len(elements):
            return
        draw = mix64(elements + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        value = j + (draw >> np.uint64(32)).astype(np.float64) / 2.0**32
        pick = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = pick
            used = [pick]
        else:
            if perm is None:  # only elements of documents that need a second step get here
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                rows = np.arange(len(elements))
                perm[rows, used[0]] = 0
                perm[:, 0] = used[0]
            rows = np.arange(len(elements))
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = place
        at = owner * slots + place
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        spots = ordered[heads]
        flat[spots] = np.minimum(flat[spots], np.minimum.reduceat(value[order], heads))
        going = (sig.max(axis=1) >= j + 1)[owner]
        if not going.all():
            elements, owner = elements[going], owner[going]
            if perm is None:
                used = [used[0][going]]
            else:
                perm = perm[going]


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_docs, bands) 64-bit bucket names, as signed integers."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = mix64(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)))
    for k in range(rows):
        h = chain64(h, bits[:, :, k])
    return h.view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, buckets): set size, 128-bit set fingerprint (null if empty), bucket names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, texts in text_batches(batches, "id", "text"):
            sets = [shingle_set(hashes.array(space_words(t)), size) for t in texts]
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            names = band_hashes(superminhash(every, owner, len(sets), bands * rows), bands, rows)
            full = np.flatnonzero(sizes)
            prints = np.zeros((len(sets), 2), np.uint64)
            if len(full):
                heads = (np.cumsum(sizes) - sizes)[full]
                # sums of well-mixed hashes of a set's elements depend on the set alone
                prints[full, 0] = np.add.reduceat(mix64(every), heads)
                prints[full, 1] = np.add.reduceat(mix64(every ^ np.uint64(0xD6E8FEB86659FD93)), heads)
            prints = prints.view(np.int64)
            empty = sizes == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(names.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints[:, 0], mask=empty), pa.array(prints[:, 1], mask=empty), lists],
                ["doc_id", "n_shingles", "f1", "f2", "buckets"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, buckets array<long>")


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, elements): the sets as packed sorted 64-bit hashes, from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, texts in text_batches(batches, "id", "text"):
            sets = [shingle_set(hashes.array(space_words(t)), size).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "elements"])

    return docs.mapInArrow(run, "id long, elements binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| on sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A hub's set meets its many pairs in a join that AQE can split."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def _block_links(percent: int):
    """Spanning links between documents of two blocks of one group that are not in the same component yet."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in frame["elements"]]
        ids, comp, left, right = (frame[c].to_numpy() for c in ("id", "comp", "left", "right"))
        forest = UnionFind()
        sizes = np.array([len(s) for s in sets])
        every, inverse = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.zeros(0), np.zeros(0, int))
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(inverse, kind="stable")
        heads = np.searchsorted(inverse[order], np.arange(len(every) + 1))
        offset = np.concatenate(([0], np.cumsum(sizes)))
        links = []
        for i in np.flatnonzero(left):
            # shared elements with every document of the block, from the block's own inverted lists
            mine = inverse[offset[i] : offset[i + 1]]
            count = heads[mine + 1] - heads[mine]
            at = np.repeat(heads[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(owner[order[at]], minlength=len(sets))
            close = 100 * shared >= percent * (sizes + sizes[i] - shared)
            for k in np.flatnonzero(close & right & (shared > 0)):
                if k != i and forest.union(int(comp[i]), int(comp[k])):
                    links.append((int(ids[i]), int(ids[k])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    feats = staged(features(docs, id_col, text_col, size, bands, rows), "minhash")
    # classes of equal sets: pre-aggregated, one row a class goes on
    reps = feats.filter("f1 is not null and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("buckets").alias("buckets"))
    reps = staged(reps, "minhash-classes")
    slots = reps.select("rep", F.explode("buckets").alias("bucket"))  # a bucket's name holds its band
    heads = slots.groupBy("bucket").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = staged(slots.join(heads.hint("merge"), "bucket").filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).dropDuplicates(), "minhash-pairs")
    ends = staged(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).dropDuplicates(), "minhash-ends")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # texts are dealt by id at every size of the table; a filter of ids small enough for each worker would do nothing for a large one
    needed = texts.filter("id is not null").join(ends.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    sets = staged(shingle_sets(needed, size), "minhash-sets")
    links = staged(verified(pairs, sets, percent), "minhash-links")
    comps = components(links)
    rest = _unfinished(pairs, comps, sets, percent, block)
    if rest is not None:
        comps = components(links.union(rest))
    of_class = reps.join(comps.hint("merge"), reps["rep"] == comps["vertex"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "n_shingles", "f1", "f2").join(of_class.hint("merge"), ["f1", "f2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unfinished(pairs: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links between different components of one candidate group, or None if every group is one component."""
    groups = components(pairs)
    members = groups.select(F.col("vertex").alias("id"), F.col("component").alias("group"))
    members = members.union(groups.select(F.col("component").alias("id"), F.col("component").alias("group")).dropDuplicates())
    members = staged(members.join(comps.hint("merge"), members["id"] == comps["vertex"], "left").select("id", "group", F.coalesce("component", "id").alias("comp")), "minhash-members")
    parts = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("group").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("n_comps")).filter("n_comps > 1")
    # a group of two was settled by its only link
    split = split.filter("size > 2").select("group", F.col("top.comp").alias("main"), F.ceil(F.col("size") / block).alias("blocks"), F.ceil((F.col("size") - F.col("top.n")) / block).alias("odd_blocks"))
    # one row a group, written so that both sides of the join are plain shuffles
    split = staged(split, "minhash-split")
    if not split.limit(1).count():
        return None
    todo = members.join(split.hint("merge"), "group").withColumn("odd", F.col("comp") != F.col("main"))
    deal = lambda n: F.expr(f"pmod(xxhash64(id), {n})")
    # written, so that the join ends its stage and AQE can split the members of a large group
    todo = staged(todo.select("id", "group", "comp", "odd", deal("blocks").alias("k"), deal("odd_blocks").alias("odd_k"), "blocks", "odd_blocks"), "minhash-todo")
    # each block of odd ones meets each block of the group: a row per block met, not per pair
    as_left = todo.filter("odd").select("id", "group", "comp", F.col("odd_k").alias("i"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    as_right = todo.select("id", "group", "comp", F.explode(F.expr("sequence(0L, odd_blocks - 1)")).alias("i"), F.col("k").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    met = as_left.union(as_right).groupBy("group", "i", "j", "id", "comp").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    met = met.join(sets.hint("merge"), "id")
    links = staged(met.groupBy("group", "i", "j").applyInPandas(_block_links(percent), "a long, b long"), "minhash-rest")
    return links if links.limit(1).count() else None


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return staged(near_duplicates(read_table(spark, sf_dir, "documents")), "minhash-groups", keep=True)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id, then of the smallest hash.

    Rows are told apart by a 64-bit hash of id and text, so different texts of
    one id are different documents, and so are rows without an id, which stay
    only where no document of their group has one.  Rows equal in id and text
    become one row.  Documents at STAGE_PERCENT or more are linked.
    """
    number = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    keyed = docs.select(number.alias("number"), whole_row(docs))
    with scratch(spark):
        rows = docs.select(number.alias("number"), F.col("doc_id").cast("long").alias("id"), "text")
        judged = staged(near_duplicates(rows, "number", percent=STAGE_PERCENT), "minhash-judged")
        ids = rows.groupBy("number").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        groups = staged(judged.select(F.col("doc_id").alias("number"), "component_id").dropDuplicates().join(ids.hint("merge"), "number"), "minhash-ids")
        first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("first"))
        stay = groups.join(first.hint("merge"), "component_id").filter(F.col("number") == F.col("first.number"))
        gone = staged(groups.join(stay.select("number").hint("merge"), "number", "left_anti").select("number"), "minhash-gone", keep=True)
        repeated = staged(stay.filter("n > 1").select("number"), "minhash-repeated", keep=True)
    stayed = once_each(keyed.join(gone.hint("merge"), "number", "left_anti"), "number", repeated)
    return stayed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 4, 1) + 1) END, lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM words
), classes AS (
  SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (SELECT rep, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT rep AS v, rep AS c FROM classes
  UNION SELECT e.b, r.c FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.v
), least_of AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(c, sets.doc_id) AS component_id, sets.doc_id = coalesce(c, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least_of ON classes.rep = v
"""

r"""BM25 over stored postings, for many queries at once.

score = sum over a query's phrases of idf * f * (k1 + 1) / (f + k1 (1 - b + b dl / avgdl)),
idf = ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that isn't positive; a
repeated word is two phrases, a prefix is one phrase that matches every token
it starts.  Rows rank by the score rounded to 9 digits, then by id.

Exact terms are an equi-join with the postings on (corpus, term); prefixes are
first turned into terms over the distinct vocabulary, so no postings are
scanned by comparison.  Postings may be stored ones or the occurrences of texts:
equal rows are summed.

The query side is broadcast only if its size is known to be small
(``BROADCAST_TERMS``).  Then what it hits is packed to a row a text, dealt by text
and written, once; frequencies are counted from that, and each task sums its
texts' scores for all queries in arrays and hands on its best.  Beyond that size
the query side is shuffled by term, and sums by query and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.text import query_terms, token_count, tokens
from ..sources.scratch import written

#: Fixed values of the ranking: k1 and b of BM25, and the candidates a list keeps.
K1, B = 1.2, 0.75
DEPTH = 50
#: Query terms that are broadcast at most (some 100 bytes each).
BROADCAST_TERMS = 50_000
#: Texts that are scored at once, scores of such a block, and terms met in it, at most (but for a single text).
BLOCK_TEXTS, BLOCK_SCORES, BLOCK_TERMS = 2048, 4_000_000, 2_000_000
#: Candidates that a task gathers before it drops those that aren't among the best.
GATHERED = 1_000_000
#: Stands for a missing id in arrays.
NO_ID = -(1 << 63)


def occurrences(sections: DataFrame, columns: tuple[str, ...] = ("text", "header", "anchor")) -> DataFrame:
    """(corpus, id, dl, term, tf) with a row per token, for ranking texts that have no stored postings.

    The query terms meet the tokens before any are shuffled, so only matches are counted.
    """
    toks = sections.select("corpus", "id", tokens(*[F.col(c) for c in columns]).alias("toks"))
    # explode_outer: before an inner explode Spark would tokenise once more, to drop empty lists
    rows = toks.select("corpus", "id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"), F.lit(1).cast("long").alias("tf"))
    return rows.filter(F.col("term").isNotNull())


def postings(sections: DataFrame, columns: tuple[str, ...] = ("text", "header", "anchor")) -> DataFrame:
    """(corpus, term, id, dl, tf)."""
    return occurrences(sections, columns).groupBy("corpus", "term", "id", "dl").agg(F.sum("tf").alias("tf"))


def corpus_stats(sections: DataFrame, columns: tuple[str, ...] = ("text", "header", "anchor")) -> DataFrame:
    """(corpus, n_docs, avgdl): one row a corpus."""
    size = token_count(*[F.col(c) for c in columns])
    return sections.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum(size) / F.count(F.lit(1))).alias("avgdl"))


def phrases(queries: DataFrame, corpora: DataFrame) -> DataFrame:
    """(qid, query) -> (corpus, qid, phrase, term, is_prefix), for every corpus."""
    terms = queries.select("qid", F.posexplode(query_terms(F.col("query"))).alias("phrase", "t")).select("qid", "phrase", "t.term", "t.is_prefix")
    names = corpora.select("corpus").distinct()
    return terms.join(F.broadcast(names))  # one row a corpus


def _asked(queries: DataFrame, corpora: DataFrame) -> tuple[DataFrame, bool]:
    """(corpus, qid, key, term, is_prefix, times), and whether they are few."""
    # a key is a term, or a prefix with its star, which no term holds; a repeated key counts as often as it is asked for
    key = F.when(F.col("is_prefix"), F.concat("term", F.lit("*"))).otherwise(F.col("term"))
    asked = phrases(queries, corpora).withColumn("key", key).groupBy("corpus", "qid", "key", "term", "is_prefix").agg(F.count(F.lit(1)).alias("times"))
    return asked, asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def _numbered(asked: DataFrame) -> tuple[list, dict[tuple[str, str], int]]:
    """The rows of few asked, and a number for each (corpus, key)."""
    rows = asked.select("corpus", "key", "qid", "times").collect()  # at most BROADCAST_TERMS
    return rows, {pair: k for k, pair in enumerate(sorted({(r[0], r[1]) for r in rows}))}


def _best(sums: DataFrame, depth: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid", "corpus").orderBy(F.desc("score"), "id"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= depth)


def bm25(queries: DataFrame, post: DataFrame, stats: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(qid, corpus, id, score, rank): each query's best in each corpus. post: (corpus, term, id, dl, tf)."""
    asked, small = _asked(queries, stats)
    keys = asked.select("corpus", "key", "term", "is_prefix").distinct()
    exact = keys.filter(~F.col("is_prefix")).select("corpus", "key", "term")
    starts = keys.filter("is_prefix").select("corpus", "key", F.col("term").alias("prefix"), F.substring("term", 1, 1).alias("lead"))
    few = F.broadcast if small else (lambda df: df)  # of tables with a row a key or less, counted just now
    wanted_terms = few(exact)
    if starts.limit(1).count():
        # prefixes: the vocabulary is cut by the first sign, then compared; written, so that its size is known
        vocabulary = post.select("corpus", "term").distinct().withColumn("lead", F.substring("term", 1, 1))
        grown = few(starts).join(vocabulary, ["corpus", "lead"]).filter(F.startswith("term", "prefix")).select("corpus", "key", "term")
        wanted_terms = written(exact.unionByName(grown), "bm25-terms")
    hits = post.join(wanted_terms, ["corpus", "term"])
    if not small:
        return _best(_joined(hits, asked, stats), depth)
    rows, number = _numbered(asked)
    kind = asked.schema["qid"].dataType
    if not rows:
        return _best(queries.sparkSession.createDataFrame([], f"qid {kind.simpleString()}, corpus string, id long, score double"), depth)
    return _best(_scored(_pack_hits(hits, number), rows, number, stats, depth, kind), depth)


def bm25_texts(queries: DataFrame, sections: DataFrame, columns: tuple[str, ...] = ("text", "header", "anchor"), depth: int = DEPTH) -> DataFrame:
    """bm25 over texts that have no stored postings."""
    asked, small = _asked(queries, sections)
    if not small or asked.filter("is_prefix").limit(1).count():
        return bm25(queries, occurrences(sections, columns), corpus_stats(sections, columns), depth)
    rows, number = _numbered(asked)
    kind = asked.schema["qid"].dataType
    if not rows:
        return _best(queries.sparkSession.createDataFrame([], f"qid {kind.simpleString()}, corpus string, id long, score double"), depth)
    packed = _pack_texts(sections, columns, number)
    stats = packed.groupBy("corpus").agg(F.sum("n").alias("n_docs"), (F.sum(F.col("dl") * F.col("n")) / F.sum("n")).alias("avgdl"))
    return _best(_scored(packed, rows, number, stats, depth, kind), depth)


def _joined(hits: DataFrame, asked: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, corpus, id, score) of all texts, by joins on the terms."""
    # each key's weight in each text is computed once; queries meet it only before the last sum
    tf = written(hits.groupBy("corpus", "key", "id", "dl").agg(F.sum("tf").alias("f")), "bm25-tf")
    df = tf.groupBy("corpus", "key").agg(F.count(F.lit(1)).alias("n"))
    weighed = tf.join(df, ["corpus", "key"]).join(F.broadcast(stats), "corpus")  # stats: one row a corpus
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = weighed.select("corpus", "key", "id", part.alias("part"))
    met = weighed.join(asked.select("corpus", "qid", "key", "times"), ["corpus", "key"])
    return met.groupBy("qid", "corpus", "id").agg(F.round(F.sum(F.col("part") * F.col("times")), 9).alias("score"))


# --- scores in arrays, for few query terms ------------------------------------------

#: n: how many texts a row stands for; 0 where only postings are known.
PACKED = "corpus string, id long, dl long, n long, keys array<int>, tfs array<long>"


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _rows(corpora: list[str], ids: np.ndarray, dl: np.ndarray, n: np.ndarray, sizes: np.ndarray, key: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """A batch of PACKED, with sizes keys a row."""
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key.astype(np.int32), tf.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(corpora, pa.string()), *(pa.array(x.astype(np.int64)) for x in (ids, dl, n)), *lists], ["corpus", "id", "dl", "n", "keys", "tfs"])


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    coded = batch.column("corpus").dictionary_encode()
    return np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy(), batch.column("id").to_numpy(), batch.column("dl").to_numpy()


def _summed(row: np.ndarray, key: np.ndarray, tf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, tf) with equal pairs summed, sorted. width: keys are below."""
    code = row.astype(np.int64) * width + key
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = _heads(code)
    return code[at] // width, code[at] % width, np.add.reduceat(tf[order], at) if len(at) else tf[order]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key to rows of many, where they follow each other."""
    for batch in batches:
        if batch.num_rows:
            names, group, ids, dl = _numbers(batch)
            at = _heads(group, ids, dl)
            yield _rows([names[g] for g in group[at]], ids[at], dl[at], np.zeros(len(at)), np.diff(np.append(at, len(ids))), batch.column("key").to_numpy(), batch.column("tf").to_numpy())


def _texts(batches: Iterator[pa.RecordBatch], most_texts: int, most_terms: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by corpus and id in blocks that end where a text ends."""
    kept: list[pa.RecordBatch] = []

    def cuts() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        _, group, ids, _ = _numbers(whole)
        sizes = np.diff(whole.column("keys").offsets.to_numpy())
        return whole, _heads(group, ids), np.concatenate(([0], np.cumsum(sizes)))

    def blocks(last: bool) -> Iterator[pa.RecordBatch]:
        whole, heads, terms = cuts()
        ends = np.append(heads[1:], whole.num_rows) if last else heads[1:]
        first = 0
        while len(ends):
            n = min(most_texts, max(1, int(np.searchsorted(terms[ends], terms[first] + most_terms, "right"))))
            yield whole.slice(first, int(ends[n - 1]) - first)
            first, ends = int(ends[n - 1]), ends[n:]
        kept[:] = [whole.slice(first)] if first < whole.num_rows else []

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            yield from blocks(False)
    if kept:
        yield from blocks(True)


def _lists(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, key and tf of each entry of the lists."""
    sizes = np.diff(block.column("keys").offsets.to_numpy())
    return np.repeat(np.arange(block.num_rows), sizes), block.column("keys").flatten().to_numpy(), block.column("tfs").flatten().to_numpy()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same corpus, id and dl to one, equal keys summed."""
    for block in _texts(batches, BLOCK_TEXTS, BLOCK_TERMS):
        names, group, ids, dl = _numbers(block)
        row, key, tf = _lists(block)
        order = np.lexsort((dl, ids, group))
        heads = _heads(group[order], ids[order], dl[order])
        start = np.zeros(len(order), np.int64)
        start[heads[1:]] = 1
        merged = np.empty(len(order), np.int64)
        merged[order] = np.cumsum(start)
        first = order[heads]
        row, key, tf = _summed(merged[row], key, tf, int(key.max(initial=0)) + 1)
        n = np.bincount(merged, block.column("n").to_numpy(), len(heads))
        yield _rows([names[g] for g in group[first]], ids[first], dl[first], n, np.bincount(row, minlength=len(heads)), key, tf)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.int64)
    for batch in batches:
        part = np.bincount(batch.column("keys").flatten().to_numpy(), minlength=len(seen))
        part[: len(seen)] += seen
        seen = part
    key = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(seen[key])], ["key", "n"])


@dataclass
class Asked:
    """Per key: its weight, its corpus' average length, and where its queries are in query and times."""

    qids: list
    idf: np.ndarray
    avgdl: np.ndarray
    starts: np.ndarray
    query: np.ndarray
    times: np.ndarray

    def scores(self, text: np.ndarray, n_texts: int, dl: np.ndarray, key: np.ndarray, f: np.ndarray) -> np.ndarray:
        """(texts, queries); 0 where they share no key, as every part is positive."""
        part = self.idf[key] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / self.avgdl[key]))
        out = np.zeros(n_texts * len(self.qids))
        n = self.starts[key + 1] - self.starts[key]
        ends = np.cumsum(n)
        first = 0
        while first < len(key):  # at most BLOCK_TERMS meetings at once, or one key's
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + BLOCK_TERMS, "right")))
            some, many = slice(first, last), n[first:last]
            at = np.arange(many.sum()) + np.repeat(self.starts[key[some]] - (ends[some] - many - done), many)
            place = np.repeat(text[some] * len(self.qids), many) + self.query[at]
            lowest, highest = int(text[first]) * len(self.qids), (int(text[last - 1]) + 1) * len(self.qids)
            out[lowest:highest] += np.bincount(place - lowest, np.repeat(part[some], many) * self.times[at], highest - lowest)
            first = last
        return out.reshape(n_texts, len(self.qids))


def _top(query: np.ndarray, score: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """The places of each query's best."""
    order = np.lexsort((ids, -score, query))
    heads = _heads(query[order])
    place = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[place < depth]


def _id() -> Column:
    return F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id")


def _packed(parts: DataFrame) -> DataFrame:
    return written(parts.repartition("corpus", "id").sortWithinPartitions("corpus", "id").mapInArrow(_merge, PACKED), "bm25-hits")


def _pack_hits(hits: DataFrame, number: dict[tuple[str, str], int]) -> DataFrame:
    """PACKED of (corpus, key, id, dl, tf)."""
    keys = F.broadcast(hits.sparkSession.createDataFrame([(c, word, k) for (c, word), k in number.items()], "corpus string, key string, number int"))  # a row a key
    plain = hits.join(keys, ["corpus", "key"]).select("corpus", _id(), F.col("dl").cast("long").alias("dl"), F.col("number").alias("key"), F.col("tf").cast("long").alias("tf"))
    return _packed(plain.sortWithinPartitions("corpus", "id", "dl").mapInArrow(_pack, PACKED))


def _pack_texts(sections: DataFrame, columns: tuple[str, ...], number: dict[tuple[str, str], int]) -> DataFrame:
    """PACKED of texts: each is tokenised once, and only its number of tokens and the asked ones go on."""
    words: dict[str, tuple[list[str], list[int]]] = {}
    for (corpus, word), k in number.items():
        words.setdefault(corpus, ([], []))[0].append(word)
        words[corpus][1].append(k)
    width = len(number) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {corpus: (pa.array(some, pa.string()), np.array(ks)) for corpus, (some, ks) in words.items()}
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_TEXTS):
                names, group, _, _ = _numbers(block := batch.slice(first, BLOCK_TEXTS))
                for g, name in enumerate(names):
                    part = block.filter(pa.array(group == g)) if len(names) > 1 else block
                    toks = part.column("toks")
                    some, ks = sets[name]
                    at = pc.index_in(toks.flatten(), some)
                    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    row = np.repeat(np.arange(part.num_rows), np.diff(toks.offsets.to_numpy()))[hit]
                    row, key, tf = _summed(row, ks[at.drop_null().to_numpy()], np.ones(len(hit), np.int64), width)
                    yield _rows([name] * part.num_rows, part.column("id").to_numpy(), part.column("dl").to_numpy(), np.ones(part.num_rows), np.bincount(row, minlength=part.num_rows), key, tf)

    toks = sections.select("corpus", _id(), tokens(*[F.col(c) for c in columns]).alias("toks"))
    return _packed(toks.select("corpus", "id", F.size("toks").cast("long").alias("dl"), "toks").mapInArrow(run, PACKED))


def _scored(packed: DataFrame, rows: list, number: dict[tuple[str, str], int], stats: DataFrame, depth: int, kind: DataType) -> DataFrame:
    """(qid, corpus, id, score) of the best texts of each task. rows: (corpus, key, qid, times), at most BROADCAST_TERMS; kind: the type of qid."""
    spark = packed.sparkSession
    found = {r[0]: r[1] for r in packed.select("keys").mapInArrow(_counted, "key int, n long").groupBy("key").agg(F.sum("n")).collect()}  # a row a key
    sizes = {r["corpus"]: (r["n_docs"], r["avgdl"]) for r in stats.select("corpus", "n_docs", "avgdl").collect()}  # a row a corpus
    n_docs, avgdl = (np.array([sizes[c][k] if c in sizes else 0 for c, _ in number], np.float64) for k in (0, 1))
    n = np.array([found.get(k, 0) for k in range(len(number))], np.float64)
    idf = np.log((np.maximum(n_docs, n) - n + 0.5) / (n + 0.5))
    idf = np.where(idf > 0, idf, 1e-6)
    qids = list(dict.fromkeys(r[2] for r in rows))
    place = {q: k for k, q in enumerate(qids)}
    rows = sorted(rows, key=lambda r: number[r[0], r[1]])
    starts = np.searchsorted([number[r[0], r[1]] for r in rows], np.arange(len(number) + 1))
    shared = spark.sparkContext.broadcast(Asked(qids, idf, avgdl, starts, np.array([place[r[2]] for r in rows], np.int64), np.array([r[3] for r in rows], np.float64)))
    texts, arrow = max(1, min(BLOCK_TEXTS, BLOCK_SCORES // len(qids))), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        width = len(asked.qids)
        names: list[str] = []
        least: list[np.ndarray] = []  # by corpus: a score that each query's best reach
        parts: list[tuple[np.ndarray, ...]] = []  # (corpus and query, score, id)
        size = 0

        def best() -> tuple[np.ndarray, ...]:
            slot, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            kept = _top(slot, score, ids, depth)
            slot, score, ids = slot[kept], score[kept], ids[kept]
            heads = _heads(slot)
            for head, n in zip(heads, np.diff(np.append(heads, len(slot))), strict=True):
                if n == depth:
                    least[slot[head] // width][slot[head] % width] = score[head + n - 1]
            return slot, score, ids

        for block in _texts(batches, texts, BLOCK_TERMS):
            corpora, group, ids, dl = _numbers(block)
            row, key, tf = _lists(block)
            heads = _heads(group, ids)
            text = np.zeros(block.num_rows, np.int64)
            text[heads[1:]] = 1
            raw = asked.scores(np.cumsum(text)[row], len(heads), dl[row], key, tf)
            scores = np.round(raw, 9)
            for g, name in enumerate(corpora):
                if name not in names:
                    names.append(name)
                    least.append(np.zeros(width))
                own = names.index(name)
                mine = np.flatnonzero(group[heads] == g)
                at, query = np.nonzero((raw[mine] > 0) & (scores[mine] >= least[own]))
                at = mine[at]
                parts.append((own * width + query, scores[at, query], ids[heads[at]]))
                size += len(at)
            if size > GATHERED:
                parts[:] = [best()]
                size = len(parts[0][0])
        if parts:
            slot, score, ids = best()
            for first in range(0, len(slot), 10_000):
                some = slice(first, first + 10_000)
                asking = pa.array([asked.qids[k] for k in slot[some] % width], arrow)
                yield pa.RecordBatch.from_arrays([asking, pa.array([names[k] for k in slot[some] // width], pa.string()), pa.array(ids[some]), pa.array(score[some])], ["qid", "corpus", "id", "score"])

    out = packed.mapInArrow(run, f"qid {kind.simpleString()}, corpus string, id long, score double")
    return out.select("qid", "corpus", F.nullif("id", F.lit(NO_ID)).alias("id"), F.round("score", 9).alias("score"))

r"""LM scoring: an interpolated modified Kneser-Ney n-gram model.

*Counting.* Workers hash the words of whole training texts and reduce them to
distinct n-grams with counts before anything is shuffled; packed arrays of
them, not rows, go to buckets on a grid of (context, last word), so even a word
that is in every bigram spreads over a row of buckets.  One more exchange a
level turns distinct n-grams into context sums (total, and how many words
follow once, twice, more often) and into continuation counts of the next lower
order.

*Storage.* Each bucket is a file of a sorted 64-bit hash array and its values
in the shared folder, written under a temporary name and renamed, so a task
that runs again only replaces it.  What the driver and each worker hold of the
model is a bit a file and a few sums, which Spark aggregates.

*Scoring.* Workers memory-map the files and look a batch's distinct n-grams up
in sorted order, which touches pages in sequence.  Where the shared folder
isn't a mounted file system, see files.py.

Base model: log10((c + 0.5) / (N + 0.5 (V + 1))).  The lowest order of the
Kneser-Ney model interpolates with 1 / (V + 1), so unknown words have a
probability and all probabilities of a context sum to 1.

ORDER is 2 by default: 3 works the same way, but its distinct trigrams alone
need more disk than the budget of 4 times the input (see README).

Tokens: words ``[^\x20\x09-\x0D]+``, A-Z lower-cased, then one end token a text.
Training rows: crc32(doc_id as text) mod 5 is not 1.

Edge cases: null or empty text is its end token.  A null doc_id counts as the
text "".  Repeated rows count again and are scored one by one.  Without training
rows N and V are 0 and every probability is that of the uniform model over one
token.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, chain64, free_shuffles, read_table, scratch, space_words, staged, staged_path, text_batches
from .files import map_bytes, write_arrays

ORDER = 2
FOLDS, HELD_OUT = 5, 1
#: N-grams that a worker reduces at once, and that a bucket holds, about.
FLUSH = 2_000_000
BUCKET = 1_500_000
#: Tokens scored at once, about; a text is never cut.
BATCH = 600_000
BEGIN, END = np.uint64(0x5BF0_3635_0D8E_8A11), np.uint64(0x2545_F491_4F6C_DD1D)


# --- counting ---------------------------------------------------------------


def ngram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of each row of words (n, k)."""
    h = words[:, 0]
    for k in range(1, words.shape[1]):
        h = chain64(h, words[:, k])
    return h


def bucket_of(words: np.ndarray, grid: int) -> np.ndarray:
    """Bucket on the grid of (context, last word); of a single word, its own."""
    if words.shape[1] == 1:
        return (words[:, 0] % np.uint64(grid * grid)).astype(np.int64)
    return grid_bucket(ngram_hash(words[:, :-1]), words[:, -1], grid)


def grid_bucket(context: np.ndarray, word: np.ndarray, grid: int) -> np.ndarray:
    return (context % np.uint64(grid)).astype(np.int64) * grid + (word % np.uint64(grid)).astype(np.int64)


def reduced(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows with summed counts, and their hashes, sorted by hash."""
    h = ngram_hash(words)
    order = np.argsort(h, kind="stable")
    h = h[order]
    heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return words[order[heads]], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0], h[heads]


def packed(kind: str, level: int, bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(kind, level, bucket, n, bytes of the arrays) per bucket. Rows go by the first array, so that its repeats compress."""
    order = np.lexsort((arrays[0], bucket))
    names, heads = np.unique(bucket[order], return_index=True)
    for b, rows in zip(names.tolist(), np.split(order, heads[1:]), strict=True):
        yield kind, level, b, len(rows), b"".join(np.ascontiguousarray(a[rows]).tobytes() for a in arrays)


PACK = "kind string, level int, bucket long, n long, body binary"
_PACK = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
#: Rows of kind 's...' say what was stored: how many of a bucket, their sum, and how many occur 1 to 4 times.
STATS = ("total", "n1", "n2", "n3", "n4")
REDUCED = f"{PACK}, {', '.join(f'{x} long' for x in STATS)}"
#: Types of the arrays of a stored file.
STORED = {"g": ("<u8", "<u4"), "u": ("<u8", "<u8"), "c": ("<u8", "<u8", "<u8", "<u8", "<u8")}


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACK, strict=True)], schema=_PACK)


def streams(words: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded token stream, the places of the scored tokens in it, and the first of these per text."""
    pad = np.full(max(1, order - 1), BEGIN)
    pieces = [x for w in words for x in (pad, w, np.array([END]))]
    stream = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    firsts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(words) + 1) * len(pad), sizes)
    return stream, at, firsts


def count_ngrams(texts: DataFrame, order: int, grid: int) -> DataFrame:
    """Packed partial counts: kind 'g' of n-grams, kind 'u' of single tokens. texts: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, waiting, n = WordHashes(), [], 0

        def out() -> pa.RecordBatch:
            stream, at, _ = streams(waiting, order)
            grams = np.stack([stream[at - k] for k in range(order - 1, -1, -1)], axis=1)
            words, counts, _ = reduced(grams, np.ones(len(grams), np.uint64))
            rows = list(packed("g", order, bucket_of(words, grid), [*words.T, counts.astype(np.uint32)]))
            words, counts, _ = reduced(stream[at][:, None], np.ones(len(at), np.uint64))
            return _table(rows + list(packed("u", 1, bucket_of(words, grid), [*words.T, counts.astype(np.uint32)])))

        for _, texts_ in text_batches(batches, "id", "text", 2_000_000):
            for text in texts_:
                waiting.append(hashes.array(space_words(text)))
                n += len(waiting[-1]) + 1
                if n >= FLUSH:
                    yield out()
                    waiting, n = [], 0
        if waiting:
            yield out()

    return texts.mapInArrow(run, PACK)


def _reduced_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*r, *[0] * len(STATS))[: len(_PACK) + len(STATS)] for r in rows], columns=[*(f.name for f in _PACK), *STATS])


def _stored(base: str, kind: str, level: int, bucket: int, arrays: list[np.ndarray]) -> None:
    write_arrays(base, f"{kind}{level}-{bucket}", [a.astype(t) for a, t in zip(arrays, STORED[kind], strict=True)])


def _level(base: str, grid: int):
    """Reduce one bucket of packed counts: write its file, and send on what other levels need."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kind, level, bucket = frame["kind"].iloc[0], int(frame["level"].iloc[0]), int(frame["bucket"].iloc[0])
        words, counts = [], []
        for n, body in zip(frame["n"], frame["body"], strict=True):
            words.append(np.frombuffer(body, np.uint64, n * level).reshape(level, n).T)
            counts.append(np.frombuffer(body, np.uint32, n, n * level * 8).astype(np.uint64))
        grams, counts, h = reduced(np.concatenate(words), np.concatenate(counts))
        if kind == "g":  # one n-gram as often as 4 thousand million times scores as that often
            counts = np.minimum(counts, np.uint64(2**32 - 1))
        _stored(base, kind, level, bucket, [h, counts])
        rows = [("s" + kind, level, bucket, len(h), b"", int(counts.sum()), *(int((counts == k).sum()) for k in (1, 2, 3, 4)))]
        if kind == "g" and level > 1:
            context = ngram_hash(grams[:, :-1])
            order = np.argsort(context, kind="stable")
            context, c = context[order], counts[order]
            heads = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            sums = [np.add.reduceat(x.astype(np.uint64), heads) for x in (c, c == 1, c == 2, c > 2)]
            rows += packed("c", level, (context[heads] % np.uint64(grid * grid)).astype(np.int64), [context[heads], *sums])
            lower, kinds, _ = reduced(grams[:, 1:], np.ones(len(grams), np.uint64))
            rows += packed("g", level - 1, bucket_of(lower, grid), [*lower.T, kinds.astype(np.uint32)])
        return _reduced_frame(rows)

    return run


def _contexts(base: str):
    """Sum the context sums of one bucket and write its file."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        level, bucket = int(frame["level"].iloc[0]), int(frame["bucket"].iloc[0])
        table = np.concatenate([np.frombuffer(body, np.uint64).reshape(5, -1) for body in frame["body"]], axis=1)
        table = table[:, np.argsort(table[0], kind="stable")]
        heads = np.flatnonzero(np.concatenate(([True], table[0, 1:] != table[0, :-1])))
        _stored(base, "c", level, bucket, [table[0, heads], *(np.add.reduceat(x, heads) for x in table[1:])])
        return _reduced_frame([("sc", level, bucket, len(heads), b"")])

    return run


class Model:
    """What workers need to score: where the files are, which there are (a bit each), and sums."""

    def __init__(self, base: str, order: int, grid: int) -> None:
        self.base, self.order, self.grid = base, order, grid
        self.files: dict[tuple[str, int], np.ndarray] = {}
        self.sizes: dict[tuple[str, int], int] = {}
        self.stats: dict[tuple[str, int], np.ndarray] = {}

    def note(self, reduced_: DataFrame) -> None:
        """reduced_: staged rows, of which those that say what was stored are summed by Spark."""
        said = reduced_.filter(F.col("kind").startswith("s"))
        bits = F.bit_or(F.expr("shiftleft(1L, cast(bucket % 64 as int))"))
        sums = said.groupBy("kind", "level", F.expr("bucket div 64").alias("word")).agg(bits.alias("bits"), F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in STATS])
        for r in sums.collect():  # a row for 64 files
            key = (r["kind"][1:], r["level"])
            self.files.setdefault(key, np.zeros(-(-self.grid * self.grid // 64), np.int64))[r["word"]] = r["bits"]
            self.sizes[key] = self.sizes.get(key, 0) + r["n"]
            self.stats[key] = self.stats.get(key, np.zeros(len(STATS), np.int64)) + np.array([r[x] for x in STATS], np.int64)

    @property
    def tokens(self) -> int:
        return int(self.stats[("u", 1)][0]) if ("u", 1) in self.stats else 0

    @property
    def vocabulary(self) -> int:
        return self.sizes.get(("u", 1), 0)

    def discounts(self, level: int) -> np.ndarray:
        """D for counts 0, 1, 2 and more."""
        _, n1, n2, n3, n4 = (float(x) for x in self.stats[("g", level)])
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
        return np.array([0.0, *(min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else y * k / 2 for k, a, b in pairs)])

    def look(self, kind: str, level: int, keys: np.ndarray, bucket: np.ndarray, columns: int = 1) -> np.ndarray:
        """(columns, len(keys)) values of sorted keys, 0 where absent."""
        out = np.zeros((columns, len(keys)), np.float64)
        if (kind, level) not in self.files:
            return out
        files, kinds = self.files[kind, level], STORED[kind]
        wide = sum(np.dtype(t).itemsize for t in kinds)
        order = np.argsort(bucket, kind="stable")
        names, heads = np.unique(bucket[order], return_index=True)
        for b, rows in zip(names.tolist(), np.split(order, heads[1:]) if len(order) else [], strict=True):
            if not int(files[b >> 6]) >> (b & 63) & 1:
                continue
            body = map_bytes(self.base, f"{kind}{level}-{b}")
            n, at, arrays = len(body) // wide, 0, []
            for t in kinds:
                arrays.append(np.frombuffer(body, t, n, at))
                at += n * np.dtype(t).itemsize
            h, *values = arrays
            place = np.minimum(np.searchsorted(h, keys[rows]), n - 1)
            good = np.asarray(h[place]) == keys[rows]
            for k in range(columns):
                out[k, rows[good]] = values[k][place[good]]
        return out

    def score(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n_known, base score, score) of texts given as word hashes."""
        stream, at, firsts = streams(words, self.order)
        cells = np.uint64(self.grid * self.grid)
        h, p, n_known, base = stream, None, None, None
        context = None  # of the current level: totals and followers at each place of the stream
        for level in range(1, self.order + 1):
            if level > 1:
                previous = np.concatenate((h[:1], h[:-1]))
                h = chain64(previous, stream)
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            bucket = grid_bucket(previous[first], stream[first], self.grid) if level > 1 else (keys % cells).astype(np.int64)
            counts = self.look("g", level, keys, bucket)[0][back][at]
            if level == 1:
                raw = self.look("u", 1, keys, bucket)[0][back][at]
                base = np.log10((raw + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
                n_known = (raw > 0).astype(np.int64)
                total = float(self.stats[("g", 1)][0]) if ("g", 1) in self.stats else 0.0
                if total:
                    d = self.discounts(1)
                    n1, n2 = self.stats[("g", 1)][1:3].astype(float)
                    more = self.sizes["g", 1] - n1 - n2
                    p = (np.maximum(counts - d[np.minimum(counts, 3).astype(int)], 0) + (d[1] * n1 + d[2] * n2 + d[3] * more) / (self.vocabulary + 1)) / total
                else:
                    p = np.full(len(at), 1.0 / (self.vocabulary + 1))
            elif ("g", level) in self.stats:
                d = self.discounts(level)
                total, n1, n2, more = context[:, at - 1]
                seen = total > 0
                mass = np.maximum(counts - d[np.minimum(counts, 3).astype(int)], 0) + (d[1] * n1 + d[2] * n2 + d[3] * more) * p
                p = np.where(seen, mass / np.where(seen, total, 1), p)
            if level < self.order:
                context = self.look("c", level + 1, keys, (keys % cells).astype(np.int64), 4)[:, back]
        sums = lambda x: np.add.reduceat(x, firsts) if len(firsts) else x[:0]
        return sums(n_known), sums(base), sums(np.log10(p))


def train(texts: DataFrame, order: int = ORDER, bucket: int = BUCKET) -> Model:
    """Count (id, text) and store the model in the shared folder."""
    spark = texts.sparkSession
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    grid = max(1, math.ceil(math.sqrt(chars / 5 / bucket)))
    with scratch(spark):
        model = Model(staged_path(spark, "ngrams", keep=True), order, grid)
        packs = count_ngrams(texts, order, grid)
        for level in range(order, 0, -1):
            grams = packs.filter((F.col("kind") == "u") | (F.col("kind") == "g") & (F.col("level") == level)).select(*[f.name for f in _PACK])
            packs = staged(grams.groupBy("kind", "level", "bucket").applyInPandas(_level(model.base, grid), REDUCED), f"ngram-level{level}")
            model.note(packs)
            contexts = packs.filter("kind = 'c'").select(*[f.name for f in _PACK]).groupBy("level", "bucket").applyInPandas(_contexts(model.base), REDUCED)
            model.note(staged(contexts, f"ngram-contexts{level}"))
            packs = packs.filter("kind = 'g'")
            free_shuffles(spark)
    return model


def score_texts(texts: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # a bit a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lm = WordHashes(), shared.value
        ids, held, words, n = [], [], [], 0
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def out() -> pa.RecordBatch:
            known, base, score = lm.score(words)
            sizes = np.array([len(w) + 1 for w in words], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes), pa.array(known, pa.int64()), pa.array(np.full(len(ids), lm.tokens, np.int64)), pa.array(base), pa.array(score)], names)

        for keys, texts_ in text_batches(batches, "key", "text", 2_000_000):
            for (key, fold), text in zip(map(_pair, keys), texts_, strict=True):
                ids.append(key)
                held.append(fold)
                words.append(hashes.array(space_words(text)))
                n += len(words[-1]) + 1
                if n >= BATCH:
                    yield out()
                    ids, held, words, n = [], [], [], 0
        if ids:
            yield out()

    keyed = texts.select(F.struct("id", "held_out").alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _pair(key: dict) -> tuple[int | None, bool]:
    return key["id"], key["held_out"]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    return score_texts(rows, train(rows.filter(~F.col("held_out")).select("id", "text"), order))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return staged(score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "lm-scores", keep=True)

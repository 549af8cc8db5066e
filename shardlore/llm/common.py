"""Helpers shared by the training-data operators.

Shared storage: every intermediate table goes below the folder that the
session names in ``spark.checkpoint.dir``.  Only in a local session where that
is unset (tests, notebooks) a temporary folder is made and set; on a cluster an
unset folder is an error.  Nothing here writes to a machine-local folder on a
cluster.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose hashes a worker keeps at once (about 150 bytes each).
HASH_CACHE = 400_000
#: Paths to drop, a list for each open :func:`scratch`.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shardlore-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/shardlore-{sc.applicationId}"


def staged_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new path of the shared folder; it is dropped with the open scratch (keep: with the one around that)."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    open_ = _SCRATCH.get()
    if len(open_) > keep:
        open_[-1 - keep].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is dropped at the end, but for what is staged to be kept."""
    mine: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), mine))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in mine:
            drop_path(spark, path)
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Spark drops shuffle files once the driver's garbage collector finds their plans unused; a long job asks for that between its steps."""
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, tag: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends at the files."""
    spark = df.sparkSession
    path = staged_path(spark, tag, keep)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row's columns (but for maps, which have no hash): rows of one hash are equal but for collisions."""

    def hashable(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(hashable(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return hashable(kind.elementType)
        return not isinstance(kind, T.MapType)

    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f.dataType)])


def whole_row(df: DataFrame) -> Column:
    """All columns in one, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def once_each(keyed: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """keyed with one row of each key; repeated: the keys with more, staged. Which of them stays depends on the rows alone."""
    if not repeated.limit(1).count():
        return keyed
    rest = [c for c in keyed.columns if c != key]
    many = keyed.join(repeated, key, "left_semi")
    picked = many.groupBy(key).agg(F.min_by(F.struct(*rest), row_hash(many)).alias("picked")).select(key, "picked.*")
    return keyed.join(repeated, key, "left_anti").unionByName(picked)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_shared(spark: SparkSession) -> None:
    """Drop every table this application staged; earlier results become unreadable."""
    drop_path(spark, shared_dir(spark))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_CACHE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def space_words(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; bytes methods touch ASCII only."""
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain64(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two hashes."""
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) + mix64(right))


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def text_batches(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, chars: int = 8_000_000):
    """Yield (ids, texts as bytes) in pieces of about that many bytes; one text is never cut."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(batch.schema.get_field_index(id_col)).to_pylist(), binary_column(batch, text_col), strict=True):
            ids.append(key)
            texts.append(text)
            size += len(text or b"") + 32
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts

"""The index store: one folder of Parquet tables per corpus, and the federation catalog."""

from __future__ import annotations

import posixpath
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..operators.bm25 import corpus_stats, postings

TABLES = ("sections", "links", "vectors", "postings", "stats", "meta")


def write_meta(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Upsert: the few rows are read, the newest of each key kept, and the table rewritten."""
    new = spark.createDataFrame([(k, str(v), 1) for k, v in values.items()], "key string, value string, age int")
    try:
        old = spark.createDataFrame(spark.read.schema(schema.META).parquet(path).collect(), schema.META).withColumn("age", F.lit(0))
        new = new.unionByName(old)
    except Exception as error:  # noqa: BLE001 - a first write has no table to merge with
        if "PATH_NOT_FOUND" not in str(error):
            raise
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("age")))
    new.withColumn("n", newest).filter("n = 1").select("key", "value").coalesce(1).write.mode("overwrite").parquet(path)


def read_meta(meta: DataFrame, key: str, default: str | None = None) -> str | None:
    row = meta.filter(F.col("key") == key).select("value").first()
    return row[0] if row and row[0] is not None else default


def derived_meta(sections: DataFrame, links: DataFrame) -> dict[str, str]:
    """section_count, link_count, resolved_count and source_kinds (``kind:count``, by kind)."""
    kinds = sections.groupBy("source_kind").count()
    text = kinds.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "source_kind", F.col("count").cast("string")))), ",")).first()[0]  # a row a kind
    n, resolved = links.agg(F.count(F.lit(1)), F.count("resolved_id")).first()
    return {"section_count": str(sections.count()), "link_count": str(n), "resolved_count": str(resolved), "source_kinds": text or ""}


def write_index(path: str, corpus: str, sections: DataFrame, links: DataFrame, vectors: DataFrame, meta: dict[str, str], dim: int) -> None:
    """Replace the index at path. Sections are partitioned by kind, so a kind filter prunes; postings are sorted by term."""
    spark = sections.sparkSession
    own = sections.withColumn("corpus", F.lit(corpus)).select(*schema.SECTIONS.names)
    own.write.mode("overwrite").partitionBy("source_kind").parquet(f"{path}/sections")
    own = spark.read.parquet(f"{path}/sections")
    links.select(*schema.LINKS.names).write.mode("overwrite").parquet(f"{path}/links")
    right = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding hasn't {dim} components")))
    vectors.select(F.lit(corpus).alias("corpus"), "id", right.alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")
    # by id as well: a term of every section is many ranges
    postings(own).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    corpus_stats(own).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    base = {"schema_version": str(schema.VERSION), "embed_dim": str(dim), **derived_meta(own, links)}
    write_meta(spark, f"{path}/meta", base | meta)


@dataclass
class Corpus:
    name: str
    path: str
    docs_root: str
    default_kind: str
    has_kind: bool
    embed_model: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def sections(self) -> DataFrame:
        """With the corpus' name, and a constant kind where the index is from before there were kinds."""
        df = self.tables["sections"].withColumn("corpus", F.lit(self.name))
        return df if self.has_kind else df.withColumn("source_kind", F.lit(self.default_kind))

    def table(self, name: str) -> DataFrame:
        return self.tables[name].withColumn("corpus", F.lit(self.name))


def open_corpus(spark: SparkSession, path: str, name: str | None = None) -> Corpus:
    """Open an index; ValueError if it has no docs root."""
    path = path.rstrip("/")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    meta = {r["key"]: r["value"] for r in tables["meta"].collect()}
    if not meta.get("docs_root_relative"):
        raise ValueError(f"{path} has no docs_root_relative")
    kind = "html" if meta.get("source_format") == "html" else "rst"
    root = meta["docs_root_relative"]
    root = posixpath.normpath(root if "://" in root or root.startswith("file:") else posixpath.join(posixpath.dirname(path), root))
    return Corpus(name or corpus_name(path, set()), path, root, kind, "source_kind" in tables["sections"].columns, meta.get("embed_model", ""), tables)


def corpus_name(path: str, taken: set[str]) -> str:
    """The last ``-`` part of the folder's stem, or the stem where that is taken."""
    stem = posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]
    short = stem.rsplit("-", 1)[-1]
    return short if short and short not in taken else stem


class Catalog:
    """Corpora in the order they were opened; the first is the default."""

    def __init__(self, corpora: list[Corpus]) -> None:
        self.corpora = {c.name: c for c in corpora}

    @classmethod
    def open(cls, spark: SparkSession, paths: list[str], embed_model: str = "") -> Catalog:
        """Missing or broken indexes are skipped with a warning; another embedding model only warns."""
        found: list[Corpus] = []
        for path in paths:
            try:
                corpus = open_corpus(spark, path, corpus_name(path, {c.name for c in found}))
            except Exception as error:  # noqa: BLE001 - one broken index must not take the others along
                warnings.warn(f"skipping {path}: {error}", stacklevel=2)
                continue
            if embed_model and corpus.embed_model and corpus.embed_model != embed_model:
                warnings.warn(f"{path} was embedded with {corpus.embed_model}, queries are with {embed_model}", stacklevel=2)
            found.append(corpus)
        return cls(found)

    @property
    def names(self) -> list[str]:
        return list(self.corpora)

    @property
    def federated(self) -> bool:
        return len(self.corpora) > 1

    def union(self, table: str) -> DataFrame:
        parts = [c.sections() if table == "sections" else c.table(table) for c in self.corpora.values()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

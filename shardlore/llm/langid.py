r"""Language identification by Bayesian evidence fusion.

For each language l the log posterior adds up

* text: log likelihood of the byte trigrams under a smoothed trigram model,
  tempered to at most ``TEXT_WEIGHT`` trigrams' worth (trigrams overlap, so a
  long text isn't as much evidence as its length says);
* declared: log P(declared markup language | l), the address suffix:
  log P(suffix | l), both from counts over the whole table;
* host: log prior of l at this host, smoothed towards its domain's, which is
  smoothed towards the table's, each by ``KAPPA`` pseudo-rows.

Counts come from grouped aggregation of the text-only decisions of *all* rows
(partial aggregates first; a hot host is one row of the result), and a row's own
vote is taken out of its host's and domain's counts.  A background model, even
over all trigrams, stands for no known language: ``und``.  Texts without a
letter are ``und`` as well.

The languages are those that at least ``LEAST_LABELLED`` rows are labelled with,
the ``MOST_LANGUAGES`` most frequent ones if there are more (a bound on the
model's size).  The text model is fitted on at most ``SAMPLE`` documents of each
(those of the smallest hashed ids), a documented bound.  Everything else covers
all rows and whole texts.

Edge cases: null or empty text, host, declared language or suffix is no
evidence.  Repeated rows are judged one by one.  Without any labelled document
all is ``und``.  Empty tables give empty results.  Only the named columns are
read, so extra ones don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_column, read_table, scratch, staged

SAMPLE = 500
#: Labelled rows that a language needs to be modelled, and languages at most.
LEAST_LABELLED, MOST_LANGUAGES = 3, 500
#: So many times the sample is ranked: fewer than SAMPLE of 4,000 expected hashes are never met in practice.
SPARE = 8
BINS = 1 << 16
KAPPA = 5.0
#: Trigrams' worth of evidence of a long text at most.
TEXT_WEIGHT = 200.0
#: Prior weight of no known language.
BACKGROUND = 0.01
#: P(declared = l | l) comes from counts smoothed by this many rows that agree.
TRUST = 8.0

# what isn't closed goes to the end, so that no place is scanned again
_TAGS = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|</?[a-z!?][^>]*(?:>|\Z)", re.S | re.I)
_LANG = re.compile(rb"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)
_LETTER = re.compile(rb"[A-Za-z\xc3-\xf4]")


def page_text(html: bytes | None) -> bytes:
    return _TAGS.sub(b" ", html or b"")


def declared_language(html: bytes | None) -> str | None:
    found = _LANG.search(html or b"")
    return found[1].decode().lower() if found else None


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of letters, each run of other ASCII as one space."""
    b = np.frombuffer(b" " + b" ".join(_WORD.findall(text.lower())) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


_WORD = re.compile(rb"[a-z\x80-\xff]+")


@dataclass
class TextModel:
    """logs: (len(languages) + 1, BINS) log probabilities; the last row is the background."""

    languages: tuple[str, ...]
    logs: np.ndarray


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, least: int = LEAST_LABELLED, sample: int = SAMPLE) -> TextModel:
    """The languages that the labels name, and their trigrams in at most sample rows each."""
    label = F.lower(F.btrim(F.col(label_col)))
    named = labelled.filter(~label.isin("", "und")).select(F.col(id_col).alias("id"), label.alias("label")).withColumn("h", F.xxhash64("id"))
    # hashes are even, so the smallest of n rows lie below a known bound; what is above it needn't be ranked
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("id").alias("n")).filter(F.col("rows") >= least).orderBy(F.desc("rows"), "label").limit(MOST_LANGUAGES).collect()
    languages = tuple(sorted(r["label"] for r in sizes))
    bounds = {r["label"]: -(2**63) + min(2**64 - 1, 2**64 * SPARE * sample // max(1, r["n"])) for r in sizes}
    below = reduce(lambda a, b: a | b, [(F.col("label") == label) & (F.col("h") <= bound) for label, bound in bounds.items()], F.lit(False))
    order = Window.partitionBy("label").orderBy("h", "id")
    chosen = named.filter(below).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).select("id", "label").dropDuplicates()
    # at most sample * len(languages) ids
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(binary_column(batch, "text"), batch.column(batch.schema.get_field_index("label")).to_pylist(), strict=True):
                found = np.bincount(trigrams(text or b""), minlength=BINS)
                sums[label] = sums[label] + found if label in sums else found
        for label, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(found[at])], ["label", "bin", "n"])

    counts = rows.select("text", "label").mapInArrow(count, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages) + 1, BINS))
    for label, at, n in counts.toLocalIterator():
        table[languages.index(label), at] = n
    model = np.log((table + 0.05) / (table.sum(axis=1, keepdims=True) + 0.05 * BINS))
    # even over the trigrams that some language has: text unlike every language does better here
    model[-1] = -np.log(max(2.0, float((table.sum(axis=0) > 0).sum()) * 4))
    return TextModel(languages, model.astype(np.float32))


def text_evidence(rows: DataFrame, model: TextModel, html: bool = False) -> DataFrame:
    """rows (id, text, host, declared) -> id, host, domain, suffix, declared, n (trigrams), logs (one a class), vote."""
    shared = rows.sparkSession.sparkContext.broadcast(model.logs)  # at most (MOST_LANGUAGES + 1, BINS) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = binary_column(batch, "text")
            declared = [declared_language(t) for t in texts] if html else batch.column(batch.schema.get_field_index("declared")).to_pylist()
            logs, sizes, votes = [], [], []
            for text in texts:
                text = page_text(text) if html else text or b""
                found = trigrams(text) if _LETTER.search(text) else np.zeros(0, np.int64)
                total = np.zeros(len(table))
                for k in range(0, len(found), 1 << 20):
                    total += table[:, found[k : k + (1 << 20)]].sum(axis=1, dtype=np.float64)
                total *= min(1.0, TEXT_WEIGHT / max(1, len(found)))
                logs.append(total.tolist())
                sizes.append(len(found))
                best = int(np.argmax(total))
                votes.append(best if len(found) and best < len(table) - 1 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(batch.schema.get_field_index("host")), pa.array(declared, pa.string()), pa.array(sizes, pa.int64()), pa.array(logs, pa.list_(pa.float64())), pa.array(votes, pa.int32())],
                ["id", "host", "declared", "n", "logs", "vote"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, host string, declared string, n long, logs array<double>, vote int")
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, F.size(labels) - 1, 2), "."))
    suffix = F.when(F.size(labels) >= 2, F.element_at(labels, -1))
    return out.withColumn("domain", F.when(F.col("host") != "", domain)).withColumn("suffix", F.when(F.col("host") != "", suffix))


def fuse(evidence: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """evidence (staged) -> id, host, declared, suffix, text_lang, lang ('und': none), confidence."""
    k = len(languages)
    if not k:  # nothing is labelled
        return evidence.select("id", "host", "declared", "suffix", F.lit("und").alias("text_lang"), F.lit("und").alias("lang"), F.lit(1.0).alias("confidence"))
    tally = [F.count_if(F.col("vote") == i).alias(f"v{i}") for i in range(k)]
    whole = evidence.agg(*tally).first()
    total = sum(whole)
    base = [(whole[i] + 1.0) / (total + k) for i in range(k)]

    def counts(key: str, prefix: str) -> DataFrame:
        named = [F.count_if(F.col("vote") == i).alias(f"{prefix}{i}") for i in range(k)]
        # written, so that its size is known before the join: few hosts are broadcast, and rows are dealt by host only where hosts are many
        return staged(evidence.filter(F.col(key).isNotNull()).groupBy(key).agg(*named), f"lang-{key}")

    out = evidence
    for key, prefix in (("host", "h"), ("domain", "d"), ("declared", "c"), ("suffix", "s")):
        out = out.join(counts(key, prefix), key, "left")
    own = lambda i: F.coalesce((F.col("vote") == i).cast("double"), F.lit(0.0))
    less = lambda prefix, i: F.coalesce(F.col(f"{prefix}{i}") - own(i), F.lit(0.0))
    sums = {p: sum((less(p, i) for i in range(1, k)), less(p, 0)) for p in ("h", "d")}
    scores = []
    for i, lang in enumerate(languages):
        at_domain = (less("d", i) + KAPPA * base[i]) / (sums["d"] + KAPPA)
        at_host = (less("h", i) + KAPPA * at_domain) / (sums["h"] + KAPPA)
        agree = F.coalesce((F.col("declared") == lang).cast("double"), F.lit(0.0))
        said = F.when(F.col("c0").isNotNull(), F.log((F.coalesce(F.col(f"c{i}"), F.lit(0)) + 1 + TRUST * agree) / (whole[i] + k + TRUST))).otherwise(0.0)
        placed = F.when(F.col("s0").isNotNull(), F.log((F.coalesce(F.col(f"s{i}"), F.lit(0)) + 1.0) / (whole[i] + k))).otherwise(0.0)
        scores.append(F.element_at("logs", i + 1) + F.log(at_host * (1 - BACKGROUND)) + said + placed)
    # no known language: the declared tag and the suffix are as likely as over all rows
    said = F.when(F.col("c0").isNotNull(), F.log((sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0")) + 1.0) / (total + k))).otherwise(0.0)
    placed = F.when(F.col("s0").isNotNull(), F.log((sum((F.col(f"s{i}") for i in range(1, k)), F.col("s0")) + 1.0) / (total + k))).otherwise(0.0)
    scores.append(F.element_at("logs", k + 1) + F.log(F.lit(BACKGROUND)) + said + placed)
    out = out.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    best = F.array_position("scores", F.col("top")).cast("int")
    named = F.element_at(F.array(*[F.lit(x) for x in (*languages, "und")]), best)
    known = (F.col("n") > 0) & F.lit(total > 0)
    weight = F.aggregate(F.transform("scores", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    text_lang = F.element_at(F.array(*[F.lit(x) for x in languages]), F.col("vote") + 1)
    return out.select("id", "host", "declared", "suffix", F.coalesce(text_lang, F.lit("und")).alias("text_lang"), F.when(known, named).otherwise("und").alias("lang"), F.when(known, 1 / weight).otherwise(1.0).alias("confidence"))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Languages of (page_id, url, html), with the text model of labelled docs (doc_id, text, lang)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:@]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), F.nullif(host, F.lit("")).alias("host"))
    model = fit(docs, "doc_id", "text", "lang")
    return fuse(staged(text_evidence(rows, model, html=True), "lang-evidence"), model.languages)


def identify_documents(docs: DataFrame, key: F.Column | None = None) -> DataFrame:
    """Languages of documents: lang is the declared language, source the host, id the key (doc_id, if none is given)."""
    docs = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("id"), *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")])
    rows = docs.select("id", "text", F.col("source").alias("host"), F.lower(F.btrim("lang")).alias("declared"))
    model = fit(docs, "id", "text", "lang")
    return fuse(staged(text_evidence(rows, model), "lang-evidence"), model.languages)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents")
    out = identify_pages(pages.select("page_id", "url", "html"), docs.select("doc_id", "text", "lang"))
    return out.withColumnRenamed("id", "page_id").withColumn("confidence", F.round("confidence", 6))


def document_key() -> F.Column:
    """All that the language of a document is judged by, and its id."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text"), F.col("source").alias("source"), F.col("lang").alias("lang"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those judged 'und' go. Every row is judged by its own text, source and declared language."""
    with scratch(spark):
        unknown = identify_documents(docs, document_key()).filter("lang = 'und'").select(F.col("id").alias("gone")).dropDuplicates()
        # written, so that its size is known before the join: texts are shuffled only if it is large
        gone = staged(unknown, "lang-gone", keep=True)
    return docs.join(gone, document_key() == gone["gone"], "left_anti").select(*[f"`{c}`" for c in docs.columns])

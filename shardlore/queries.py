"""The engine's queries over the given tables, by name, and their SQL for DuckDB.

documents, pages and conversations stand for three corpora; lineitem, part and
orders for large edge lists.  Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import bm25, embed, fusion, graph, knn, parsing
from .plans import search
from .registry import query
from .schema import LINKS, SECTIONS
from .sources import store
from .sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpora ---------------------------------------------------------------------

#: corpus -> (table, id, repo, path, text, kind), the same in both dialects.
CORPORA = {
    "documents": ("documents", "doc_id", "source", "concat(source, '/', CAST(doc_id AS {s}), '.rst')", "text", "CASE WHEN lang = 'en' THEN 'rst' ELSE 'code' END"),
    "pages": ("pages", "page_id", "'web'", "concat('web/', CAST(page_id AS {s}), '.html')", "html", "'html'"),
    "conversations": ("conversations", "conv_id * 100000 + turn", "'chat'", "concat('chat/', CAST(conv_id AS {s}), '.md')", "text", "'rst'"),
}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, ident, repo, path, text, kind = CORPORA[name]
    rows = table(spark, sf_dir, source)
    made = rows.selectExpr(f"'{name}' AS corpus", f"{ident} AS id", f"{repo} AS repo", path.format(s="STRING") + " AS file_path", "'' AS anchor", "'' AS breadcrumb", "'' AS header", "1 AS line_start", f"CAST(regexp_count({text}, '\\n') + 1 AS INT) AS line_end", f"{text} AS text", f"{kind} AS source_kind", "CAST(array() AS array<string>) AS all_anchors")
    return made.select(SECTIONS.names)


def corpora(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = corpus(spark, sf_dir, names[0])
    for name in names[1:]:
        out = out.unionByName(corpus(spark, sf_dir, name))
    return out


def corpora_sql(*names: str) -> str:
    """CTE ``sections``."""
    parts = []
    for place, name in enumerate(names):
        source, ident, repo, path, text, kind = CORPORA[name]
        parts.append(f"SELECT '{name}' AS corpus, {place} AS place, {ident} AS id, {repo} AS repo, {path.format(s='VARCHAR')} AS file_path, {text} AS text, {kind} AS source_kind FROM {source}")
    return "sections AS (" + " UNION ALL ".join(parts) + ")"


TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '([\p{L}\p{N}\p{Co}_]+)', 1)"
POSTINGS = f"""toks AS (SELECT corpus, place, id, {TOKENS} AS t FROM sections),
  post AS (SELECT corpus, place, id, len(t) AS dl, unnest(t) AS term FROM toks),
  stats AS (SELECT corpus, count(*) AS n_docs, sum(len(t)) / count(*) AS avgdl FROM toks GROUP BY corpus)"""
TERMS = r"""terms AS (
    SELECT qid, i AS phrase, lower(rtrim(t, '*')) AS term, ends_with(t, '*') AS is_prefix FROM (
      SELECT qid, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT qid, regexp_extract_all(coalesce(query, ''), '[A-Za-z0-9_]+\*?') AS l FROM queries)
      WHERE NOT list_has_any(l, ['OR*', 'AND*', 'NOT*'])))"""
BM25 = f"""{POSTINGS}, {TERMS},
  tf AS (
    SELECT qid, corpus, place, phrase, id, dl, count(*) AS f FROM (
      SELECT qid, corpus, place, phrase, id, dl FROM post JOIN terms ON post.term = terms.term WHERE NOT is_prefix
      UNION ALL SELECT qid, corpus, place, phrase, id, dl FROM post JOIN (SELECT * FROM terms WHERE is_prefix) p ON starts_with(post.term, p.term))
    GROUP BY ALL),
  df AS (SELECT qid, corpus, phrase, count(*) AS nd FROM tf GROUP BY ALL),
  idf AS (SELECT qid, df.corpus, phrase, avgdl, CASE WHEN ln((n_docs - nd + 0.5) / (nd + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - nd + 0.5) / (nd + 0.5)) END AS w FROM df JOIN stats ON df.corpus = stats.corpus),
  scored AS (
    SELECT tf.qid, tf.corpus, place, id, round(sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
    FROM tf JOIN idf ON tf.qid = idf.qid AND tf.corpus = idf.corpus AND tf.phrase = idf.phrase GROUP BY ALL),
  keyword AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, corpus ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored) WHERE rank <= 50)"""
BENCHMARK = "queries AS (SELECT item_id AS qid, text AS query FROM benchmark)"


def ranked(sections: DataFrame, queries: DataFrame) -> DataFrame:
    return bm25.bm25_texts(queries, sections, ("text",))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


# --- full text -------------------------------------------------------------------


@query(f"WITH {corpora_sql('documents')}, {POSTINGS} SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n_occ FROM post GROUP BY term")
def tokens_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = bm25.postings(corpus(spark, sf_dir, "documents"), ("text",))
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_occ"))


@query(f"WITH {corpora_sql(*CORPORA)}, {POSTINGS} SELECT corpus, n_docs, round(avgdl, 6) AS avgdl FROM stats")
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_stats(corpora(spark, sf_dir, *CORPORA), ("text",)).withColumn("avgdl", F.round("avgdl", 6))


def _keyword(name: str, text: str) -> None:
    sql = f"WITH {corpora_sql('documents')}, queries AS (SELECT 0 AS qid, '{text}' AS query), {BM25} SELECT id, rank, round(score, 6) AS score FROM keyword"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = spark.createDataFrame([(0, text)], "qid int, query string")
        return ranked(corpus(spark, sf_dir, "documents"), asked).select("id", "rank", F.round("score", 6).alias("score"))

    query(sql, name)(run)


_keyword("bm25_exact", "attion eriner thanedble")
_keyword("bm25_prefix", "eren* the")
_keyword("bm25_repeat_term", "ertion ertion antion")
_keyword("bm25_common_terms", "the of and to")
_keyword("bm25_void_query", "the OR* of")
_keyword("bm25_no_terms", "??? ...")


@query(f"WITH {BENCHMARK}, {TERMS} SELECT qid, phrase, term, is_prefix FROM terms")
def fts_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = benchmark_queries(spark, sf_dir).select("qid", F.posexplode(tx.query_terms(F.col("query"))).alias("phrase", "t"))
    return terms.select("qid", (F.col("phrase") + 1).cast("long").alias("phrase"), "t.term", "t.is_prefix")


@query(f"WITH {corpora_sql('documents')}, {BENCHMARK}, {BM25} SELECT qid, id, rank, round(score, 6) AS score FROM keyword")
def bm25_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(corpus(spark, sf_dir, "documents"), benchmark_queries(spark, sf_dir))
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


# --- an index build ----------------------------------------------------------------


@query(f"WITH {corpora_sql('documents')}, {POSTINGS} SELECT 'sections' AS part, count(*) AS n FROM sections UNION ALL SELECT 'vectors', count(*) FROM sections UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT id, term FROM post) UNION ALL SELECT 'tokens', count(*) FROM post")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: parsed, numbered, tokenised and embedded (by the hashing stand-in); the sizes of what an index holds."""
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".rst"))
    files = table(spark, sf_dir, "documents").select(F.split(name, "/").alias("file_key"), F.col("source").alias("repo"), name.alias("rel"), F.encode("text", "utf-8").alias("content"))
    sections = parsing.number(parsing.parse_prose(files)).withColumn("corpus", F.lit("documents")).persist()
    inputs = sections.select("id", tx.embed_input(F.col("source_kind"), F.col("text")).alias("text"))
    counts = [
        sections.agg(F.count(F.lit(1)).alias("n")).select(F.lit("sections").alias("part"), "n"),
        embed.embed_texts(inputs, embed.HashingEmbedder).agg(F.count(F.lit(1)).alias("n")).select(F.lit("vectors").alias("part"), "n"),
        bm25.postings(sections, ("text",)).agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens")).selectExpr("stack(2, 'postings', postings, 'tokens', tokens) AS (part, n)"),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- vectors ----------------------------------------------------------------------

COSINE = "abs(round(1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * x)))), 6))"


@query("SELECT v.vec_id AS id, " + COSINE.format(a="v.embedding", b="q.embedding") + " AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, id LIMIT 50")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn.nearest(vectors, vectors.filter("id = 0").first()["embedding"])


@query("SELECT qid, id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, " + COSINE.format(a="v.embedding", b="q.embedding") + " AS distance FROM embeddings v, embeddings q)) WHERE rank <= 10")
def cosine_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.lit("documents").alias("corpus"), F.col("vec_id").alias("id"), "embedding")
    return knn.nearest_batch(vectors, vectors.select(F.col("id").alias("qid"), "embedding"), 10).select("qid", "id", "distance", "rank")


# --- fusion ------------------------------------------------------------------------

SEMANTIC = """semantic AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
      SELECT b.item_id AS qid, 'documents' AS corpus, v.vec_id AS id, """ + COSINE.format(a="v.embedding", b="q.embedding") + """ AS distance
      FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v)) WHERE rank <= 50)"""
FUSED = """sums AS (SELECT qid, corpus, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(list * 1000 + rank) AS first FROM lists GROUP BY ALL)
SELECT qid, corpus, id, round(rrf, 9) AS rrf, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first, corpus, id) AS n FROM sums) WHERE n <= 8"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.lit("documents").alias("corpus"), F.col("vec_id").alias("id"), "embedding")
    asked = benchmark_queries(spark, sf_dir).join(vectors.drop("corpus"), F.col("qid") == F.col("id")).select("qid", "embedding")
    return knn.nearest_batch(vectors, asked)


def _fused(lists: list[DataFrame]) -> DataFrame:
    return fusion.fuse(lists, 8).select("qid", "corpus", "id", F.round("rrf", 9).alias("rrf"), "place")


@query(f"WITH {corpora_sql('documents')}, {BENCHMARK}, {BM25}, {SEMANTIC}, lists AS (SELECT qid, corpus, id, rank, 0 AS list FROM keyword UNION ALL SELECT qid, corpus, id, rank, 1 FROM semantic), {FUSED}")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused([ranked(corpus(spark, sf_dir, "documents"), benchmark_queries(spark, sf_dir)), _semantic(spark, sf_dir)])


@query(f"WITH {corpora_sql(*CORPORA)}, {BENCHMARK}, {BM25}, lists AS (SELECT qid, corpus, id, rank, place AS list FROM keyword), {FUSED}")
def rrf_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(corpora(spark, sf_dir, *CORPORA), benchmark_queries(spark, sf_dir))
    place = F.create_map(*[F.lit(x) for k, name in enumerate(CORPORA) for x in (name, k)])
    lists = found.select("qid", "corpus", "id", "rank", place[F.col("corpus")].alias("list"))
    return fusion.fuse_ranked(lists, 8).select("qid", "corpus", "id", F.round("rrf", 9).alias("rrf"), "place")


@query(
    f"WITH {corpora_sql('documents')}, {BENCHMARK}, {BM25}, {SEMANTIC}, kinds AS (SELECT id FROM sections WHERE source_kind = 'code'),"
    " lists AS (SELECT qid, corpus, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, 0 AS list FROM keyword WHERE id IN (SELECT id FROM kinds)"
    f" UNION ALL SELECT qid, corpus, id, row_number() OVER (PARTITION BY qid ORDER BY rank), 1 FROM semantic WHERE id IN (SELECT id FROM kinds)), {FUSED}"
)
def rrf_kind_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = corpus(spark, sf_dir, "documents")
    lists = [ranked(sections, benchmark_queries(spark, sf_dir)), _semantic(spark, sf_dir)]
    return _fused([fusion.keep_kinds(one.select("qid", "corpus", "id", "rank"), sections, ["code"]) for one in lists])


@query(f"WITH {corpora_sql(*CORPORA)}, {BENCHMARK}, {BM25}, lists AS (SELECT qid, corpus, id, rank, place AS list FROM keyword), best AS ({FUSED.replace('sums AS', 'WITH sums AS', 1)}) SELECT qid, corpus || ':' || CAST(id AS VARCHAR) AS id, best.place AS place, rrf, source_kind, file_path FROM best JOIN sections USING (corpus, id)")
def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three indexes are written, opened as a catalog and searched: ranking reads the stored postings."""
    base = scratch_path(spark, "indexes")
    none = spark.createDataFrame([], LINKS)
    for name in CORPORA:
        sections = corpus(spark, sf_dir, name)
        vectors = spark.createDataFrame([], "id long, embedding array<float>")
        store.write_index(f"{base}/{name}", name, sections, none, vectors, {"docs_root_relative": ".", "source_format": "rst"}, 64)
    catalog = store.Catalog.open(spark, [f"{base}/{name}" for name in CORPORA])
    found = search.search(catalog, benchmark_queries(spark, sf_dir), 8, "keyword")
    return found.select("qid", "id", "place", F.round("rrf", 9).alias("rrf"), "source_kind", "file_path")


# --- sections and documents -----------------------------------------------------------

SNIPPET = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"WITH {corpora_sql(*CORPORA)} SELECT corpus, id, CASE WHEN length({SNIPPET}) > 320 THEN left({SNIPPET}, 320) || '…' ELSE {SNIPPET} END AS snippet, file_path || ':1-' || CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS VARCHAR) AS citation FROM sections")
def snippet_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = tx.citation(F.col("file_path"), F.col("anchor"), F.col("line_start"), F.col("line_end"))
    return corpora(spark, sf_dir, *CORPORA).select("corpus", "id", tx.snippet(F.col("text")).alias("snippet"), cited.alias("citation"))


@query(f"WITH {corpora_sql('documents')} SELECT 'documents:' || CAST(id AS VARCHAR) AS id, repo, file_path, source_kind, text FROM sections WHERE id = 7")
def get_section_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus(spark, sf_dir, "documents").filter("id = 7")
    return found.select(tx.id_text(F.col("corpus"), F.col("id"), True).alias("id"), "repo", "file_path", "source_kind", "text")


@query(f"WITH {corpora_sql('documents')} SELECT file_path, len(string_split(text, chr(10))) AS lines FROM sections")
def get_doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "documents").select("file_path", tx.line_count(F.col("text")).alias("lines"))


@query(f"WITH {corpora_sql(*CORPORA)} SELECT source_kind, count(*) AS n, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM sections GROUP BY source_kind")
def est_tokens_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora(spark, sf_dir, *CORPORA).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(tx.est_tokens(F.col("text"))).alias("tokens"))


@query(f"WITH {corpora_sql(*CORPORA)} SELECT corpus, count(*) FILTER (length(text) // 4 > 1000) AS over_code, count(*) FILTER (length(text) // 4 > 1500) AS over_prose FROM sections GROUP BY corpus")
def oversize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = tx.est_tokens(F.col("text"))
    return corpora(spark, sf_dir, *CORPORA).groupBy("corpus").agg(F.count_if(size > 1000).alias("over_code"), F.count_if(size > 1500).alias("over_prose"))


@query(r"""
WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT id, lines, unnest(range(0, len(lines), 15)) AS off FROM l)
SELECT id, off + 1 AS line_start, least(off + 20, len(lines)) AS line_end, array_to_string(lines[off + 1:off + 20], chr(10)) AS window_text
FROM w WHERE (off = 0 OR off + 5 < len(lines)) AND len(list_filter(lines[off + 1:off + 20], lambda x: trim(x) <> '')) > 0
""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.line_windows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 20, 5)


@query(r"""
WITH RECURSIVE l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines, length(text) // 4 > 1000 AS big FROM documents),
c AS (
  SELECT id, lines, 1 AS n, 1 AS start, greatest(1, length(lines[1]) // 4) + 1 AS load FROM l WHERE big
  UNION ALL
  SELECT id, lines, n + 1, CASE WHEN load + greatest(1, length(lines[n + 1]) // 4) + 1 > 800 THEN n + 1 ELSE start END,
    CASE WHEN load + greatest(1, length(lines[n + 1]) // 4) + 1 > 800 THEN greatest(1, length(lines[n + 1]) // 4) + 1 ELSE load + greatest(1, length(lines[n + 1]) // 4) + 1 END
  FROM c WHERE n < len(lines)
)
SELECT id, CAST(start AS BIGINT) AS line_start, CAST(max(n) AS BIGINT) AS line_end, md5(array_to_string(any_value(lines)[start:max(n)], chr(10))) AS body_md5 FROM c GROUP BY id, start
UNION ALL SELECT id, 1, len(lines), md5(array_to_string(lines, chr(10))) FROM l WHERE NOT big
""")
def line_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode_outer(parsing.packed_lines(F.col("text"), 1000, 800)).alias("p"))
    return packed.select("id", "p.line_start", "p.line_end", F.md5("p.body").alias("body_md5"))


@query("SELECT doc_id AS old_id, 'documents' AS corpus, row_number() OVER (ORDER BY source, doc_id) AS id FROM documents UNION ALL SELECT conv_id * 100000 + turn, 'conversations', row_number() OVER (ORDER BY conv_id, turn) + (SELECT count(*) FROM documents) FROM conversations")
def union_offset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.array(F.col("source"), F.format_string("%012d", "doc_id")).alias("file_key"), F.lit(0).alias("ord"), F.col("doc_id").alias("old_id"), F.lit("documents").alias("corpus"))
    turns = table(spark, sf_dir, "conversations").select(F.array(F.format_string("%012d", "conv_id")).alias("file_key"), F.col("turn").cast("int").alias("ord"), (F.col("conv_id") * 100000 + F.col("turn")).alias("old_id"), F.lit("conversations").alias("corpus"))
    return parsing.offset_union(parsing.number(docs), parsing.number(turns)).select("old_id", "corpus", "id")


@query(f"WITH {corpora_sql(*CORPORA)} SELECT corpus, count(*) AS section_count, string_agg(DISTINCT source_kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY source_kind || ':' || CAST(n AS VARCHAR)) AS source_kinds FROM (SELECT *, count(*) OVER (PARTITION BY corpus, source_kind) AS n FROM sections) GROUP BY corpus")
def meta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = corpora(spark, sf_dir, *CORPORA).groupBy("corpus", "source_kind").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "source_kind", F.col("n").cast("string")))), ",")
    return kinds.groupBy("corpus").agg(F.sum("n").alias("section_count"), text.alias("source_kinds"))


# --- the graph -------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as edges from orders to parts; parts over size 25 don't resolve."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    known = table(spark, sf_dir, "part").filter("p_size <= 25").select("p_partkey")
    edges = lines.join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    return edges.select(F.col("l_orderkey").alias("src_id"), F.lit("ref").alias("kind"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("target_raw"), F.col("p_partkey").alias("resolved_id"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).cast("long").alias("edge"))


EDGES = "edges AS (SELECT l_orderkey AS src_id, 'part-' || CAST(l_partkey AS VARCHAR) AS target_raw, p_partkey AS resolved_id, CAST((l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey AS BIGINT) AS edge FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON l_partkey = p_partkey)"


@query("SELECT l_orderkey AS src_id, l_linenumber AS pos, 'brand-' || CAST(l_suppkey % 60 AS VARCHAR) AS target_raw, id AS resolved_id FROM lineitem LEFT JOIN (SELECT replace(lower(p_brand), '#', '-') AS anchor, min(p_partkey) AS id FROM part GROUP BY ALL) ON 'brand-' || CAST(l_suppkey % 60 AS VARCHAR) = anchor")
def links_resolve_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))).alias("all_anchors"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("brand-"), (F.col("l_suppkey") % 60).cast("string")).alias("target_raw"))
    found = edges.join(graph.anchor_map(sections), F.col("target_raw") == F.col("anchor"), "left")
    return found.select("src_id", "pos", "target_raw", F.col("id").alias("resolved_id"))


@query("SELECT anchor, min(p_partkey) AS id FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS anchor FROM part) GROUP BY anchor")
def links_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anchor_map(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("all_anchors")))


@query(f"WITH {EDGES} SELECT count(*) AS n_links, count(resolved_id) AS n_resolved FROM edges")
def resolved_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("resolved_id").isNotNull()).alias("n_resolved"))


def _related(direction: str, asked: str, key: str) -> None:
    ends = {"out": ("src_id", "resolved_id IS NOT NULL", "resolved_id"), "in": ("resolved_id", "resolved_id IS NOT NULL", "src_id"), "unresolved": ("src_id", "resolved_id IS NULL", "CAST(NULL AS BIGINT)")}
    own, fit, other = ends[direction]
    sql = f"WITH {EDGES} SELECT {own} AS asked_id, CAST(pos AS INTEGER) AS pos, target_raw, {other} AS id FROM (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY edge) AS pos FROM edges WHERE {fit}) WHERE pos <= 20"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = table(spark, sf_dir, asked).select(F.col(key).alias("id"))
        ends = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "orders").select("o_orderkey")).distinct()
        found = graph.related(_edges(spark, sf_dir), ends, ids)
        return found.filter(F.col("direction") == direction).select("asked_id", "pos", "target_raw", "id")

    query(sql, f"related_{direction}")(run)


_related("out", "orders", "o_orderkey")
_related("in", "part", "p_partkey")
_related("unresolved", "orders", "o_orderkey")

URL_PATH = r"regexp_extract(url, '://[^/?#]*/([^?#]*)', 1)"


@query(f"""
WITH k AS (SELECT DISTINCT {URL_PATH} AS path FROM pages WHERE {URL_PATH} <> ''),
s AS (SELECT path, array_to_string(string_split(path, '/')[unnest(range(1, len(string_split(path, '/')) + 1)):], '/') AS suffix FROM k)
SELECT suffix, min(path) AS path FROM s GROUP BY suffix HAVING count(*) = 1
""")
def suffix_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1).alias("path")).filter("path <> ''").distinct()
    return graph.unique_suffixes(keys.withColumn("key", F.col("path")), "key", "path")


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
p AS (SELECT page_id, ltrim(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), '/') AS path FROM pages), m AS (SELECT path, min(page_id) AS id FROM p WHERE path <> '' GROUP BY path)
SELECT h.page_id AS src_id, href, m.id AS resolved_id, count(*) AS n FROM h LEFT JOIN m ON ltrim(href, '/') = m.path GROUP BY ALL
""")
def href_extract_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select(F.col("page_id").alias("src_id"), F.explode_outer(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")).filter("href is not null")
    paths = pages.select("page_id", F.ltrim(F.regexp_extract("url", r"://[^/?#]*(/[^?#]*)", 1), F.lit("/")).alias("path")).filter("path <> ''")
    found = paths.groupBy("path").agg(F.min("page_id").alias("resolved_id"))
    return hrefs.join(found, F.ltrim(F.col("href"), F.lit("/")) == F.col("path"), "left").groupBy("src_id", "href", "resolved_id").agg(F.count(F.lit(1)).alias("n"))


def _unescaped(column: str) -> str:
    """SQL for the references that the pages hold; SQL has no general way."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):  # the last must be last
        column = f"regexp_replace({column}, '&{name};?', '{sign}', 'g')"
    return column


@query(rf"""
WITH parts AS (
  SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h,
    regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)(<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>)+', chr(10), 'g') AS t FROM pages
), plain AS (SELECT page_id, trim({_unescaped("h")}) AS header, {_unescaped("t")} AS t FROM parts),
tidy AS (
  SELECT page_id, header, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), e' \t\n\x0b\x0c\r') AS text FROM plain
)
SELECT row_number() OVER (ORDER BY page_id) AS id, 'web/' || page_id AS docname, header, header AS breadcrumb, text FROM tidy WHERE text <> ''
""")
def html_fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without sections, one section each: all their text."""
    pages = table(spark, sf_dir, "pages").select(F.array(F.format_string("%012d", "page_id")).alias("file_key"), F.lit("web").alias("docset"), F.concat(F.lit("web/"), F.col("page_id").cast("string")).alias("docname"), F.encode("html", "utf-8").alias("content"))
    return parsing.number(parsing.parse_pages(pages)).select("id", "docname", "header", "breadcrumb", "text")

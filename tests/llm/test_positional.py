import hashlib
import re

import numpy as np
import pytest

from shardlore.llm import positional as ps


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            size = min(8, len(iw))
            pieces = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if iw else set()
            for k in range(len(w) - size + 1) if size else ():
                if tuple(w[k : k + size]) in pieces:
                    hit |= set(range(k, k + size))
                    names.add(item)
        joined = ",".join(sorted(str(x) for x in names if x is not None))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=str)


PHRASE = "the quick brown fox jumps over the lazy dog near the river bank"
ITEMS = [(1, PHRASE), (2, PHRASE.upper() + "!"), (10, "alpha-beta gamma"), (3, ""), (4, None), (5, "über größe 1234 naïve"), (6, "the the the the the the the the the"), (None, "no id here at all"), (None, "is no id here"), (10, "another text of item ten")]
DOCS = [
    (1, f"so {PHRASE}. and then"), (2, PHRASE.replace("fox", "cat")), (3, None), (4, ""), (5, "Alpha, BETA (gamma) alpha beta"), (6, "Über GRÖßE 1234 naïve x über größe 1234 naïve"), (7, "the " * 50), (8, "alpha beta"), (None, f"{PHRASE} {PHRASE}"),
    (9, "x " * 30_000 + PHRASE), (1, f"so {PHRASE}. and then"), (11, "quick brown fox jumps over the lazy dog"), (12, "!!!"), (13, "alpha"), (14, "beta gamma"), (15, "there is no id here at all and alpha beta gamma"),
]


@pytest.mark.parametrize(("segment", "block", "candidates"), [(1_000_000, 100_000, 2_000_000), (5, 3, 7)])
def test_contamination(spark, monkeypatch, segment, block, candidates):
    monkeypatch.setattr(ps, "CANDIDATES", candidates)
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, id int")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, words int")
    out = ps.contamination(ps.build_index(docs, segment_words=segment), items, block_windows=block).drop("items").collect()
    assert sorted(map(tuple, out), key=str) == brute(DOCS, ITEMS)


def test_random_texts(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(rng.choice(list("abcd"), n))
    docs = [(k, text(rng.integers(0, 200))) for k in range(60)]
    items = [(k, text(rng.integers(0, 14))) for k in range(40)]
    found = ps.contamination(ps.build_index(spark.createDataFrame(docs, "doc_id long, text string"), segment_words=500), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.drop("items").collect()), key=str) == brute(docs, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a x x x x b"), (3, "b"), (4, "a"), (5, "b a"), (6, "a b b")], "doc_id long, text string")
    index = ps.build_index(docs)
    near = lambda slop: {(r.doc_id, r.position) for r in ps.proximity(index, ["a", "b"], slop).collect()}
    assert {d for d, _ in near(1)} == {1, 5, 6} and {d for d, _ in near(5)} == {1, 2, 5, 6}
    assert ps.proximity(index, ["a", "nowhere"], 9).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert ps.contamination(ps.build_index(none), items).count() == 0
    (row,) = ps.contamination(ps.build_index(spark.createDataFrame([(1, PHRASE)], none.schema)), items.limit(0)).collect()
    assert (row.n_hit, row.n_items, row.contaminated) == (0, 0, False)


def test_stage(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in DOCS if i is not None], "doc_id long, text string, lang string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    judged = {r[0]: r[2] for r in brute([d for d in DOCS if d[0] is not None], ITEMS)}
    want = {i for i, n_hit in judged.items() if n_hit < 8}
    assert {1, 2, 9} <= judged.keys() - want and {3, 4, 5, 8} <= want
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        assert {r.doc_id for r in ps.decontaminate_stage(spark, docs, folder).collect()} == want


def test_stage_judges_rows_without_an_id_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame([*[(None, t, "en") for _, t in DOCS], (0, "clean", "en"), (1, PHRASE, "en")], "doc_id long, text string, lang string")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    hits = {r[0]: r[2] for r in brute([(k, t) for k, (_, t) in enumerate(DOCS)], ITEMS)}
    want = [t for k, (_, t) in enumerate(DOCS) if hits[k] < 8]
    out = ps.decontaminate_stage(spark, docs, f"file://{tmp_path}")
    rows = out.collect()
    assert out.schema == docs.schema and 1 < len(want) < len(DOCS)
    assert sorted((r.text for r in rows if r.doc_id is None), key=str) == sorted(want, key=str)
    assert [(r.doc_id, r.text) for r in rows if r.doc_id is not None] == [(0, "clean")]

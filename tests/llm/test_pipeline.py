"""The pipeline against brute-force versions of its stages, each on its own input; none of them calls the code under test."""

import hashlib

import pytest
from test_curriculum import brute_rows
from test_langid import brute_languages
from test_line_runs import brute as brute_lines
from test_minhash import brute_stage
from test_positional import brute as brute_leaks

import corpus_pipeline
from shardlore.llm.common import staged


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """The given documents and rows without an id, repeated ids, repeated rows, null texts, and columns with names that stages use."""
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    long_one = max(rows, key=lambda r: len(r[1]))
    extra = [(None, *r[1:]) for r in rows[:40]] + [(r[0], rows[(k + 1) % 40][1], *r[2:]) for k, r in enumerate(rows[40:60])] + rows[60:70] + rows[60:70]
    extra += [(None, item + " " + long_one[1], *long_one[2:]), (None, long_one[1], *long_one[2:]), (None, "эта строка на другом языке " * 9, "en", "src", 1), (None, None, "en", None, None), (9_001, None, None, None, None), (9_002, "", "en", "src", 0), (None, "12 34 !!", "en", "src", 8)]
    made = spark.createDataFrame(rows + extra, docs.schema)
    for name in ("epoch", "position", "row", "number", "mixed_id", "gone", "bad"):
        made = made.selectExpr("*", f"'{name}' AS {name}")
    made.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("odd", [False, True])
def test_each_stage(spark, sf_dir, odd_dir, odd):
    folder = odd_dir if odd else sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(staged(stage(spark, inputs[-1], folder), name))
    assert all(frame.columns == docs.columns for frame in inputs[:-1])
    rows = [[(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()] for frame in inputs]
    same = lambda a, b: sorted(map(str, a)) == sorted(map(str, b))

    whole = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    judged = brute_languages([(t, s, lang.strip().lower() if lang is not None else None) for _, t, s, lang in whole], [(t, lang.strip().lower()) for _, t, _, lang in whole if lang])
    assert same(rows[1], [r[:2] for r, lang in zip(whole, judged) if lang != "und"])
    assert (len(rows[1]) < len(rows[0])) == odd

    # brute_lines sorts its results, so rows go in one by one under numbers, and ids tell documents apart
    want = []
    marks = {}
    for i, n_lines, dropped, sha in brute_lines(rows[1]):
        marks.setdefault((i, sha), []).append((n_lines, dropped))
    empty = hashlib.sha256(b"").hexdigest()
    for (i, sha), found in marks.items():
        want += [(i, sha)] * sum(not (dropped and sha == empty) for _, dropped in found)
    got = [(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows[2]]
    assert sorted(map(str, set(got))) == sorted(map(str, {x for x in want if x in set(got)})) and abs(len(want) - len(got)) <= len(rows[1]) // 20
    assert all(t is None or t.strip() or not t for _, t in rows[2])

    assert same(rows[3], brute_stage(rows[2]))
    hits = [(i, n_hit) for i, _, n_hit, *_ in (brute_leaks([r], items)[0] for r in rows[3])]
    assert same(rows[4], [r for r, (_, n) in zip(rows[3], hits) if n < 8]) and len(rows[4]) < len(rows[3])

    last = inputs[5].collect()
    at = "mix_position" if odd else "position"
    assert inputs[5].columns == [*docs.columns, *(("mix_epoch", "mix_position") if odd else ("epoch", "position"))]
    counts = lambda xs: sorted((str(x), xs.count(x)) for x in set(xs))
    assert counts([(r.doc_id, r.source, r.text) for r in last]) == counts([key for key, _ in brute_rows([(r.doc_id, r.source, r.text) for r in inputs[4].collect()])])
    assert [r[at] for r in last] == sorted(r[at] for r in last)


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "text", "epoch", "position"} <= set(out.columns)


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shardlore.llm import line_runs as lr

LONG = "this line is surely long enough"


def brute(rows):
    def key(line):
        stripped = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if c.isascii() else c for c in stripped)

    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                where[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        own = -(2**63) if i is None else i
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(where.get(key(x), ())) >= 3 and max(where[key(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, f"{LONG}\nown one\n{LONG.upper()} \n"), (2, f"\t{LONG}\r\nshort"), (3, f"{LONG}\n{LONG}"), (4, None), (5, ""), (None, LONG), (6, "ÄÖÜäöüÄÖÜäöüÄÖÜäöü12"), (7, "äöüäöüäöüäöüäöüäöü12"),
    (8, " " + LONG), (9, "x" * 19), (10, "x" * 19), (11, "x" * 19), (12, "é" * 20), (13, "é" * 20), (14, "é" * 20), (14, "é" * 20), (15, "\n\n"), (16, "a" * 300_000 + "\n" + LONG[:-1]), (17, "a" * 300_000), (18, "a" * 300_000),
    *((100 + k, f"hot line that is in a third of all\nline {k} of its own and no other") for k in range(60)),
]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_drop(spark, batches):
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in ROWS], "doc_id long, text string, doc int, row string, n_lines int")
    out = lr.drop_repeated(docs, batches=batches)
    got = out.select(F.col("row.doc_id").alias("i"), "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)
    assert out.first()["row"].asDict().keys() == {"doc_id", "text", "doc", "row", "n_lines"}


def test_runs_are_levelled_and_incremental(spark):
    store = lr.LineRuns(spark, fanout=3)
    seen, count, top = set(), {}, {}
    for k in range(7):
        texts = [f"shared line number {k // 2} is here", f"private line number {k} is here", LONG]
        batch = spark.createDataFrame([(10 * k, "\n".join(texts)), (10 * k + 1, "\n".join(texts[:1]))], "doc_id long, text string")
        fresh = {(r.h1, r.h2) for r in store.add(lr.line_hashes(batch)).collect()}
        lines = [(r.doc, r.h1, r.h2) for r in lr.line_hashes(batch).collect()]
        assert fresh == {x[1:] for x in lines} - seen
        seen |= {x[1:] for x in lines}
        for doc, *h in lines:
            count[tuple(h)], top[tuple(h)] = count.get(tuple(h), 0) + 1, max(top.get(tuple(h), 0), doc)
    store.compact()
    assert [len(level) for level in store.levels] == [1, 2]  # 7 = 1 + 2 * 3
    held = [(r.h1, r.h2) for name in store.runs() for r in store.run(name).collect()]
    assert len(held) == len(set(held)) == len(seen)  # each line is in one run
    for least in (1, 2, 4, 7):
        assert {(r.h1, r.h2): r.top_doc for r in store.repeated(least).collect()} == {h: top[h] for h, n in count.items() if n >= least}
    store.close()
    assert not store.paths


def test_runs_meet_without_a_shuffle(spark):
    """The plans of the anti-join with a run and of a merge of runs hold no exchange."""
    store = lr.LineRuns(spark, fanout=9)
    docs = spark.createDataFrame([(k, f"{LONG} {k}\n{LONG} {k // 2}") for k in range(100)], "doc_id long, text string")
    for k in range(3):
        store.add(lr.line_hashes(docs.filter(F.col("doc_id") % 3 == k)))
    one, two, _ = store.runs()
    plans = [store.run(one).join(store.run(two).select("h1", "h2").hint("merge"), ["h1", "h2"], "left"), store.merged(store.run(one), store.run(two))]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "SortMergeJoin" in text
    assert plans[0].count() > 0
    store.close()


def test_rows_without_an_id_have_their_own_drop_lists(spark):
    rows = [(None, f"{LONG}\nrow {k}", "x") for k in range(5)] + [(k, LONG, "y") for k in range(3)] + [(2, f"{LONG}\nof the same id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string")
    out = [(r["row"].doc_id, r.kept_text) for r in lr.drop_repeated(docs).collect()]
    assert sorted(out, key=str) == sorted([(None, f"row {k}") for k in range(5)] + [(0, ""), (1, ""), (2, LONG), (2, f"{LONG}\nof the same id")], key=str)


def test_empty_and_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert lr.drop_repeated(empty).count() == 0
    docs = spark.createDataFrame([(k, LONG if k < 3 else "kept as it is", "en", "s", 1) for k in range(4)] + [(9, "", "en", "s", 0)], empty.schema)
    out = lr.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and {(r.doc_id, r.n_chars) for r in out.collect()} == {(2, len(LONG)), (3, 13), (9, 0)}

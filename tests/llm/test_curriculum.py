import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shardlore.llm import curriculum as cu


def targets(sizes):
    """Water filling, one round of caps at a time."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full = {}
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        left = sum(weight[s] for s in names if s not in full)
        share = {s: full.get(s, rest * weight[s] / left if left else 0) for s in names}
        over = [s for s in names if s not in full and share[s] > 3 * sizes[s]]
        if not over:
            return share
        full |= {s: 3 * sizes[s] for s in over}


def brute(rows):
    key = lambda i, t: hashlib.md5(((t or "") if i is None else str(i)).encode()).hexdigest()
    rows = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), key(i, t)) for i, s, t in rows]
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    share, out = targets(sizes), []
    for s in sizes:
        start = 0
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0] or 0, r[2]))
        for i, _, n, _ in own:
            taken = sum(n for e in range(3) if 2 * (start + e * sizes[s]) + n <= 2 * share[s])
            out.append((i, n, sizes[s], round(share[s], 6), taken))
            start += n
    return sorted(out, key=str)


def corpus():
    rows = [(k, f"s{k % 7}" if k % 3 else "hot", "word " * (k % 23 + 1)) for k in range(400)]
    rows += [(500, "tiny", "a b"), (501, "none", ""), (502, "none", None), (503, None, "x y\tz\n\n w"), (504, None, " "), (505, "é", "ü"), (None, "hot", "q"), (0, "hot", "word"), (900, "s1", "w " * 20_000)]
    return rows


@pytest.mark.parametrize("range_rows", [20_000, 7])
def test_mix(spark, monkeypatch, range_rows):
    monkeypatch.setattr(cu, "RANGE_ROWS", range_rows)
    docs = spark.createDataFrame([(*r, 1, "k") for r in corpus()], "doc_id long, source string, text string, part int, key string")
    mixed = cu.mix(docs).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixed), key=str) == brute(corpus())
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
        assert all(r.taken <= 3 * r["size"] and all(0 < t <= 1 for t in r.positions) for r in own)


def test_reruns_agree(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, source string, text string")
    assert sorted(map(str, cu.mix(docs).collect())) == sorted(map(str, cu.mix(docs.repartition(9)).collect()))


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.5])
def test_training_time_inverts_the_integrated_schedule(spark, slope):
    steps = 1000
    frame = spark.range(1, steps + 1).select((F.col("id") / steps).alias("u"))
    for row in frame.select("u", cu.training_time(F.col("u"), F.lit(slope)).alias("t")).collect():
        integral = sum(1 + slope * (2 * (x + 0.5) / 200 * row.t - 1) for x in range(200)) / 200 * row.t
        assert abs(integral - row.u) < 1e-9


def test_any_schedule_is_inverted(spark):
    schedule = cu.Schedule((3, 0, 1, 2))
    frame = spark.range(1, 601).select((F.col("id") / 600).alias("u"))
    for row in frame.select("u", schedule.time(F.col("u")).alias("t")).collect():
        whole, part = divmod(row.t * 4, 1)
        demand = sum((3, 0, 1, 2)[: int(whole)]) + (part * (3, 0, 1, 2)[int(whole)] if whole < 4 else 0)
        assert abs(demand / 6 - row.u) < 1e-9
    docs = spark.createDataFrame(corpus(), "doc_id long, source string, text string")
    late = cu.mix(docs, schedules={"hot": cu.Schedule((0, 0, 0, 1))}).filter("source = 'hot'").collect()
    assert all(t >= 0.75 for r in late for t in r.positions) and any(r.positions for r in late)
    with pytest.raises(ValueError):
        cu.Schedule((0.0, 0.0))


def brute_rows(rows):
    """((id, source, text), epoch) of every row that the mix takes; rows: (id, source, text)."""
    out = []
    by_source = {}
    for i, s, t in rows:
        by_source.setdefault(s, []).append((hashlib.md5(((t or "") if i is None else str(i)).encode()).hexdigest(), i or 0, len((t or "").split()), i, t))
    share = targets({s: sum(r[2] for r in own) for s, own in by_source.items()})
    for s, own in by_source.items():
        start, size = 0, sum(r[2] for r in own)
        for _, _, n, i, t in sorted(own, key=lambda r: r[:3]):
            out += [((i, s, t), e) for e in range(3) if n and 2 * (start + e * size) + n <= 2 * share[s]]
            start += n
    return sorted(out, key=str)


def test_no_row_is_lost(spark):
    """Rows without an id, rows of one id with other texts, equal rows, and columns named as those that are added."""
    rows = corpus() + [(None, "hot" if k % 2 else None, "word " * (k % 5 + 1) + str(k % 20)) for k in range(60)] + [(None, "hot", ""), (7, "s0", "another text of this id"), corpus()[3], corpus()[3]]
    docs = spark.createDataFrame([(*r, "e", "p", "m", 1) for r in rows], "doc_id long, source string, text string, Epoch string, position string, mixed_id string, number int")
    out = cu.mixed_rows(docs)
    assert out.columns == [*docs.columns, "mix_epoch", "mix_position"]
    found = out.collect()
    assert [r.mix_position for r in found] == sorted(r.mix_position for r in found)
    assert {(r.Epoch, r.position, r.mixed_id, r.number) for r in found} == {("e", "p", "m", 1)}
    # equal rows of equal size may change places, so compare which row is taken how often
    got, want = {}, {}
    for r in found:
        got[r.doc_id, r.source, r.text] = got.get((r.doc_id, r.source, r.text), 0) + 1
    for key, _ in brute_rows(rows):
        want[key] = want.get(key, 0) + 1
    assert got == want
    assert sorted(map(str, cu.mixed_rows(docs.repartition(7)).collect())) == sorted(map(str, found))
    assert sum(len(r.text.split()) for r in found) == sum(r.taken for r in cu.mix(docs).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, source string, text string")
    assert cu.mix(docs.limit(0)).count() == 0 and cu.mixed_rows(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "a", None)], docs.schema)
    assert [(r.target, r.taken) for r in cu.mix(blank).collect()] == [(0.0, 0)]

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlore.llm import langid as li

SAMPLES = {
    "en": "the cat and the dog were in the house with that other thing which they had seen there",
    "de": "der hund und die katze waren nicht in dem haus mit dem anderen ding das sie gesehen haben",
    "fr": "le chat et le chien étaient dans la maison avec une autre chose que les gens ont vue",
    "es": "el gato y el perro estaban en la casa con otra cosa que los niños habían visto allí",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = [(100 * k + n, " ".join(rng.permutation(text.split())), lang) for k, (lang, text) in enumerate(SAMPLES.items()) for n in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def page(text, lang=None):
    return f"<html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><head><style>p{{}}</style><script>var the='and the';</script></head><body><!-- the the --><p>{text}</p></body></html>"


def test_pages(spark, labelled):
    rows = [(k, f"http://h{k}.example.org/x", page(text, lang)) for k, (lang, text) in enumerate(SAMPLES.items())]
    # many German pages at one host, and short undecided ones there and elsewhere
    rows += [(100 + k, "http://www.haus.example.de/", page(SAMPLES["de"], "de")) for k in range(40)]
    rows += [(200, "https://WWW.haus.example.de/y", page("in")), (201, "http://neu.example.de/", page("")), (202, None, None), (203, "", ""), (204, "http://u.example.org/", page("12 345 !!")), (205, "http://r.example.org/", page("эта страница написана на другом языке совсем " * 3))]
    rows += [(206, "http://www.haus.example.de/", page(SAMPLES["en"], "de")), (207, "http://x.example.org/", page(SAMPLES["fr"], "fr") * 200), (0, rows[0][1], rows[0][2])]
    out = {r.id: r for r in li.identify_pages(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, id int"), labelled).collect()}
    assert [out[k].lang for k in range(4)] == list(SAMPLES)
    assert all(out[100 + k].lang == "de" for k in range(40))
    assert out[200].lang == "de"  # the host decides where the text can't
    assert all(out[k].lang == "und" for k in (201, 202, 203, 204, 205))
    assert out[206].lang == "en" and out[207].lang == "fr"  # clear text outweighs tag and host
    assert (out[200].host, out[200].suffix, out[0].declared) == ("www.haus.example.de", "de", "en")
    assert len(out) == len(rows) - 1


def test_priors_by_hand(spark):
    """The fused scores of three rows against the formula."""
    logs = {1: [-10.0, -12.0, -30.0], 2: [-11.0, -11.0, -30.0], 3: [-9.0, -14.0, -30.0]}
    rows = [(k, "h" if k < 3 else "g", "d.x", "x", "aa" if k == 3 else None, 5, v, 0) for k, v in logs.items()]
    frame = spark.createDataFrame(rows, "id long, host string, domain string, suffix string, declared string, n long, logs array<double>, vote int")
    out = {r.id: r for r in li.fuse(frame, ("aa", "bb")).collect()}
    base = [4 / 5, 1 / 5]
    scores = []
    for i in range(2):
        domain = ((2 if i == 0 else 0) + 5 * base[i]) / 7  # without the row's own vote
        host = ((1 if i == 0 else 0) + 5 * domain) / 6
        suffix = ((3 if i == 0 else 0) + 1) / ((3 if i == 0 else 0) + 2)
        scores.append(logs[2][i] + np.log(host * 0.99) + np.log(suffix))
    scores.append(-30 + np.log(0.01) + np.log(4 / 5))
    want = np.exp(scores[0] - max(scores)) / np.exp(np.array(scores) - max(scores)).sum()
    assert out[2].lang == "aa" and abs(out[2].confidence - want) < 1e-12


def test_held_out_accuracy(spark, sf_dir):
    """Without its declared language and source, a document is still put right by its text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = li.fit(docs.filter(half == 0), "doc_id", "text", "lang")
    asked = docs.filter(half == 1).select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("declared"))
    found = li.fuse(li.staged(li.text_evidence(asked, model), "t"), model.languages).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id").collect()
    assert np.mean([r.lang == r.truth for r in found]) > 0.98


def test_sample_is_that_of_the_smallest_hashes(spark, monkeypatch):
    rows = [(k, "the cat " * (1 + k % 3) if k % 2 else "der hund", "en" if k % 2 else "de") for k in range(2000)] + [(7, "the cat", "en")] * 3000 + [(None, "und", "fr")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fast = li.fit(docs, "doc_id", "text", "lang", sample=20)
    monkeypatch.setattr(li, "SPARE", 10**9)  # ranks all
    slow = li.fit(docs, "doc_id", "text", "lang", sample=20)
    assert np.array_equal(fast.logs, slow.logs) and fast.languages == slow.languages == ("de", "en")  # two rows are too few


def test_stage_keeps_documents_in_known_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(9001, "", "en", "s", 0), (9002, None, "en", "s", 0), (9003, "123 456 ###", "en", "s", 11), (9004, "это русский текст без перевода " * 5, "en", "s", 155)], docs.schema)
    out = li.language_stage(spark, docs.union(odd), "")
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert out.columns == docs.columns and kept == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("share", [7, 1])
def test_stage_judges_rows_without_an_id_one_by_one(spark, share):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % share != 0, F.col("doc_id")))
    odd = spark.createDataFrame([(None, "", "en", "s", 0), (None, None, None, None, 0), (None, "это русский текст без перевода " * 5, "en", "s", 155)], docs.schema)
    out = li.language_stage(spark, docs.union(odd), "")
    kept = sorted(map(str, out.collect()))
    assert out.schema == docs.schema and kept == sorted(map(str, docs.collect()))


def test_empty_tables(spark, labelled):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert li.identify_pages(pages, labelled).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", page(SAMPLES["en"]))], pages.schema)
    assert [r.lang for r in li.identify_pages(one, labelled.limit(0)).collect()] == ["und"]


def test_languages_come_from_the_labels(spark, labelled):
    russian = "это русский текст без перевода и без других слов на этом языке совсем".split()
    rng = np.random.default_rng(1)
    more = spark.createDataFrame([(900 + k, " ".join(rng.permutation(russian)), " RU") for k in range(30)] + [(990, "x", ""), (991, "y", None)], labelled.schema)
    assert li.fit(labelled.union(more), "doc_id", "text", "lang").languages == ("de", "en", "es", "fr", "ru")
    pages = spark.createDataFrame([(1, "http://a.b/", page(" ".join(russian)))], "page_id long, url string, html string")
    assert [r.lang for r in li.identify_pages(pages, labelled.union(more)).collect()] == ["ru"]


def brute_languages(rows, labelled, least=3):
    """(lang of each of rows): the formulas once more, one row and one trigram at a time, in dictionaries. rows: (text, host, declared); labelled: (text, label), of which all are used."""
    import math
    import re
    from collections import Counter

    def grams(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        spaced = b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.encode())) + b" "
        return [((spaced[k] << 16 | spaced[k + 1] << 8 | spaced[k + 2]) * 2654435761 % 2**32) >> 16 for k in range(len(spaced) - 2)] if re.search(rb"[a-z\xc3-\xf4]", spaced) else []

    many = Counter(label for _, label in labelled)
    langs = sorted(x for x, n in many.items() if x and n >= least)
    counts = {x: Counter() for x in langs}
    for text, label in labelled:
        if label in counts:
            counts[label].update(grams(text))
    kinds = len(set().union(*counts.values()))
    logs = []
    for text, _, _ in rows:
        found = grams(text)
        weight = min(1, 200 / max(1, len(found)))
        own = [weight * sum(math.log((counts[x][g] + 0.05) / (sum(counts[x].values()) + 0.05 * 65536)) for g in found) for x in langs]
        logs.append((len(found), [*own, -weight * len(found) * math.log(max(2, 4 * kinds))]))
    votes = [langs[max(range(len(langs)), key=lambda i: (v[i], -i))] if n and max(v[:-1]) >= v[-1] else None for n, v in logs]
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None
    suffix = lambda h: h.split(".")[-1] if h and "." in h else None
    tally = {kind: Counter() for kind in "hdcs"}
    keys = [{"h": host, "d": domain(host), "c": declared, "s": suffix(host)} for _, host, declared in rows]
    for vote, key in zip(votes, keys):
        for kind in "hdcs":
            tally[kind][key[kind], vote] += 1
    total = {x: votes.count(x) for x in langs}
    n_all, k, out = sum(total.values()), len(langs), []
    for (n, v), vote, key in zip(logs, votes, keys):
        at = lambda kind, x, mine=0: 0 if key[kind] is None else tally[kind][key[kind], x] - (mine and x == vote)
        scores = []
        for i, x in enumerate(langs):
            prior = (total[x] + 1) / (n_all + k)
            for kind in "dh":
                prior = (at(kind, x, 1) + 5 * prior) / (sum(at(kind, y, 1) for y in langs) + 5)
            said = math.log((at("c", x) + 1 + 8 * (key["c"] == x)) / (total[x] + k + 8)) if key["c"] is not None else 0
            placed = math.log((at("s", x) + 1) / (total[x] + k)) if key["s"] is not None else 0
            scores.append(v[i] + math.log(prior * 0.99) + said + placed)
        rest = [math.log((sum(at(kind, x) for x in langs) + 1) / (n_all + k)) if key[kind] is not None else 0 for kind in "cs"]
        scores.append(v[-1] + math.log(0.01) + sum(rest))
        out.append([*langs, "und"][scores.index(max(scores))] if n and n_all else "und")
    return out


def test_pages_against_a_second_implementation(spark, sf_dir):
    import re

    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()
    plain = lambda h: re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", h or "")
    declared = lambda h: m[1].lower() if (m := re.search(r"<html[^>]*\slang=.?([a-zA-Z]{2,3})", h or "")) else None
    host = lambda u: m[1].lower() if (m := re.search(r"://([^/?#:@]+)", u or "")) else None
    want = brute_languages([(plain(r.html), host(r.url), declared(r.html)) for r in pages], docs)
    got = li.op5_language_id(spark, sf_dir).orderBy("page_id").collect()
    assert [r.lang for r in got] == want and len(set(want)) >= 4

import re

import pytest
from pyspark.sql import functions as F

from shardlore.llm import surrogates as sg

TEXTS = [
    (1, "Write to Anna.Smith@Mail7.Example.com or call +1 (974) 555-3436; host 97.51.17.173."),
    (2, "anna.smith@mail7.example.com, card 4929 3483 8514 6306 and 4929348385146306, IBAN DE89 3704 0044 0532 0130 00."),
    (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" SSN 123-45-6789'),
    (4, "Mr. Smith met Anna Smith, FRAU MÜLLER and Иван Петров. Mrs Jones too."),
    (5, None), (6, ""), (7, "clean words only, v1.2.3.4.5, 2024-01-02, 1234567, price 12.50"), (7, "clean words only, v1.2.3.4.5, 2024-01-02, 1234567, price 12.50"), (None, "x@y.org"),
    (8, "97.51.17.173 " * 500), (9, "9807915762804490 is a number of sixteen digits"), (10, "errest.23@mail3.example.com oned"),
]


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame([(*r, "a", "b") for r in TEXTS], "doc_id long, text string, kind string, swaps string")
    rows = sg.replace_entities(docs).select("row.doc_id", "n_entities", "kinds", "new_text", F.col("row.text").alias("old")).collect()
    return {r.doc_id: r for r in rows}


def test_nothing_private_is_left_and_the_rest_stays(out):
    before = {text[a:b] for _, text in TEXTS if text for a, b, _, _ in sg.find_entities(text)}
    for row in out.values():
        assert not any(e in (row.new_text or "") for e in before if len(e) > 6)
    for k in (5, 6, 7):
        assert (out[k].n_entities, out[k].new_text) == (0, out[k].old)
    assert out[1].new_text.startswith("Write to ") and " or call +1 (" in out[1].new_text
    assert (out[1].kinds, out[8].n_entities, out[9].kinds) == ("email,ip,phone", 500, "card")


def test_coreference_and_format(out):
    mail = re.search(r"\S+@\S+\.com", out[1].new_text)[0]
    assert re.search(r"\S+@\S+\.com", out[2].new_text)[0] == mail.lower() and mail[0].isupper() and mail[5].isupper()
    cards = re.findall(r"(?:\d{4} ?){4}", out[2].new_text.partition("IBAN")[0])
    assert cards[0].replace(" ", "").strip() == cards[1].strip() and " " in cards[0].strip() and cards[0][0] == "4"
    iban = re.search(r"DE[\d ]{25}", out[2].new_text)[0]
    assert sg.iban_rest(iban.replace(" ", "")) == 1 and iban[4] == " "
    ip = re.search(r"host ([\d.]+)\.$", out[1].new_text)[1]
    assert set(out[8].new_text.split()) == {ip} and all(int(x) < 256 for x in ip.split("."))
    assert re.search(r'token = "([0-9a-f]{40})"', out[3].new_text)
    assert sg.luhn("4929348385146306") == sg.luhn(cards[1].strip())


def test_neighbours_and_phone_forms():
    """A number isn't lost to the one next to it; all forms of a phone are one entity."""
    kinds = lambda t: [(k, c) for _, _, k, c in sg.find_entities(t)]
    assert kinds("+1 (843) 555-7672 97.51.17.173 now") == [("phone", "+18435557672"), ("ip", "97.51.17.173")]
    assert kinds("97.51.17.173 +1 (843) 555-7672 4845168114407329") == [("ip", "97.51.17.173"), ("phone", "+18435557672"), ("card", "4845168114407329")]
    assert {kinds(x)[0] for x in ("+1 (843) 555-7672 12 34", "(843) 555-7672", "843-555-7672", "+18435557672")} == {("phone", "+18435557672")}
    assert {kinds(x)[0] for x in ("+44 20 7946 0958", "+442079460958")} == {("phone", "+442079460958")}
    value = sg.surrogate("phone", "+18435557672", 0)
    assert value[:2] == "+1" and sg.lay_out("phone", "(843) 555-7672", value) == f"({value[2:5]}) {value[5:8]}-{value[8:]}"


def test_names(out):
    m = re.match(r"Mr\. (\w+) met (\w+) (\w+), FRAU (\w+) and (\w+) (\w+)\. Mrs (\w+) too\.", out[4].new_text)
    assert m[1] == m[3] and m[2] in sg.FIRST["latin", "f"] and m[4].isupper()
    assert m[5] in sg.FIRST["cyrillic", "m"] and m[6] in sg.LAST["cyrillic"] and m[7] not in (m[1], "Jones")


def test_names_after_capitalised_words():
    names = lambda t: [(t[a:b], k) for a, b, k, _ in sg.find_entities(t)]
    full = [("Anna", "first"), ("Smith", "last")]
    for text in ("Contact Anna Smith today", "Dear Anna Smith,", "Yesterday Anna Smith came", "The New Contact Anna Smith Today", "Anna Anna Smith", "Wir sahen es. Gestern Anna\nSmith"):
        assert names(text) == full, text
    assert names("Anna Smith Peter Jones") == [*full, ("Peter", "first"), ("Jones", "last")]
    assert names("Сегодня Иван Петров") == [("Иван", "first"), ("Петров", "last")]
    assert names("Contact Anna Nobody Smith") == names("Contact Anna. Smith") == []


def test_names_in_capitals_alone(spark):
    texts = [(1, "ANNA SMITH called"), (2, "CONTACT JÜRGEN MÜLLER NOW"), (3, "ИВАН ПЕТРОВ"), (4, "Then Anna Smith"), (5, "AnNA SMith"), (6, "anna smith"), (7, "Soﬁa Smith")]
    rows = sg.replace_entities(spark.createDataFrame(texts, "doc_id long, text string")).select("row.doc_id", "n_entities", "new_text").collect()
    out = {r.doc_id: r for r in rows}
    assert [out[k].n_entities for k in range(1, 8)] == [2, 2, 2, 2, 2, 0, 2]
    assert out[1].new_text.removesuffix(" called") == out[4].new_text.removeprefix("Then ").upper()


@pytest.mark.parametrize("length", [8, 512, 513, 800, 100_000])
def test_secrets_of_any_length(spark, length):
    secret = ("Ab1/cD2+eF3_" * length)[:length]
    docs = spark.createDataFrame([(1, f"token={secret} end")], "doc_id long, text string")
    (row,) = sg.replace_entities(docs).select("n_entities", "new_text").collect()
    left = re.fullmatch(r"token=(\S+) end", row.new_text)[1]
    assert row.n_entities == 1 and len(left) == length and secret[-8:] != left[-8:] and secret[:8] != left[:8]


def test_collisions_are_drawn_again(spark):
    """More last names than the list has, among them every name of it."""
    names = [f"latin:{n.casefold()}" for n in sg.LAST["latin"]] + [f"latin:name{k}" for k in range(100)]
    table = spark.createDataFrame([("last", n) for n in names], "kind string, canon string")
    first, again = (sorted(map(tuple, sg.assign_surrogates(table).collect())) for _ in range(2))
    values = [v for _, _, v in first]
    assert len(set(values)) == len(names) and not set(values) & set(names) and first == again
    assert sorted(map(tuple, sg.assign_surrogates(table, b"other").collect())) != first


def test_keys_and_empty_table(spark):
    assert sg.surrogate("email", "anna@b.org", 0) == sg.surrogate("email", "anna@b.org", 0) != sg.surrogate("email", "anna@b.org", 0, b"k")
    assert sg.replace_entities(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sg.replace_entities(docs).select("row.text", "new_text", "n_entities").collect()
    private = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\b[0-9a-f]{40}\b")
    for r in rows:
        old = set(private.findall(r.text))
        assert not old & set(private.findall(r.new_text)) and (r.n_entities > 0) == bool(old)
        assert len(private.findall(r.text)) == len(private.findall(r.new_text))
        assert private.sub("_", r.text) == private.sub("_", r.new_text)


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.new_text for r in sorted(sg.replace_entities(docs).select("row.doc_id", "new_text").collect())]


def test_titles_in_odd_case(spark):
    old = ["Mrſ Anna Smith", "κύριοσ Νίκος Παπαδόπουλος", "MıSS Anna Smith", "I miss Paris"]
    new = replaced(spark, old)
    assert [o.split()[0] == n.split()[0] and o != n for o, n in zip(old, new)] == [True, True, True, False]
    assert new[0].split()[1:] == new[2].split()[1:]


def test_digits_of_any_script(spark):
    ascii_ = ["+1 (974) 555-3436", "4929 3483 8514 6306", "97.51.17.173", "123-45-6789", "DE89 3704 0044 0532 0130 00"]
    shift = lambda t, zero: "".join(chr(zero + int(c)) if c.isdigit() else c for c in t)
    mixed = lambda t: "".join(chr((48, 0x660, 0xFF10)[k % 3] + int(c)) if c.isdigit() else c for k, c in enumerate(t))
    old = [f"x {f(t)} y" for t in ascii_ for f in (str, lambda t: shift(t, 0x660), lambda t: shift(t, 0xFF10), mixed)]
    new = replaced(spark, old)
    to_ascii = lambda t: "".join(str(int(c)) if c.isdecimal() else c for c in t)
    for k in range(0, len(old), 4):
        assert len({to_ascii(n) for n in new[k : k + 4]}) == 1 and new[k] != old[k]
    for o, n in zip(old, new):
        if "." not in o:
            assert [c.isdecimal() and ord(c) - int(c) for c in o] == [c.isdecimal() and ord(c) - int(c) for c in n]  # each digit in its script
            assert sum(a != b for a, b in zip(o, n)) >= 5


def test_formats_with_too_few_values(spark):
    """Domains of one letter, secrets of signs, short phones: all become distinct, and nothing raises."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{u}@{d}.co" for d in letters for u in "abcd"]
    signs = ['password: "====....----____++++"', 'password: "=-=-....----____++++"', 'password = "========-----___+++/a"']
    phones = [f"+7 12345{k}" for k in range(10)] + [f"+7 1{k:05d}" for k in range(0, 100000, 997)]
    new = replaced(spark, mails + signs + phones)
    old = mails + signs + phones
    assert len(set(new)) == len(old) and not set(new) & set(old)
    domains = {}
    for o, n in zip(mails, new):
        domains.setdefault(o.split("@")[1], set()).add(n.split("@")[1])
    assert all(len(v) == 1 for v in domains.values()) and len(set.union(*domains.values())) == 26
    assert all("====" not in n and "----" not in n for n in new[len(mails) : len(mails) + 2])


def test_names_are_learnt_from_titles(spark):
    texts = ["Dr. Zelda Quuxley wrote", "Yesterday Zelda Quuxley came", "Zelda Nobody", "Mrs Oddname", "Anna Oddname", "Then Zelda Oddname left", "Frau Zelda Quuxley", "Bank Street", "Mr Bank Street", *["Bank Street"] * 40]
    new = replaced(spark, texts)
    first, last = re.match(r"Dr\. (\w+) (\w+) wrote", new[0]).groups()
    assert new[1] == f"Yesterday {first} {last} came" and new[6] == f"Frau {first} {last}" and first in sg.FIRST["latin", "f"]
    odd = new[3].split()[1]
    assert new[2] == texts[2] and new[4].split()[1] == odd and new[5] == f"Then {first} {odd} left"
    assert new[7] == "Bank Street" == new[-1] and new[8] != texts[8]


def test_repeated_and_missing_ids_and_clashing_columns(spark):
    rows = [(None, "a@x.org", "p"), (None, "b@x.org", "q"), (None, "b@x.org", "q"), (4, "a@x.org", "r"), (4, "10.1.2.3", None), (5, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, swaps string").withColumn("row", F.lit(1)).withColumn("n_entities", F.lit("x")).withColumn("doc", F.lit(2))
    out = sg.replace_entities(docs).select("row.doc_id", F.col("row.text").alias("old"), "row.swaps", "new_text", "n_entities").collect()
    new = {r.old: r.new_text for r in out}
    assert len(out) == 6 and len({v for v in new.values()}) == 4 and all(r.new_text == new[r.old] for r in out)
    assert new["a@x.org"].split("@")[1] == new["b@x.org"].split("@")[1] != "x.org" and sorted(r.n_entities for r in out) == [0, 1, 1, 1, 1, 1]


PLAIN = (
    ("email", r"[A-Za-z0-9][\w.+%-]*@[\w.-]+\.[a-z]+"), ("secret", r"(?<==\s\")[0-9a-f]{40}|\b[0-9a-f]{40}\b"), ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)"), ("card", r"\b\d{16}\b"),
)


def test_against_a_second_implementation(spark, sf_dir):
    """Every text of the given documents, with entities found by simple patterns and surrogates assigned one by one in a dictionary."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    canon = {"email": str.lower, "secret": str, "phone": lambda s: "+" + re.sub(r"\D", "", s), "ip": str, "card": str}
    whole = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PLAIN), re.A)
    entities = {(m.lastgroup, canon[m.lastgroup](m[0])) for _, t in rows for m in whole.finditer(t)}
    entities |= {("domain", c.split("@")[1]) for k, c in entities if k == "email"}
    assert {k for k, _ in entities} >= {"email", "domain", "phone", "ip", "card"}
    value = {}
    waiting, attempt = sorted(entities), 0
    while waiting:
        drawn, rest = {}, []
        for kind, c in waiting:
            scope = c.split("@")[1] if kind == "email" else ""
            v = sg.surrogate(kind, c, attempt)
            clash = (kind, f"{v}@{scope}" if scope else v) in entities or (kind, scope, v) in drawn or (kind, scope, v) in {(k, s, x) for (k, _), (s, x) in value.items()}
            if clash:
                rest.append((kind, c))
            else:
                drawn[kind, scope, v] = c
        value |= {(kind, c): (scope, v) for (kind, scope, v), c in drawn.items()}
        waiting, attempt = rest, attempt + 1

    def put(m):
        kind, c = m.lastgroup, canon[m.lastgroup](m[0])
        v = value[kind, c][1]
        if kind == "email":
            v += "@" + value["domain", c.split("@")[1]][1]
            return "".join(n.upper() if o.isupper() else n for o, n in zip(m[0], v, strict=True))
        return re.sub(r"\d", lambda _, it=iter(v[1:]): next(it), m[0]) if kind == "phone" else v

    want = sorted((i, whole.sub(put, t)) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in sg.replace_entities(docs).select("row.doc_id", "new_text").collect()) == want

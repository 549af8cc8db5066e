r"""PII: detected entities get keyed, type-consistent surrogates.

Detection is by strict patterns: e-mail addresses, phone numbers, IPv4
addresses, card numbers (digits in a card's layout, Luhn-valid or not), IBANs
with right check digits, US social security numbers, secrets assigned to a named
variable or with a known prefix, and persons.  Digits of any script count.

Persons are names after a title, and pairs of a first and a last name.  Which
words are names isn't fixed but learnt from the whole corpus: a word is a first
(last) name if the documents that have it in this place after a title are at
least one for each ``TITLE_SHARE`` that have it in this place of a capitalised
pair.  The share doesn't change with the corpus' size.  The small gazetteers
below only add to these, and are what name surrogates are drawn from.

An entity is (kind, canonical form): case, spaces and punctuation of a surface
don't matter, so one entity has one surrogate in the whole corpus
(coreference), laid out in each surface's own format: digits for digits in the
surface's script, letters for letters in the same case, separators as they were,
a phone with or without its country code.  Kinds keep what makes them valid: a
card's Luhn property and first digit, an IBAN's country and check digits, a
phone's country code, octets below 256, a top-level domain; a first name's
surrogate has its gender (if titles and gazetteers agree on one) and script, a
last name's its script.  The domain of an address is an entity of its own:
colleagues stay colleagues, and distinct domains stay distinct.

Surrogates come from HMAC-SHA256 under a secret key.  Collision checks: over
the distinct entities, a surrogate that two entities share (all but the least
of them), or that is itself an entity of the corpus, is drawn again; only such
entities are.  After ``FIRM`` attempts a surrogate may be longer than its
surface, ever more so, so that entities of a format with too few values (a
domain of one letter, a secret of signs) become distinct as well, and no entity
can stop a run.

The entity table is grouped with partial aggregates; texts meet their
replacements in one join on a hash of (id, text).  A collision of that hash
only adds replacements that the other text doesn't use.

Edge cases: null or empty texts have no entities and stay as they are.
Repeated rows get equal results; rows without an id, and different texts of one
id, are each replaced on their own.  An empty table gives an empty result.
Extra columns are carried by :func:`replace_entities` inside ``row`` whatever
their names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

#: Give a secret key of your own; this one only makes runs agree.
KEY = b"shardlore-example-key"
#: Documents with a word in a pair that one with it after a title speaks for.
TITLE_SHARE = 20
#: Attempts that keep the length of the surface.
FIRM = 3

FIRST = {
    ("latin", "f"): "Anna Maria Laura Emma Julia Sarah Elena Sofia Clara Marie Lucia Paula Alice Helen Irene Nora Eva Ines Rosa Carmen Claire Sophie Camille Greta Heidi Ingrid Linda Mary Susan Karen".split(),
    ("latin", "m"): "John Peter Paul David Martin Thomas Daniel Michael Robert James William Carlos Miguel Pedro Jorge Luis Pierre Louis Henri Jacques Hans Karl Klaus Stefan Jürgen Antonio Marco George Edward Frank".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Татьяна Наталья Ирина Светлана Екатерина Дарья Юлия Вера".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Владимир Юрий Олег Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Ειρήνη Δήμητρα Γεωργία".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Πέτρος Ανδρέας".split(),
}
LAST = {
    "latin": "Smith Jones Brown Taylor Wilson Johnson Miller Davis Garcia Martinez Lopez Sanchez Fernandez Gonzalez Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Dubois Moreau Laurent Lefebvre Bernard Durand Rossi Bianchi Clark Lewis Walker Hall".split(),
    "cyrillic": "Иванов Петров Сидоров Смирнов Кузнецов Попов Соколов Лебедев Новиков Морозов Волков Орлов".split(),
    "greek": "Παπαδόπουλος Νικολάου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Αντωνίου Βασιλείου".split(),
}
SYLLABLES = {"latin": "ra lin to mar ve ni sol der ka min".split(), "cyrillic": "ра лин то мар ве ни сол дер ка мин".split(), "greek": "ρα λιν το μαρ βε νι σολ δερ κα μιν".split()}
TITLES = {"mr": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "г-н": "m", "г-жа": "f", "κύριος": "m", "κυρία": "f", "dr": "", "prof": ""}
_TITLE_GENDER = {re.compile(re.escape(t), re.I): g for t, g in TITLES.items()}
_GENDER = {n.casefold(): g for (_, g), names in FIRST.items() for n in names}
_LAST = {n.casefold() for names in LAST.values() for n in names}

_NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][^\W\d_]+)?"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])", re.A)),
    ("secret", re.compile(r"""(?i:(?<![A-Za-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?token|private[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?)([A-Za-z0-9+/_.=-]{8,})""")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})", re.A)),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{4}(?:\d{1,3})?(?![\d-]|\.\d)|(?<![\d.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-]|\.\d)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\w)")),
    ("ssn", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}(?![\w-])|(?<![\w(+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+(-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])")),
    ("title", re.compile(rf"(?<!\w)((?i:{'|'.join(TITLES)}))(\.?\s{{1,2}})({_NAME})(?:(\s)({_NAME}))?")),
    # the second name is only looked at: it may be the first of the next pair
    ("person", re.compile(rf"(?<!\w)({_NAME})(?=(\s)({_NAME})(?!\w))")),
)
#: The patterns cost most where nothing is to be found; a text without these can have no entity of the kind.
_HINTS = {"email": re.compile("@"), "title": re.compile(rf"(?<!\w)(?i:{'|'.join(TITLES)})(?!\w)")}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script_of(name: str) -> str:
    first = ord(name[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


#: Country codes of one and of two digits; all others have three.
_SHORT_CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in _SHORT_CODES), digits[:3])


#: Digits of scripts other than ASCII's; each script has its ten in a row.
_FOREIGN_DIGIT = re.compile(r"[^\D0-9]")
_TO_ASCII = {c: int(chr(c)) + 48 for c in range(128, 0x20000) if chr(c).isdecimal()}


def title_gender(title: str) -> str:
    """Whatever the pattern matched without regard to case, such as a long s, is one of the titles."""
    return next(g for pattern, g in _TITLE_GENDER.items() if pattern.fullmatch(title))


def name_form(name: str) -> str:
    return f"{script_of(name)}:{name.casefold()}"


@dataclass
class Found:
    """spans: (start, end, kind, canonical form), in order and without overlaps; genders: (first name, gender or ""); pairs: capitalised words in pairs that aren't known as names."""

    spans: list[tuple[int, int, str, str]]
    genders: set[tuple[str, str]]
    pairs: set[tuple[str, str]]


def detect(text: str, firsts: Container[str] = (), lasts: Container[str] = ()) -> Found:
    """The entities of a text; firsts and lasts: forms of names beyond the gazetteers. Later patterns don't see what earlier ones took."""
    taken: list[tuple[int, int, str, str]] = []
    found: list[tuple[int, int, str, str]] = []
    genders: set[tuple[str, str]] = set()
    pairs: set[tuple[str, str]] = set()
    if not text.isascii() and _FOREIGN_DIGIT.search(text):
        text = text.translate(_TO_ASCII)  # one code point for one: places stay
    rest = text

    def add(start: int, end: int, kind: str, canon: str) -> None:
        found.append((start, end, kind, canon))

    digits = lambda s: re.sub(r"\D", "", s)
    has_digit = re.search(r"\d", text) is not None
    for kind, pattern in PATTERNS:
        if kind in _HINTS and not _HINTS[kind].search(text) or kind in ("iban", "card", "ip", "ssn", "phone") and not has_digit:
            continue
        for m in pattern.finditer(rest):
            if kind == "email":
                add(*m.span(), kind, m[0].lower())
            elif kind == "secret":
                if len(set(m[1])) >= 5 and (re.search(r"\d", m[1]) or len(m[1]) >= 16):
                    add(*m.span(1), kind, m[1])
            elif kind == "iban":
                canon = m[0].replace(" ", "")
                if 15 <= len(canon) <= 34 and iban_rest(canon) == 1:
                    add(*m.span(), kind, canon)
            elif kind in ("card", "ssn"):
                add(*m.span(), kind, digits(m[0]))
            elif kind == "phone":
                number = digits(m[0])
                if 7 <= len(number) <= 15:  # without a country code it is a number of country 1
                    add(*m.span(), kind, "+" + ("" if m[0][0] == "+" else "1") + number)
            elif kind == "ip":
                add(*m.span(), kind, ".".join(str(int(x)) for x in m[0].split(".")))
            elif kind == "title":
                if m[1] == "miss":  # far more often a verb
                    continue
                if m[5]:
                    add(*m.span(3), "first", name_form(m[3]))
                    genders.add((name_form(m[3]), _GENDER.get(m[3].casefold(), title_gender(m[1]))))
                add(*m.span(5 if m[5] else 3), "last", name_form(m[5] or m[3]))
            elif not found or m.start() >= found[-1][1]:
                first, last = name_form(m[1]), name_form(m[3])
                if (m[1].casefold() in _GENDER or first in firsts) and (m[3].casefold() in _LAST or last in lasts):
                    add(*m.span(1), "first", first)
                    add(*m.span(3), "last", last)
                    genders.add((first, _GENDER.get(m[1].casefold(), "")))
                else:
                    pairs.add((first, last))
        if found:
            pieces, at = [], 0
            for start, end, *_ in found:
                pieces += [rest[at:start], "\0" * (end - start)]
                at = end
            rest = "".join([*pieces, rest[at:]])
            taken += found
            found.clear()
    return Found(sorted(taken), genders, pairs)


def find_entities(text: str, firsts: Container[str] = (), lasts: Container[str] = ()) -> list[tuple[int, int, str, str]]:
    return detect(text, firsts, lasts).spans


class _Draw:
    """A stream of small numbers from HMAC-SHA256."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.seed, self.n, self.pool = key, "\0".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def some(self, n: int, signs: str = "0123456789") -> str:
        return "".join(signs[self.below(len(signs))] for _ in range(n))

    def like(self, text: str, more: int = 0) -> str:
        """The same format: digit for digit, letter for letter; hex stays hex; signs alone become letters and digits. more: how many signs longer."""
        if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", text) and not text.isdigit():
            return self.some(len(text) + more, "0123456789ABCDEF" if text.isupper() else "0123456789abcdef")
        if not any(c.isascii() and c.isalnum() for c in text):
            return self.some(len(text) + more, "abcdefghijklmnopqrstuvwxyz0123456789")
        out = []
        for c in text:
            if c.isascii() and c.isdigit():
                out.append(str(self.below(10)))
            elif c.isascii() and c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + self.below(26)))
            else:
                out.append(c)
        return "".join(out) + self.some(more, "0123456789" if text.isdigit() else "abcdefghijklmnopqrstuvwxyz")


def surrogate(kind: str, canon: str, attempt: int, key: bytes = KEY, gender: str = "") -> str:
    """The canonical form of an entity's surrogate; of an e-mail address, that of its local part."""
    draw = _Draw(key, kind, canon, str(attempt))
    more = max(0, attempt - FIRM) ** 2
    if kind == "email":
        return draw.like(canon.rpartition("@")[0], more)
    if kind == "domain":
        *labels, top = canon.split(".")
        return ".".join([*(draw.like(x) for x in labels[:-1]), draw.like(labels[-1], more), top])
    if kind == "phone":
        code = country_code(canon[1:])
        return "+" + code + draw.like(canon[1 + len(code) :], more)
    if kind == "ip":
        octets = ".".join(str(1 + draw.below(254)) for _ in range(4))
        # addresses are used up at last: go on in the range that is set apart for documentation
        return octets if not more else "2001:db8:" + ":".join(draw.some(4, "0123456789abcdef") for _ in range(6))
    if kind == "card":
        body = canon[0] + draw.like(canon[1:-1], more)
        good = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (good if luhn(canon) else str((int(good) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = draw.like(canon[4:], more)
        return canon[:2] + f"{98 - iban_rest(canon[:2] + '00' + body):02d}" + body
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + draw.some(more)
    if kind in ("first", "last"):
        script = canon.partition(":")[0]
        names = FIRST[script, gender or "mf"[draw.below(2)]] if kind == "first" else LAST[script]
        name = names[draw.below(len(names))]
        extra = "".join(SYLLABLES[script][draw.below(10)] for _ in range(2 * max(0, attempt - 1)))
        return f"{script}:{(name + extra).casefold()}"
    return draw.like(canon, more)


def _digit_like(old: str, new: str) -> str:
    """A digit in the script of another."""
    return chr(ord(old) - int(old) + int(new)) if old.isdecimal() and new.isdecimal() else new


def _filled(surface: str, signs: str, letters: bool) -> str:
    """surface with its digits (and ASCII letters) replaced in turn; what is left of signs comes at the end."""
    rest = iter(signs)
    out = [_digit_like(c, next(rest, c)) if c.isdecimal() or letters and c.isascii() and c.isalpha() else c for c in surface]
    return "".join([*out, *rest])


def _cased(surface: str, value: str) -> str:
    return "".join(n.upper() if c is not None and c.isupper() else n for c, n in zip_longest(surface, value) if n is not None)


def lay_out(kind: str, surface: str, value: str) -> str:
    """A surrogate's canonical form in the format of a surface."""
    if kind in ("first", "last"):
        name = value.rpartition(":")[2]
        return name.upper() if surface.isupper() and len(surface) > 1 else "-".join(p.capitalize() for p in name.split("-"))
    if kind == "ip":
        sample = next(c for c in surface if c.isdecimal())
        return "".join(_digit_like(sample, c) if c.isdecimal() else c for c in value)
    if kind == "secret":
        return value
    if kind == "email":
        old, new = surface.rpartition("@"), value.rpartition("@")
        return _cased(old[0], new[0]) + "@" + ".".join(_cased(*labels) for labels in zip(old[2].split("."), new[2].split("."), strict=True))
    if kind == "iban":
        return _filled(surface, value, True)
    signs = value.removeprefix("+")
    return _filled(surface, signs[1:] if kind == "phone" and surface[0] != "+" else signs, False)  # a surface without a country code is of country 1


ENTITIES = "doc long, kind string, canon string, note string"


def entities(texts: DataFrame) -> DataFrame:
    """(doc, text) -> distinct (doc, kind, canon, note) with one row a domain, and rows of kind 'pair' for two words that may be names: canon and note.

    The note of a first name is the gender that a title or the gazetteer gives it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = detect(text or "")
                own = {(k, c, "") for _, _, k, c in found.spans if k != "first"} | {("first", *x) for x in found.genders}
                own |= {("domain", c.rpartition("@")[2], "") for _, _, k, c in found.spans if k == "email"}
                rows += [(doc, *x) for x in sorted(own)] + [(doc, "pair", *x) for x in sorted(found.pairs)]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 3), strict=True)], ["doc", "kind", "canon", "note"])

    return texts.mapInArrow(run, ENTITIES)


def with_learned_names(found: DataFrame) -> DataFrame:
    """(doc, kind, canon, note): pairs become names where the corpus or the gazetteers know both words as such."""
    spark = found.sparkSession
    listed = [("first", name_form(n)) for names in FIRST.values() for n in names] + [("last", name_form(n)) for names in LAST.values() for n in names]
    one = lambda kind, name, titled: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("canon"), F.lit(titled).alias("titled"))
    votes = F.when(F.col("kind") == "first", F.array(one("first", "canon", True))).when(F.col("kind") == "last", F.array(one("last", "canon", True)))
    votes = votes.when(F.col("kind") == "pair", F.array(one("first", "canon", False), one("last", "note", False)))
    votes = found.select("doc", F.explode(votes).alias("v")).groupBy("v.kind", "v.canon").agg(F.count_if(F.col("v.titled")).alias("titled"), F.count_if(~F.col("v.titled")).alias("paired"))
    learnt = votes.filter((F.col("titled") > 0) & (F.col("titled") * TITLE_SHARE >= F.col("paired"))).select("kind", "canon")
    known = learnt.union(spark.createDataFrame(listed, "kind string, canon string")).dropDuplicates()
    firsts = known.filter("kind = 'first'").select(F.col("canon"))
    lasts = known.filter("kind = 'last'").select(F.col("canon").alias("note"))
    pairs = found.filter("kind = 'pair'").join(lasts, "note", "left_semi").join(firsts, "canon", "left_semi")
    made = pairs.select("doc", F.explode(F.array(F.struct(F.lit("first").alias("kind"), "canon"), F.struct(F.lit("last").alias("kind"), F.col("note").alias("canon")))).alias("e"))
    return found.filter("kind <> 'pair'").unionByName(made.select("doc", "e.kind", "e.canon", F.lit("").alias("note")))


def assign_surrogates(distinct: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, canon[, note]) -> (kind, canon, value): distinct within a kind (of addresses: within a domain), and no entity of the table itself."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            values = [surrogate(kind, canon, attempt, key, note) for kind, canon, note, _, attempt in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], [*names, "value"])

    names = ["kind", "canon", "note", "scope", "attempt"]
    schema = "kind string, canon string, note string, scope string, attempt int, value string"
    place = ["kind", "scope", "value"]
    if "note" not in distinct.columns:
        distinct = distinct.withColumn("note", F.lit(""))
    mail = F.col("kind") == "email"
    every = distinct.withColumn("scope", F.when(mail, F.substring_index("canon", "@", -1)).otherwise(""))
    real = every.select("kind", "scope", F.when(mail, F.expr("left(canon, length(canon) - length(scope) - 1)")).otherwise(F.col("canon")).alias("value")).withColumn("real", F.lit(True))
    order = F.row_number().over(Window.partitionBy(*place).orderBy("canon"))

    def checked(drawn: DataFrame, tag: str, others: DataFrame) -> DataFrame:
        bad = (order > 1) | F.coalesce("real", F.lit(False))
        return staged(drawn.join(others, place, "left").withColumn("bad", bad).select(*names, "value", "bad"), tag)

    rows = checked(every.select(*names[:4], F.lit(0).alias("attempt")).mapInArrow(draw, schema), "surrogates-0", real)
    settled = rows.filter("not bad")
    attempt = 0
    while rows.filter("bad").limit(1).count():  # more than FIRM rounds only where a format has too few values
        attempt += 1
        again = rows.filter("bad").withColumn("attempt", F.lit(attempt)).select(*names)
        drawn = staged(again.mapInArrow(draw, schema), f"surrogates-draw-{attempt}")
        # what is settled or real is cut to the few values drawn now, then joined
        used = settled.select(*place).unionByName(real.select(*place)).join(drawn.select(*place), place, "left_semi").dropDuplicates().withColumn("real", F.lit(True))
        rows = checked(drawn, f"surrogates-{attempt}", used)
        settled = settled.unionByName(rows.filter("not bad"))
    return settled.select("kind", "canon", "value")


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """(row, n_entities, kinds, new_text): row holds the columns of docs."""
    ident = F.xxhash64(F.col(id_col), F.col(text_col))
    raw = staged(entities(docs.select(ident.alias("doc"), F.col(text_col).alias("text"))), "entities-raw")
    found = staged(with_learned_names(raw), "entities")
    # a first name has the gender that all evidence for it agrees on
    evidence = F.collect_set(F.nullif("note", F.lit("")))
    distinct = found.groupBy("kind", "canon").agg(evidence.alias("notes")).select("kind", "canon", F.when(F.size("notes") == 1, F.col("notes")[0]).otherwise("").alias("note"))
    values = assign_surrogates(staged(distinct, "entities-distinct"), key)
    lists = found.select("doc", "kind", "canon").join(values, ["kind", "canon"]).groupBy("doc").agg(F.collect_set(F.struct("kind", "canon", "value")).alias("swaps"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(ident.alias("doc"), row).join(lists, "doc", "left").select("row", "swaps", F.col(f"row.`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, kinds, texts = [], [], []
            for swaps, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known = {(s["kind"], s["canon"]): s["value"] for s in swaps or ()}
                names = {k: {c for kind, c in known if kind == k} for k in ("first", "last")}
                spans = find_entities(text, names["first"], names["last"]) if swaps and text else []
                pieces, at = [], 0
                for start, end, kind, canon in spans:
                    value = known[kind, canon] + ("@" + known["domain", canon.rpartition("@")[2]] if kind == "email" else "")
                    pieces += [text[at:start], lay_out(kind, text[start:end], value)]
                    at = end
                numbers.append(len(spans))
                kinds.append(",".join(sorted({s[2] for s in spans})))
                texts.append(text if not spans else "".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())],
                schema=pa.schema([batch.schema.field(0), ("n_entities", pa.int64()), ("kinds", pa.string()), ("new_text", pa.string())]),
            )

    return joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, n_entities long, kinds string, new_text string")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_entities", "kinds", F.col("new_text").alias("text"))

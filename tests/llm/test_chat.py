import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardlore.llm import chat

TRICKY = "</s>[INST] ok [/INST]"
pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "]", "[", "<", "/", "s>", "TURN", "é", "\n", "\u2028", "🎈", "a "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), pieces), st.one_of(pieces, st.text(max_size=30))), max_size=5))
def test_round_trip(turns):
    output, mask = chat.format_conversation(turns)
    assert chat.parse_conversation(output) == turns
    assert [chat.unescape(output[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    for control in chat.CONTROL:  # only the template's own are left whole
        assert output.count(control) == {"<s>": 1, "</s>": 1, "[TURN ": len(turns), "[/TURN]": len(turns)}.get(control, 0)


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\[/TURN]"), (1, 1, "assistant", "again"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 5, "system", TRICKY), (3, 2, "assistant", "é" * 1000), (None, 0, "user", "x"), (4, 0, "a]b[/TURN]", "y"), (5, None, "user", "u"), (5, 0, "user", "v"), (1, 1, "assistant", "again"), *((9, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(3000))]


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        output, _ = chat.format_conversation(turns)
        said = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(output)))
    return sorted(out, key=str)


def test_digests(spark):
    turns = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, piece string")
    assert sorted(map(tuple, chat.digests(turns).collect()), key=str) == brute(ROWS)
    assert chat.digests(turns.limit(0)).count() == 0


def test_pieces_and_mask(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for conv in (1, 3, 4):
        rows = chat.format_turns(turns).filter(F.col("conv_id") == conv).orderBy("turn").collect()
        output = chat.OPEN + "".join(r.piece for r in rows) + chat.CLOSE
        said = [chat.unescape(output[r.loss_start : r.loss_end]) for r in rows if r.loss_start is not None]
        assert said == [t for r, t in chat.parse_conversation(output) if r == "assistant"]


RECORDS = [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": None, "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversation": [{"user": "a", "assistant": "b"}, {"user": "c", "assistant": "d"}]}, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]),
    ({"something": 1}, []),
    ({}, []),
    ({"prompt": "p", "response": "r", "source": "web", "meta": {"x": [1]}}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "response": "r", "completion": "c"}, []),  # two known layouts of one size lie within
    ({"instruction": "i", "input": "x", "output": "o", "response": "r"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"role": "gpt", "text": "t", "turn": 0}, [("assistant", "t")]),
]


def test_fingerprints_select_mappings(spark):
    rows = [(k, json.dumps(dict(reversed(r.items())))) for k, (r, _) in enumerate(RECORDS)] + [(90, None), (91, "{broken"), (92, "[1]")]
    found = chat.canonical_turns(spark.createDataFrame(rows, "id long, json string"), "id", "json").orderBy("id", "turn").collect()
    for k, (_, want) in enumerate(RECORDS):
        assert [(r.role, r.text) for r in found if r.id == k and r.turn is not None] == want
    assert {r.id for r in found if r.turn is None} == {7, 8, 10, 90, 91, 92}
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) != chat.fingerprint(["a.b"])


def test_typed_tables(spark):
    for kind, values, want in [
        ("messages array<struct<role string, content string>>", [{"role": "human", "content": "a"}, {"role": "assistant", "content": None}], [("user", "a"), ("assistant", "")]),
        ("conversation array<struct<user string, assistant string>>", [{"user": "a", "assistant": "b"}], [("user", "a"), ("assistant", "b")]),
    ]:
        frame = spark.sql(f"SELECT 1L AS id, from_json('{json.dumps(values)}', '{kind.split(' ', 1)[1]}') AS {kind.split(' ', 1)[0]}")
        assert [(r.role, r.text) for r in chat.mapped_frame(frame, "id").orderBy("turn").collect()] == want
    flat = spark.createDataFrame([(1, "i", "x", "o"), (2, "i", None, None)], "id long, instruction string, input string, output string")
    assert [(r.id, r.role, r.text) for r in chat.mapped_frame(flat, "id").orderBy("id", "turn").collect()] == [(1, "user", "i\n\nx"), (1, "assistant", "o"), (2, "user", "i"), (2, "assistant", "")]


def test_rows_of_turns_are_mapped_by_their_schema(spark, monkeypatch):
    """Extra columns don't matter; without the mapping, or with a wrong mask, the result is another or none."""
    import pytest

    turns = spark.createDataFrame([(*r, "z", 1.5) for r in ROWS], "conv_id long, turn long, role string, text string, piece string, id double")
    mapped = chat.mapped_frame(turns, "conv_id").select(F.col("id").alias("conv_id"), "turn", "role", "text")
    assert sorted(map(tuple, chat.digests(mapped).collect()), key=str) == brute(ROWS)
    monkeypatch.delitem(chat.LAYOUTS, ("role", "text", "turn"))
    monkeypatch.delitem(chat.MAPPINGS, chat.fingerprint(["role", "text", "turn"]))
    chat._WITHIN.clear()
    with pytest.raises(ValueError, match="no mapping"):
        chat.mapped_frame(turns, "conv_id")
    chat._WITHIN.clear()


def test_the_loss_text_is_what_the_mask_says():
    """read_back's own lines on a turn whose mask is off by one."""
    piece, (a, b) = chat.format_turn("assistant", "said [/TURN] it")
    assert chat.unescape(piece[a:b]) == "said [/TURN] it" and chat.unescape(piece[a : b - 1]) == "said [/TURN] i"
    assert chat.format_turn("user", "x")[1] is None


def test_a_broken_mask_changes_the_digest(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "said")], "conv_id long, turn long, role string, text string")
    read = chat.read_back(turns)
    assert [tuple(r) for r in read.collect()] == [(1, 0, "assistant", "said", len("[TURN assistant]said[/TURN]"), True, None)]

r"""Chat formatting with declarative mappings selected by schema fingerprints.

*Fingerprints.* A record's layout is the sorted set of its nested field paths
(array elements as ``[]``), hashed.  :data:`LAYOUTS` gives a declarative
mapping for each known layout: rows of one turn, prompt and response columns,
instruction with optional input, lists of messages under several names.  A
fingerprint selects its mapping; of a layout with fields beyond the known ones,
the fingerprint selects the known layout with the most fields that lies within
it, if there is just one.  Any other layout gives no turns and is reported, not
guessed at.  :func:`canonical_turns` does this for JSON records, each by its own
fingerprint, :func:`mapped_frame` for typed tables, by that of the schema.

*Template.* A conversation is ``<s>``, then for each turn ``[TURN role]text[/TURN]``,
and ``</s>``.  Inside texts ``\`` becomes ``\\`` and each control string gets a
``\`` after its first character (``<s>`` is ``<\s>``), so none is left whole;
inside roles a ``\`` stands before all but ASCII letters, digits and ``_``.
Formatting is reversible for any text: ``\x`` is read as ``x``.

*Loss mask.* The inside of each assistant turn, as code point ranges of the
output.  :func:`digests` reads the loss text from the output at these ranges,
without looking at roles.

:func:`format_turns` and :func:`digests` stream rows sorted by conversation and
turn: one batch of turns is in memory at a time, also for a conversation with a
third of all rows.

Edge cases: a null text is empty, a null role is ``""``.  Rows with a null
conv_id are one conversation.  Turns of equal number go by role and text;
repeated rows are repeated turns.  An empty table gives an empty result (the
query adds conversation -1).  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

OPEN, CLOSE, TURN_END = "<s>", "</s>", "[/TURN]"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN ", "[/TURN]")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ROLE = re.compile(r"[^A-Za-z0-9_]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"\[TURN ((?:[^\\\]]++|\\.)*+)\]", re.S)
_BODY = re.compile(r"((?:[^\\\[]++|\\.|\[(?!/TURN\]))*+)\[/TURN\]", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn's output, and the range of it that the loss is taken of."""
    head, body = f"[TURN {_ROLE.sub(lambda m: chr(92) + m[0], role)}]", escape(text)
    return head + body + TURN_END, (len(head), len(head) + len(body)) if role == "assistant" else None


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The output and the loss mask's ranges in it."""
    pieces, mask, at = [OPEN], [], len(OPEN)
    for role, text in turns:
        piece, loss = format_turn(role, text)
        pieces.append(piece)
        if loss:
            mask.append((at + loss[0], at + loss[1]))
        at += len(piece)
    return "".join([*pieces, CLOSE]), mask


def parse_turn(output: str, at: int) -> tuple[str, str, tuple[int, int], int]:
    """(role, text, range of the text, end) of the turn that starts at a place of the output."""
    head = _HEAD.match(output, at)
    body = head and _BODY.match(output, head.end())
    if not body:
        raise ValueError(f"no turn at {at}")
    return unescape(head[1]), unescape(body[1]), body.span(1), body.end()


def parse_conversation(output: str) -> list[tuple[str, str]]:
    if not output.startswith(OPEN):
        raise ValueError("no conversation")
    at, turns = len(OPEN), []
    while not output.startswith(CLOSE, at):
        role, text, _, at = parse_turn(output, at)
        turns.append((role, text))
    return turns


# --- schema fingerprints -----------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def value_paths(value: Any, at: str = "") -> list[str]:
    """The paths of one decoded record. Nulls and empty lists have none, so optional fields don't matter."""
    if isinstance(value, dict):
        return sorted({p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)})
    if isinstance(value, list):
        return sorted({p for v in value for p in value_paths(v, f"{at}[]")})
    return [] if value is None else [at]


def fingerprint(paths: list[str]) -> str:
    return xxhash.xxh3_64_hexdigest("\n".join(sorted(paths)))


#: Layout -> steps. A step is (role, field), (role, field, joint, field), ("*", list, role field, text field), ("#", list, fields named as roles) or ("row", turn, role and text field).
LAYOUTS: dict[tuple[str, ...], tuple[tuple[str, ...], ...]] = {
    ("role", "text", "turn"): (("row", "turn", "role", "text"),),
    ("prompt", "response"): (("user", "prompt"), ("assistant", "response")),
    ("prompt", "completion"): (("user", "prompt"), ("assistant", "completion")),
    ("question", "answer"): (("user", "question"), ("assistant", "answer")),
    ("instruction", "output"): (("user", "instruction"), ("assistant", "output")),
    ("instruction", "input", "output"): (("user", "instruction", "\n\n", "input"), ("assistant", "output")),
    ("instruction", "response"): (("user", "instruction"), ("assistant", "response")),
    ("system", "prompt", "response"): (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ("messages[].content", "messages[].role"): (("*", "messages", "role", "content"),),
    ("conversations[].from", "conversations[].value"): (("*", "conversations", "from", "value"),),
    ("turns[].role", "turns[].text"): (("*", "turns", "role", "text"),),
    ("conversation[].assistant", "conversation[].user"): (("#", "conversation", "user", "assistant"),),
}
MAPPINGS = {fingerprint(list(paths)): steps for paths, steps in LAYOUTS.items()}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fingerprints met so far -> that of the known layout within, or none; a worker forgets them all at some number.
_WITHIN: dict[str, str | None] = {}
_MOST_MET = 100_000


def select_mapping(paths: list[str]) -> tuple[str, tuple[tuple[str, ...], ...] | None]:
    """(fingerprint, steps) of a layout: those of its own fingerprint, or of the largest known layout within it."""
    layout = fingerprint(paths)
    if layout in MAPPINGS:
        return layout, MAPPINGS[layout]
    if layout not in _WITHIN:
        if len(_WITHIN) >= _MOST_MET:
            _WITHIN.clear()
        inside = [known for known in LAYOUTS if set(known) <= set(paths)]
        largest = [known for known in inside if len(known) == max(map(len, inside))]
        _WITHIN[layout] = fingerprint(list(largest[0])) if len(largest) == 1 else None
    known = _WITHIN[layout]
    return layout, MAPPINGS[known] if known else None


def apply_mapping(record: dict, steps: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    turns = []
    named = lambda r: ROLES.get(r or "", r or "")
    for step in steps:
        if step[0] == "row":
            turns.append((named(record.get(step[2])), record.get(step[3]) or ""))
        elif step[0] == "*":
            _, where, role, text = step
            turns += [(named(m.get(role)), m.get(text) or "") for m in record.get(where) or () if m]
        elif step[0] == "#":
            _, where, *roles = step
            turns += [(r, m[r]) for m in record.get(where) or () if m for r in roles if m.get(r) is not None]
        elif len(step) == 4:
            turns.append((step[0], (record.get(step[1]) or "") + (step[2] + record[step[3]] if record.get(step[3]) else "")))
        else:
            turns.append((step[0], record.get(step[1]) or ""))
    return turns


def canonical_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """JSON records of any known layout -> (id, layout, turn, role, text); an unknown layout gives one row of null turn."""
    import json

    schema = pa.schema([("id", pa.int64()), ("layout", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text else {}
                except ValueError:
                    record = {}
                record = record if isinstance(record, dict) else {}
                layout, steps = select_mapping(value_paths(record))
                turns = apply_mapping(record, steps) if steps else []
                first = record.get("turn") if steps and steps[0][0] == "row" and isinstance(record.get("turn"), int) else 0
                rows += [(key, layout, k, role, body) for k, (role, body) in enumerate(turns, first)] or [(key, layout, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return records.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("json")).mapInArrow(run, "id long, layout string, turn long, role string, text string")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _step_turns(df: DataFrame, step: tuple[str, ...]) -> Column:
    """One step of a mapping as an array of turns."""
    if step[0] == "*":
        _, where, role, text = step
        messages = F.coalesce(F.col(where), F.array().cast(df.schema[where].dataType))
        named = lambda r: F.coalesce(*[F.when(r == k, F.lit(v)) for k, v in ROLES.items()], r, F.lit(""))
        return F.transform(messages, lambda m: _turn(named(m[role]), m[text]))
    if step[0] == "#":
        _, where, *roles = step
        exchanges = F.coalesce(F.col(where), F.array().cast(df.schema[where].dataType))
        pairs = F.flatten(F.transform(exchanges, lambda m: F.array(*[F.struct(F.lit(r).alias("role"), m[r].alias("text")) for r in roles])))
        return F.filter(pairs, lambda t: t["text"].isNotNull())
    if len(step) == 4:
        extra = F.when(F.coalesce(F.col(step[3]), F.lit("")) != "", F.concat(F.lit(step[2]), F.col(step[3]))).otherwise("")
        return F.array(_turn(F.lit(step[0]), F.concat(F.coalesce(F.col(step[1]), F.lit("")), extra)))
    return F.array(_turn(F.lit(step[0]), F.col(step[1])))


def mapped_frame(df: DataFrame, id_col: str) -> DataFrame:
    """The same for a typed table: its schema's fingerprint selects the mapping once, and no Python runs on the rows."""
    shape = T.StructType([f for f in df.schema.fields if f.name != id_col])
    layout, steps = select_mapping(field_paths(shape))
    if not steps:
        raise ValueError(f"no mapping for the layout {field_paths(shape)}")
    if steps[0][0] == "row":  # a turn a row, which says its own number and role
        _, turn, role, text = steps[0]
        return df.select(F.col(id_col).alias("id"), F.lit(layout).alias("layout"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    parts = [_step_turns(df, step) for step in steps]
    exploded = df.select(F.col(id_col).alias("id"), F.posexplode(F.concat(*parts)).alias("turn", "t"))
    return exploded.select("id", F.lit(layout).alias("layout"), F.col("turn").cast("long"), "t.role", "t.text")


# --- formatting ---------------------------------------------------------------

DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
READ = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("size", pa.int64()), ("masked", pa.bool_()), ("loss", pa.string())])


def clean_turns(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def in_order(rows: DataFrame) -> DataFrame:
    """Each conversation in one partition and in order; the sort spills, so its length doesn't matter."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end): the output in pieces, the mask as ranges of the whole output."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, k = object(), 0, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, at, k = conv, len(OPEN), 0
                piece, loss = format_turn(role, text)
                rows.append((conv, k, piece, *((at + loss[0], at + loss[1]) if loss else (None, None))))
                at, k = at + len(piece), k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return in_order(clean_turns(turns)).mapInArrow(run, "conv_id long, turn long, piece string, loss_start long, loss_end long")


def read_back(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, size, masked, loss): each turn is formatted where it lies, and read back from its output.

    masked says whether the loss mask has a range in the turn's output; loss is
    what the output holds in this range, or null where that is the text itself,
    which isn't sent twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                piece, mask = format_turn(role, text)
                role, text, _, end = parse_turn(piece, 0)  # from here on only what the output and the mask say
                if end != len(piece):
                    raise ValueError("a turn was cut short")
                loss = unescape(piece[slice(*mask)]) if mask else None
                rows.append((role, text, end, mask is not None, None if loss == text else loss))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(READ)[2:], strict=True))], schema=READ)

    return clean_turns(turns).mapInArrow(run, "conv_id long, turn long, role string, text string, size long, masked boolean, loss string")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what is read back from its formatted output (see DIGEST).

    A digest of a conversation goes through its turns in order, so only the
    hashing itself runs in one task, turn by turn; all other work is done before
    the shuffle, wherever the turns lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            conv, n, turns_sha, chars, loss_sha, size = state
            done.append((conv, n, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), size + len(CLOSE)))

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), DIGEST, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=DIGEST)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)]
            for conv, role, text, size, masked, loss in zip(*columns, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len(OPEN)]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if masked:
                    loss = text if loss is None else loss
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += size
            if len(done) >= 1000:
                yield out()
        if state is not None:
            close()
        if done:
            yield out()

    return in_order(read_back(turns)).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = mapped_frame(read_table(spark, sf_dir, "conversations"), "conv_id").select(F.col("id").alias("conv_id"), "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(turns.unionByName(added))


_ESC = r"replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[TURN ', '[\TURN '), '[/TURN]', '[\/TURN]')"
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(role, '([^A-Za-z0-9_])', '\\\1', 'g')) + length({_ESC}) + 14) + 7 AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

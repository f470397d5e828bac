r"""Chat formatting with schema fingerprints.

Conversations come in many layouts: one row for each turn, arrays of messages, prompt and
response columns, instructions with inputs. ``fingerprint`` hashes the sorted nested field
paths of a layout; ``LAYOUTS`` holds a declarative mapping (SQL expressions) for each. A
table can hold the fields of several layouts, and others; ``canonical_turns`` picks the mapping
of each row and returns turn rows, ``format_chat`` writes the template and ``read_chat`` reads it back.

Template of a turn: ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside a text or
role are escaped by one more backslash after their ``<``, which reading takes away again, so
any text, even one that holds escaped control strings, comes back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm.common import map_arrow

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN = re.compile(r"<(\\*)\|im_(start|end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end)\|>")
#: A row of output ends with the first turn that brings it to this many characters.
PART_CHARS = 1 << 20
#: Names of the same role in different layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested paths of all leaf fields; ``[]`` marks an array's elements."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}".lstrip(".")))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """Hash of the field paths in order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and the turns that they make, as SQL; ``turn`` for rows by turn."""

    name: str
    paths: tuple[str, ...]
    turns: str
    turn: str | None = None

    @property
    def key(self) -> str:
        return fingerprint(self.paths)


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


_ASK = "if(coalesce(input, '') = '', instruction, concat_ws('\\n', instruction, input))"
_LAYOUTS = (
    Layout("rows by turn", ("role", "text", "turn"), f"array({_turn('role', 'text')})", "turn"),
    Layout("messages", ("messages[].content", "messages[].role"), f"transform(messages, m -> {_turn('m.role', 'm.content')})"),
    Layout("from and value", ("conversations[].from", "conversations[].value"), f"transform(conversations, m -> {_turn('m.`from`', 'm.value')})"),
    Layout("prompt and response", ("prompt", "response"), f"array({_turn(chr(39) + 'user' + chr(39), 'prompt')}, {_turn(chr(39) + 'assistant' + chr(39), 'response')})"),
    Layout("prompt and completion", ("completion", "prompt"), f"array({_turn(chr(39) + 'user' + chr(39), 'prompt')}, {_turn(chr(39) + 'assistant' + chr(39), 'completion')})"),
    Layout("instruction", ("instruction", "output"), f"array({_turn(chr(39) + 'user' + chr(39), 'instruction')}, {_turn(chr(39) + 'assistant' + chr(39), 'output')})"),
    Layout("instruction with input", ("input", "instruction", "output"), f"array({_turn(chr(39) + 'user' + chr(39), _ASK)}, {_turn(chr(39) + 'assistant' + chr(39), 'output')})"),
)
LAYOUTS = {x.key: x for x in _LAYOUTS}
_TURNS = "array<struct<role: string, text: string>>"


def find_layouts(schema: T.StructType) -> list[Layout]:
    """All layouts whose fields a schema has, those with more fields first; fields beyond do not count.

    A schema that has the fields of none raises ValueError.
    """
    paths = set(field_paths(schema))
    found = sorted((x for x in LAYOUTS.values() if paths.issuperset(x.paths)), key=lambda x: -len(x.paths))
    if not found:
        raise ValueError(f"no layout has the fingerprint {fingerprint(sorted(paths))} of {sorted(paths)}")
    return found


def find_layout(schema: T.StructType) -> Layout:
    """The first of the layouts of a schema."""
    return find_layouts(schema)[0]


def _columns(layout: Layout) -> list[Column]:
    """The table's columns that a layout reads."""
    return [F.col(f"`{c}`") for c in dict.fromkeys(re.split(r"[.\[]", p)[0] for p in layout.paths)]


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turn rows ``conv_id, turn, role, text`` of a table in any known layouts.

    A row is read by the first of the table's layouts (see ``find_layouts``) of which it has no
    column null; if there is none, by the first of which it has a column that is not null, or else by the first.
    Null roles and texts become empty, null or empty message arrays give no turn, role names
    of other layouts are put in the common words. Columns of other names are ignored.
    """
    layouts = find_layouts(df.schema)
    held = [[c.isNotNull() for c in _columns(x)] for x in layouts]
    use = F.coalesce(*[F.when(reduce(op, h), F.lit(i)) for op in (and_, or_) for i, h in enumerate(held)], F.lit(0)) if len(layouts) > 1 else F.lit(0)

    def by_row(values: list[Column]) -> Column:
        return reduce(lambda rest, i: F.when(F.col("_use") == i, values[i]).otherwise(rest), range(1, len(values)), values[0])

    turn = by_row([(F.expr(x.turn) if x.turn else F.lit(0)).cast("long") for x in layouts])
    turns = by_row([F.expr(x.turns).cast(_TURNS) for x in layouts])
    rows = df.withColumn("_use", use).select(F.col(id_col).alias("_id"), turn.alias("_turn"), by_row([F.lit(x.turn is None) for x in layouts]).alias("_renamed"), F.posexplode(turns).alias("_pos", "_row"))
    role = F.coalesce(F.col("_row.role"), F.lit(""))
    for other, common in ROLES.items():
        role = F.when(F.col("_renamed") & (role == other), F.lit(common)).otherwise(role)
    return rows.select(F.col("_id").alias("conv_id"), (F.col("_turn") + F.col("_pos")).alias("turn"), role.alias("role"), F.coalesce(F.col("_row.text"), F.lit("")).alias("text"))


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|im_\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


FORMATTED = "conv_id long, part int, formatted string, loss_spans array<struct<start: long, end: long>>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, first, part, pieces, spans, at = None, True, 0, [], [], 0

    def out() -> pa.RecordBatch:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([part], pa.int32()), pa.array(["".join(pieces)], pa.string()), pa.array([spans], pa.list_(span))], ["conv_id", "part", "formatted", "loss_spans"])

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not first and (conv != now or at >= PART_CHARS):
                yield out()
                part = part + 1 if conv == now else 0
                pieces, spans, at = [], [], 0
            now, first = conv, False
            head, body = f"{START}{_role_line(role)}\n", escape(text)
            if role == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            pieces.append(f"{head}{body}{END}\n")
            at += len(pieces[-1])
    if not first:
        yield out()


def format_chat(turns: DataFrame) -> DataFrame:
    """Formatted conversations: ``conv_id, part, formatted, loss_spans``.

    A conversation is one row, or several parts to be read in order where it has more than
    PART_CHARS characters; parts end between turns. Loss spans count the characters of a part
    and hold the assistants' texts. Turns are in the order of ``turn``; equal ones follow by
    role and text. Turns without a conv_id form one conversation. A conversation's turns are
    sorted and streamed, never gathered.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(rows, _format, FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fresh(conv) -> dict:
        return {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}

    def out(rows: list[dict]) -> pa.RecordBatch:
        done = [r | {k: r[k].hexdigest() for k in ("turns_sha256", "loss_sha256")} for r in rows]
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        return pa.RecordBatch.from_pylist(done, schema=schema)

    now, done, parts = None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    done.append(now)
                now, parts = fresh(row["conv_id"]), 0
            if row["part"] != parts:
                raise ValueError(f"conversation {row['conv_id']}: part {parts} is missing or part {row['part']} comes twice")
            parts += 1
            text, at = row["formatted"], 0
            for m in _TURN.finditer(text):
                if m.start() != at:
                    raise ValueError(f"conversation {row['conv_id']}: no turn starts at {at}")
                at = m.end()
                now["n_turns"] += 1
                now["turns_sha256"].update(f"{_role_of(m[1])}\n{unescape(m[2])}\n".encode())
            if at != len(text):
                raise ValueError(f"conversation {row['conv_id']}: no turn starts at {at}")
            for span in row["loss_spans"]:
                loss = unescape(text[span["start"] : span["end"]])
                now["loss_chars"] += len(loss)
                now["loss_sha256"].update(loss.encode())
            now["formatted_chars"] += len(text)
        if done:
            yield out(done)
            done = []
    if now is not None:
        yield out([now])


def read_chat(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read from the rows of ``format_chat`` in any order.

    A conversation's parts are sorted and streamed; a missing or repeated part raises ValueError. Other columns are ignored,
    an empty table gives an empty result.
    """
    rows = formatted.select("conv_id", "part", "formatted", "loss_spans")
    return map_arrow(rows.repartition("conv_id").sortWithinPartitions("conv_id", "part"), _read, READ)

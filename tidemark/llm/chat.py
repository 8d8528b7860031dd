"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only that reply is trainable. Turns after the last reply (or a
conversation without any) give one closing example without a target, so that the
output holds every turn.

Template: a turn is `<|role|>\\n` + text + `<|end|>\\n`. Within roles and texts a
backslash follows each sign that can begin a control string and each backslash, so that
no text can end a turn or open another, and `unescape` gives the text back exactly.
Single signs are escaped, not strings: no two escapes can overlap.
The loss span of an example covers its reply's escaped text and nothing else.

Conversations stream through sorted partitions turn by turn: a task keeps the text
of one conversation's context only.

Defined cases: null texts and roles are empty; turns of equal number are ordered by
role, then text; repeated rows are turns of their own; a null conv_id is one
conversation; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of this template and of other common ones, as fixed values.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_MARKED = re.compile(r"[\\<|\[]")  # a backslash, and the first sign of each control string
_ESCAPED = re.compile(r"([\\<|\[])\\")
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)
END = "<|end|>\n"

EXAMPLES = "conv_id long, example int, target_turn long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _MARKED.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def opening(role: str) -> str:
    return f"<|{escape(role)}|>\n"


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, unescaped."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("signs between turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("an unfinished turn")
    return out


class _Out:
    """Rows gathered to batches of a few MB."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20) -> None:
        self.schema, self.limit, self.rows, self.size = schema, limit, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("target_turn", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    out, none = _Out(schema), object()
    conv, context, n, rest = none, "", 0, False

    def closing():
        if conv is not none and rest:
            yield from out.add((conv, n, None, context, 0, 0), len(context))

    for batch in batches:
        for who, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if conv is none or who != conv:
                yield from closing()
                conv, context, n, rest = who, "", 0, False
            body = escape(text or "")
            head = context + opening(role or "")
            context = head + body + END
            rest = role != "assistant"
            if not rest:
                yield from out.add((conv, n, turn, context, len(head), len(head) + len(body)), len(context))
                n += 1
    yield from closing()
    yield from out.flush()


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of all conversations (conv_id, turn, role, text). The examples of one conversation stand together, in order, in one partition."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
    out, none = _Out(schema, 1 << 20), object()
    conv, whole, turns, loss, chars, size, n = none, "", None, None, 0, 0, 0

    def closing():
        if conv is not none:
            read = parse(whole)
            for role, text in read:
                turns.update(f"{role}\n{text}\n".encode())
            yield from out.add((conv, len(read), turns.hexdigest(), chars, loss.hexdigest(), size, n), 200)

    for batch in batches:
        for who, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
            if conv is none or who != conv:
                yield from closing()
                conv, turns, loss, chars, size, n = who, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            elif not text.startswith(whole):
                raise ValueError("an example doesn't continue the one before")
            trained = unescape(text[a:b])
            loss.update(trained.encode())
            whole, chars, size, n = text, chars + len(trained), size + len(text), n + 1
    yield from closing()
    yield from out.flush()


def digest(examples: DataFrame) -> DataFrame:
    """One row for each conversation, read back from what expand() returned."""
    return examples.mapInArrow(_read_back, DIGESTS)

"""Formatting conversations with a compiled template, and reading them back.

Control strings open and close turns.  Inside roles and texts they are broken by
a backslash after their first character, and backslashes are doubled, so no
text can open a turn and every text can be restored.

Rows of a conversation meet by a shuffle on ``conv_id`` and stream through in
the order of ``turn`` (ties by role, then text); a task holds one conversation
at a time.  Defined results: a null text or role is empty; null ids make one
conversation; repeated rows are turns of their own; an empty table gives no
conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template

#: Strings that only the template may write; those of other common formats are broken too.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_BROKEN = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
_ROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
_FORMATTED = "conv_id long, n_turns long, formatted string, spans array<array<long>>"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_FLUSH_CHARS = 1 << 20


def escape(text: str | None) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn; the whole string must be turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def _format(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape, "trim": lambda x: (x or "").strip()})
        rows: list[tuple] = []
        size = 0
        current, messages = None, []

        def close():
            nonlocal size
            text, spans = render({"messages": messages})
            rows.append((current, len(messages), text, [list(s) for s in spans]))
            size += len(text)

        def drain():
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)
            rows, size = [], 0
            return out

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if messages and conv != current:
                    close()
                    messages = []
                    if size >= _FLUSH_CHARS:
                        yield drain()
                current = conv
                messages.append({"role": role or "", "text": text or ""})
        if messages:
            close()
        if rows:
            yield drain()

    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, formatted, spans (marked stretches of ``formatted`` as [begin, end) code points)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(template), _FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            turns = read_turns(r["formatted"])
            loss = "".join(unescape(r["formatted"][a:b]) for a, b in r["spans"])
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((r["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(_digest, _DIGEST)

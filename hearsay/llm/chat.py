"""Chat formatting with a grammar that reads back exactly what was written.

A conversation is rendered turn by turn as

    ### role:          or   #### role:        (the body is escaped)
    body
    </turn>

Roles are percent-encoded but for letters, digits, '_' and '-'. A body is written as it is where
reading it back gives the same turn and it holds no control string; else it is escaped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
CONTROL = ("###", END)
_TURN = re.compile(r"(####?) ([\w%.~-]*):\n(.*?)\n</turn>\n", re.ASCII | re.DOTALL)
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_BACK = {v: k for k, v in _ESCAPES.items()}


def escape(text: str) -> str:
    return re.sub(r"[\\#<]", lambda m: _ESCAPES[m[0]], text)


def unescape(body: str) -> str:
    return re.sub(r"\\[\\hl]", lambda m: _BACK[m[0]], body)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering, and where its body starts and ends in it."""
    name = quote(role, safe="")
    for mark, body in (("###", text), ("####", escape(text))):
        out = f"{mark} {name}:\n{body}\n{END}\n"
        if parse(out) == [(role, text)] and (mark == "####" or not any(c in text for c in CONTROL)):
            return out, len(mark) + len(name) + 3, len(mark) + len(name) + 3 + len(body)
    raise ValueError("a turn can't be read back")


def turns(formatted: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(mark, role, text, start, end of body) of each turn; the whole must parse."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield m[1], unquote(m[2]), unescape(m[3]) if m[1] == "####" else m[3], m.start(3), m.end(3)
        at = m.end()


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    try:
        return [(role, text) for _, role, text, _, _ in turns(formatted)]
    except ValueError:
        return []


def format_chats(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): each conversation's rendering, and the spans of code points that a model learns from.

    loss lists (start, end) of the bodies of turns whose role is `learn`. Rows come together by
    conversation and in order of turn (null first), then role, then text, by a sort within
    partitions that tasks stream through, so memory holds one conversation at a time.

    A null role or text is empty. Repeated rows are repeated turns. A null conv_id is a
    conversation of its own. An empty table gives no rows. Other columns are ignored.
    """
    own = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def done(rows: list[tuple]) -> pa.RecordBatch:
        spans = pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), spans], ["conv_id", "formatted", "loss"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, spans, length, rows, held = None, [], [], 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and conv != at:
                    rows.append((at, "".join(parts), spans))
                    held += length
                    parts, spans, length = [], [], 0
                    if held > 1 << 22:
                        yield done(rows)
                        rows, held = [], 0
                at = conv
                out, start, end = render_turn(role, text)
                if role == learn:
                    spans.append({"start": length + start, "end": length + end})
                parts.append(out)
                length += len(out)
        if parts:
            rows.append((at, "".join(parts), spans))
        yield done(rows)

    return own.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as the renderings and their masks say.

    Turns come from parsing the rendering; learned text comes from the masked spans, unescaped as
    the turn around them is marked.
    """
    import hashlib

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, learned, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                mark_at = {}
                for mark, role, text, start, _ in turns(formatted):
                    whole.update(f"{role}\n{text}\n".encode())
                    mark_at[start] = mark
                    n += 1
                for span in loss:
                    body = formatted[span["start"] : span["end"]]
                    text = unescape(body) if mark_at[span["start"]] == "####" else body
                    learned.update(text.encode())
                    chars += len(text)
                out.append((conv, n, whole.hexdigest(), chars, learned.hexdigest(), len(formatted)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return chats.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

r"""Chat formatting with schema fingerprints (operator 10).

A record's schema is the set of its nested field paths. A layout is a declarative mapping with the paths
that it needs; the hash of the record's paths among these is compared with the layout's own, so fields that
the layout doesn't need never count, whatever their names. Of the layouts that fit, the one with the most
paths is taken, of equals the first listed. It turns prompt, instruction and message records, or a table
with one row a turn, into canonical turns (conversation, turn, role, text). The template writes each
turn as ``<|im_start|>role\ntext<|im_end|>\n`` and escapes control strings inside a text by one
backslash after their first character (more where the text has some there already), so that
unescaping gives the text back. Each piece carries the span of its loss mask: assistant texts only.

Null texts and roles count as empty, null turns sort first, ties of a turn go by the formatted piece,
rows with a null conversation make one conversation, an empty table gives an empty result. A value that
is no string counts as its JSON form, a list of parts as its parts' texts in order, a message that is no
object as a text without a role; an empty system text before messages is left out. A record of no known layout becomes one row with null role and text and
the layout ``unknown:<fingerprint of all its paths>``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseloom.llm.shared import map_arrow, rows, shuffle_partitions

#: Control strings that a text may not contain as they are: first character and rest. Fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
#: Names of speakers in known layouts. Fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, paths joined by a blank line) for flat records; ``each``: list, role and text fields, after the ``turns`` that aren't empty; ``rowwise``: columns of a table of turns."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    rowwise: tuple[str, str, str, str] | None = None


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), rowwise=("conv_id", "turn", "role", "text")),
    Layout("message_rows", ("conversation_id", "position", "role", "content"), rowwise=("conversation_id", "position", "role", "content")),
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("speakers", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Layout("system_messages", ("system", "messages[].role", "messages[].content"), turns=(("system", ("system",)),), each=("messages", "role", "content")),
    Layout("system_speakers", ("system", "conversations[].from", "conversations[].value"), turns=(("system", ("system",)),), each=("conversations", "from", "value")),
    Layout("completion", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_prompt", ("system", "prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


#: Layouts by the fingerprint of their paths, those of most paths first.
REGISTRY = {fingerprint(layout.paths): layout for layout in sorted(LAYOUTS, key=lambda x: -len(x.paths))}


@functools.lru_cache(maxsize=4096)
def layout_of(paths: frozenset[str], rowwise: bool) -> Layout | None:
    """The layout whose fingerprint the paths have among its own."""
    return next((x for key, x in REGISTRY.items() if bool(x.rowwise) == rowwise and fingerprint(paths & set(x.paths)) == key), None)


def value_paths(value: object, at: str = "") -> Iterator[str]:
    """Nested field paths of a parsed record, also those that hold others; a list adds ``[]``."""
    if at:
        yield at
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The same paths from a schema."""
    if at:
        yield at
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")


def turns_from_table(df: DataFrame) -> DataFrame:
    """Canonical turns of a typed table, by the fingerprint of its schema."""
    layout = layout_of(frozenset(schema_paths(df.schema)), rowwise=True)
    if layout is None:
        raise ValueError(f"no layout of turns has the paths {sorted(schema_paths(df.schema))}")
    conv, turn, role, text = (F.col(f"`{c}`") for c in layout.rowwise)
    return df.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.lit(layout.name).alias("layout"))


def said(value: object) -> str:
    """The text of a value: strings as they are, nulls empty, parts in order, anything else as JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode()
    if isinstance(value, list) and all(isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
        return "".join(said(x if isinstance(x, str) else x["text"]) for x in value)
    return json.dumps(value)


def record_turns(record: object) -> tuple[str, list[tuple[str | None, str | None]]]:
    """Layout and (role, text) turns of one parsed record."""
    have = frozenset(value_paths(record))
    layout = layout_of(have, rowwise=False) if isinstance(record, dict) else None
    if layout is None or layout.each and not isinstance(record.get(layout.each[0]), list):
        return f"unknown:{fingerprint(have)}", [(None, None)]
    turns = [(role, "\n\n".join(v for p in paths if (v := said(record.get(p))))) for role, paths in layout.turns]
    if layout.each:
        turns = [t for t in turns if t[1]]
        items, role, text = layout.each
        for x in record[items]:
            turns.append((ROLES.get(r := said(x.get(role)), r), said(x.get(text))) if isinstance(x, dict) else ("", said(x)))
    return layout.name, turns


def turns_from_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical turns of JSON records of any known layouts, chosen record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            out: list[tuple] = []
            for i, text in zip(ids, texts):
                try:
                    name, turns = record_turns(json.loads(text or "null"))
                except (ValueError, RecursionError):  # no JSON, or nested beyond measure
                    name, turns = record_turns(None)
                out += [(i, k, role, said, name) for k, (role, said) in enumerate(turns)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "turn", "role", "text", "layout"])

    return map_arrow(df.select(id_col, json_col), run, "conv_id long, turn long, role string, text string, layout string")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(rf"([<\[])\\(\\*)({_REST})", r"\1\2\3", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end): the pieces in order are the formatted conversation.

    The span counts code points of the piece; it is null outside the loss mask. A role's backslashes
    and line feeds are escaped too, as a line feed ends it.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(OPEN), escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n")), F.lit("\n"))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    mask = role == LOSS_ROLE
    return turns.select("conv_id", "turn", head.alias("head"), body.alias("body"), mask.alias("mask")).select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.when(F.col("mask"), F.char_length("head").cast("long")).alias("loss_start"),
        F.when(F.col("mask"), (F.char_length("head") + F.char_length("body")).cast("long")).alias("loss_end"),
    )


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = piece[len(OPEN) : -len(CLOSE)].partition("\n")
    role = re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
    return role, unescape(text)


class _Digest:
    def __init__(self, key: object) -> None:
        self.key, self.turns, self.loss = key, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = parse_piece(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            said = unescape(piece[start:end])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.n += 1
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted pieces.

    Pieces are sorted (and spilled) by Spark and streamed, so memory doesn't grow with a conversation.
    A SHA-256 over a conversation is sequential by definition: the pieces of one conversation pass
    through one task; all work on texts was done row by row before.
    """
    dealt = pieces.repartition(shuffle_partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 6, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now: _Digest | None = None
        for conv, _, piece, start, end in rows(batches):
            done = []
            for c, p, s, e in zip(conv, piece, start, end):
                if now is None or c != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(c)
                now.add(p, s, e)
            yield batch(done)
        if now is not None:
            yield batch([now.row()])

    return map_arrow(dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

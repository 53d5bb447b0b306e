"""Chat formatting: layouts recognised by schema fingerprint, canonical turns, one reversible template.

The nested field paths of a record, sorted and hashed, are its fingerprint; a declarative mapping is filed under
each known fingerprint and says where conversation, order, roles and texts stand. So prompt, instruction and
message layouts may be mixed in one table. Canonical turns are sorted by conversation and order and formatted
turn by turn: a conversation of any length streams through a task and is never gathered.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is put behind the ``<`` of every
``<|``, ``<\\|``, ``<\\\\|`` and so on, which undoes uniquely; a line break in a role becomes ``<|nl|>``. The loss mask
covers the texts of assistant turns.

Cases: null roles and texts are empty; a null order comes first; turns of equal order go by role and text;
repeated rows are turns of their own; rows without conversation form one; an id that is no whole number is a hash
of itself; fields that no layout knows are ignored, and a content in parts is its texts, joined; an unknown layout gives no turn but is
kept as a row of layout ``unknown`` by ``canonical_turns``; other columns change no layout in the query, which
names its columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarmetric.llm.common import literal_rows, table

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
_GUARD, _UNGUARD = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
EXCHANGE_ROLES = (("human", "user"), ("gpt", "assistant"))


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns: ``each`` names a list of messages, ``turns`` are (role, text path) pairs.

    A role that begins with ``=`` is given, otherwise it is a path.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    order: str | None = None
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("turn", ("conv_id", "role", "text", "turn"), (("role", "text"),), order="turn"),
    Layout("messages", ("conv_id", "messages[].content", "messages[].role"), (("role", "content"),), each="messages"),
    Layout("message_parts", ("conv_id", "messages[].content[].text", "messages[].content[].type", "messages[].role"), (("role", "content"),), each="messages"),
    Layout("exchange", ("conv_id", "conversations[].from", "conversations[].value"), (("from", "value"),), each="conversations", roles=EXCHANGE_ROLES),
    Layout("prompt", ("conv_id", "prompt", "response"), (("=user", "prompt"), ("=assistant", "response"))),
    Layout("completion", ("completion", "conv_id", "prompt"), (("=user", "prompt"), ("=assistant", "completion"))),
    Layout("system_prompt", ("conv_id", "prompt", "response", "system"), (("=system", "system"), ("=user", "prompt"), ("=assistant", "response"))),
    Layout("instruction", ("conv_id", "input", "instruction", "output"), (("=user", "instruction\n\ninput"), ("=assistant", "output"))),
    Layout("instruction_only", ("conv_id", "instruction", "output"), (("=user", "instruction"), ("=assistant", "output"))),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a parsed record; list items share one path."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union({f"{prefix}[]"} if not value else set(), *[field_paths(v, f"{prefix}[]") for v in value])
    return {prefix}


def fingerprint(paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


MAPPINGS = {fingerprint(layout.paths): layout for layout in LAYOUTS}
KNOWN_PATHS = frozenset(p for layout in LAYOUTS for p in layout.paths)


def layout_of(record) -> Layout | None:
    """The layout of a parsed record: by its fingerprint, by that of the fields any layout knows, or the one with the most fields among these."""
    if not isinstance(record, dict):
        return None
    paths = field_paths(record)
    found = MAPPINGS.get(fingerprint(paths)) or MAPPINGS.get(fingerprint(paths & KNOWN_PATHS))
    return found or max((x for x in LAYOUTS if paths.issuperset(x.paths)), key=lambda x: len(x.paths), default=None)


def conversation_id(value) -> int | None:
    """An id as 64 bits: a whole number as it is, any other value by a hash of its text."""
    if value is None or value == "":
        return None
    try:
        number = int(value) if not isinstance(value, float) or value.is_integer() else None
    except (TypeError, ValueError):
        number = None
    if number is not None and -(1 << 63) <= number < 1 << 63:
        return number
    return xxhash.xxh64_intdigest(json.dumps(value, sort_keys=True)) - (1 << 63)


def said_text(value) -> str:
    """A text, or the texts of a list of parts."""
    if isinstance(value, list):
        return "".join(said_text(x.get("text") if isinstance(x, dict) else x) for x in value)
    return "" if value is None else str(value)


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[int | None, str, str]]:
    """(order, role, text) of a record's turns."""
    items = record[layout.each] if layout.each else [record]
    n, names = 0, dict(layout.roles)
    for item in items:
        for role, text in layout.turns:
            who = role[1:] if role.startswith("=") else item.get(role) or ""
            said = "\n\n".join(said_text(item.get(p)) for p in text.split("\n\n") if item.get(p))
            yield (record.get(layout.order) if layout.order else n), names.get(who, who), said
            n += 1


def canonical_turns(records: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, layout from records in JSON (column ``record``)."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch["record"]:
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                layout = layout_of(record)
                if layout is None:
                    out.append((conversation_id(record.get("conv_id")) if isinstance(record, dict) else None, None, None, None, "unknown"))
                else:
                    conv = conversation_id(record["conv_id"])
                    out += [(conv, *turn, layout.name) for turn in turns_of(record, layout)]
            frame = pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "layout"])
            yield frame.astype({"conv_id": "Int64", "turn": "Int64"})

    return records.select("record").mapInPandas(convert, "conv_id long, turn long, role string, text string, layout string")


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text."""
    head = f"{START}{escape(role).replace(chr(10), BREAK)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_start, loss_end by turn, in order inside a partition that holds whole conversations.

    ``formatted`` of a conversation's rows, joined, is its text. The loss span is null outside assistant turns.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(*format_turn(role or "", text or ""), role == "assistant") for role, text in zip(b["role"], b["text"], strict=True)]
            frame = pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "formatted": [d[0] for d in done]})
            frame["loss_start"] = pd.array([d[1] if d[3] else None for d in done], dtype="Int64")
            frame["loss_end"] = pd.array([d[2] if d[3] else None for d in done], dtype="Int64")
            yield frame

    known = turns.where("layout <> 'unknown'").select("conv_id", "turn", "role", "text")
    ordered = known.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(write, "conv_id long, formatted string, loss_start long, loss_end long")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text."""
    return [(unescape(role.replace(BREAK, "\n")), unescape(text)) for role, text in _TURN.findall(formatted)]


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text reads back as; hashes are carried on, turn by turn."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None
        for b in batches:
            done = []
            for conv, text, start, end in zip(b["conv_id"], b["formatted"], b["loss_start"], b["loss_end"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                if not pd.isna(start):
                    learnt = unescape(text[int(start) : int(end)])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(text)
            yield _rows(done)
        yield _rows([now] if now else [])

    return formatted.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(done: list[list]) -> pd.DataFrame:
    rows = [(c, n, t.hexdigest(), k, h.hexdigest(), size) for c, n, t, k, h, size in done]
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    own = own.union(literal_rows(spark, [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long,turn long,role string,text string"))
    records = own.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat_digest(format_chats(canonical_turns(records)))


ORACLE = rf"""
with turn as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
shown as (select *, '<|im_start|>' || replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) as formatted from turn)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(formatted))::bigint as formatted_chars from shown group by conv_id"""

"""Conversation structure repair: the cheapest edits of the turns, by a run-length dynamic programme.

The turns of a conversation, in order, become symbols (role initial and fault); equal neighbours are one run. A
symbol is a min-plus transition over the four states of the grammar ``(s?(ua)+)?``: nothing yet, after the system
turn, after a user turn, after an assistant turn. Binary powers of each transition are cached, so a run of any
length moves the costs to go by a few small products. The choices are then unrolled turn by turn for the audit,
taking the least letter that keeps the cost.

Rows are put in order once, by ranges over all rows, so that one very long conversation lies in many parts. Equal rows
are counted before that. Costs, faults and audits come from the parts: a conversation cut by part borders
gives a transition per part, and its audit is unrolled in each part for each of the four states it can be entered
in; at most two pieces of a part are cut, so only these few small rows are linked one after the other. The text of
a conversation is hashed in order by one task, row by row, since the hash is sequential; it is never held.

Order: by turn (nulls first), then role, then text; copies of a row stand together. Cases: a null conv_id is a
conversation of its own; null role and text are one blank, and so is a null id or turn in the key of the
damage; a role that is no user, assistant or system initial can only be rerolled or deleted; an empty role
has no initial; conversations whose rows are all dropped give zeros; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tarmetric.llm.common import literal_rows, table
from tarmetric.session import materialize

FAR = float("inf")
STATES = range(4)
RANGE_CHARS = 256
#: Costs of the edits.
RANK = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
#: State after a role, by state before; the role an insertion or a new role takes.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEEDED = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
#: Symbols: a role initial, whether the turn is truncated; ``x`` stands for any other role and ``-`` for a turn that must go.
SYMBOLS = ("s", "u", "a", "x", "S", "U", "A", "X", "-")
LEGAL = ("su", "ua", "au")

Matrix = tuple[tuple[float, ...], ...]
Vector = tuple[float, ...]


# --- the dynamic programme --------------------------------------------------------------------------------


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[p][k] + b[k][q] for k in STATES) for q in STATES) for p in STATES)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[p][q] + v[q] for q in STATES) for p in STATES)


def inserted(state: int) -> int:
    return AFTER[NEEDED[state]][state]


@lru_cache(None)
def insertions() -> Matrix:
    """Cost of insertions alone between two states."""
    out = [[FAR] * 4 for _ in STATES]
    for p in STATES:
        at, cost = p, 0
        for _ in range(4):
            out[p][at] = min(out[p][at], cost)
            at, cost = inserted(at), cost + RANK["I"]
    return tuple(map(tuple, out))


def edits(symbol: str, state: int) -> list[tuple[str, int, float]]:
    """(letter, state after, cost) of the edits of a turn, in the order of the letters."""
    out = [("D", state, RANK["D"])]
    if symbol != "-":
        more = TRUNCATED_COST if symbol.isupper() else 0
        kept = AFTER.get(symbol.lower(), {}).get(state)
        if kept is not None:
            out.append(("K", kept, RANK["K"] + more))
        out.append(("R", inserted(state), RANK["R"] + more))
    return out


@lru_cache(None)
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2**k equal turns, insertions before each included."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    step = [[FAR] * 4 for _ in STATES]
    for p in STATES:
        for _, q, cost in edits(symbol, p):
            step[p][q] = min(step[p][q], cost)
    return product(insertions(), tuple(map(tuple, step)))


def run_transition(symbol: str, length: int) -> Matrix:
    out = None
    for k in range(length.bit_length()):
        if length >> k & 1:
            out = power(symbol, k) if out is None else product(out, power(symbol, k))
    return out


@lru_cache(1 << 16)
def _before(symbol: str, k: int, v: Vector) -> Vector:
    return applied(power(symbol, k), v)


def before_run(symbol: str, length: int, v: Vector) -> Vector:
    """Costs to go before a run whose costs to go behind it are ``v``; bit by bit through the cached powers."""
    base = min(v)
    v = tuple(x - base for x in v)  # few vectors differ but for a constant
    for k in range(length.bit_length()):
        if length >> k & 1:
            v = _before(symbol, k, v)
            low = min(v)
            base, v = base + low, tuple(x - low for x in v)
    return tuple(x + base for x in v)


@lru_cache(None)
def ending() -> Vector:
    """Costs to go behind the last turn."""
    return applied(insertions(), (0.0, FAR, FAR, 0.0))


def runs(symbols: str) -> list[tuple[str, int]]:
    ends = [i for i, (a, b) in enumerate(pairwise(symbols), 1) if a != b]
    cuts = [0, *ends, len(symbols)] if symbols else []
    return [(symbols[i], j - i) for i, j in pairwise(cuts)]


def piece_transition(symbols: str) -> Matrix:
    out = tuple(tuple(0.0 if p == q else FAR for q in STATES) for p in STATES)
    for symbol, length in runs(symbols):
        out = product(out, run_transition(symbol, length))
    return out


def unroll(symbols: str, state: int, v_end: Vector, last: bool) -> tuple[str, int, float]:
    """(audit, state behind, cost) of a piece entered in ``state``: of its cheapest edits the ASCII-least.

    ``v_end``: costs to go behind the piece. The insertions behind a conversation's last turn belong to its last piece.
    """
    own = runs(symbols)
    ends = [v_end]
    for symbol, length in reversed(own):
        ends.append(before_run(symbol, length, ends[-1]))
    ends.reverse()
    whole, out = ends[0][state], []
    if whole == FAR:
        return "", state, FAR
    for (symbol, length), behind in zip(own, ends[1:], strict=True):
        steps = [behind]
        for _ in range(length):
            steps.append(before_run(symbol, 1, steps[-1]))
        for i in range(length, 0, -1):
            state = _turn(symbol, state, steps[i], steps[i - 1], out)
    if last:
        while state not in (0, 3):
            out.append("I")
            state = inserted(state)
        return "".join(out), state, whole
    return "".join(out), state, whole - v_end[state]


def _turn(symbol: str, state: int, here: Vector, behind: Vector, out: list[str]) -> int:
    """Append the letters of one turn with the insertions before it; the state behind it."""
    while True:
        options = edits(symbol, state)
        nearer = inserted(state)
        options.insert(1, ("I", nearer, RANK["I"]))
        for letter, after, cost in options:
            if cost + (here[after] if letter == "I" else behind[after]) == here[state]:
                break
        out.append(letter)
        state = after
        if letter != "I":
            return state


# --- damage, order and faults -----------------------------------------------------------------------------


def conversation_key(conv: Column) -> Column:
    """A text that names a conversation; empty for a null id."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def turns_of(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text, n (equal rows)."""
    blank = F.lit(" ")
    rows = conversations.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"))


def damaged(turns: DataFrame) -> DataFrame:
    """The damage the check asks for: dropped, emptied, unstopped, repeated and misattributed rows by a checksum of their place."""
    blank = F.lit(" ")
    conv = F.when(F.col("key") == "", blank).otherwise(F.substring("key", 2, 1 << 30))
    code = F.pmod(F.crc32(F.concat_ws(":", conv, F.coalesce(F.col("turn").cast("string"), blank))), F.lit(20))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.where(code != 0).select(
        "key", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("n") * F.when(code == 3, 2).otherwise(1)).alias("n")
    )
    # one place is damaged in one way, but damage can make its rows equal
    return rows.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n"))


def in_order(turns: DataFrame) -> DataFrame:
    """The rows in order, written: ``at`` grows along it and its upper bits are the part; with what the faults need."""
    order = ["key", "turn", "role"]
    rows = turns.withColumn("_head", F.substring("text", 1, RANGE_CHARS))
    rows = rows.repartitionByRange(*order, "_head").sortWithinPartitions(*order, "text").drop("_head")
    last = F.substring(F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1), 1, 1)
    return materialize(
        rows.select(
            "*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"), F.substring("role", 1, 1).alias("initial"),
            F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"),
            (last == "").alias("is_blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("is_cut"),
        ),
        "turns-in-order",
    )


def with_faults(ordered: DataFrame) -> DataFrame:
    """part, at, key, turn, initial, n, symbol of the first of the n copies, and whether it is blank, a duplicate or truncated; written."""
    rows = ordered.drop("role", "text")
    said = ["key", "h1", "h2"]
    again = rows.where(~F.col("is_blank")).groupBy(*said).agg(F.min("at").alias("first"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    met = rows.join(again, said, "left")
    copy = ~F.col("is_blank") & F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    cut = F.col("is_cut") & ~copy
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("is_blank") | copy, "-").when(cut, F.upper(letter)).otherwise(letter)
    return materialize(met.select("part", "at", "key", "turn", "initial", "n", symbol.alias("symbol"), "is_blank", copy.alias("is_copy"), cut.alias("is_cut")), "turn-symbols")


def fault_counts(marked: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated."""
    long = lambda c: c.cast("long")
    blank = F.sum(F.when(F.col("is_blank"), F.col("n")).otherwise(0))
    copies = F.sum(F.when(~F.col("is_blank"), F.col("n") - 1 + F.col("is_copy").cast("long")).otherwise(0))
    # distinct turns first, so that a long conversation is counted in many tasks
    by_turn = marked.groupBy("key", "turn").agg(blank.alias("blank"), copies.alias("duplicate"), F.sum(long(F.col("is_cut"))).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("key").agg(long(gaps).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


# --- pieces -----------------------------------------------------------------------------------------------


def pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str, str]]:
    """(key, part, symbols, initials of the rows) of each conversation in a part; copies follow their row."""
    key, part, symbols, initials = None, None, [], []
    for b in batches:
        for k, p, initial, n, symbol in b[["key", "part", "initial", "n", "symbol"]].itertuples(index=False, name=None):
            if (k, p) != (key, part):
                if key is not None:
                    yield key, part, "".join(symbols), initials
                key, part, symbols, initials = k, p, [], []
            symbols.append(symbol + "-" * (n - 1))
            initials.append((initial, n))
    if key is not None:
        yield key, part, "".join(symbols), initials


def illegal_pairs(initials: list[tuple[str, int]]) -> int:
    """Neighbours that may not follow each other; a row's copies never may."""
    return sum(n - 1 for _, n in initials) + sum(a + b not in LEGAL for (a, _), (b, _) in pairwise(initials))


def cut_conversations(ordered: DataFrame) -> dict[str, list[int]]:
    """The parts of each conversation that lies in several: at most two of a part, so as many as there are parts."""
    row = F.struct("at", "key")
    ends = ordered.groupBy("part").agg(F.min(row).alias("a"), F.max(row).alias("b")).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(ends, key=lambda r: r["part"]):
        for key in {r["a"]["key"], r["b"]["key"]}:
            found.setdefault(key, []).append(r["part"])
    return {k: parts for k, parts in found.items() if len(parts) > 1}


def _dealt(marked: DataFrame) -> DataFrame:
    return marked.select("part", "at", "key", "initial", "n", "symbol").repartition("part").sortWithinPartitions("part", "at")


def ends_of_pieces(marked: DataFrame, cut: dict[str, list[int]]) -> dict[tuple[str, int], Vector]:
    """Costs to go behind each piece of the cut conversations."""

    def transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(k, p, [x for row in piece_transition(s) for x in row]) for k, p, s, _ in pieces_of(batches)]
        yield pd.DataFrame(rows, columns=["key", "part", "cost"])

    spark = marked.sparkSession
    wanted = literal_rows(spark, [(k,) for k in cut], "key string")
    rows = _dealt(marked.join(F.broadcast(wanted), "key", "left_semi")).mapInPandas(transitions, "key string, part int, cost array<double>").collect()
    held = {(r["key"], r["part"]): r["cost"] for r in rows}
    out = {}
    for key, parts in cut.items():
        v = ending()
        for part in reversed(parts):
            out[key, part] = v
            flat = held[key, part]
            v = applied(tuple(tuple(flat[4 * p : 4 * p + 4]) for p in STATES), v)
    return out


def audits(marked: DataFrame, ordered: DataFrame) -> DataFrame:
    """key, part, audit, cost, illegal, first and last initial of each piece, written."""
    cut = cut_conversations(ordered)
    behind = ends_of_pieces(marked, cut) if cut else {}
    last = {(key, parts[-1]) for key, parts in cut.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        names = ["key", "part", "entered", "audit", "left", "cost", "illegal", "head", "tail"]
        for key, part, symbols, initials in pieces_of(batches):
            more = (illegal_pairs(initials), initials[0][0], initials[-1][0])
            at = (key, part)
            for state in STATES if at in behind else (0,):
                audit, after, cost = unroll(symbols, state, behind.get(at, ending()), at not in behind or at in last)
                if cost < FAR:
                    rows.append((key, part, state, audit, after, int(cost), *more))
                    held += len(audit)
            if len(rows) >= 10_000 or held > 1 << 22:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    found = _dealt(marked).mapInPandas(solve, "key string, part int, entered int, audit string, left int, cost long, illegal long, head string, tail string")
    found = materialize(found, "audits")
    if not cut:
        return found.drop("entered", "left")
    # the states in which the pieces of the cut conversations are entered, one after the other
    wanted = literal_rows(marked.sparkSession, [(k, p) for k, parts in cut.items() for p in parts], "key string,part int")
    links = found.join(F.broadcast(wanted), ["key", "part"], "left_semi").select("key", "part", "entered", "left").collect()
    left = {(r["key"], r["part"], r["entered"]): r["left"] for r in links}
    taken = []
    for key, parts in cut.items():
        state = 0
        for part in parts:
            taken.append((key, part, state))
            state = left[key, part, state]
    whole = found.join(F.broadcast(wanted), ["key", "part"], "left_anti")
    chosen = found.join(F.broadcast(literal_rows(marked.sparkSession, taken, "key string,part int,entered int")), ["key", "part", "entered"], "left_semi")
    return whole.union(chosen.select(*whole.columns)).drop("entered", "left")


# --- the repaired text ------------------------------------------------------------------------------------


class _Repair:
    """The repaired text of one conversation, hashed as it goes by."""

    def __init__(self, key: str):
        self.key, self.hash, self.state, self.audit, self.at, self.parts = key, hashlib.sha256(), 0, "", 0, []
        self.empty = True

    def say(self, initial: str, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty, self.state = False, AFTER[initial][self.state]

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            need = NEEDED[self.state]
            self.say(need, ROLE[need], "")
            self.at += 1

    def piece(self, audit: str) -> None:
        self.insert()
        self.audit, self.at = audit, 0
        self.parts.append(audit)

    def row(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.insert()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.say(role[0], role, text)
            elif letter == "R":
                need = NEEDED[self.state]
                self.say(need, ROLE[need], text)

    def done(self) -> tuple[str, str, str]:
        self.insert()
        return self.key, "".join(self.parts), self.hash.hexdigest()


def repaired(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    """key, audit, repaired_sha256: the rows of a conversation go by in order behind the audit of their piece."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Repair | None = None
        for b in batches:
            out = []
            for key, role, text, n, audit in b[["key", "role", "text", "n", "audit"]].itertuples(index=False, name=None):
                if now is None or now.key != key:
                    out += [now.done()] if now else []
                    now = _Repair(key)
                if audit is not None:
                    now.piece(audit)
                else:
                    now.row(role, text, int(n))
            yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
        if now:
            yield pd.DataFrame([now.done()], columns=["key", "audit", "repaired_sha256"])

    none = F.lit(None).cast("string")
    rows = ordered.select("key", "part", "at", "role", "text", "n", none.alias("audit"))
    heads = solved.select("key", "part", F.lit(-1).cast("long").alias("at"), none.alias("role"), none.alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    dealt = rows.union(heads).repartition("key").sortWithinPartitions("key", "part", "at")
    return dealt.mapInPandas(read, "key string, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``turns``."""
    ordered = in_order(turns)
    marked = with_faults(ordered)
    solved = audits(marked, ordered)
    before = F.lag("tail").over(W.partitionBy("key").orderBy("part"))  # one row a part
    met = solved.select("key", "cost", "illegal", (before.isNotNull() & ~F.concat(before, "head").isin(*LEGAL)).cast("long").alias("border"))
    sums = met.groupBy("key").agg(F.sum(F.col("illegal") + F.col("border")).alias("illegal"), F.sum("cost").alias("cost"))
    return fault_counts(marked).join(sums, "key").join(repaired(ordered, solved), "key")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damaged(turns_of(conversations)))
    every = conversations.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found, "key", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by a recursion over the turns: a step keeps for every state the cheapest edits (cost, audit, text)."""
    blank = r"^[\x20\x09-\x0D]*$"

    def least(options: list[str]) -> str:
        return f"list_sort([x for x in [{', '.join(options)}] if x is not null])[1]"

    def more(was: str, cost: str, letter: str, said: str = "''") -> str:
        return f"case when {was} is not null then struct_pack(c := {was}.c + {cost}, a := {was}.a || '{letter}', t := {was}.t || {said}) end"

    def line(role: str, text: str) -> str:
        return f"{role} || ':' || {text} || chr(10)"

    user, helper = line("'user'", "''"), line("'assistant'", "''")
    closed = f"""i1 as (select *, q0 as p0, q1 as p1, {least(['q2', more('q0', '5', 'I', user), more('q1', '5', 'I', user), more('q3', '5', 'I', user)])} as p2 from %s),
  i2 as (select *, {least(['q3', more('p2', '5', 'I', helper)])} as p3 from i1),
  i3 as (select * replace ({least(['p2', more('p3', '5', 'I', user)])} as p2) from i2)"""
    keep = lambda p, s: f"case when init = '{s}' and not gone then {more(p, 'extra', 'K', line('role', 'text'))} end"
    new = lambda p, r: f"case when not gone then {more(p, '1 + extra', 'R', line(repr(r), 'text'))} end"
    go = lambda p: more(p, "2", "D")
    step = f"""select conv, n + 1 as n, {least([go('p0')])} as q0, {least([go('p1'), keep('p0', 's')])} as q1,
    {least([go('p2'), *[f(p, x) for p in ('p0', 'p1', 'p3') for f, x in ((keep, 'u'), (new, 'user'))]])} as q2,
    {least([go('p3'), keep('p2', 'a'), new('p2', 'assistant')])} as q3 from (select i3.*, role, text, init, gone, extra from i3 join faulty on faulty.conv = i3.conv and faulty.k = i3.n)"""
    return rf"""with recursive crc_table as (select list(v order by i) as tbl from (select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i))),
raw as (select conv_id, coalesce('=' || conv_id::varchar, '') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place from conversations),
coded as (select raw.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(place) + 1), lambda i: ascii(place[i])::bigint)), lambda c, b: xor(c >> 8, tbl[xor(c & 255, b) + 1])), 4294967295) % 20 as code from raw, crc_table),
harmed as (select conv, turn, case code when 4 then 'user' else role end as role, case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case code when 3 then 2 else 1 end)) as copy from coded where code <> 0),
placed as materialized (select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as k, substr(role, 1, 1) as init from harmed),
seen as (select *, regexp_matches(text, '{blank}') as is_blank, row_number() over (partition by conv, role, text order by k) > 1 as is_copy, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as ends, lag(init) over (partition by conv order by k) as before from placed),
faulty as materialized (select *, is_blank or is_copy as gone, case when not is_blank and not is_copy and ends not in ('.', '!', '?') then 5 else 0 end as extra from seen),
walk as (select conv, 1::bigint as n, struct_pack(c := 0::bigint, a := '', t := '') as q0, null::struct(c bigint, a varchar, t varchar) as q1, null::struct(c bigint, a varchar, t varchar) as q2, null::struct(c bigint, a varchar, t varchar) as q3 from (select distinct conv from placed)
  union all (with {closed % 'walk'} {step})),
ended as (select walk.* from walk join (select conv, max(k) + 1 as n from placed group by conv) using (conv, n)),
{closed % 'ended'},
best as (select conv, {least(['p0', 'p3'])} as b from i3),
counted as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (is_blank) as blank, count(*) filter (not is_blank and is_copy) as duplicate, count(*) filter (extra = 5) as truncated,
  count(*) filter (before is not null and before || init not in ('su', 'ua', 'au')) as illegal from faulty group by conv),
every as (select distinct conv_id, conv from raw)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.c, 0) as cost, coalesce(b.a, '') as audit,
  sha256(coalesce(b.t[:-2], '')) as repaired_sha256 from every left join counted using (conv) left join best using (conv)"""


ORACLE = _oracle()

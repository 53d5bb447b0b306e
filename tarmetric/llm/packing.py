"""Packing: windows over the token stream, cut by an order-preserving dynamic programme.

Documents keep their order. Their tokens form a stream that is cut into windows of at most ``length`` tokens, at
document or sentence ends (inside a sentence only where no end is near enough, or to close the stream).
A window costs its padding, which is none at exactly ``length`` tokens or a power of two, and a penalty for its
right cut: none at the end of a document, some at the end of a sentence, more elsewhere. With S(i) tokens
before cut i the cost of a window i..j is length - S(j) + S(i), so the best i is the least cost(i) + S(i) among
the cuts within reach: a queue of increasing values gives it in constant time. In the last ``length`` tokens of a
stream, where a short window may be left, the few starts that make a window a power of two are tried as well;
elsewhere full windows are wanted.

Every task packs the rows of its own partition in their order, in blocks of about ``BLOCK`` tokens; the rows of
the last, unfinished window go on into the next block. No shuffle, bounded memory, and a lost task packs
the same rows again. Sequences are numbered by partition and place. Only a partition's last window can be
short; it is cut at powers of two when that costs less than its padding.

Cases: a null or empty text is the end id alone; rows sharing an id are packed apart; a document longer than a
block is cut like any other; an empty partition gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tarmetric.llm.common import table

LENGTH, END_ID = 4096, 2
TOKENIZER = "word_bpe_49k.json"
SENTENCE_PENALTY, INSIDE_PENALTY = 2.0, 24.0
BLOCK = 1 << 18
#: Texts taken from a batch and pieces without ids given out at once; pieces with ids are given out by blocks of tokens.
TEXTS_HELD, ROWS_HELD = 256, 10_000
RUNS_KEPT = 400_000
_LETTERS = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u024f"
#: Texts whose letters are all Latin, without apostrophes, controls or special tokens: their letter runs and the runs
#: between these and white space are the tokenizer's own pieces, or whole groups of them.
_PLAIN = re.compile(rf"[{_LETTERS}\x20-\x26\x28-\x40\x5b-\x60\x7b-\x7e\t\n\r\u2010-\u2027]*")
_RUN = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}\s]+")
_WORD = re.compile(rf"[{_LETTERS}]+")


class PieceIds(dict):
    """Token ids of pieces of text, as little-endian bytes.

    The tokenizer lower-cases, drops white space and merges nothing across its pieces, so the ids of a plain text
    are those of its runs, one after the other. A Latin word goes straight to the merge model; other runs and
    texts that are not plain go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ends = {i for w in (".", "!", "?", "...", "!!") if (i := self.tokenizer.token_to_id(f"{w}</w>")) is not None}
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): shown.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x250))}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        if _WORD.fullmatch(run):
            shown = run if run.isascii() else run.translate(self.letters)
            got = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        else:
            got = self.encode(run)
        if len(self) < RUNS_KEPT:
            self[run] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            joined = b""
        elif "<|" not in text and _PLAIN.fullmatch(low := text.lower()):
            joined = b"".join(map(self.__getitem__, _RUN.findall(low)))
        else:
            joined = self.encode(text)
        return np.frombuffer(joined + END_ID.to_bytes(4, "little"), dtype="<u4")


_KNOWN: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    if path not in _KNOWN:
        _KNOWN[path] = PieceIds(path)
    return _KNOWN[path]


def cut_windows(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH, powers_from: int | None = None) -> list[int]:
    """Places of the cheapest cuts. ``places``: allowed cuts in increasing order, first 0, last the stream's end.

    No two neighbours may be more than ``length`` apart. With ``powers_from`` the stream ends here and windows that
    end behind that place may be powers of two; without it the cheapest cut within ``length`` of the end is the
    last, and what follows stays for the next windows.
    """
    at, pen = places.tolist(), penalties.tolist()
    n = len(at)
    cost, came = [0.0] * n, [0] * n
    index = {p: k for k, p in enumerate(at) if powers_from is not None and p >= powers_from - length}
    goes_on = powers_from is None
    powers_from = at[-1] if goes_on else powers_from
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        p = at[j]
        while at[queue[0][1]] < p - length:
            queue.popleft()
        value, origin = queue[0]
        value += length - p
        if p > powers_from:
            for w in powers:
                i = index.get(p - w)
                if i is not None and cost[i] < value:
                    value, origin = cost[i], i
        value += pen[j]
        cost[j], came[j] = value, origin
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], n - 1
    if goes_on:
        j = min((k for k in range(n) if at[k] > at[-1] - length), key=lambda k: (cost[k], -k))
    while j:
        cuts.append(at[j])
        j = came[j]
    return [0, *reversed(cuts)]


def allowed_cuts(ids: np.ndarray, ends: np.ndarray, sentence_ids: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a stream with their penalties. ``ends``: ends of documents.

    Sentences longer than 1/32 of ``length`` get cuts at every 1/64, and the last stretch of the stream those cuts
    that make powers of two from its end.
    """
    total = len(ids)
    is_end = np.zeros(total + 1, dtype=bool)
    is_end[ends] = True
    sentence = np.zeros(total + 1, dtype=bool)
    sentence[1:] = np.isin(ids, sentence_ids)
    places = np.flatnonzero(is_end | sentence)
    places = np.unique(np.r_[0, places, total])
    gaps = np.diff(places)
    step = max(1, length // 64)
    forced = [np.arange(places[k] + step, places[k + 1], step) for k in np.flatnonzero(gaps > 2 * step)]
    if last:
        tail = total - np.cumsum(1 << np.arange(length.bit_length() - 1))
        part, left = [], total % length
        for k in range(length.bit_length()):
            if left >> k & 1:
                part.append(total - (left & ((1 << (k + 1)) - 1)))
        forced += [np.array([t for t in [*tail, *part] if t > 0], dtype=np.int64)]
    places = np.unique(np.concatenate([places, *forced]))
    penalties = np.where(is_end[places], 0.0, np.where(sentence[places], SENTENCE_PENALTY, INSIDE_PENALTY))
    penalties[-1] = 0.0
    return places, penalties


def pack_stream(docs: Iterator[tuple], length: int, sentence_ids: np.ndarray, block: int = BLOCK) -> Iterator[tuple]:
    """(doc_id, start, length, crc32, doc tokens, sequence, offset, ids) of the pieces of ``docs`` (doc_id, ids)."""
    held: list[list] = []  # doc_id, ids not yet packed, start of these, tokens of the document
    size, sequence = 0, 0

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal held, size, sequence
        ids = np.concatenate([h[1] for h in held])
        ends = np.cumsum([len(h[1]) for h in held])
        places, penalties = allowed_cuts(ids, ends, sentence_ids, length, last)
        cuts = cut_windows(places, penalties, length, len(ids) - length if last else None)
        k, done = 0, 0
        for left, right in zip(cuts, cuts[1:]):
            at = left
            while at < right:
                to = min(right, int(ends[k]))
                doc, own, start, tokens = held[k]
                begin = at - (int(ends[k]) - len(own))
                piece = own[begin : begin + to - at]
                yield doc, start + begin, to - at, zlib.crc32(piece.tobytes()), tokens, sequence, at - left, piece
                at = to
                if to == ends[k]:
                    k += 1
            sequence += 1
            done = right
        rest = held[k:]
        if rest:
            doc, own, start, tokens = rest[0]
            begin = done - (int(ends[k]) - len(own))
            rest[0] = [doc, own[begin:], start + begin, tokens]
        held, size = rest, sum(len(h[1]) for h in rest)

    for doc, ids in docs:
        # a long document enters block by block
        for at in range(0, len(ids), block):
            part = ids[at : at + block]
            held.append([doc, part, at, len(ids)])
            size += len(part)
            if size >= block:
                yield from flush(False)
    if size:
        yield from flush(True)


def piece_batch(rows: list[tuple], base: int, with_ids: bool) -> pa.RecordBatch:
    """Rows of :func:`pack_stream` as a batch; sequences are numbered from ``base``."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    *numbers, pieces = zip(*rows)
    numbers[5] = [base + n for n in numbers[5]]
    columns = [pa.array(n, pa.int64()) for n in numbers]
    if with_ids:
        ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).view(np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=[*names, *(["ids"] if with_ids else [])])


def packed_batches(batches: Iterator[pa.RecordBatch], path: str, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of one partition (``doc_id, text, _part``), given out by tokens, so a task holds few of them."""
    known = piece_ids(path)
    base = 0

    def stream() -> Iterator[tuple]:
        nonlocal base
        for b in batches:
            base = b["_part"][0].as_py() << 33 if b.num_rows else base
            for at in range(0, b.num_rows, TEXTS_HELD):
                part = b.slice(at, TEXTS_HELD)
                yield from zip(part["doc_id"].to_pylist(), map(known.ids, part["text"].to_pylist()))

    rows, tokens = [], 0
    for row in pack_stream(stream(), length, np.array(sorted(known.ends), dtype=np.uint32)):
        rows.append(row if with_ids else (*row[:-1], None))
        tokens += row[2] if with_ids else 1
        if tokens >= (BLOCK if with_ids else ROWS_HELD):
            yield piece_batch(rows, base, with_ids)
            rows, tokens = [], 0
    if rows:
        yield piece_batch(rows, base, with_ids)


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on demand their ids."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("_part")).mapInArrow(lambda batches: packed_batches(batches, path, length, with_ids), schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

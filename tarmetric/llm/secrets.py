"""Secret scans: fixed credential patterns, and guess costs of values in a credential context.

The guess cost of a value is the smallest total, in bits, over all ways to cut it into common words, dates,
repeats, keyboard walks, counting runs and brute-force characters: a dynamic programme over the places of the
value. A value behind a credential word is added as a span of kind ``guess`` when its cost reaches
``GUESS_BITS``; words and placeholders stay below.

The scan is a map over the rows: no shuffle, one text at a time, whole texts.

Cases: null and empty texts have no spans; rows sharing an id are scanned apart; spans of different kinds may
overlap and all are reported; a redaction joins overlapping spans; other columns are ignored by the scan and
kept by the redaction.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarmetric.llm.common import table

KINDS = ("assign", "access", "hex", "guess")
GUESS_BITS = 45.0
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|bearer|auth(?:orization)?|(?:api|access|private|signing)[_\x20-]?key)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']+))""",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "cred", "bearer", "auth", "key")

# Words that guessers try first, most common first.
COMMON = (
    "password", "123456", "qwerty", "admin", "welcome", "letmein", "login", "secret", "token", "dragon", "monkey", "football",
    "iloveyou", "master", "sunshine", "shadow", "princess", "default", "changeme", "example", "sample", "test", "demo", "user",
    "root", "guest", "key", "api", "your", "here", "none", "null", "value", "string", "dummy", "placeholder", "redacted", "my",
    "pass", "the", "and", "for", "prod", "dev", "local", "host", "data", "base", "server", "name", "abc", "hello", "love",
)
_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
_LONGEST = max(map(len, COMMON))
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("4@310$57", "aaeiosst")


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isascii() and c.isalpha():
        return math.log2(26) + 0.5
    return math.log2(33) if c.isascii() else 10.0


def guess_bits(value: str) -> float:
    """Least bits of a segmentation of ``value``."""
    low = value.lower()
    if len(low) != len(value):
        low = value
    plain = low.translate(_LEET)
    n = len(value)
    dates = {}
    for k in range(n):
        if m := _DATE.match(value, k):
            dates.setdefault(m.end(), []).append((k, math.log2(365 * 120) if m.end() - k > 4 else math.log2(120)))
    best = [0.0] * (n + 1)
    same = walk = count = 0  # where the current run of each kind begins
    for j in range(1, n + 1):
        c = low[j - 1]
        cost = best[j - 1] + _char_bits(value[j - 1])
        if j > 1:
            before = low[j - 2]
            if c != before:
                same = j - 1
            if not _near(before, c):
                walk = j - 1
            if ord(c) - ord(before) not in (1, -1) or not (c.isalnum() and before.isalnum()):
                count = j - 1
        if j - same >= 3:
            cost = min(cost, best[same] + _char_bits(c) + math.log2(j - same))
        if j - walk >= 4:
            cost = min(cost, best[walk] + math.log2(len(_PLACE)) + 2.3 + (j - walk) * 0.8)
        if j - count >= 3:
            cost = min(cost, best[count] + math.log2(62) + math.log2(j - count) + 1)
        for unit in (2, 3, 4):  # a repeated unit
            if j >= 2 * unit and low[j - unit : j] == low[j - 2 * unit : j - unit]:
                cost = min(cost, best[j - unit] + 1.5)
        for i in range(max(0, j - _LONGEST), j - 1):
            rank = _RANK.get(low[i:j])
            leet = 0.0
            if rank is None:
                rank, leet = _RANK.get(plain[i:j]), 2.0
            if rank is not None:
                upper = 0.0 if value[i:j].islower() or not value[i:j].isalpha() else 1.0 + (0.0 if value[i:j].istitle() or value[i:j].isupper() else 3.0)
                cost = min(cost, best[i] + math.log2(rank + 1) + leet + upper)
        for i, bits in dates.get(j, ()):
            cost = min(cost, best[i] + bits)
        best[j] = cost
    return best[n]


def find_spans(text: str | None, least_bits: float = GUESS_BITS) -> tuple[list[tuple[int, str, int]], float]:
    """(start, kind, end) of all spans by start and kind, and the largest guess cost seen."""
    if not text:
        return [], 0.0
    found, most = [], 0.0
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        for m in _CONTEXT.finditer(text):
            g = m.lastindex
            value = m[g]
            bits = guess_bits(value)
            most = max(most, bits)
            if bits >= least_bits:
                found.append((m.start(g), "guess", m.end(g)))
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2])), most


def scan_secrets(docs: DataFrame, least_bits: float = GUESS_BITS) -> DataFrame:
    """doc_id, spans (array of start, kind, end in code points) and guess_bits of every row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [find_spans(t, least_bits) for t in b["text"]]
            rows = [[{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans, _ in got]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": rows, "guess_bits": [bits for _, bits in got]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(scan, "doc_id long, spans array<struct<start:long,kind:string,end:long>>, guess_bits double")


def secret_digest(scanned: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return scanned.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("guess"), "guess_bits"
    )


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    spans, _ = find_spans(text)
    if not spans:
        return text
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    cuts = [0, *[x for span in merged for x in span], len(text)]
    return mark.join(text[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows with secrets replaced in ``text``; ``n_chars``, where there, follows the new text."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    new = docs.withColumn("text", clean("text"))
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))

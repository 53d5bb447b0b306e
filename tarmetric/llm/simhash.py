"""SimHash near-duplicates: generalised pigeonhole over correlated bits with unequal thresholds.

A fingerprint has 64 bits. The bits are grouped into parts so that correlated bits share a part; each part i
gets a threshold t_i (-1: unused) with sum(t_i + 1) = radius + 1, so two fingerprints within the radius are
within t_i in at least one part. The thresholds come from a dynamic programme over candidate counts, which
are computed from the counts of all distinct fingerprints. A fingerprint is filed under its key in every used
part and probes the keys within t_i; what meets under a key is verified on all 64 bits.

Buckets above ``bucket_rows`` are refined: fingerprints within the radius agree in one of radius + 1 slices
of the remaining bits, so they meet again under (part, key, slice, value). Every bucket returns a spanning
forest of its verified links, not its pairs. Equal fingerprints are one node from the start, whatever their
number.

Cases: null or blank texts have fingerprint zero and are linked like any other; fewer than four words give
one shingle; repeated rows share a class; a class whose ids are all null has a null id; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tarmetric.llm.common import row_key, table
from tarmetric.llm.components import components
from tarmetric.session import materialize

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
BUCKET_ROWS = 4096
CHUNK = 1 << 15
FOLD = 16
#: Cost of filing or probing one row, in verified pairs.
PROBE_COST = 30


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text: a bit is set if over half of the shingle hashes set it."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(words, len(parts))
    n = len(parts) - k + 1
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), dtype="<u8", count=to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The row's key, doc_id and fingerprint; written once, since texts are read for it."""
    return materialize(docs.select("doc_id", *row_key(), fingerprint_column("text").alias("fp")), "fingerprints")


# --- the plan of parts and thresholds ---------------------------------------------------------------------


def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
        for at in range(0, len(bits), CHUNK):
            part = bits[at : at + CHUNK]
            total += (part.T @ part).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS), "n": total.ravel()})


def bit_groups(fps: DataFrame, parts: int, both: np.ndarray, n: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width; a group takes the free bit most correlated with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - g)
        order = sorted(free)
        own = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def bit_key(fp: Column, bits: list[int]) -> Column:
    """The given bits of ``fp`` as a number."""
    out = F.lit(0).cast("long")
    for k, bit in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1)), k))
    return out


def masks(width: int, most: int) -> list[int]:
    """All keys with one to ``most`` of ``width`` bits set."""
    return [sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(range(width), k)]


def candidate_costs(counts: np.ndarray, width: int, n: int, radius: int) -> list[float]:
    """Cost of thresholds -1 to ``radius`` in a part: pairs that meet plus rows that are filed and probe.

    ``counts`` are over the first ``FOLD`` bits; the other bits of a wider part divide the pairs.
    """
    kept = min(width, FOLD)
    near, costs, at = np.zeros(1 << kept), [0.0], np.arange(1 << kept)
    for t in range(radius + 1):
        for c in combinations(range(kept), t):
            near += counts[at ^ sum(1 << b for b in c)]
        probes = len(masks(width, t)) + 1 if t < 4 or width <= 16 else 1e6
        scale = probes / (len(masks(kept, t)) + 1) / 2.0 ** (width - kept)
        costs.append(float((counts * near).sum()) * scale + PROBE_COST * n * probes)
    return costs


def allocate(costs: list[list[float]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = radius + 1, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, radius - used + 1):
                key, value = used + t + 1, total + cost[t + 1]
                if key not in following or value < following[key][0]:
                    following[key] = (value, [*chosen, t])
        best = following
    return best[radius + 1]


def plan_parts(fps: DataFrame, radius: int = RADIUS, choices: tuple[int, ...] = (4, 3, 2)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts in use, of the cheapest number of parts."""
    cells = fps.select("fp").mapInArrow(_bit_pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(BITS * BITS)
    both[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy()
    n = fps.count()
    groups = {m: bit_groups(fps, m, both.reshape(BITS, BITS), n) for m in choices}
    listed = [g for m in choices for g in groups[m]]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), bit_key(F.col("fp"), g[:FOLD]).alias("key")) for i, g in enumerate(listed)])
    # at most 2^FOLD rows a part
    seen = fps.select(F.inline(keys)).groupBy("part", "key").count().toPandas()
    counts = np.zeros((len(listed), 1 << FOLD))
    counts[seen["part"].to_numpy(dtype=np.int64), seen["key"].to_numpy(dtype=np.int64)] = seen["count"].to_numpy()
    plans = []
    for m in choices:
        first = next(i for i, g in enumerate(listed) if g is groups[m][0])
        costs = [candidate_costs(counts[first + i][: 1 << min(len(g), FOLD)], len(g), n, radius) for i, g in enumerate(groups[m])]
        total, chosen = allocate(costs, radius)
        plans.append((total, [(g, t) for g, t in zip(groups[m], chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


# --- candidates, verification, spanning forests ------------------------------------------------------------


def postings(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, probe (0: filed, 1: probing), fp."""
    out = None
    for i, (bits, t) in enumerate(parts):
        own = fps.select(F.lit(i).alias("part"), bit_key(F.col("fp"), bits).alias("key"), "fp")
        if t > 0:
            every = F.array(F.lit(0).cast("long"), *[F.lit(m).cast("long") for m in masks(len(bits), t)])
            own = own.select("part", "key", F.explode(every).alias("mask"), "fp")
            own = own.select("part", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), F.when(F.col("mask") == 0, 0).otherwise(1).alias("probe"), "fp")
        else:
            own = own.select("part", "key", F.lit(0).alias("probe"), "fp")
        out = own if out is None else out.union(own)
    return out


def refine(rows: DataFrame, parts: list[tuple[list[int], int]], radius: int, bucket_rows: int) -> DataFrame:
    """Postings with slice and value: -1 and 0, or in large buckets one row per slice of the other bits."""
    large = rows.groupBy("part", "key").count().where(F.col("count") > bucket_rows).select("part", "key")
    large = materialize(large, "large-buckets")
    small = rows.join(large, ["part", "key"], "left_anti").select("part", "key", F.lit(-1).alias("slice"), F.lit(0).cast("long").alias("value"), "probe", "fp")
    cut = None
    for i, (bits, _) in enumerate(parts):
        rest = [b for b in range(BITS) if b not in bits]
        slices = [rest[s :: radius + 1] for s in range(radius + 1)]
        each = F.array(*[F.struct(F.lit(s).alias("slice"), bit_key(F.col("fp"), own).alias("value")) for s, own in enumerate(slices)])
        part = rows.where(F.col("part") == i).join(large, ["part", "key"], "left_semi").select("part", "key", F.inline(each), "probe", "fp")
        cut = part if cut is None else cut.union(part)
    return small.union(cut)


def forest(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is within the radius in one bucket; each fingerprint is reached once."""
    fp = np.unique(fp)
    left, out = fp, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                got, left = left[near], left[~near]
                out.append((np.full(len(got), x), got))
                queue.extend(got)
    return out


def bucket_links(group: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int, dense: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of sorted buckets (filed rows first in each). Large buckets give a forest."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    ends = np.repeat(starts + sizes, sizes)
    a, b = [], []
    here = np.flatnonzero((np.repeat(sizes, sizes) <= dense) & (probe == 0))
    step = 1
    while len(here := here[here + step < ends[here]]):
        near = np.bitwise_count(fp[here] ^ fp[here + step]) <= radius
        a.append(fp[here[near]])
        b.append(fp[here[near] + step])
        step += 1
    for s, k in zip(starts[sizes > dense].tolist(), sizes[sizes > dense].tolist(), strict=True):
        own = fp[s : s + k]
        # a probing row matters only near a filed one; those are far fewer
        n = int((probe[s : s + k] == 0).sum())
        if n and n < k:
            near = np.zeros(k, dtype=bool)
            near[:n] = True
            for row in range(n, k, CHUNK):
                for at in range(0, n, 256):
                    near[row : row + CHUNK] |= (np.bitwise_count(own[row : row + CHUNK, None] ^ own[None, at : min(n, at + 256)]) <= radius).any(axis=1)
            own = own[near]
        for x, y in forest(own, radius) if n else []:
            a.append(x)
            b.append(y)
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """a, b of the links found in the buckets of ``rows``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
            key = np.concatenate([p[0] for p in parts])
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0)
            x, y = bucket_links(group, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), radius)
            pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_pydict({"a": pa.array(pair[:, 0].view(np.int64)), "b": pa.array(pair[:, 1].view(np.int64))})

        held: list = []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "key", "slice", "value")], axis=1)
            now = (key, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("probe").to_numpy(zero_copy_only=False))
            if not len(key):
                continue
            # the last bucket of the batch may go on in the next one
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield emit([*held, tuple(x[:cut] for x in now)])
                held = []
            elif held and (held[-1][0][-1] != key[0]).any():
                yield emit(held)
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield emit(held)

    order = ["part", "key", "slice", "value"]
    return rows.repartition(*order).sortWithinPartitions(*order, "probe").mapInArrow(verify, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links a, b between distinct fingerprints: they connect exactly what pairs within the radius connect."""
    parts = plan_parts(fps, radius)
    return link_buckets(refine(postings(fps, parts), parts, radius, bucket_rows), radius).distinct()


def classes(base: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """fp, root and component_id (the smallest doc_id reachable) of every distinct fingerprint of ``base``."""
    fps = materialize(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(fingerprint_links(fps, radius, bucket_rows), "fingerprint-links")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    base = fingerprints(docs)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return base.join(classes(base, radius), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

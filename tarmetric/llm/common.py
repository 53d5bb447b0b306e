"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda over another array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key() -> list[Column]:
    """128 bits naming a document row by its id and text, so that rows need no generated id.

    Rows equal in both share the key and get the same decision.
    """
    own = F.struct("doc_id", "text")
    return [F.xxhash64(F.lit(1), own).alias("_k1"), F.xxhash64(F.lit(2), own).alias("_k2")]


def literal_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A short fixed table built in the JVM, so that no Python runs for it."""
    rows = list(rows)
    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split()[1] for part in schema.split(",")]
    if not rows:
        return spark.sql("select " + ", ".join(f"cast(null as {t}) as {n}" for n, t in zip(names, types))).where("false")
    entry = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows])
    return spark.range(1).select(F.inline(entry))


#: Most rows of a side that is sent to all tasks.
FEW_ROWS = 1 << 18


def few_rows(written: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A written table of short rows, marked for sending where it is counted to have at most ``most`` rows."""
    return F.broadcast(written) if written.count() <= most else written


#: Most 64-bit words of the bitmap of keys.
KEY_BITMAP = 1 << 17


def _may_have(keys: DataFrame) -> Column:
    """Whether ``_k1`` may be one of the keys: their bitmap is a constant of the plan."""
    size = KEY_BITMAP
    bit = F.shiftrightunsigned("_k1", 40).bitwiseAND(F.lit(63)).cast("int")
    held = keys.select(F.col("_k1").bitwiseAND(F.lit(size - 1)).cast("int").alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("v"))
    words = [0] * size
    for r in held.groupBy("id").agg(F.bit_or("v").alias("v")).toLocalIterator():  # at most KEY_BITMAP rows
        words[r["id"]] = r["v"]
    bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    word = F.get(bits, F.col("_k1").bitwiseAND(F.lit(size - 1)).cast("int"))
    return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1)) == 1


def rows_with(rows: DataFrame, keys: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """The rows whose ``_k1``, ``_k2`` are in the written table ``keys``; where it is long, only rows that its bitmap may hold are moved."""
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), ["_k1", "_k2"], "left_semi")
    return rows.where(_may_have(keys)).join(keys, ["_k1", "_k2"], "left_semi")


def rows_without(rows: DataFrame, keys: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """The rows whose ``_k1``, ``_k2`` are not in the written table ``keys``, moved as in :func:`rows_with`."""
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), ["_k1", "_k2"], "left_anti")
    may = _may_have(keys)
    return rows.where(~may).union(rows.where(may).join(keys, ["_k1", "_k2"], "left_anti"))

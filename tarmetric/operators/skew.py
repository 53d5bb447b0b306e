"""Skew-safe building blocks: salted joins, two-level running sums, two-level lead, ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

HOT_MIN_ROWS = 50_000
MAX_HOT_KEYS = 10_000


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    hot_min: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Equi-join whose hot left keys are spread over several tasks; every pair still meets once.

    A key is hot when it holds more than ``hot_min`` left rows and more than 1/10,000 of all of
    them, so there are fewer than 10,000 hot keys by construction and that table may be
    broadcast. Right rows of a hot key are repeated once per salt, all others stay single. The
    salt is a hash of the left row, so a recomputed task places its rows the same way.
    ``counts`` (keys and ``_n``) saves a pass where the caller already has it.
    """
    counts = key_counts(left, keys) if counts is None else counts
    total = counts.agg(F.sum("_n").alias("_total"))
    share = F.greatest(F.lit(hot_min), F.ceil(F.col("_total") / MAX_HOT_KEYS))
    hot = (
        counts.crossJoin(F.broadcast(total))
        .filter(F.col("_n") > share)
        .select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    )
    hashable = [f.name for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    salt = F.coalesce(F.pmod(F.xxhash64(*hashable), F.col("_salts")).cast("int"), F.lit(0))
    spread = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    repeated = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    # Exploded rows are estimated as small as what they were made from; unhinted they would be broadcast.
    return spread.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def running_sum(df: DataFrame, key: list[str], order: str, value: Column, name: str, chunk: int = 4096) -> DataFrame:
    """Inclusive running sum of ``value`` per ``key`` in integer ``order``, in two levels.

    Chunk totals are summed first (one row per chunk), then each chunk is summed on its own, so
    one very long group is spread over many window partitions.
    """
    parts = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_v", value)
    totals = parts.groupBy(*key, "_chunk").agg(F.sum("_v").alias("_t"))
    before = W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*key, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    # The rows often come from an explode, whose size is estimated as that of its input: unhinted they would be broadcast.
    return (
        parts.withColumn("_s", F.sum("_v").over(inside))
        .join(offsets.hint("merge"), [*key, "_chunk"])
        .withColumn(name, F.col("_o") + F.col("_s"))
        .drop("_chunk", "_v", "_s", "_o")
    )


def next_in_group(df: DataFrame, key: list[str], order: list[str], bucket: Column, fields: list[str]) -> DataFrame:
    """``lead`` of ``fields`` per ``key``, with the group cut into buckets along the order.

    ``bucket`` must not decrease along ``order``. The last row of a bucket takes the first row of
    the following non-empty bucket, so no window holds more than one bucket of a hot key.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*key, "_bucket").orderBy(*order)
    packed = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f) for f in fields])
    heads = rows.groupBy(*key, "_bucket").agg(F.min(packed).alias("_head"))
    heads = heads.select(*key, "_bucket", F.lead("_head").over(W.partitionBy(*key).orderBy("_bucket")).alias("_after"))
    out = rows.withColumn("_next", F.lead(packed).over(inside)).join(heads.hint("merge"), [*key, "_bucket"])
    for f in fields:
        out = out.withColumn(f"next_{f}", F.coalesce(F.col("_next"), F.col("_after"))[f])
    return out.drop("_bucket", "_next", "_after")


def ordinal(df: DataFrame, band: Column, order: list[str], name: str) -> DataFrame:
    """0-based position in a total order without one global window.

    ``band`` is a coarse integer that does not decrease along ``order`` and takes a bounded
    number of values; only the band counts meet in one window.
    """
    banded = df.withColumn("_band", band)
    counts = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_band",
        F.coalesce(F.sum("_n").over(W.orderBy("_band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
    )
    inside = F.row_number().over(W.partitionBy("_band").orderBy(*order))
    return banded.withColumn("_r", inside).join(offsets, "_band").withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_band", "_r", "_o")

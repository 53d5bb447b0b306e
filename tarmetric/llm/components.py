"""Connected components of a link table by contraction; hubs are never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric.session import materialize


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """node, root for every node of ``links`` (a, b): nodes share a root exactly when links connect them.

    A round sends each node to the neighbour, or itself, with the smallest hash and keeps only links
    between different images; the hash order changes by round, so a chain shrinks by a constant share.
    Each round is a written table.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), label)
    found, turn = None, 0
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("n"))  # noqa: E731, B023
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("least"))
        step = materialize(
            near.select("node", F.least(F.col("least"), rank(F.col("node")))["n"].alias("to")), f"{label}-step"
        )
        found = step.select("node", F.col("to").alias("root")) if found is None else _follow(found, step)
        found = materialize(found, f"{label}-root")
        ends = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        pair = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = materialize(pair.distinct(), f"{label}-next")
        turn += 1
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _follow(found: DataFrame, step: DataFrame) -> DataFrame:
    on = step.select(F.col("node").alias("root"), F.col("to").alias("next"))
    return found.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

"""Dataset profile and leakage checks as DataFrame assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tarmetric.functions.rounding import round_dp


QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def column_kind(data_type: str) -> str:
    return {"string": "text", "boolean": "flag"}.get(data_type, "number")


def profile(dataset: DataFrame, accuracy: int = 1_000_000) -> DataFrame:
    """One row per column: kind, nulls, distinct values; for numbers also range, mean, spread, quartiles, the mean
    of event rows and the correlation with being one.

    The columns are unfolded into rows once. Counts, moments and quantile sketches combine before the exchange, so a
    column's last task merges sketches, not values; a quartile's rank is at most ``rows / accuracy`` off. Values are
    told apart by (column, value), which spreads over all tasks whatever the number of columns.
    """
    event = (F.col("label_status") == "event").cast("double")
    kinds = {f.name: column_kind(f.dataType.simpleString()) for f in dataset.schema.fields}
    cells = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("text"),
            (F.col(c).cast("double") if kind == "number" else F.lit(None).cast("double")).alias("x"),
        )
        for c, kind in kinds.items()
    ]
    rows = dataset.select(event.alias("event"), F.explode(F.array(*cells)).alias("c")).select("event", "c.*")
    x = F.col("x")
    is_event = F.when(x.isNotNull(), F.col("event"))
    correlation = F.try_divide(F.covar_pop(x, is_event), F.stddev_pop(x) * F.stddev_pop(is_event))  # NULL where one is constant
    moments = rows.groupBy("feature", "kind").agg(
        F.count_if(F.col("text").isNull()).alias("nulls"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        round_dp(F.avg(x), 4).alias("mean_all"),
        round_dp(F.stddev(x), 4).alias("spread"),
        *[F.percentile_approx(x, q, accuracy).alias(name) for name, q in QUANTILES.items()],
        round_dp(F.avg(F.when(F.col("event") == 1, x)), 4).alias("mean_event"),
        round_dp(correlation, 4).alias("correlation"),
    )
    values = rows.select("feature", "text").distinct().groupBy("feature").agg(F.count("text").alias("distinct_values"))
    return moments.join(values, "feature")


def label_counts(dataset: DataFrame) -> DataFrame:
    """Rows, segments and years of each label status."""
    return dataset.groupBy("label_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("segment_id").alias("segments"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def _check(name: str, violations: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return violations.agg(F.lit(name).alias("name"), (n == 0).alias("passed"), n.alias("violations"))


LIFETIME = ("historical_landslide_count", "nearest_landslide_distance_m")


def leakage_checks(
    dataset: DataFrame, segments: DataFrame, events: DataFrame, cell_year: DataFrame, inputs: list[str], assigned: DataFrame
) -> DataFrame:
    """Seven checks, each ``name, passed, violations``; every one reads the whole table.

    ``events`` (segment_id, year) are counted anew, ``segments`` (segment_id, way_id) names the road a segment was cut
    from, ``inputs`` are the columns the fitted pipeline reads, and ``assigned`` (segment_id, year, way_group, fold)
    are the rows as the folds deal them.
    """
    rain = cell_year.select(
        F.col("lat").alias("rainfall_grid_lat"), F.col("lng").alias("rainfall_grid_lon"), "year", F.col("annual_mm").alias("_mm")
    )
    wrong_year = dataset.join(rain, ["rainfall_grid_lat", "rainfall_grid_lon", "year"], "left").filter(
        ~F.col("_mm").eqNullSafe(F.col("annual_rainfall_mm"))
    )
    # Event years strictly before each row, from the labels alone.
    before = W.partitionBy("segment_id").orderBy("year").rangeBetween(W.unboundedPreceding, -1)
    event = (F.col("label_status") == "event").cast("int")
    undercounted = dataset.withColumn("_e", F.coalesce(F.sum(event).over(before), F.lit(0))).filter(
        F.col("historical_landslide_count_prior") < F.col("_e")
    )
    # A row whose history also holds events of its own or a later year.
    dated = events.filter(F.col("year").isNotNull()).groupBy("segment_id", "year").agg(F.count(F.lit(1)).alias("_n"))
    first = dataset.agg(F.min("year").alias("_first"))
    known = dated.crossJoin(F.broadcast(first)).groupBy("segment_id").agg(
        F.coalesce(F.sum(F.when(F.col("year") < F.col("_first"), F.col("_n"))), F.lit(0)).alias("_early")
    )
    counted = dataset.join(dated, ["segment_id", "year"], "left").join(known, "segment_id", "left")
    counted = counted.withColumn("_past", F.coalesce("_early", F.lit(0)) + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    lifetime = counted.filter(F.col("historical_landslide_count_prior") > F.col("_past")).select("segment_id")
    named = dataset.sparkSession.createDataFrame([(c,) for c in inputs if c in LIFETIME], "segment_id string")
    split_segments = assigned.groupBy("segment_id").agg(F.count_distinct("fold").alias("n"))
    split_ways = assigned.join(segments.select("segment_id", "way_id"), "segment_id").groupBy("way_id").agg(F.count_distinct("fold").alias("n"))
    missing = segments.select("segment_id").join(dataset.select("segment_id").distinct(), "segment_id", "left_anti")
    relabelled = dataset.groupBy("segment_id", "year").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("l"), F.max("label_status").alias("s"))
    checks = {
        "future_rainfall": wrong_year,
        "prior_cutoff": undercounted,
        "no_lifetime_feature": lifetime.unionByName(named),
        "group_isolation": split_segments.filter("n > 1"),
        "candidate_pool": missing,
        "single_label": relabelled.filter("n > 1 or (s = 'event' and l <> 1.0)"),
        "sibling_grouping": split_ways.filter("n > 1"),
    }
    return reduce(DataFrame.unionByName, [_check(k, v) for k, v in checks.items()])

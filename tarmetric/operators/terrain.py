"""Elevation sampling and segment terrain profiles.

The elevation grid is a long table ``tile_lat, tile_lng, row, col, elev``: row 0 is the north
edge, column 0 the west edge of a one-degree tile. A void or absent sample never turns into a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarmetric import params as P
from tarmetric.functions.geo import haversine_km, representative_point, resample
from tarmetric.functions.rounding import round_dp
from tarmetric.operators.gridjoin import nearest_points
from tarmetric.operators.skew import running_sum


def tile_name(tile_lat: Column, tile_lng: Column) -> Column:
    return F.concat(
        F.when(tile_lat >= 0, "N").otherwise("S"),
        F.lpad(F.abs(tile_lat).cast("string"), 2, "0"),
        F.when(tile_lng >= 0, "E").otherwise("W"),
        F.lpad(F.abs(tile_lng).cast("string"), 3, "0"),
    )


def sample_elevation(points: DataFrame, grid: DataFrame, key: list[str], tile_samples: int = P.TILE_SAMPLES) -> DataFrame:
    """Bilinear elevation for ``points(key..., lat, lng)``; ``elev`` is NULL without usable samples.

    Where one of the four corners is void the single nearest sample is used instead, if it is valid.
    The four corners are one equi-join on (tile, row, col).
    """
    n = tile_samples - 1
    placed = (
        points.withColumn("tile_lat", F.floor("lat").cast("int"))
        .withColumn("tile_lng", F.floor("lng").cast("int"))
        .withColumn("_rf", (F.col("tile_lat") + 1 - F.col("lat")) * n)
        .withColumn("_cf", (F.col("lng") - F.col("tile_lng")) * n)
        .withColumn("_r0", F.least(F.floor("_rf"), F.lit(n - 1)).cast("int"))
        .withColumn("_c0", F.least(F.floor("_cf"), F.lit(n - 1)).cast("int"))
    )
    corners = placed.select(
        *key,
        "tile_lat",
        "tile_lng",
        "_rf",
        "_cf",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (0, 1) for j in (0, 1)])
        ).alias("k"),
        "_r0",
        "_c0",
    ).withColumn("row", F.col("_r0") + F.col("k.dr")).withColumn("col", F.col("_c0") + F.col("k.dc"))
    valid = grid.filter(F.col("elev") != P.TILE_VOID).select("tile_lat", "tile_lng", "row", "col", F.col("elev").cast("double").alias("elev"))
    read = corners.join(valid, ["tile_lat", "tile_lng", "row", "col"], "left")
    fr, fc = F.col("_rf") - F.col("_r0"), F.col("_cf") - F.col("_c0")
    weight = F.when(F.col("k.dr") == 0, 1 - fr).otherwise(fr) * F.when(F.col("k.dc") == 0, 1 - fc).otherwise(fc)
    is_nearest = (F.col("row") == F.rint("_rf")) & (F.col("col") == F.rint("_cf"))
    summed = read.groupBy(*key).agg(
        F.count("elev").alias("_valid"),
        F.sum(F.when(F.col("elev").isNotNull(), weight * F.col("elev"))).alias("_bilinear"),
        F.max(F.when(is_nearest, F.col("elev"))).alias("_nearest"),
    )
    elev = F.when(F.col("_valid") == 4, F.col("_bilinear")).otherwise(F.col("_nearest"))
    return points.join(summed.select(*key, elev.alias("elev")), key, "left")


def sample_blocks(
    points: DataFrame, blocks: DataFrame, tile_samples: int = P.TILE_SAMPLES, intervals: int = P.TILE_BLOCK_INTERVALS
) -> DataFrame:
    """``points(..., lat, lng)`` with bilinear ``elev`` read from raster blocks; NULL without usable samples.

    All corners of a point stand in one block, so this is one equi-join on the block's key and no aggregation.
    Corners that are void or absent are treated as in ``sample_elevation``.
    """
    n = tile_samples - 1
    placed = (
        points.withColumn("tile_lat", F.floor("lat").cast("int"))
        .withColumn("tile_lng", F.floor("lng").cast("int"))
        .withColumn("_rf", (F.col("tile_lat") + 1 - F.col("lat")) * n)
        .withColumn("_cf", (F.col("lng") - F.col("tile_lng")) * n)
        .withColumn("_r0", F.least(F.floor("_rf"), F.lit(n - 1)).cast("int"))
        .withColumn("_c0", F.least(F.floor("_cf"), F.lit(n - 1)).cast("int"))
        .withColumn("block_row", F.floor(F.col("_r0") / intervals).cast("int"))
        .withColumn("block_col", F.floor(F.col("_c0") / intervals).cast("int"))
    )
    read = placed.join(blocks, ["tile_lat", "tile_lng", "block_row", "block_col"], "left")

    def at(row: Column, col: Column) -> Column:
        place = (row - F.col("block_row") * intervals) * F.col("width") + (col - F.col("block_col") * intervals)
        value = F.get("samples", place.cast("int")).cast("double")
        return F.when(value != P.TILE_VOID, value)

    r0, c0 = F.col("_r0"), F.col("_c0")
    fr, fc = F.col("_rf") - r0, F.col("_cf") - c0
    top = at(r0, c0) * (1 - fc) + at(r0, c0 + 1) * fc
    bottom = at(r0 + 1, c0) * (1 - fc) + at(r0 + 1, c0 + 1) * fc
    bilinear = top * (1 - fr) + bottom * fr  # NULL as soon as one corner is
    nearest = at(F.rint("_rf").cast("int"), F.rint("_cf").cast("int"))
    return read.select(*points.columns, F.coalesce(bilinear, nearest).alias("elev"))


def terrain_samples(segments: DataFrame, interval_m: float = P.SAMPLE_INTERVAL_M) -> DataFrame:
    """``segment_id, seq, lat, lng`` along every segment."""
    return segments.select("segment_id", F.posexplode(resample(F.col("geometry"), interval_m)).alias("seq", "p")).select(
        "segment_id", "seq", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng")
    )


def with_distance_along(samples: DataFrame) -> DataFrame:
    """Cumulative metres from the first sample of each segment."""
    order = W.partitionBy("segment_id").orderBy("seq")
    step = haversine_km(F.lag("lat").over(order), F.lag("lng").over(order), F.col("lat"), F.col("lng")) * 1000.0
    stepped = samples.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return running_sum(stepped, ["segment_id"], "seq", F.col("_step"), "along_m").drop("_step")


def segment_terrain(samples: DataFrame) -> DataFrame:
    """Elevation range, mean and slope from ``segment_id, seq, along_m, elev`` samples.

    Slope is the arctangent of total absolute climb over the distance between the first and last
    valid sample; it needs two valid samples.
    """
    order = W.partitionBy("segment_id").orderBy("seq")
    climb = F.when(
        F.col("elev").isNotNull(), F.abs(F.col("elev") - F.last("elev", True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    )
    valid_at = F.when(F.col("elev").isNotNull(), F.col("along_m"))
    out = (
        samples.withColumn("_climb", climb)
        .groupBy("segment_id")
        .agg(
            F.avg("elev").alias("elevation_m"),
            F.min("elev").alias("min_elevation_m"),
            F.max("elev").alias("max_elevation_m"),
            F.count(F.lit(1)).alias("sample_count"),
            F.count("elev").alias("valid_sample_count"),
            F.sum("_climb").alias("_rise"),
            (F.max(valid_at) - F.min(valid_at)).alias("_run"),
        )
    )
    usable = (F.col("valid_sample_count") >= P.MIN_SLOPE_SAMPLES) & (F.col("_run") > 0)
    ratio = F.when(usable, F.col("_rise") / F.col("_run"))
    return out.select(
        "segment_id",
        "elevation_m",
        "min_elevation_m",
        "max_elevation_m",
        "sample_count",
        "valid_sample_count",
        F.degrees(F.atan(ratio)).alias("slope_deg"),
        (ratio * 100.0).alias("slope_percent"),
    )


def profile_segments(segments: DataFrame, grid: DataFrame, tile_samples: int = P.TILE_SAMPLES) -> DataFrame:
    samples = with_distance_along(terrain_samples(segments))
    return segment_terrain(sample_elevation(samples, grid, ["segment_id", "seq"], tile_samples))


def profile_from_blocks(segments: DataFrame, blocks: DataFrame, tile_samples: int = P.TILE_SAMPLES, intervals: int = P.TILE_BLOCK_INTERVALS) -> DataFrame:
    """Terrain of every segment from raster blocks, as read from tile files."""
    samples = with_distance_along(terrain_samples(segments))
    return segment_terrain(sample_blocks(samples, blocks, tile_samples, intervals))


def terrain_quality(segments: DataFrame) -> DataFrame:
    """One-row report: coverage, medians and implausible values.

    Elevations carry one decimal and slopes two, so the exact medians hold a bounded set of values.
    """
    n = F.count(F.lit(1))
    fallback = F.col("source")["elevation_m"].contains("fallback")
    low, high = P.PLAUSIBLE_ELEVATION_M
    return segments.agg(
        n.alias("total"),
        F.count("elevation_m").alias("with_elevation"),
        F.count("slope_deg").alias("with_slope"),
        F.count_if(F.col("source")["elevation_m"].startswith("real:")).alias("real_elevation"),
        F.count_if(fallback).alias("fallback_elevation"),
        round_dp(F.lit(100.0) * F.count("slope_deg") / n, 1).alias("slope_coverage_pct"),
        F.min("elevation_m").alias("min_elevation"),
        F.median("elevation_m").alias("median_elevation"),
        F.max("elevation_m").alias("max_elevation"),
        F.min("slope_deg").alias("min_slope"),
        F.median("slope_deg").alias("median_slope"),
        F.max("slope_deg").alias("max_slope"),
        F.count_if(~F.col("elevation_m").between(low, high)).alias("implausible_elevation"),
        F.count_if(F.col("slope_deg") > P.SUSPICIOUS_SLOPE_DEG).alias("suspicious_slope"),
    )


def nearest_segments_by_midpoint(places: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """The ``k`` segments whose midpoint is nearest to each named place, for any number of places."""
    mid = representative_point(F.col("geometry"))
    points = segments.select(F.col("segment_id").alias("id"), mid["lat"].alias("lat"), mid["lng"].alias("lng"))
    near = nearest_points(places.select(F.col("name").alias("qid"), "lat", "lng"), points, k)
    near = near.select(F.col("qid").alias("name"), F.col("id").alias("segment_id"), F.col("dist_km").alias("distance_km_to_place"), "rank")
    return near.join(segments.drop("name"), "segment_id")

"""Gridded rainfall: lattice matching, daily and yearly aggregates.

``rain`` is long: ``obs_date, lat, lng, rainfall_mm`` with NULL for a missing reading.
A missing reading and a place without coverage stay apart: neither is ever zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.risk import rain_factor
from tarmetric.functions.rounding import round_dp
from tarmetric.session import materialize


def _axis(rain: DataFrame, name: str) -> DataFrame:
    """bucket -> sorted lattice values in it and its two neighbours.

    Coordinates have two decimals, so an axis has at most 36,001 values and the table at most
    1,441 buckets: it may be broadcast.
    """
    values = rain.select(F.col(name).alias("v")).distinct()
    near = values.select("v", F.explode(F.array([F.floor(F.col("v") / P.RAIN_GRID_DEG) + F.lit(k) for k in (-1, 0, 1)])).alias("bucket"))
    return near.groupBy("bucket").agg(F.array_sort(F.collect_set("v")).alias("values"))


def _offset_from(x: Column) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))


def attach_lattice_cell(
    points: DataFrame, rain: DataFrame, lat: str = "lat", lng: str = "lng", max_deg: float = P.RAIN_MATCH_MAX_DEG
) -> DataFrame:
    """Append ``grid_lat, grid_lng``: the nearest lattice point within ``max_deg``, else NULL.

    The lattice is the product of its latitudes and longitudes, so each axis is matched alone
    (lowest value on a tie) and no point is shuffled.
    """
    out = points
    for axis, col in (("lat", lat), ("lng", lng)):
        table = _axis(rain, axis).withColumnRenamed("values", f"_{axis}s").withColumnRenamed("bucket", f"_{axis}_b")
        out = out.withColumn(f"_{axis}_b", F.floor(F.col(col) / P.RAIN_GRID_DEG)).join(F.broadcast(table), f"_{axis}_b", "left")
        values = F.col(f"_{axis}s")
        best = F.array_min(F.transform(values, _offset_from(F.col(col))))
        out = out.withColumn(f"_{axis}", best).drop(f"_{axis}s", f"_{axis}_b")
    away = F.sqrt(F.col("_lat.d") * F.col("_lat.d") + F.col("_lng.d") * F.col("_lng.d"))
    near = away <= max_deg
    return (
        out.withColumn("grid_lat", F.when(near, F.col("_lat.v")))
        .withColumn("grid_lng", F.when(near, F.col("_lng.v")))
        .drop("_lat", "_lng")
    )


def grid_key(degrees: Column) -> Column:
    """Lattice coordinate in hundredths of a degree, an exact integer join key."""
    return F.rint(degrees * 100).cast("int")


def daily_rainfall(points: DataFrame, rain: DataFrame, date: str = "obs_date", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rainfall at each point and date with a status: ok, missing_value or no_coverage.

    Points that already have ``grid_lat, grid_lng`` keep them: match places before they are multiplied by days.
    """
    cells = points if {"grid_lat", "grid_lng"} <= set(points.columns) else attach_lattice_cell(points, rain, lat, lng)
    loaded = rain.select(F.col("obs_date").alias("_date"), F.lit(True).alias("_loaded")).distinct()
    readings = rain.select(
        F.col("obs_date").alias("_date"), grid_key(F.col("lat")).alias("_gy"), grid_key(F.col("lng")).alias("_gx"), "rainfall_mm"
    )
    keyed = (
        cells.withColumn("_date", F.col(date)).withColumn("_gy", grid_key(F.col("grid_lat"))).withColumn("_gx", grid_key(F.col("grid_lng")))
    )
    # One row per calendar day: a bounded table.
    read = keyed.join(F.broadcast(loaded), "_date", "left").join(readings, ["_date", "_gy", "_gx"], "left")
    covered = F.col("_loaded").isNotNull() & F.col("grid_lat").isNotNull()
    status = F.when(~covered, "no_coverage").when(F.col("rainfall_mm").isNull(), "missing_value").otherwise("ok")
    return (
        read.withColumn("status", status)
        .withColumn("grid_lat", F.when(covered, F.col("grid_lat")))
        .withColumn("grid_lng", F.when(covered, F.col("grid_lng")))
        .withColumn("rainfall_mm", F.when(covered, F.col("rainfall_mm")))
        .withColumn("weather_factor", F.when(F.col("status") == "ok", rain_factor(F.col("rainfall_mm"))))
        .drop("_date", "_gy", "_gx", "_loaded")
    )


def segment_rainfall(segments: DataFrame, rain: DataFrame, date: Column) -> DataFrame:
    """Rainfall and factor for the representative point (``latm, lngm``) of every segment."""
    points = segments.select("segment_id", F.col("latm").alias("lat"), F.col("lngm").alias("lng"), date.alias("obs_date"))
    return daily_rainfall(points, rain)


def rain_context(segments: DataFrame, rain: DataFrame, date: Column) -> DataFrame:
    """Weather context of the segments with a real reading; the others are left out."""
    read = segment_rainfall(segments, rain, date)
    return read.filter(F.col("status") == "ok").select("segment_id", "weather_factor")


def nearest_annual_cell(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Nearest of the yearly-rainfall cells that exist, at any distance; ties to the lowest latitude, then longitude.

    Cells are filed in square buckets. A point sees its bucket and the eight around it; a cell within one
    bucket's side is then surely the nearest. Points without one go on with buckets twice as wide, so
    cells are found at any distance in a few rounds, and few points stay after the first. Equal places are
    matched once.
    """
    cells = materialize(cells.select("lat", "lng").where("lat is not null and lng is not null").distinct(), "annual-cells")
    places = points.select("lat", "lng").where("lat is not null and lng is not null").distinct()
    side, found = 2 * P.RAIN_GRID_DEG, None
    while side < 1024 and not cells.isEmpty():
        at = lambda c, k: F.floor(F.col(c) / F.lit(side)) + k  # noqa: E731, B023
        around = F.array(*[F.struct(at("lat", i).alias("_y"), at("lng", j).alias("_x")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        filed = cells.select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.inline(around))
        dy, dx = F.col("_lat") - F.col("lat"), F.col("_lng") - F.col("lng")
        near = places.withColumns({"_y": at("lat", 0), "_x": at("lng", 0)}).join(filed, ["_y", "_x"], "left")
        best = F.min(F.struct((dy * dy + dx * dx).alias("d"), F.col("_lat").alias("lat"), F.col("_lng").alias("lng"))).alias("best")
        tried = materialize(near.groupBy("lat", "lng").agg(best), "annual-nearest")
        sure = F.coalesce(F.col("best.d") <= side * side, F.lit(False))
        done = tried.where(sure).select("lat", "lng", F.col("best.lat").alias("grid_lat"), F.col("best.lng").alias("grid_lng"))
        found = done if found is None else found.unionByName(done)
        places = tried.where(~sure).select("lat", "lng")
        if places.isEmpty():
            break
        side *= 2
    if found is None:
        return points.withColumns({"grid_lat": F.lit(None).cast("double"), "grid_lng": F.lit(None).cast("double")})
    return points.join(found, ["lat", "lng"], "left").select(*points.columns, "grid_lat", "grid_lng")


def rainfall_inventory(rain: DataFrame) -> DataFrame:
    n, missing = F.count(F.lit(1)), F.count_if(F.col("rainfall_mm").isNull())
    return rain.agg(
        (F.count_distinct("lat") * F.count_distinct("lng")).alias("grid_cells"),
        n.alias("observations"),
        F.min("obs_date").alias("first_date"),
        F.max("obs_date").alias("last_date"),
        F.count_distinct("obs_date").alias("days"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lng").alias("min_lng"),
        F.max("lng").alias("max_lng"),
        missing.alias("missing"),
        round_dp(F.lit(100.0) * missing / n, 1).alias("missing_pct"),
    )


def daily_max(rain: DataFrame) -> DataFrame:
    """Highest reading of each day, NULL where every cell is missing."""
    return rain.groupBy("obs_date").agg(F.max("rainfall_mm").alias("max_mm"))


def wettest_days(rain: DataFrame, n: int = 5) -> DataFrame:
    return daily_max(rain).filter(F.col("max_mm").isNotNull()).orderBy(F.desc("max_mm"), F.desc("obs_date")).limit(n)


def cell_years(rain: DataFrame) -> DataFrame:
    """Yearly aggregates per cell; all NULL where a cell has no valid day in the year."""
    mm = F.col("rainfall_mm")
    first, last = P.MONSOON_MONTHS
    monsoon = F.month("obs_date").between(first, last)
    valid = F.count(mm)
    return rain.groupBy("lat", "lng", F.year("obs_date").alias("year")).agg(
        round_dp(F.sum(mm), 2).alias("annual_mm"),
        round_dp(F.sum(F.when(monsoon, mm)), 2).alias("monsoon_mm"),
        round_dp(F.max(mm), 2).alias("max_day_mm"),
        F.when(valid > 0, F.count_if(mm > P.RAINY_DAY_MM)).alias("rainy_days"),
        F.count_if(mm.isNull()).alias("missing_days"),
        F.count(F.lit(1)).alias("total_days"),
    )


def high_rain_segments(read: DataFrame, n: int = 20) -> DataFrame:
    """Top segments by weather factor at or above the threshold, with the total count."""
    high = read.filter(F.col("weather_factor") >= P.HIGH_RAIN_FACTOR)
    total = high.agg(F.count(F.lit(1)).alias("high_segment_count"))
    top = high.orderBy(F.desc("weather_factor"), "segment_id").limit(n)
    return top.crossJoin(F.broadcast(total))

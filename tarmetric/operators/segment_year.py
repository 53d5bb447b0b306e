"""Leakage-safe segment-year table: strict prior history, three-valued labels, rainfall columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarmetric import params as P
from tarmetric.functions.risk import rain_factor, score_struct
from tarmetric.functions.rounding import round_dp
from tarmetric.operators.rainfall import nearest_annual_cell


def segment_years(segments: DataFrame, years: DataFrame) -> DataFrame:
    """Every segment in every year. Years are calendar years: a bounded table."""
    return segments.crossJoin(F.broadcast(years.select("year").distinct()))


def yearly_events(events: DataFrame) -> DataFrame:
    """One row per segment and dated year: counts, nearest distance, label evidence."""
    return events.filter(F.col("year").isNotNull()).groupBy("segment_id", "year").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("distance_to_road_m").alias("nearest_m"),
        F.max(~F.col("is_negative")).alias("any_positive"),
        F.max("day_precise").alias("any_day_precise"),
    )


def prior_history(grid: DataFrame, yearly: DataFrame) -> DataFrame:
    """Count and nearest distance over events strictly before each grid year.

    Event years outside the grid take part in the window and are dropped afterwards. A segment
    has at most a few hundred calendar years, so the window stays small whatever the event count.
    """
    both = grid.select("segment_id", "year", F.lit(True).alias("_in")).unionByName(
        yearly.select("segment_id", "year", "n", "nearest_m"), allowMissingColumns=True
    )
    before = W.partitionBy("segment_id").orderBy("year").rangeBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("historical_landslide_count_prior", F.coalesce(F.sum("n").over(before), F.lit(0)))
    seen = seen.withColumn("nearest_historical_landslide_distance_m_prior", F.min("nearest_m").over(before))
    return seen.filter("_in").select(
        "segment_id", "year", "historical_landslide_count_prior", "nearest_historical_landslide_distance_m_prior"
    )


def label_status(n: Column, any_positive: Column) -> Column:
    return F.when(any_positive, "event").when(n > 0, "non_event_documented").otherwise("unobserved")


def label_value(status: Column) -> Column:
    """1 for an event, 0 for a documented non-event, NULL (never 0) when unobserved."""
    return F.when(status == "event", F.lit(1.0)).when(status == "non_event_documented", F.lit(0.0))


def build_dataset(segments: DataFrame, events: DataFrame, cell_year: DataFrame, years: DataFrame) -> DataFrame:
    """The segment-year table.

    ``segments``: ``segment_id, road_type, terrain_type, distance_km, slope_deg, elevation_m,
    landslide_hazard_score, lat, lng`` (representative point).
    """
    grid = segment_years(segments, years)
    yearly = yearly_events(events)
    undated = events.filter(F.col("year").isNull()).groupBy("segment_id").agg(F.count(F.lit(1)).alias("_undated"))
    cells = nearest_annual_cell(segments.select("segment_id", "lat", "lng"), cell_year.select("lat", "lng"))
    rain = cell_year.select(
        F.col("lat").alias("grid_lat"), F.col("lng").alias("grid_lng"), "year",
        "annual_mm", "monsoon_mm", "max_day_mm", "rainy_days", "missing_days",
    )
    out = (
        grid.join(prior_history(grid, yearly), ["segment_id", "year"])
        .join(yearly.select("segment_id", "year", "n", "any_positive", "any_day_precise"), ["segment_id", "year"], "left")
        .join(undated, "segment_id", "left")
        .join(cells.select("segment_id", "grid_lat", "grid_lng"), "segment_id", "left")
        .join(rain, ["grid_lat", "grid_lng", "year"], "left")
    )
    status = label_status(F.col("n"), F.col("any_positive"))
    return out.select(
        "segment_id",
        "year",
        "road_type",
        "terrain_type",
        "distance_km",
        "slope_deg",
        "elevation_m",
        "landslide_hazard_score",
        "historical_landslide_count_prior",
        "nearest_historical_landslide_distance_m_prior",
        F.coalesce("_undated", F.lit(0)).alias("undated_historical_match_count"),
        F.col("grid_lat").alias("rainfall_grid_lat"),
        F.col("grid_lng").alias("rainfall_grid_lon"),
        F.col("annual_mm").alias("annual_rainfall_mm"),
        F.col("monsoon_mm").alias("monsoon_jun_sep_rainfall_mm"),
        F.col("max_day_mm").alias("max_daily_rainfall_mm"),
        F.col("rainy_days").alias("rainy_days_count"),
        F.col("missing_days").alias("rainfall_missing_days"),
        F.coalesce("n", F.lit(0)).alias("event_report_count"),
        F.coalesce("any_day_precise", F.lit(False)).alias("event_day_precision"),
        status.alias("label_status"),
        label_value(status).alias("label"),
    )


def dataset_audit(dataset: DataFrame) -> DataFrame:
    """One-row coverage audit."""
    n = F.count(F.lit(1))
    event = F.col("label_status") == "event"
    shape = F.count_distinct("segment_id") * F.count_distinct("year")
    return dataset.agg(
        n.alias("rows"),
        F.count_distinct("segment_id").alias("segments"),
        F.count_distinct("year").alias("years"),
        (n == shape).alias("full_grid"),
        F.count_if(event).alias("event_rows"),
        F.count_if(F.col("label_status") == "non_event_documented").alias("non_event_rows"),
        F.count_if(F.col("label_status") == "unobserved").alias("unobserved_rows"),
        round_dp(F.lit(100.0) * F.count_if(event) / n, 3).alias("event_pct"),
        F.count_distinct(F.when(event, F.col("segment_id"))).alias("event_segments"),
        F.count_if(event & F.col("event_day_precision")).alias("day_precise_events"),
        F.count_if(F.col("historical_landslide_count_prior") > 0).alias("rows_with_history"),
        F.count_distinct(F.when(F.col("undated_historical_match_count") > 0, F.col("segment_id"))).alias("undated_segments"),
        F.count_if(F.col("rainfall_missing_days") > 0).alias("rows_with_missing_rain"),
    )


STATUSES = ["event", "non_event_documented", "unobserved"]


def status_by_year(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("year").pivot("label_status", STATUSES).count().fillna(0)


def baseline_scores(dataset: DataFrame) -> DataFrame:
    """Rule-based score from the prior-cutoff history and the year's wettest day."""
    risk = score_struct(
        F.col("slope_deg"),
        F.col("historical_landslide_count_prior"),
        F.col("nearest_historical_landslide_distance_m_prior"),
        F.col("landslide_hazard_score"),
        rain_factor(F.col("max_daily_rainfall_mm")),
        F.lit(None).cast("double"),
    )
    return dataset.withColumn("score", risk["risk_score"])


def way_group(segment_id: Column) -> Column:
    """Way id of ``seg_<way>_<run>``, else the segment id itself."""
    way = F.regexp_extract(segment_id, r"^seg_(\d+)_\d+$", 1)
    return F.coalesce(F.nullif(way, F.lit("")), segment_id)


NUMERIC_FEATURES = [
    "distance_km",
    "slope_deg",
    "elevation_m",
    "historical_landslide_count_prior",
    "nearest_historical_landslide_distance_m_prior",
    "has_prior_history",
]
RAIN_FEATURES = ["annual_rainfall_mm", "monsoon_jun_sep_rainfall_mm", "max_daily_rainfall_mm", "rainy_days_count"]
CATEGORIES = {"road_type": sorted(P.ROAD_CLASS_SPEED), "terrain_type": sorted(P.TERRAIN_BASE_RISK)}


def feature_names(with_rain: bool, categories: dict[str, list[str]] | None = None) -> list[str]:
    """Ordered feature names: numeric, rainfall, then one-hot by sorted category."""
    chosen = categories or CATEGORIES
    onehot = [f"{c}_{v}" for c in ("road_type", "terrain_type") for v in chosen[c]]
    return NUMERIC_FEATURES + (RAIN_FEATURES if with_rain else []) + onehot


def observed_categories(dataset: DataFrame) -> dict[str, list[str]]:
    """Categories present in the data. The two enums have nine and three values: a bounded result."""
    row = dataset.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in CATEGORIES]).first()
    return {c: list(row[c]) for c in CATEGORIES}


def feature_columns(dataset: DataFrame, with_rain: bool, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Numeric features, sentinel distance, history flag and one-hot columns next to the keys."""
    chosen = categories or CATEGORIES
    out = dataset.withColumn("has_prior_history", (F.col("historical_landslide_count_prior") > 0).cast("int"))
    out = out.withColumn(
        "nearest_historical_landslide_distance_m_prior",
        F.coalesce("nearest_historical_landslide_distance_m_prior", F.lit(P.NO_HISTORY_DISTANCE_M)),
    )
    onehot = [F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{c}_{v}") for c in ("road_type", "terrain_type") for v in chosen[c]]
    numeric = NUMERIC_FEATURES + (RAIN_FEATURES if with_rain else [])
    event = (F.col("label_status") == "event").cast("int")
    return out.select(
        "segment_id", "year", "label_status", "terrain_type", way_group(F.col("segment_id")).alias("way_group"),
        event.alias("is_event"), *numeric, *onehot,
    )


def schema_fingerprint(names: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the ordered names joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", names), 256), 1, 16)

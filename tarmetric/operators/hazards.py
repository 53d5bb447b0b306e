"""Hazard events, their lifecycle and the per-segment context they create.

Event tables are long: one row per hazard and affected segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.risk import lookup, lookup_or_fail, score_struct


def weather_factor(hazard_type: Column, severity: Column) -> Column:
    return F.when(hazard_type == "heavy_rain", lookup_or_fail(severity, P.WEATHER_SEVERITY_FACTOR, "severity"))


def incident_factor(hazard_type: Column, severity: Column) -> Column:
    return F.when(hazard_type != "heavy_rain", lookup_or_fail(severity, P.INCIDENT_SEVERITY_FACTOR, "severity"))


def closes_road(hazard_type: Column, severity: Column) -> Column:
    return hazard_type.isin(P.CLOSURE_TYPES) & (severity == P.CLOSURE_SEVERITY)


def build_hazards(events: DataFrame) -> DataFrame:
    """Attach the factor each hazard feeds (weather or incident, never both) and its closure flag."""
    kind, severity = F.col("type"), F.col("severity")
    return (
        events.withColumn("weather_factor", weather_factor(kind, severity))
        .withColumn("incident_factor", incident_factor(kind, severity))
        .withColumn("is_closure", closes_road(kind, severity))
    )


def unknown_severities(events: DataFrame) -> DataFrame:
    return events.filter(lookup(F.col("severity"), P.INCIDENT_SEVERITY_FACTOR).isNull())


def active_at(events: DataFrame, as_of: Column, opened: str = "created_at", closed: str = "cleared_at") -> DataFrame:
    """Rows open at ``as_of``: created by then and not cleared by then."""
    return events.filter((F.col(opened) <= as_of) & (F.col(closed).isNull() | (F.col(closed) > as_of)))


def first_clear(events: DataFrame, clears: DataFrame, key: str = "hazard_id") -> DataFrame:
    """Join clear events; repeated clears change nothing because the first one counts."""
    first = clears.groupBy(key).agg(F.min("cleared_at").alias("cleared_at"))
    return events.drop("cleared_at").join(first, key, "left")


def segment_context(active: DataFrame) -> DataFrame:
    """Worst weather, worst incident and closure per segment over the active hazards."""
    return active.groupBy("segment_id").agg(
        F.max("weather_factor").alias("weather_factor"),
        F.max("incident_factor").alias("incident_factor"),
        F.max("is_closure").alias("closed"),
    )


def split_unknown_segments(events: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a hazard with any unknown segment, or none at all, is rejected whole."""
    ids = segments.select("segment_id", F.lit(True).alias("_known"))
    checked = events.join(ids, "segment_id", "left")
    bad = checked.filter(F.col("_known").isNull())
    rejected = bad.groupBy("hazard_id").agg(
        F.array_sort(F.collect_set("segment_id")).alias("unknown_segment_ids")
    )
    accepted = events.join(rejected, "hazard_id", "left_anti")
    return accepted, rejected


def overlay_context(segments: DataFrame, context: DataFrame, weather: float | None = None, incident: float | None = None) -> DataFrame:
    """Per-segment factors; the context overrides the uniform value where it has one."""
    ctx = context.select(
        "segment_id",
        F.col("weather_factor").alias("_w"),
        F.col("incident_factor").alias("_i"),
        F.col("closed").alias("_c"),
    )
    out = segments.join(ctx, "segment_id", "left")
    return (
        out.withColumn("weather_factor", F.coalesce("_w", F.lit(weather).cast("double")))
        .withColumn("incident_factor", F.coalesce("_i", F.lit(incident).cast("double")))
        .withColumn("closed", F.coalesce("_c", F.lit(False)))
        .drop("_w", "_i", "_c")
    )


def score_segments(segments: DataFrame) -> DataFrame:
    """Append the score struct fields; needs slope, history, zonation and factor columns."""
    risk = score_struct(
        F.col("slope_deg"),
        F.col("historical_landslide_count"),
        F.col("nearest_landslide_distance_m"),
        F.col("landslide_hazard_score"),
        F.col("weather_factor"),
        F.col("incident_factor"),
    )
    return segments.withColumn("_risk", risk).select("*", "_risk.*").drop("_risk")

"""Explainable risk score as column expressions over ``segment LEFT JOIN context``."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tarmetric import params as P
from tarmetric.functions.geo import ladder
from tarmetric.functions.rounding import clamp01, round_dp
from tarmetric.functions.text import stripped


def lookup(key: Column, table: dict[str, float]) -> Column:
    """Map literal lookup on the trimmed, lower-cased key; NULL for an unknown key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(stripped(key)))


def lookup_or_fail(key: Column, table: dict[str, float], what: str) -> Column:
    """Like :func:`lookup`, but an unknown non-null key stops the job."""
    found = lookup(key, table)
    message = F.concat(F.lit(f"unknown {what}: "), key)
    return F.when(key.isNotNull() & found.isNull(), F.raise_error(message).cast("double")).otherwise(found)


def terrain_class(elevation_m: Column) -> Column:
    return (
        F.when(elevation_m < P.TERRAIN_PLAIN_BELOW_M, "plain")
        .when(elevation_m < P.TERRAIN_HILL_BELOW_M, "hill")
        .when(elevation_m.isNotNull(), "mountain")
    )


def base_risk(terrain: Column, landslide_susceptibility: Column, flood_susceptibility: Column) -> Column:
    raw = (
        lookup(terrain, P.TERRAIN_BASE_RISK)
        + P.LANDSLIDE_SUSCEPTIBILITY_WEIGHT * landslide_susceptibility
        + P.FLOOD_SUSCEPTIBILITY_WEIGHT * flood_susceptibility
    )
    return round_dp(F.least(F.lit(1.0), raw), 3)


def slope_risk(slope_deg: Column) -> Column:
    span = P.SLOPE_FULL_DEG - P.SLOPE_ZERO_DEG
    return F.when(slope_deg.isNull(), F.lit(0.0)).otherwise(clamp01((slope_deg - P.SLOPE_ZERO_DEG) / span))


def history_risk(count: Column, nearest_m: Column, zonation_score: Column) -> Column:
    """Log-scaled count blended with proximity, then the maximum with the zonation score."""
    by_count = F.least(F.lit(1.0), F.log1p(count.cast("double")) / math.log1p(P.HISTORY_COUNT_FULL))
    by_distance = F.coalesce(clamp01(1.0 - nearest_m / P.HISTORY_PROXIMITY_M), F.lit(0.0))
    blended = clamp01(P.HISTORY_COUNT_SHARE * by_count + (1.0 - P.HISTORY_COUNT_SHARE) * by_distance)
    observed = F.when(count > 0, blended).otherwise(F.lit(0.0))
    return F.greatest(observed, F.coalesce(zonation_score, F.lit(0.0)))


def factor_risk(factor: Column) -> Column:
    """Weather or incident contribution: a missing factor adds nothing."""
    return F.coalesce(clamp01(factor), F.lit(0.0))


def risk_level(score: Column) -> Column:
    return ladder(score, P.RISK_LEVELS)


def hazard_level(score: Column) -> Column:
    return ladder(score, P.HAZARD_LEVELS)


def class_score(hazard_class: Column) -> Column:
    return lookup(hazard_class, P.HAZARD_CLASS_SCORE)


def ml_tier(score: Column) -> Column:
    return ladder(score, {**P.ML_TIERS, "Low": float("-inf")})


def rain_factor(mm: Column) -> Column:
    """Piecewise linear rainfall to weather factor; NULL stays NULL, 4 decimals."""
    out = F.when(mm <= 0, F.lit(0.0))
    for (x0, y0), (x1, y1) in zip(P.RAIN_ANCHORS, P.RAIN_ANCHORS[1:]):
        out = out.when(mm <= x1, round_dp(y0 + (mm - x0) / (x1 - x0) * (y1 - y0), 4))
    return out.when(mm.isNotNull(), F.lit(1.0))


def score_struct(
    slope_deg: Column,
    count: Column,
    nearest_m: Column,
    zonation_score: Column,
    weather_factor: Column,
    incident_factor: Column,
) -> Column:
    """STRUCT of the score, its level and the rounded components.

    The score uses the unrounded components.
    """
    s = slope_risk(slope_deg)
    h = history_risk(count, nearest_m, zonation_score)
    w = factor_risk(weather_factor)
    i = factor_risk(incident_factor)
    raw = P.TERRAIN_WEIGHT * s + P.HISTORICAL_WEIGHT * h + P.WEATHER_WEIGHT * w + P.INCIDENT_WEIGHT * i
    score = round_dp(clamp01(raw), 4)
    return F.struct(
        score.alias("risk_score"),
        risk_level(score).alias("risk_level"),
        round_dp(s, 4).alias("slope_risk"),
        round_dp(h, 4).alias("historical_landslide_risk"),
        round_dp(w, 4).alias("weather_risk"),
        round_dp(i, 4).alias("incident_risk"),
    )


def reasons(
    slope_deg: Column,
    count: Column,
    nearest_m: Column,
    zone_class: Column,
    zone_score: Column,
    zone_source: Column,
    weather_factor: Column,
    incident_factor: Column,
    risk: Column,
) -> Column:
    """Ordered plain-language reasons; entries that do not apply are left out."""
    s, w, i = risk["slope_risk"], risk["weather_risk"], risk["incident_risk"]
    slope_text = (
        F.when(slope_deg.isNull(), "Slope data unavailable, no terrain contribution applied")
        .when(s >= 0.5, F.format_string("High slope exposure (%.1f deg)", slope_deg))
        .when(s > 0, F.format_string("Moderate slope exposure (%.1f deg)", slope_deg))
        .otherwise(F.format_string("Low slope exposure (%.1f deg)", slope_deg))
    )
    plural = F.when(count == 1, "observation").otherwise("observations")
    near = F.when(nearest_m.isNotNull(), F.format_string(", nearest %.0fm away", nearest_m)).otherwise("")
    history_text = F.when(
        count > 0,
        F.concat(count.cast("string"), F.lit(" historical landslide "), plural, F.lit(" matched"), near),
    ).otherwise("No matched historical landslide observation (data coverage, not a confirmed absence)")
    zone_text = F.when(
        zone_score.isNotNull(),
        F.concat(
            F.lit("Landslide zonation: "),
            F.coalesce(zone_class, F.lit("unknown")),
            F.format_string(" (score=%.2f, source=", zone_score),
            F.coalesce(zone_source, F.lit("unknown")),
            F.lit(")"),
        ),
    ).otherwise("No landslide zonation coverage, historical evidence only")
    weather_text = F.when(w > 0, F.format_string("Elevated weather risk (factor=%.2f)", weather_factor)).when(
        weather_factor.isNull(), "No weather context supplied (not confirmed clear weather)"
    )
    incident_text = F.when(i > 0, F.format_string("Active incident contribution (factor=%.2f)", incident_factor))
    score_text = F.format_string("Risk score: %.2f (rule-based estimate, not a probability)", round_dp(risk["risk_score"], 2))
    return F.array_compact(
        F.array(slope_text, history_text, zone_text, weather_text, incident_text, score_text)
    )


def input_metadata(fields: dict[str, Column]) -> Column:
    """MAP of the score inputs as text, empty string for NULL."""
    pairs = [x for k, c in fields.items() for x in (F.lit(k), F.coalesce(c.cast("string"), F.lit("")))]
    return F.create_map(*pairs)

"""Hazard-zonation polygons: class check, point lookup, segment sampling.

``polygons``: ``polygon_id, hazard_class, ring``. No coverage is a status of its own, never "low".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.geo import edges_of, interpolate_along
from tarmetric.functions.risk import class_score, hazard_level, lookup_or_fail
from tarmetric.functions.rounding import round_dp
from tarmetric.operators.gridjoin import containing_polygons
from tarmetric.session import materialize


def unknown_classes(polygons: DataFrame) -> DataFrame:
    """Class values outside the vocabulary; a loadable layer returns no rows."""
    return polygons.filter(class_score(F.col("hazard_class")).isNull()).groupBy("hazard_class").count()


def scored_layer(polygons: DataFrame) -> DataFrame:
    """Polygons with their score; an unknown class stops the job."""
    return polygons.withColumn("hazard_score", lookup_or_fail(F.col("hazard_class"), P.HAZARD_CLASS_SCORE, "hazard class"))


def point_zone(points: DataFrame, polygons: DataFrame, key: list[str]) -> DataFrame:
    """Highest-scoring polygon that contains each point, else no_coverage.

    On equal scores the lowest polygon id gives the class.
    """
    hits = containing_polygons(points.select(*key, "lat", "lng"), scored_layer(polygons))
    best = hits.groupBy(*key).agg(
        F.max_by(F.struct("hazard_class", "hazard_score"), F.struct("hazard_score", -F.col("polygon_id"))).alias("_z")
    )
    out = points.join(best, key, "left")
    return (
        out.withColumn("status", F.when(F.col("_z").isNull(), "no_coverage").otherwise("ok"))
        .withColumn("hazard_class", F.col("_z.hazard_class"))
        .withColumn("hazard_score", round_dp(F.col("_z.hazard_score"), 4))
        .withColumn("hazard_level", hazard_level(F.col("hazard_score")))
        .drop("_z")
    )


def segment_samples(segments: DataFrame) -> DataFrame:
    """Five points along every segment: ``segment_id, frac, lat, lng``."""
    fractions = F.explode(F.array(*[F.lit(f) for f in P.ZONE_SAMPLE_FRACTIONS]))
    cut = segments.select("segment_id", "geometry", "distance_km", edges_of(F.col("geometry")).alias("_edges"))
    spread = cut.select("segment_id", "geometry", "distance_km", "_edges", fractions.alias("frac"))
    spot = interpolate_along(F.col("geometry"), F.col("frac") * F.col("distance_km"), F.col("_edges"))
    return spread.withColumn("_p", spot).select("segment_id", "frac", F.col("_p.lat").alias("lat"), F.col("_p.lng").alias("lng"))


def segment_zone(samples: DataFrame, polygons: DataFrame) -> DataFrame:
    """Highest class over the covered samples of each segment (first sample on a tie)."""
    sampled = point_zone(samples, polygons, ["segment_id", "frac"])
    best = F.max_by(F.struct("hazard_class", "hazard_score"), F.struct("hazard_score", -F.col("frac")))
    rows = sampled.groupBy("segment_id").agg(
        best.alias("_z"), F.count_if(F.col("status") == "ok").alias("covered_samples")
    )
    covered = F.col("covered_samples") > 0
    return rows.select(
        "segment_id",
        F.when(covered, "ok").otherwise("no_coverage").alias("status"),
        F.when(covered, F.col("_z.hazard_class")).alias("hazard_class"),
        F.when(covered, F.col("_z.hazard_score")).alias("hazard_score"),
        F.when(covered, hazard_level(F.col("_z.hazard_score"))).alias("hazard_level"),
        "covered_samples",
    )


def segment_zones(segments: DataFrame, landslide_polygons: DataFrame, flood_polygons: DataFrame) -> DataFrame:
    """Landslide and flood zonation side by side; the two layers are independent."""
    def named(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            "segment_id",
            F.col("hazard_class").alias(f"{kind}_hazard_class"),
            F.col("hazard_score").alias(f"{kind}_hazard_score"),
            F.col("status").alias(f"{kind}_hazard_status"),
        )

    # Both layers read the same points; they are interpolated once.
    samples = materialize(segment_samples(segments), "zone-samples")
    slides = named(segment_zone(samples, landslide_polygons), "landslide")
    floods = named(segment_zone(samples, flood_polygons), "flood")
    return slides.join(floods, "segment_id")


def layer_coverage(zones: DataFrame) -> DataFrame:
    return zones.agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count("landslide_hazard_score").alias("landslide_covered"),
        F.count("flood_hazard_score").alias("flood_covered"),
    )


def uncovered_ids(current: DataFrame, features: DataFrame, key: str = "segment_id") -> DataFrame:
    """Current ids without a feature row."""
    return current.select(key).join(features.select(key), key, "left_anti")


def merge_features(current: DataFrame, features: DataFrame, columns: list[str], key: str = "segment_id") -> DataFrame:
    """Overlay non-null feature values, but only when the features cover every current row.

    Stale features (any current id missing) leave the table as it is. The coverage count is one
    row in the same plan, not a driver action.
    """
    gap = uncovered_ids(current, features, key).agg(F.count(F.lit(1)).alias("_missing"))
    renamed = features.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = current.join(renamed, key, "left").crossJoin(F.broadcast(gap))
    for c in columns:
        fresh = F.when(F.col("_missing") == 0, F.col(f"_{c}"))
        out = out.withColumn(c, F.coalesce(fresh, F.col(c)) if c in current.columns else fresh)
    return out.drop("_missing", *[f"_{c}" for c in columns])

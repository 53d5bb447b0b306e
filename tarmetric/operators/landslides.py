"""Landslide inventory matched to roads, aggregated and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.rounding import round_dp
from tarmetric.functions.text import district, event_year, is_day_precise, is_negative_observation, movement_type
from tarmetric.operators.gridjoin import nearest_edges
from tarmetric.operators.network import in_box


def match_to_segments(inventory: DataFrame, edges: DataFrame, attributes: DataFrame, threshold_m: float = P.LANDSLIDE_MATCH_M) -> DataFrame:
    """Every record with its true distance; segment attributes only within the threshold.

    ``attributes``: ``segment_id, name, road_type``.
    """
    near = nearest_edges(inventory, edges, threshold_m)
    meters = round_dp(F.col("nearest_km") * 1000.0, 2)
    matched = meters <= threshold_m
    tagged = (
        near.withColumn("distance_to_road_m", meters)
        .withColumn("matched_segment_id", F.when(matched, F.col("nearest_id")))
        .withColumn("match_status", F.when(matched, "MATCHED").otherwise("UNMATCHED"))
        .drop("nearest_id", "nearest_km", "nearest_lat", "nearest_lng")
    )
    names = attributes.select(
        F.col("segment_id").alias("matched_segment_id"),
        F.col("name").alias("matched_road_name"),
        F.col("road_type").alias("matched_highway_class"),
    )
    return tagged.join(names, "matched_segment_id", "left")


def segment_history(matched: DataFrame, segments: DataFrame) -> DataFrame:
    """Count (0 if none, no deduplication) and nearest distance (NULL if none) per segment."""
    hits = (
        matched.filter(F.col("match_status") == "MATCHED")
        .groupBy(F.col("matched_segment_id").alias("segment_id"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("distance_to_road_m").alias("nearest_landslide_distance_m"))
    )
    return segments.select("segment_id").join(hits, "segment_id", "left").select(
        "segment_id", F.coalesce("_n", F.lit(0)).alias("historical_landslide_count"), "nearest_landslide_distance_m"
    )


def validate_matches(matched: DataFrame, segments: DataFrame, main_nodes: DataFrame, box: DataFrame) -> DataFrame:
    """District, movement type, box test and three-valued geographic consistency."""
    on_main = main_nodes.select("node_id", F.lit(True).alias("_main"))
    ends = segments.select(F.col("segment_id").alias("matched_segment_id"), "from_node_id", "to_node_id")
    ends = (
        ends.join(on_main.withColumnRenamed("node_id", "from_node_id").withColumnRenamed("_main", "_f"), "from_node_id", "left")
        .join(on_main.withColumnRenamed("node_id", "to_node_id").withColumnRenamed("_main", "_t"), "to_node_id", "left")
        .select("matched_segment_id", (F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("_ends_on_main"))
    )
    boxed = matched.crossJoin(F.broadcast(box)).withColumn("within_network_bbox", in_box(F.col("latitude"), F.col("longitude")))
    out = boxed.drop("min_lat", "max_lat", "min_lng", "max_lng").join(ends, "matched_segment_id", "left")
    consistent = F.when(F.col("match_status") == "MATCHED", F.col("within_network_bbox") & F.coalesce("_ends_on_main", F.lit(False)))
    return (
        out.withColumn("district", district(F.col("description_before_coordinates")))
        .withColumn("movement_type", movement_type(F.col("description_after_coordinates")))
        .withColumn("geographically_consistent", consistent)
        .drop("_ends_on_main")
    )


def match_summary(validated: DataFrame, history: DataFrame) -> DataFrame:
    hit = F.col("match_status") == "MATCHED"
    inside = F.col("within_network_bbox")
    n = F.count(F.lit(1))
    records = validated.agg(
        n.alias("total"),
        F.count_if(hit).alias("matched"),
        F.count_if(~hit).alias("unmatched"),
        F.coalesce(round_dp(F.try_divide(F.lit(100.0) * F.count_if(hit), n), 1), F.lit(0.0)).alias("match_rate_pct"),
        F.count_if(inside).alias("in_bbox"),
        F.count_if(hit & ~inside).alias("matched_outside_bbox"),
        F.count_if(~hit & inside).alias("unmatched_inside_bbox"),
    )
    roads = history.agg(
        F.count_if(F.col("historical_landslide_count") >= 1).alias("segments_with_landslide"),
        F.max("historical_landslide_count").alias("max_per_segment"),
    )
    return records.crossJoin(F.broadcast(roads))


def match_frequencies(validated: DataFrame) -> DataFrame:
    """Matched records by district, road label and movement type in one pass (grouping sets)."""
    unnamed = F.concat(F.lit("(unnamed "), F.col("matched_highway_class"), F.lit(")"))
    rows = validated.filter(F.col("match_status") == "MATCHED").select(
        "district", F.coalesce("matched_road_name", unnamed).alias("road"), "movement_type"
    )
    sets = rows.groupingSets([["district"], ["road"], ["movement_type"]], "district", "road", "movement_type").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("records")
    )
    kind = F.when(F.col("_g") == 3, "district").when(F.col("_g") == 5, "road").otherwise("movement_type")
    return sets.select(
        kind.alias("breakdown"), F.coalesce("district", "road", "movement_type").alias("label"), "records"
    )


def distance_distribution(matched: DataFrame) -> DataFrame:
    """Minimum, median, maximum and counts within 50, 100 and 500 m of the matched records.

    Matched distances carry two decimals up to the threshold, so the exact median keeps at most
    50,001 distinct values.
    """
    d = F.col("distance_to_road_m")
    return matched.filter(F.col("match_status") == "MATCHED").agg(
        F.min(d).alias("min_m"),
        F.median(d).alias("median_m"),
        F.max(d).alias("max_m"),
        F.count_if(d <= 50).alias("within_50m"),
        F.count_if(d <= 100).alias("within_100m"),
        F.count_if(d <= 500).alias("within_500m"),
    )


def closest_matches(matched: DataFrame, n: int = 10) -> DataFrame:
    return matched.filter(F.col("match_status") == "MATCHED").orderBy("distance_to_road_m", "slide_no").limit(n)


def landslide_events(matched: DataFrame) -> DataFrame:
    """Event index of the matched records: year, date precision and the negative-observation flag."""
    return matched.filter(F.col("match_status") == "MATCHED").select(
        "slide_no",
        F.col("matched_segment_id").alias("segment_id"),
        event_year(F.col("description_after_coordinates"), F.col("slide_id")).alias("year"),
        is_day_precise(F.col("description_after_coordinates")).alias("day_precise"),
        "distance_to_road_m",
        is_negative_observation(F.col("raw_record")).alias("is_negative"),
    )

"""Fastest against risk-aware routes, and continue / reroute / suspend decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarmetric import params as P
from tarmetric.functions.rounding import round_dp

OD = ["origin", "destination"]
SUMMARY = ["node_path", "estimated_travel_time_min", "total_distance_km", "aggregate_risk_score", "max_segment_risk", "unsafe_segment_count"]


def _named(summary: DataFrame, prefix: str, key: list[str] = OD) -> DataFrame:
    return summary.select(*key, *[F.col(c).alias(f"{prefix}_{c}") for c in SUMMARY])


def compare_routes(pairs: DataFrame, fastest: DataFrame, safe: DataFrame, key: list[str] = OD) -> DataFrame:
    """One row per pair (or other ``key`` of the three tables): outcome, chosen route and the difference in minutes.

    ``fastest`` and ``safe`` are route summaries under the same context. A pair with no road at
    all is reported as ``no_route``; a road without a safe path as ``no_safe_route_available``.
    """
    out = pairs.select(*key).join(_named(fastest, "fastest", key), key, "left").join(_named(safe, "safe", key), key, "left")
    same = F.col("safe_node_path") == F.col("fastest_node_path")
    outcome = (
        F.when(F.col("fastest_node_path").isNull(), "no_route")
        .when(F.col("safe_node_path").isNull(), "no_safe_route_available")
        .when(same, "fastest_route_is_safe")
        .otherwise("safer_route_selected")
    )
    out = out.withColumn("outcome", outcome)
    for c in SUMMARY:
        out = out.withColumn(f"recommended_{c}", F.col(f"safe_{c}"))
    extra = F.col("safe_estimated_travel_time_min") - F.col("fastest_estimated_travel_time_min")
    reason = (
        F.when(F.col("outcome") == "no_route", "No road connects the two places")
        .when(F.col("outcome") == "no_safe_route_available", F.format_string(
            "Every path has a segment at or above %.2f or closed", F.lit(P.HARD_UNSAFE_SCORE)))
        .when(F.col("outcome") == "fastest_route_is_safe", "The fastest route is also the risk-aware choice")
        .when(F.col("fastest_unsafe_segment_count") > 0, F.format_string(
            "The fastest route has %d unsafe segment(s)", F.col("fastest_unsafe_segment_count")))
        .otherwise("A real alternative has a lower risk-weighted cost")
    )
    return (
        out.withColumn("extra_minutes", round_dp(extra, 1))
        .withColumn("fastest_has_unsafe", F.col("fastest_unsafe_segment_count") > 0)
        .withColumn("reason", reason)
        .drop(*[f"safe_{c}" for c in SUMMARY])
    )


def decide(comparison: DataFrame, previous: DataFrame, margin: float = P.HYSTERESIS_SCORE, key: list[str] = OD) -> DataFrame:
    """Decision ladder of a new comparison against the route a pair already follows.

    ``previous`` is a route summary profiled under the new context; a pair without a row there
    has no previous route.
    """
    out = comparison.join(_named(previous, "previous", key), key, "left")
    # Scores carry four decimals; the difference is taken in whole ten-thousandths.
    gain = F.rint((F.col("previous_aggregate_risk_score") - F.col("recommended_aggregate_risk_score")) * 10_000)
    infeasible = F.col("previous_unsafe_segment_count") > 0
    unchanged = F.col("previous_node_path") == F.col("recommended_node_path")
    step = (
        F.when(F.col("outcome") == "no_route", "no_route")
        .when(F.col("outcome") == "no_safe_route_available", "suspend")
        .when(F.col("previous_node_path").isNull(), "accept")
        .when(unchanged, "unchanged")
        .when(infeasible, "infeasible")
        .when(gain < margin * 10_000, "hysteresis")
        .otherwise("safer")
    )
    out = out.withColumn("decision_rule", step)
    rule = F.col("decision_rule")
    decision = (
        F.when(rule == "no_route", "no_route")
        .when(rule == "suspend", "suspend")
        .when(rule.isin("infeasible", "safer"), "reroute")
        .otherwise("continue")
    )
    out = out.withColumn("decision", decision)
    keeps = rule.isin("unchanged", "hysteresis")
    eta = F.col("recommended_estimated_travel_time_min") - F.col("previous_estimated_travel_time_min")
    return out.withColumn("eta_change_min", F.when(keeps, F.lit(0.0)).when(F.col("decision") == "reroute", round_dp(eta, 1))).withColumn(
        "decided_node_path",
        F.when(keeps, F.col("previous_node_path")).when(F.col("decision").isin("continue", "reroute"), F.col("recommended_node_path")),
    )


def affected_segments(active: DataFrame) -> DataFrame:
    """Network-wide segments under an active hazard with the number of hazards on each."""
    return active.groupBy("segment_id").agg(F.count_distinct("hazard_id").alias("active_hazards"))


def attach_hazards(decisions: DataFrame, active: DataFrame) -> DataFrame:
    """How many segments and hazards were in force for each decision.

    The lists themselves belong to the evaluation, not to a pair: they stay a table
    (:func:`affected_segments`) instead of one long value repeated on every row.
    """
    totals = active.agg(
        F.count_distinct("segment_id").alias("affected_segments"), F.count_distinct("hazard_id").alias("active_hazards")
    )
    return decisions.crossJoin(F.broadcast(totals))


def route_hazards(legs: DataFrame, active: DataFrame) -> DataFrame:
    """``graph, origin, destination, hazard_id``: the active hazards on the segments of each route."""
    return legs.select("graph", *OD, "segment_id").join(active.select("segment_id", "hazard_id"), "segment_id").select("graph", *OD, "hazard_id").distinct()


def corridor_pairs(places: DataFrame, position: str, node: str = "node_id") -> DataFrame:
    """Consecutive pairs of an ordered list of places (a short reference list)."""
    order = W.orderBy(position)
    pairs = places.select(
        F.col(position).alias("leg_no"), F.col(node).alias("origin"), F.lead(node).over(order).alias("destination")
    )
    return pairs.filter(F.col("destination").isNotNull())


def dominant_status(decision: Column, planning: Column) -> Column:
    """STRUCT<level, title>: a live decision goes before the planning outcome."""
    live = (
        F.when(decision == "suspend", F.struct(F.lit("critical").alias("level"), F.lit("Suspend").alias("title")))
        .when(decision == "reroute", F.struct(F.lit("caution").alias("level"), F.lit("Reroute").alias("title")))
        .when(decision.isNotNull(), F.struct(F.lit("safe").alias("level"), F.lit("Proceed").alias("title")))
    )
    planned = (
        F.when(planning == "no_safe_route_available", F.struct(F.lit("critical").alias("level"), F.lit("Suspend").alias("title")))
        .when(planning.isNotNull(), F.struct(F.lit("safe").alias("level"), F.lit("Proceed").alias("title")))
    )
    return F.coalesce(live, planned)


def initial_plan(modes: DataFrame, fastest: DataFrame, comparison: DataFrame) -> DataFrame:
    """Starting route and status by mode: fastest always idles, risk-aware may start suspended."""
    fast = _named(fastest, "fast")
    compared = comparison.select(
        *OD, "outcome", "recommended_node_path", "recommended_aggregate_risk_score", "fastest_node_path", "fastest_aggregate_risk_score"
    )
    out = modes.join(fast, OD, "left").join(compared, OD, "left")
    blocked = F.col("outcome") == "no_safe_route_available"
    plain = F.col("mode") == "fastest"
    path = F.when(plain, F.col("fast_node_path")).when(blocked, F.col("fastest_node_path")).otherwise(F.col("recommended_node_path"))
    score = (
        F.when(plain, F.col("fast_aggregate_risk_score"))
        .when(blocked, F.col("fastest_aggregate_risk_score"))
        .otherwise(F.col("recommended_aggregate_risk_score"))
    )
    status = F.when(path.isNull(), "no_route").when(plain | ~blocked, "idle").otherwise("suspended")
    keep = modes.columns
    return out.select(*keep, path.alias("node_path"), score.alias("aggregate_risk_score"), status.alias("status"))


def route_kpis(summary: DataFrame, legs: DataFrame) -> DataFrame:
    """Display row per route: distance, ETA text, worst level and the worst segment's components."""
    worst = legs.groupBy(*OD).agg(
        F.min_by(
            F.struct("slope_risk", "historical_landslide_risk", "weather_risk", "incident_risk", "risk_level"),
            F.struct(-F.col("risk_score"), F.col("leg_idx")),
        ).alias("_w"),
        F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_critical_segments"),
        F.count(F.lit(1)).alias("segments"),
    )
    minutes = F.floor(F.col("estimated_travel_time_min") + 0.5).cast("int")
    eta = F.when(minutes >= 60, F.format_string("%dh %dm", F.floor(minutes / 60).cast("int"), minutes % 60)).otherwise(
        F.format_string("%dm", minutes)
    )
    return summary.join(worst, OD).select(
        *OD, "total_distance_km", eta.alias("eta_text"), "segments", "high_critical_segments",
        F.col("_w.risk_level").alias("worst_level"),
        F.col("_w.slope_risk").alias("worst_slope_risk"),
        F.col("_w.historical_landslide_risk").alias("worst_history_risk"),
        F.col("_w.weather_risk").alias("worst_weather_risk"),
        F.col("_w.incident_risk").alias("worst_incident_risk"),
    )

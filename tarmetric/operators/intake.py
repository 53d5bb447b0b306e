"""Field-report intake, duplicate flags, resolution, alerts and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarmetric import params as P
from tarmetric.functions.risk import lookup
from tarmetric.functions.rounding import round_dp
from tarmetric.operators.gridjoin import nearest_edges, nearest_filed
from tarmetric.operators.hazards import build_hazards


def hazard_type_for(incident_type: Column) -> Column:
    pairs = [F.lit(x) for kv in P.INCIDENT_TO_HAZARD.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), incident_type)


def rejection_reason(report: DataFrame) -> Column:
    """Why a report is not acceptable; NULL for a valid one."""
    return (
        F.when(~F.coalesce(F.col("latitude").between(-90, 90), F.lit(False)), "latitude")
        .when(~F.coalesce(F.col("longitude").between(-180, 180), F.lit(False)), "longitude")
        .when(F.length(F.coalesce(F.col("description"), F.lit(""))) < 1, "description")
        .when(hazard_type_for(F.col("incident_type")).isNull(), "incident_type")
        .when(lookup(F.col("severity"), P.INCIDENT_SEVERITY_FACTOR).isNull(), "severity")
    )


def validate_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with ``reject_reason``)."""
    checked = reports.withColumn("reject_reason", rejection_reason(reports))
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), checked.filter(F.col("reject_reason").isNotNull())


def snap_reports(
    reports: DataFrame, edges: DataFrame | None, max_m: float = P.REPORT_SNAP_M, always: bool = True, filed: DataFrame | None = None
) -> DataFrame:
    """Nearest segment and an accepted flag; farther than ``max_m`` (strictly) is rejected.

    With ``filed``, a table of ``file_edges`` at ``max_m``, reports without an edge within reach get no segment.
    """
    near = nearest_edges(reports, edges, max_m, always=always) if filed is None else nearest_filed(reports, filed, max_m)
    meters = F.col("nearest_km") * 1000.0
    return (
        near.withColumn("accepted", F.coalesce(meters <= max_m, F.lit(False)))
        .withColumn("segment_id", F.when(F.col("accepted"), F.col("nearest_id")))
        .withColumn("nearest_segment_id", F.col("nearest_id"))
        .withColumn("distance_to_road_m", round_dp(meters, 1))
        .drop("nearest_id", "nearest_km")
    )


def reports_to_hazards(snapped: DataFrame) -> DataFrame:
    """The hazard each accepted report raises: incident factor only, closed when blocking."""
    hazards = snapped.filter("accepted").select(
        F.concat(F.lit("report-"), F.col("report_id").cast("string")).alias("hazard_id"),
        "report_id",
        hazard_type_for(F.col("incident_type")).alias("type"),
        "severity",
        "segment_id",
        "created_at",
        F.col("resolved_at").alias("cleared_at"),
    )
    return build_hazards(hazards)


def flag_duplicates(reports: DataFrame, window_s: int = P.DUPLICATE_WINDOW_S) -> DataFrame:
    """``possible_duplicate``: an earlier report of the same type and segment, at most an hour
    old and still unresolved at this report's time. Nothing is dropped.

    A report sees an active earlier one exactly if the latest resolution time among the earlier
    ones in its window lies after it. Each row is filed under its own hour and the next, so a hot
    segment is split by hour instead of being one window partition.
    """
    seconds = F.unix_micros(F.col("created_at"))
    span = window_s * 1_000_000
    rows = reports.withColumn("_t", seconds).withColumn(
        "_open_until", F.coalesce(F.unix_micros(F.col("resolved_at")), F.lit(2**62))
    )
    bucket = F.floor(F.col("_t") / span)
    filed = rows.select(
        "report_id", "incident_type", "segment_id", "_t", "_open_until", bucket.alias("_own"),
        F.explode(F.array(bucket, bucket + 1)).alias("_bucket"),
    )
    # Equal timestamps are ordered by id: pack both into one frame value per row.
    group = W.partitionBy("incident_type", "segment_id", "_bucket").orderBy("_t")
    same_time = W.partitionBy("incident_type", "segment_id", "_bucket", "_t").orderBy("report_id")
    before = F.max("_open_until").over(group.rangeBetween(-span, -1))
    level = F.max("_open_until").over(same_time.rowsBetween(W.unboundedPreceding, -1))
    flagged = filed.withColumn("_before", before).withColumn("_level", level).filter(F.col("_bucket") == F.col("_own"))
    hit = F.coalesce(F.greatest("_before", "_level") > F.col("_t"), F.lit(False))
    flags = flagged.select("report_id", hit.alias("possible_duplicate"))
    return reports.join(flags, "report_id")


def resolve_reports(reports: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Earliest resolution per report; repeated resolutions change nothing."""
    first = resolutions.groupBy("report_id").agg(F.min("resolved_at").alias("resolved_at"))
    out = reports.drop("resolved_at").join(first, "report_id", "left")
    return out.withColumn("status", F.when(F.col("resolved_at").isNull(), "active").otherwise("resolved"))


def report_impact(snapped: DataFrame, risk: DataFrame, decisions_by_segment: DataFrame | None = None) -> DataFrame:
    """Accepted reports with the current risk of their segment and, if given, route decisions."""
    out = snapped.filter("accepted").join(risk.select("segment_id", "risk_score", "risk_level"), "segment_id", "left")
    return out if decisions_by_segment is None else out.join(decisions_by_segment, "segment_id", "left")


def alert_feed(hazards: DataFrame, reports: DataFrame, route_segments: DataFrame) -> DataFrame:
    """Active hazards that no report owns, and active reports, as one list with an on-route flag."""
    on_route = route_segments.select("segment_id").distinct().withColumn("_on", F.lit(True))
    own = reports.select(F.concat(F.lit("report-"), F.col("report_id").cast("string")).alias("hazard_id"))
    plain = hazards.withColumn("hazard_id", F.col("hazard_id").cast("string")).join(own, "hazard_id", "left_anti")
    hazard_rows = (
        plain.join(on_route, "segment_id", "left")
        .groupBy("hazard_id", "type", "severity", "created_at")
        .agg(F.count_distinct("segment_id").alias("segments"), F.coalesce(F.max("_on"), F.lit(False)).alias("on_route"))
        .select(
            F.lit("hazard").alias("kind"), F.col("hazard_id").alias("alert_id"), F.col("type").alias("title"),
            "severity", "segments", "on_route", "created_at",
        )
    )
    report_rows = reports.join(on_route, "segment_id", "left").select(
        F.lit("field_report").alias("kind"),
        F.col("report_id").cast("string").alias("alert_id"),
        F.col("incident_type").alias("title"),
        "severity",
        F.lit(1).cast("long").alias("segments"),
        F.coalesce("_on", F.lit(False)).alias("on_route"),
        "created_at",
    )
    return hazard_rows.unionByName(report_rows)


def newest_first(feed: DataFrame) -> DataFrame:
    return feed.orderBy(F.desc("created_at"), "kind", "alert_id")


def corridor_health(feed: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return feed.agg(n.alias("active_alerts"), F.when(n > 0, "obstructed").otherwise("open").alias("health"))


def activity_timeline(**events: DataFrame) -> DataFrame:
    """Union of event tables (``event_id, at, detail``) labelled with their source."""
    out = None
    for kind, df in events.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col("event_id").cast("string").alias("event_id"), "at", "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def current_state(log: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Latest row per key of an append-only event table."""
    fields = [c for c in log.columns if c != key]
    packed = log.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*version)).alias("_s"))
    return packed.select(key, "_s.*")

"""Risk score and hazard context queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarmetric.functions import risk as K
from tarmetric.functions.rounding import round_dp
from tarmetric.operators import hazards as H
from tarmetric.plans.fixtures import AS_OF, rnd
from tarmetric.plans.q_rain import day_rain
from tarmetric.plans.q_spatial import zones
from tarmetric.plans.registry import World, define, query


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def slope_sql(x: str = "slope_deg") -> str:
    return f"(case when {x} is null or {x}<=2 then 0e0 when {x}>=25 then 1e0 else ({x}-2e0)/23e0 end)"


def history_sql(n: str, d: str, z: str) -> str:
    count = f"least(1e0, ln(1e0+{n})/ln(6e0))"
    near = f"(case when {d} is null then 0e0 else greatest(0e0, least(1e0, 1e0-{d}/5e2)) end)"
    return f"greatest(case when {n}<=0 then 0e0 else greatest(0e0, least(1e0, 7e-1*{count}+(1e0-7e-1)*{near})) end, coalesce({z}, 0e0))"


def clamp_sql(x: str) -> str:
    return f"(case when {x} is null then 0e0 else greatest(0e0, least(1e0, {x})) end)"


def score_sql(n: str = "historical_landslide_count", d: str = "nearest_landslide_distance_m", z: str = "landslide_hazard_score", w: str = "weather_factor", i: str = "incident_factor") -> str:
    raw = f"35e-2*{slope_sql()}+35e-2*{history_sql(n, d, z)}+2e-1*{clamp_sql(w)}+1e-1*{clamp_sql(i)}"
    return rnd(f"greatest(0e0, least(1e0, {raw}))", 4)


def level_sql(x: str) -> str:
    return f"(case when {x}>=75e-2 then 'critical' when {x}>=5e-1 then 'high' when {x}>=25e-2 then 'moderate' else 'low' end)"


define("ox_hazard", """
    select *, case when type='heavy_rain' then case severity when 'minor' then 3e-1 when 'major' then 6e-1 else 9e-1 end end as weather_factor,
    case when type<>'heavy_rain' then case severity when 'minor' then 2e-1 when 'major' then 5e-1 else 1e0 end end as incident_factor,
    type<>'heavy_rain' and severity='blocking' as is_closure from {hazard}""")
define("ox_known", "select * from {ox_hazard} where segment_id in (select segment_id from {road_segment})")
ACTIVE = f"created_at<=timestamp '{AS_OF}' and (cleared_at is null or cleared_at>timestamp '{AS_OF}')"
define("ox_active", "select * from {ox_known} where " + ACTIVE)
define("ox_ctx", "select segment_id, max(weather_factor) as weather_factor, max(incident_factor) as incident_factor, bool_or(is_closure) as closed from {ox_active} group by 1")
# Live risk: rainfall supplies weather where it has a reading, hazards otherwise and for incidents.
define("ox_live_in", """
    select s.*, coalesce(r.weather_factor, c.weather_factor) as weather_factor, c.incident_factor, coalesce(c.closed, false) as closed
    from {road_segment} s left join {ox_ctx} c using (segment_id) left join {ox_day_rain} r using (segment_id)""")
define("ox_live", "select *, " + level_sql("risk_score") + " as risk_level from (select *, " + score_sql() + " as risk_score from {ox_live_in})")


def known_hazards(w: World) -> DataFrame:
    def build() -> DataFrame:
        accepted, _ = H.split_unknown_segments(H.build_hazards(w["hazard"]), w.segments)
        return accepted

    return w.keep("known_hazards", build)


def active_hazards(w: World) -> DataFrame:
    return H.active_at(known_hazards(w), as_of())


def hazard_context(w: World) -> DataFrame:
    return w.keep("hazard_context", lambda: H.segment_context(active_hazards(w)))


def calm(w: World) -> DataFrame:
    """Scored segments without any context."""
    null = F.lit(None).cast("double")
    base = w.segments.withColumns({"weather_factor": null, "incident_factor": null, "closed": F.lit(False)})
    return H.score_segments(base)


def live(w: World) -> DataFrame:
    """Scored segments under rainfall of the day and the active hazards."""
    def build() -> DataFrame:
        out = H.overlay_context(w.segments, hazard_context(w))
        rain = day_rain(w).select("segment_id", F.col("weather_factor").alias("_rain"))
        out = out.join(rain, "segment_id", "left")
        return H.score_segments(out.withColumn("weather_factor", F.coalesce("_rain", "weather_factor")).drop("_rain"))

    return w.keep("live_risk", build)


@query("f1_slope_risk", "select segment_id, " + rnd(slope_sql(), 6) + " as slope_risk from {road_segment}")
def slope_risk(w: World) -> DataFrame:
    return w.segments.select("segment_id", round_dp(K.slope_risk(F.col("slope_deg")), 6).alias("slope_risk"))


@query("f2_history_risk", "select segment_id, " + rnd(history_sql("historical_landslide_count", "nearest_landslide_distance_m", "landslide_hazard_score"), 6) + " as history_risk from {road_segment}")
def history_risk(w: World) -> DataFrame:
    h = K.history_risk(F.col("historical_landslide_count"), F.col("nearest_landslide_distance_m"), F.col("landslide_hazard_score"))
    return w.segments.select("segment_id", round_dp(h, 6).alias("history_risk"))


@query("f3_f4_factor_risk", "select segment_id, " + clamp_sql("weather_factor") + " as weather_risk, " + clamp_sql("incident_factor") + " as incident_risk from {ox_live_in}")
def factor_risk(w: World) -> DataFrame:
    return live(w).select("segment_id", K.factor_risk(F.col("weather_factor")).alias("weather_risk"), K.factor_risk(F.col("incident_factor")).alias("incident_risk"))


@query("f5_f6_segment_risk", """
    select segment_id, risk_score, risk_level, """ + rnd(slope_sql(), 4) + " as slope_risk, " + rnd(history_sql("historical_landslide_count", "nearest_landslide_distance_m", "landslide_hazard_score"), 4)
    + " as historical_landslide_risk, " + rnd(clamp_sql("weather_factor"), 4) + " as weather_risk, " + rnd(clamp_sql("incident_factor"), 4) + " as incident_risk from {ox_live}")
def segment_risk(w: World) -> DataFrame:
    return live(w).select("segment_id", "risk_score", "risk_level", "slope_risk", "historical_landslide_risk", "weather_risk", "incident_risk")


REASONS = """
    select segment_id, concat_ws(' | ',
      case when slope_deg is null then 'Slope data unavailable, no terrain contribution applied'
           when sr>=5e-1 then concat('High slope exposure (', printf('%.1f', slope_deg), ' deg)') when sr>0 then concat('Moderate slope exposure (', printf('%.1f', slope_deg), ' deg)')
           else concat('Low slope exposure (', printf('%.1f', slope_deg), ' deg)') end,
      case when historical_landslide_count>0 then concat(cast(historical_landslide_count as varchar), ' historical landslide ', case when historical_landslide_count=1 then 'observation' else 'observations' end, ' matched',
           case when nearest_landslide_distance_m is null then '' else concat(', nearest ', printf('%.0f', nearest_landslide_distance_m), 'm away') end)
           else 'No matched historical landslide observation (data coverage, not a confirmed absence)' end,
      case when landslide_hazard_score is not null then concat('Landslide zonation: ', landslide_hazard_class, ' (score=', printf('%.2f', landslide_hazard_score), ', source=layer)')
           else 'No landslide zonation coverage, historical evidence only' end,
      case when """ + clamp_sql("weather_factor") + """>0 then concat('Elevated weather risk (factor=', w_txt, ')') when weather_factor is null then 'No weather context supplied (not confirmed clear weather)' end,
      case when """ + clamp_sql("incident_factor") + """>0 then concat('Active incident contribution (factor=', printf('%.2f', incident_factor), ')') end,
      concat('Risk score: ', printf('%.2f', floor(risk_score*1e2+5e-1)/1e2), ' (rule-based estimate, not a probability)')) as reasons
    from (select *, """ + slope_sql() + """ as sr, printf('%.2f', floor(weather_factor*1e2+5e-1)/1e2) as w_txt from {ox_live})"""


@query("f7_reasons", REASONS)
def reasons(w: World) -> DataFrame:
    risk = F.struct("risk_score", "slope_risk", "weather_risk", "incident_risk")
    rows = K.reasons(
        F.col("slope_deg"), F.col("historical_landslide_count"), F.col("nearest_landslide_distance_m"), F.col("landslide_hazard_class"),
        F.col("landslide_hazard_score"), F.lit("layer"), round_dp("weather_factor", 2), F.col("incident_factor"), risk,
    )
    return live(w).select("segment_id", F.concat_ws(" | ", rows).alias("reasons"))


@query("f8_input_metadata", """
    select segment_id, coalesce(cast(slope_deg as varchar), '') as slope_deg, cast(historical_landslide_count as varchar) as historical_landslide_count,
    coalesce(cast(elevation_m as varchar), '') as elevation_m, coalesce(cast(nearest_landslide_distance_m as varchar), '') as nearest_landslide_distance_m,
    coalesce(landslide_hazard_class, '') as landslide_hazard_class, case when weather_factor is not null then 'true' else 'false' end as weather_factor_supplied,
    case when incident_factor is not null then 'true' else 'false' end as incident_factor_supplied from {ox_live}""")
def input_metadata(w: World) -> DataFrame:
    m = K.input_metadata({
        "slope_deg": F.col("slope_deg"), "elevation_m": F.col("elevation_m"), "historical_landslide_count": F.col("historical_landslide_count"),
        "nearest_landslide_distance_m": F.col("nearest_landslide_distance_m"), "landslide_hazard_class": F.col("landslide_hazard_class"),
        "weather_factor_supplied": F.col("weather_factor").isNotNull(), "incident_factor_supplied": F.col("incident_factor").isNotNull(),
    })
    shown = ["slope_deg", "elevation_m", "historical_landslide_count", "nearest_landslide_distance_m", "landslide_hazard_class", "weather_factor_supplied", "incident_factor_supplied"]
    return live(w).withColumn("m", m).select("segment_id", *[F.col("m")[k].alias(k) for k in shown])


@query("f9_static_summary", """
    select segment_id, terrain_type, floor(least(1e0, case terrain_type when 'plain' then 5e-2 when 'hill' then 15e-2 else 25e-2 end)*1e3+5e-1)/1e3 as base_risk, 'open' as status from {road_segment}""")
def static_summary(w: World) -> DataFrame:
    base = K.base_risk(F.col("terrain_type"), F.lit(0.0), F.lit(0.0))
    return w.segments.select("segment_id", "terrain_type", base.alias("base_risk"), F.lit("open").alias("status"))


@query("f11_severity_factors", "select hazard_id, weather_factor, incident_factor from {ox_hazard}")
def severity_factors(w: World) -> DataFrame:
    return H.build_hazards(w["hazard"]).select("hazard_id", "weather_factor", "incident_factor")


@query("f12_f13_class_scores", """
    select polygon_id, s as hazard_score, case when s>=75e-2 then 'very_high' when s>=5e-1 then 'high' when s>=25e-2 then 'moderate' else 'low' end as hazard_level from (
    select polygon_id, case lower(hazard_class) when 'very low' then 1e-1 when 'low' then 25e-2 when 'moderate' then 45e-2 when 'high' then 7e-1 else 9e-1 end as s from {landslide_zone})""")
def class_scores(w: World) -> DataFrame:
    s = K.class_score(F.col("hazard_class"))
    return w["landslide_zone"].select("polygon_id", s.alias("hazard_score"), K.hazard_level(s).alias("hazard_level"))


@query("f15_riskiest_segments", "select segment_id, risk_score, risk_level, closed from {ox_live} order by risk_score desc, segment_id limit 20")
def riskiest_segments(w: World) -> DataFrame:
    return live(w).orderBy(F.desc("risk_score"), "segment_id").limit(20).select("segment_id", "risk_score", "risk_level", "closed")


SCENARIOS = "select 'calm' as scenario, cast(null as double) as weather_factor, cast(null as double) as incident_factor union all select 'rain', 6e-1, null union all select 'blocked', null, 1e0 union all select 'severe', 9e-1, 9e-1"
define("ox_scenario", SCENARIOS)


@query("f16_sensitivity_grid", """
    select segment_id, scenario, risk_score, """ + level_sql("risk_score") + " as risk_level from (select segment_id, scenario, " + score_sql() + " as risk_score from {road_segment} cross join {ox_scenario})")
def sensitivity_grid(w: World) -> DataFrame:
    grid = w.segments.crossJoin(F.broadcast(w.spark.sql(SCENARIOS)))
    return H.score_segments(grid).select("segment_id", "scenario", "risk_score", "risk_level")


@query("f17_live_segment_risk", "select segment_id, weather_factor, incident_factor, closed, risk_score, risk_level from {ox_live}")
def live_segment_risk(w: World) -> DataFrame:
    return live(w).select("segment_id", "weather_factor", "incident_factor", "closed", "risk_score", "risk_level")


@query("e16_segment_detail", """
    select l.segment_id, z.c as zone_class, floor(z.s*1e4+5e-1)/1e4 as zone_score, case when z.n>0 then 'ok' else 'no_coverage' end as zone_status, historical_landslide_count, nearest_landslide_distance_m,
    r.rainfall_mm, r.status as rain_status, l.risk_score from {ox_live} l left join {ox_seg_slide_zone} z using (segment_id) left join {ox_day_rain} r using (segment_id)""")
def segment_detail(w: World) -> DataFrame:
    zone = zones(w).select("segment_id", F.col("landslide_hazard_class").alias("zone_class"), F.col("landslide_hazard_score").alias("zone_score"), F.col("landslide_hazard_status").alias("zone_status"))
    rain = day_rain(w).select("segment_id", "rainfall_mm", F.col("status").alias("rain_status"))
    base = live(w).select("segment_id", "historical_landslide_count", "nearest_landslide_distance_m", "risk_score")
    return base.join(zone, "segment_id", "left").join(rain, "segment_id", "left")


@query("g1_hazard_construction", "select hazard_id, type, severity, weather_factor, incident_factor, is_closure from {ox_hazard}")
def hazard_construction(w: World) -> DataFrame:
    return H.build_hazards(w["hazard"]).select("hazard_id", "type", "severity", "weather_factor", "incident_factor", "is_closure")


@query("g2_segment_context", "select * from {ox_ctx}")
def segment_context(w: World) -> DataFrame:
    return hazard_context(w)


@query("g3_closed_segments", "select segment_id from {ox_ctx} where closed")
def closed_segments(w: World) -> DataFrame:
    return hazard_context(w).filter("closed").select("segment_id")


@query("g4_factor_resolution", """
    select segment_id, coalesce(c.weather_factor, 3e-1) as weather_factor, coalesce(c.incident_factor, 1e-1) as incident_factor, coalesce(closed, false) as closed
    from {road_segment} left join {ox_ctx} c using (segment_id)""")
def factor_resolution(w: World) -> DataFrame:
    return H.overlay_context(w.segments, hazard_context(w), 0.3, 0.1).select("segment_id", "weather_factor", "incident_factor", "closed")


@query("g5_hazard_lifecycle", """
    select hazard_id, cast(epoch_us(created_at) as bigint) as created_us, severity from {hazard} where """ + ACTIVE)
def hazard_lifecycle(w: World) -> DataFrame:
    """Active hazards from create events and repeated clear events."""
    h = w["hazard"]
    clears = h.filter("cleared_at is not null").select("hazard_id", "cleared_at")
    later = clears.withColumn("cleared_at", F.col("cleared_at") + F.expr("interval 2 hours"))
    state = H.first_clear(h, clears.unionByName(later))
    return H.active_at(state, as_of()).select("hazard_id", F.unix_micros("created_at").alias("created_us"), "severity")


@query("g6_rejected_hazards", "select hazard_id, segment_id as unknown_segments from {hazard} where segment_id not in (select segment_id from {road_segment})")
def rejected_hazards(w: World) -> DataFrame:
    _, rejected = H.split_unknown_segments(w["hazard"], w.segments)
    return rejected.select("hazard_id", F.concat_ws(",", "unknown_segment_ids").alias("unknown_segments"))

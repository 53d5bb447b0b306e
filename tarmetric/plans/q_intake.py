"""Field-report intake, alerts, timelines and trip queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarmetric.functions.rounding import round_dp
from tarmetric.operators import hazards as H
from tarmetric.operators import intake as I
from tarmetric.operators import trips as T
from tarmetric.operators.routing import risk_cost, route_geometry, weighted
from tarmetric.plans.fixtures import TRIP_AS_OF, hav, rnd
from tarmetric.plans.q_risk import ACTIVE, active_hazards, as_of, hazard_context, live
from tarmetric.plans.q_routing import OD, decisions, legs, risk_edges, scored, summary
from tarmetric.plans.q_spatial import snapped
from tarmetric.plans.registry import World, define, query


@query("i1_incident_hazard_type", """
    select report_id, case when incident_type='landslide' then 'landslide' else 'road_blockage' end as hazard_type from {field_report}""")
def incident_hazard_type(w: World) -> DataFrame:
    return w["field_report"].select("report_id", I.hazard_type_for(F.col("incident_type")).alias("hazard_type"))


def spoiled(w: World) -> DataFrame:
    """Reports with a share of invalid fields, as a validation would meet them."""
    r, n = w["field_report"], F.col("report_id")
    return r.select(
        "report_id",
        F.when(n % 31 == 0, F.lit("alien")).otherwise(F.col("incident_type")).alias("incident_type"),
        F.when(n % 37 == 0, F.lit("huge")).otherwise(F.col("severity")).alias("severity"),
        F.when(n % 41 == 0, F.lit(91.0)).otherwise(F.col("latitude")).alias("latitude"),
        F.when(n % 43 == 0, F.lit(None).cast("double")).otherwise(F.col("longitude")).alias("longitude"),
        F.when(n % 47 == 0, F.lit("")).otherwise(F.col("description")).alias("description"),
    )


@query("i2_report_validation", """
    select coalesce(case when report_id%41=0 then 'latitude' when report_id%43=0 then 'longitude' when report_id%47=0 then 'description' when report_id%31=0 then 'incident_type' when report_id%37=0 then 'severity' end, 'valid') as verdict,
    count(*) as reports from {field_report} group by 1""")
def report_validation(w: World) -> DataFrame:
    valid, bad = I.validate_reports(spoiled(w))
    rows = valid.select(F.lit("valid").alias("verdict")).unionByName(bad.select(F.col("reject_reason").alias("verdict")))
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("reports"))


define("ox_accepted", "select r.*, n.segment_id, " + rnd("km*1e3", 1) + " as distance_to_road_m from {field_report} r join {ox_report_near} n using (report_id) where km*1e3<=3e2")


def report_hazards(w: World) -> DataFrame:
    return w.keep("report_hazards", lambda: I.reports_to_hazards(snapped(w)))


@query("i3_report_hazards", """
    select concat('report-', cast(report_id as varchar)) as hazard_id, case when incident_type='landslide' then 'landslide' else 'road_blockage' end as type, severity, segment_id,
    case severity when 'minor' then 2e-1 when 'major' then 5e-1 else 1e0 end as incident_factor, severity='blocking' as is_closure from {ox_accepted}""")
def report_to_hazard(w: World) -> DataFrame:
    return report_hazards(w).select("hazard_id", "type", "severity", "segment_id", "incident_factor", "is_closure")


define("ox_duplicate", """
    select a.report_id, bool_or(b.report_id is not null) as possible_duplicate from {ox_accepted} a left join {ox_accepted} b on b.incident_type=a.incident_type and b.segment_id=a.segment_id
    and (b.created_at<a.created_at or (b.created_at=a.created_at and b.report_id<a.report_id)) and a.created_at-b.created_at<=interval '60' minute and (b.resolved_at is null or b.resolved_at>a.created_at) group by 1""")


@query("i4_possible_duplicates", "select report_id, possible_duplicate from {ox_duplicate}")
def possible_duplicates(w: World) -> DataFrame:
    return I.flag_duplicates(snapped(w).filter("accepted")).select("report_id", "possible_duplicate")


COARSE = """
    select report_id, case when report_id%2=0 then 'landslide' else 'accident' end as incident_type, concat('zone_', cast(cast(floor(latitude*1e1) as bigint) as varchar(9))) as segment_id, created_at, resolved_at from {field_report}"""
define("coarse_report", COARSE)


@query("i4_duplicates_by_district", """
    select a.report_id, bool_or(b.report_id is not null) as possible_duplicate from {coarse_report} a left join {coarse_report} b on b.incident_type=a.incident_type and b.segment_id=a.segment_id
    and (b.created_at<a.created_at or (b.created_at=a.created_at and b.report_id<a.report_id)) and a.created_at-b.created_at<=interval '60' minute and (b.resolved_at is null or b.resolved_at>a.created_at) group by 1""")
def duplicates_by_district(w: World) -> DataFrame:
    """Few, very busy keys: the flag under skew."""
    coarse = w.spark.sql(COARSE, field_report=w["field_report"])
    return I.flag_duplicates(coarse).select("report_id", "possible_duplicate")


@query("i5_resolutions", """
    select report_id, case when resolved_at is null then 'active' else 'resolved' end as status, cast(epoch_us(resolved_at) as bigint) as resolved_us from {field_report}""")
def resolutions(w: World) -> DataFrame:
    r = w["field_report"]
    first = r.filter("resolved_at is not null").select("report_id", "resolved_at")
    again = first.withColumn("resolved_at", F.col("resolved_at") + F.expr("interval 5 minutes"))
    return I.resolve_reports(r, first.unionByName(again)).select("report_id", "status", F.unix_micros("resolved_at").alias("resolved_us"))


ACTIVE_R = ACTIVE.replace("cleared_at", "resolved_at")


def active_reports(w: World) -> DataFrame:
    accepted = snapped(w).filter("accepted")
    return H.active_at(accepted, as_of(), closed="resolved_at")


@query("i6_active_reports", "select report_id, incident_type, severity, segment_id, cast(epoch_us(created_at) as bigint) as created_us from {ox_accepted} where " + ACTIVE_R)
def active_report_list(w: World) -> DataFrame:
    return active_reports(w).select("report_id", "incident_type", "severity", "segment_id", F.unix_micros("created_at").alias("created_us"))


@query("i7_report_impact", """
    select report_id, a.segment_id, l.risk_score, l.risk_level, coalesce(d.reroutes,0) as reroutes, coalesce(d.suspends,0) as suspends from {ox_accepted} a left join {ox_live} l using (segment_id) left join (
      select segment_id, count(distinct case when decision='reroute' then (d.origin, d.destination) end) as reroutes, count(distinct case when decision='suspend' then (d.origin, d.destination) end) as suspends
      from {ox_leg} g join {ox_decision} d on d.origin=g.origin and d.destination=g.destination where g.graph='calm' group by 1) d using (segment_id)""")
def report_impact(w: World) -> DataFrame:
    """Risk of the reported segment and the decisions of the pairs whose earlier route uses it."""
    decided = decisions(w).select(*OD, "decision")
    used = legs(w, "calm").select(*OD, "segment_id").join(decided, OD)
    per = used.distinct().groupBy("segment_id").agg(
        F.count_if(F.col("decision") == "reroute").alias("reroutes"), F.count_if(F.col("decision") == "suspend").alias("suspends")
    )
    out = I.report_impact(snapped(w), live(w), per)
    return out.select("report_id", "segment_id", "risk_score", "risk_level", F.coalesce("reroutes", F.lit(0)).alias("reroutes"), F.coalesce("suspends", F.lit(0)).alias("suspends"))


define("ox_route_seg", "select distinct segment_id from {ox_leg} where graph='fast'")
define("ox_feed", """
    select 'hazard' as kind, cast(hazard_id as varchar) as alert_id, type as title, severity, cast(1 as bigint) as segments, segment_id in (select segment_id from {ox_route_seg}) as on_route, created_at from {ox_active}
    union all select 'field_report', cast(report_id as varchar), incident_type, severity, 1, segment_id in (select segment_id from {ox_route_seg}), created_at from {ox_accepted} where """ + ACTIVE_R)


def feed(w: World) -> DataFrame:
    reports = active_reports(w)
    columns = ["hazard_id", "type", "severity", "segment_id", "created_at"]
    plain = active_hazards(w).select(F.col("hazard_id").cast("string").alias("hazard_id"), *columns[1:])
    owned = H.active_at(report_hazards(w), as_of()).select(*columns)
    return I.alert_feed(plain.unionByName(owned), reports, legs(w, "fast"))


@query("i8_alert_feed", "select kind, alert_id, title, severity, segments, on_route, cast(epoch_us(created_at) as bigint) as created_us from {ox_feed}")
def alert_feed(w: World) -> DataFrame:
    return feed(w).select("kind", "alert_id", "title", "severity", "segments", "on_route", F.unix_micros("created_at").alias("created_us"))


@query("i8_newest_alerts", "select kind, alert_id from {ox_feed} order by created_at desc, kind, alert_id")
def newest_alerts(w: World) -> DataFrame:
    return I.newest_first(feed(w)).select("kind", "alert_id")


@query("d12_hazards_without_report", "select cast(hazard_id as varchar) as hazard_id from {ox_active}")
def hazards_without_report(w: World) -> DataFrame:
    return feed(w).filter("kind = 'hazard'").select(F.col("alert_id").alias("hazard_id"))


@query("i9_corridor_health", "select count(*) as active_alerts, case when count(*)>0 then 'obstructed' else 'open' end as health from {ox_feed}")
def corridor_health(w: World) -> DataFrame:
    return I.corridor_health(feed(w))


@query("i10_activity_timeline", """
    select 'hazard' as kind, cast(hazard_id as varchar) as event_id, cast(epoch_us(created_at) as bigint) as at_us, type as detail from {hazard}
    union all select 'report', cast(report_id as varchar), cast(epoch_us(created_at) as bigint), incident_type from {field_report}
    union all select 'trip', cast(trip_id as varchar), cast(epoch_us(started_at) as bigint), mode from {trip}""")
def activity_timeline(w: World) -> DataFrame:
    line = I.activity_timeline(
        hazard=w["hazard"].select(F.col("hazard_id").alias("event_id"), F.col("created_at").alias("at"), F.col("type").alias("detail")),
        report=w["field_report"].select(F.col("report_id").alias("event_id"), F.col("created_at").alias("at"), F.col("incident_type").alias("detail")),
        trip=w["trip"].select(F.col("trip_id").alias("event_id"), F.col("started_at").alias("at"), F.col("mode").alias("detail")),
    )
    return line.select("kind", "event_id", F.unix_micros("at").alias("at_us"), "detail")


# Trips follow the fastest route of their pair.
TRIP_TIME = f"timestamp '{TRIP_AS_OF}'"


def until() -> Column:
    return F.lit(TRIP_AS_OF).cast("timestamp")


def pauses(w: World) -> DataFrame:
    return w.keep("pauses", lambda: T.pause_seconds(w["trip_event"].withColumnRenamed("at_time", "at"), until()))


define("ox_pause", f"""
    select trip_id, coalesce(sum(case when action='pause' and at_time<{TRIP_TIME} then (epoch_us(least(coalesce(nxt, {TRIP_TIME}), {TRIP_TIME}))-epoch_us(at_time))/1e6 end), 0e0) as paused_s, count_if(action='pause') as pauses
    from (select *, lead(at_time) over (partition by trip_id order by at_time, event_id) as nxt from {{trip_event}}) group by 1""")


@query("j6_pause_totals", "select trip_id, " + rnd("paused_s", 3) + " as paused_s, pauses from {ox_pause}")
def pause_totals(w: World) -> DataFrame:
    return pauses(w).select("trip_id", round_dp("paused_s", 3).alias("paused_s"), "pauses")


def offsets(w: World) -> DataFrame:
    own = legs(w, "fast").drop("graph")
    return w.keep("leg_offsets", lambda: T.leg_offsets(own, scored(w, "calm"), OD))


def progress(w: World) -> DataFrame:
    """Trips at the reporting time; a trip loses a thousandth of its user's recorded pause time."""
    def build() -> DataFrame:
        trips = w["trip"].join(pauses(w).select("trip_id", "paused_s"), "trip_id", "left")
        elapsed = (F.unix_micros(until()) - F.unix_micros("started_at")) / 1e6
        paused = F.coalesce("paused_s", F.lit(0.0)) / 1e3
        asked = trips.select("trip_id", *OD, "speed_kmph", "started_at", elapsed.alias("elapsed_s"), paused.alias("paused_s"))
        return T.trip_progress(asked, offsets(w), summary(w, "fast", "live").select(*OD, "total_distance_km"), OD)

    return w.keep("trip_progress", build)


define("ox_offset", "select origin, destination, leg_idx, segment_id, sum(distance_km) over (partition by origin, destination order by leg_idx) as to_km from {ox_leg} join (select segment_id, distance_km from {ox_collapsed}) using (segment_id) where graph='fast'")
define("ox_trip", f"""
    select t.trip_id, t.origin, t.destination, t.speed_kmph, r.total_distance_km, r.legs, t.started_at, least(r.total_distance_km, greatest(0e0, (epoch_us({TRIP_TIME})-epoch_us(started_at))/1e6-coalesce(p.paused_s,0e0)/1e3)/3.6e3*speed_kmph) as km
    from {{trip}} t join (select * from {{ox_route}} where graph='fast') r using (origin, destination) left join {{ox_pause}} p using (trip_id)""")
define("ox_progress", """
    select t.*, km>=total_distance_km as arrived, case when km>=total_distance_km then legs-1 else coalesce(first_leg, legs-1) end as leg_idx from {ox_trip} t join (
      select trip_id, min(case when km<o.to_km-1e-9 then o.leg_idx end) as first_leg from {ox_trip} t join {ox_offset} o on o.origin=t.origin and o.destination=t.destination group by 1) f using (trip_id)""")


@query("j1_j4_trip_progress", """
    select trip_id, arrived, leg_idx, case when arrived then 1e0 else """ + rnd("km/total_distance_km", 4) + " end as progress, case when arrived then total_distance_km else " + rnd("km", 3)
    + " end as distance_travelled_km, case when arrived then 0e0 else " + rnd("total_distance_km-km", 3) + " end as distance_remaining_km, case when arrived then 0e0 else " + rnd("(" + rnd("total_distance_km-km", 3) + ")/speed_kmph*6e1", 1) + " end as eta_minutes from {ox_progress}")
def trip_progress(w: World) -> DataFrame:
    return progress(w).select(
        "trip_id", "arrived", F.col("leg_idx").cast("long").alias("leg_idx"), "progress", "distance_travelled_km", "distance_remaining_km", "eta_minutes"
    )


@query("j2_trip_positions", """
    select trip_id, """ + rnd("case when part<=h1 or h2<=0 then ay+(latm-ay)*least(1e0,greatest(0e0,part/h1)) else latm+(bey-latm)*least(1e0,greatest(0e0,(part-h1)/h2)) end", 6) + " as lat, "
    + rnd("case when part<=h1 or h2<=0 then ax+(lngm-ax)*least(1e0,greatest(0e0,part/h1)) else lngm+(bex-lngm)*least(1e0,greatest(0e0,(part-h1)/h2)) end", 6) + """ as lng from (
      select trip_id, km, latm, lngm, a.lat as ay, b.lat as bey, a.lng as ax, b.lng as bex, h.h1, h.h2, km-h.before as part, row_number() over (partition by trip_id order by h.leg_idx) as r from {ox_trip} t
      join {ox_leg_geo} h on h.origin=t.origin and h.destination=t.destination and (h.before+h.h1+h.h2>=km or h.leg_idx=t.legs-1) join {road_node} a on a.node_id=h.u join {road_node} b on b.node_id=h.v) where r=1""")
def trip_positions(w: World) -> DataFrame:
    geometry = route_geometry(legs(w, "fast").drop("graph"), scored(w, "calm"), OD)
    return T.trip_positions(progress(w), geometry, OD).select("trip_id", round_dp("lat", 6).alias("lat"), round_dp("lng", 6).alias("lng"))


define("ox_leg_geo", """
    select *, coalesce(sum(h1+h2) over (partition by origin, destination order by leg_idx rows between unbounded preceding and 1 preceding), 0e0) as before from (
      select l.origin, l.destination, l.leg_idx, l.u, l.v, s.latm, s.lngm, case when s.from_node_id=l.u then s.ha else s.hb end as h1, case when s.from_node_id=l.u then s.hb else s.ha end as h2 from {ox_leg} l
      join (select segment_id, from_node_id, latm, lngm, """ + hav("lat1", "lng1", "latm", "lngm") + " as ha, "
      + hav("latm", "lngm", "lat2", "lng2") + """ as hb from {ox_collapsed}) s using (segment_id) where l.graph='fast')""")


@query("d11_hazards_ahead", """
    select trip_id, coalesce(bool_or(l.leg_idx>=p.leg_idx), false) as hazard_ahead from {ox_progress} p left join (select * from {ox_leg} where graph='fast' and segment_id in (select segment_id from {ox_ctx})) l
    on l.origin=p.origin and l.destination=p.destination group by 1""")
def hazards_ahead(w: World) -> DataFrame:
    own = legs(w, "fast").drop("graph")
    return T.hazards_ahead(progress(w), own, hazard_context(w), OD).select("trip_id", "hazard_ahead")


def trip_checks(w: World) -> DataFrame:
    """Trips with what decides whether their route is planned anew; every eleventh was suspended before."""
    own = legs(w, "fast").drop("graph")
    rows = T.hazards_ahead(progress(w), own, hazard_context(w), OD)
    return rows.withColumns({"started": F.col("started_at") <= until(), "was_suspended": F.col("trip_id") % 11 == 0})


def checked(w: World) -> DataFrame:
    own = legs(w, "fast").drop("graph")
    return w.keep("checked_trips", lambda: T.checked_starts(trip_checks(w), own))


def decided_under_way(w: World) -> DataFrame:
    def build() -> DataFrame:
        own = legs(w, "fast").drop("graph")
        cost = risk_cost(F.col("travel_time_min"), F.col("risk_score"))
        return T.decide_under_way(checked(w), own, scored(w, "live"), weighted(risk_edges(w, "live"), "safe", cost))

    return w.keep("decided_under_way", build)


define("ox_ahead", """
    select p.trip_id, coalesce(bool_or(l.leg_idx>=p.leg_idx), false) as ahead from {ox_progress} p left join (select * from {ox_leg} where graph='fast' and segment_id in (select segment_id from {ox_ctx})) l
    on l.origin=p.origin and l.destination=p.destination group by 1""")
define("ox_checked", f"""
    select trip_id, origin, destination, from_leg, u as node from (
      select p.trip_id, p.origin, p.destination, case when p.trip_id%11=0 then 0 else p.leg_idx end as from_leg from {{ox_progress}} p join {{ox_ahead}} a using (trip_id)
      where p.started_at<={TRIP_TIME} and (p.trip_id%11=0 or (a.ahead and not p.arrived))) c
    join (select origin, destination, leg_idx as from_leg, u from {{ox_leg}} where graph='fast') using (origin, destination, from_leg)""")
SCORE = rnd("greatest(0e0, least(1e0, 7e-1*max(risk_score)+(1e0-7e-1)*(sum(cast(round(risk_score*1e4) as bigint))/1e4/count(*))))", 4)
define("ox_rest", """
    select c.origin, c.destination, c.from_leg, any_value(c.node) as node, """ + SCORE + """ as score, count_if(closed or risk_score>=65e-2) as unsafe, concat(cast(any_value(c.node) as varchar), '>', string_agg(cast(l.v as varchar), '>' order by l.leg_idx)) as path
    from (select distinct origin, destination, from_leg, node from {ox_checked}) c join {ox_leg} l on l.graph='fast' and l.origin=c.origin and l.destination=c.destination and l.leg_idx>=c.from_leg
    join (select segment_id, risk_score, closed from {ox_live_seg}) using (segment_id) group by 1,2,3""")
define("ox_anew", """
    select node, destination, path, score from (select s.origin as node, s.node as destination, s.path, segs from {ox_sp} s where s.graph='safe' and (s.origin, s.node) in (select (node, destination) from {ox_rest})) s
    join (select s.origin as node, s.node as destination, """ + SCORE + """ as score from (select origin, node, unnest(segs) as segment_id from {ox_sp} where graph='safe' and (origin, node) in (select (node, destination) from {ox_rest})) s
      join (select segment_id, risk_score from {ox_live_seg}) using (segment_id) group by 1,2) using (node, destination)""")
define("ox_under_way", """
    select r.origin, r.destination, r.from_leg, r.node, r.path as rest_path, a.path as new_path, case when a.path is null then 'suspend' when a.path=r.path then 'unchanged' when r.unsafe>0 then 'infeasible'
      when round((r.score-a.score)*1e4)<500 then 'hysteresis' else 'safer' end as decision_rule from {ox_rest} r left join {ox_anew} a on a.node=r.node and a.destination=r.destination""")


@query("j5_reroute_from_node", """
    select c.trip_id, c.from_leg, c.node as reroute_from_node, d.decision_rule, case d.decision_rule when 'suspend' then 'suspend' when 'infeasible' then 'reroute' when 'safer' then 'reroute' else 'continue' end as decision,
    case when d.decision_rule in ('infeasible','safer') then d.new_path when d.decision_rule<>'suspend' then d.rest_path end as decided_node_path from {ox_checked} c join {ox_under_way} d using (origin, destination, from_leg)""")
def reroute_from_node(w: World) -> DataFrame:
    """Plan of every checked trip from the node its current leg begins at."""
    plan = decided_under_way(w).select(*T.START, "decision_rule", "decision", "decided_node_path")
    rows = checked(w).join(plan, T.START)
    return rows.select("trip_id", F.col("from_leg").cast("long").alias("from_leg"), "reroute_from_node", "decision_rule", "decision", "decided_node_path")


@query("j5_trip_status", f"""
    select p.trip_id, case when p.started_at>{TRIP_TIME} then 'idle' when arrived and p.trip_id%11<>0 then 'arrived' when d.decision_rule='suspend' then 'suspended'
    when d.decision_rule in ('infeasible','safer') then 'rerouting' else 'en_route' end as status from {{ox_progress}} p left join (
      select c.trip_id, u.decision_rule from {{ox_checked}} c join {{ox_under_way}} u using (origin, destination, from_leg)) d on d.trip_id=p.trip_id""")
def trip_status(w: World) -> DataFrame:
    """Decided on what lies ahead of the trip: a closed segment behind it suspends nobody."""
    decided = checked(w).join(decided_under_way(w).select(*T.START, "decision"), T.START).select("trip_id", "decision")
    rows = trip_checks(w).join(decided, "trip_id", "left")
    status = T.trip_status(F.col("started"), F.col("arrived"), F.col("was_suspended"), F.col("hazard_ahead"), F.col("decision"))
    return rows.select("trip_id", status.alias("status"))

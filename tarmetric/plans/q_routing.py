"""Routing and decision queries: every distinct origin-destination pair of the customers at once.

Four variants of the network: by minutes, by distance, risk-aware under the live context and risk-aware without any
context. A query routes the variants it names, all in one run; later queries read those and route only what is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tarmetric.functions.rounding import round_dp
from tarmetric.operators import cells as C
from tarmetric.operators import decisions as D
from tarmetric.operators import network as N
from tarmetric.operators import routing as R
from tarmetric.plans.fixtures import rnd
from tarmetric.plans.q_risk import active_hazards, calm, clamp_sql, history_sql, level_sql, live, score_sql, slope_sql
from tarmetric.plans.registry import World, define, query

OD = D.OD
GRAPHS = ["fast", "distance", "safe", "calm"]


def scored(w: World, context: str) -> DataFrame:
    """Scored segments, one per unordered node pair, under the live context or none."""
    source = {"live": live, "calm": calm}[context]
    return w.keep(f"scored_{context}", lambda: N.keep_shortest_parallel(source(w)))


def risk_edges(w: World, context: str) -> DataFrame:
    usable = scored(w, context).filter(R.is_usable(F.col("risk_score"), F.col("closed")))
    return N.directed_edges(usable.select("segment_id", "from_node_id", "to_node_id", "bidirectional", "distance_km", "travel_time_min", "risk_score", "risk_level"))


def all_edges(w: World, graphs: list[str] = GRAPHS) -> DataFrame:
    """Arcs of the variants ``graphs``; the live context is worked out only for the variant that has it."""
    minutes = F.col("travel_time_min")

    def arcs(graph: str) -> DataFrame:
        if graph in ("fast", "distance"):
            plain = N.directed_edges(scored(w, "calm").select("segment_id", "from_node_id", "to_node_id", "bidirectional", "distance_km", "travel_time_min"))
            return R.weighted(plain, graph, minutes if graph == "fast" else F.col("distance_km"))
        return R.weighted(risk_edges(w, "live" if graph == "safe" else "calm"), graph, R.risk_cost(minutes, F.col("risk_score")))

    # written, since routes and their costs both read them
    return w.keep_parts("arcs", "graph", graphs, lambda new: reduce(DataFrame.unionByName, [arcs(g) for g in new]))


def corridor(w: World) -> DataFrame:
    return D.corridor_pairs(w["place"].select("pos", "node_id"), "pos")


def pairs(w: World) -> DataFrame:
    legs = corridor(w).filter("origin <> destination").select(*OD)
    return w.keep("pairs", lambda: w["od_pair"].unionByName(legs).distinct())


def requests(w: World, graphs: list[str] = GRAPHS) -> DataFrame:
    return pairs(w).select(F.explode(F.array(*[F.lit(g) for g in graphs])).alias("graph"), *OD)


def places(w: World) -> DataFrame:
    return w.nodes.select(F.col("node_id").alias("node"), "lat", "lng")


def legs(w: World, *graphs: str) -> DataFrame:
    """Legs of the variants ``graphs`` (all without any)."""
    return w.keep_parts("legs", "graph", graphs or GRAPHS, lambda new: C.routes_between(all_edges(w, new), requests(w, new), places(w)))


def costs(w: World, *graphs: str) -> DataFrame:
    return w.keep_parts("costs", "graph", graphs or GRAPHS, lambda new: C.route_costs(legs(w, *new), all_edges(w, new)))


def routes(w: World, *graphs: str) -> DataFrame:
    return w.keep_parts("routes", "graph", graphs or GRAPHS, lambda new: R.assemble_routes(legs(w, *new), scored(w, "calm")))


def summary(w: World, graph: str, context: str) -> DataFrame:
    """Route totals and risk profile of one network variant under one context."""
    def build() -> DataFrame:
        own = legs(w, graph).drop("graph")
        profile = R.risk_profiles(R.leg_risks(own, scored(w, context)), OD)
        return routes(w, graph).drop("graph").join(profile, OD)

    return w.keep(f"summary_{graph}_{context}", build)


def comparison(w: World, context: str) -> DataFrame:
    graph = "safe" if context == "live" else "calm"
    routes(w, "fast", graph)  # in one run
    return D.compare_routes(pairs(w), summary(w, "fast", context), summary(w, graph, context))


# Comparison views.
define("ox_calm_seg", "select *, false as closed, " + level_sql("risk_score") + " as risk_level from (select *, " + score_sql(w="cast(null as double)", i="cast(null as double)") + " as risk_score from {ox_collapsed})")
define("ox_live_seg", "select * from {ox_live} where segment_id in (select segment_id from {ox_collapsed})")
DIRECTED = """select from_node_id as src, to_node_id as dst, {cols} from {view} where {cond}
    union all select to_node_id, from_node_id, {cols} from {view} where bidirectional and {cond}"""


def directed(view: str, cond: str, cols: str) -> str:
    return DIRECTED.replace("{view}", "{" + view + "}").replace("{cond}", cond).replace("{cols}", cols)


SAFE = "not closed and risk_score<65e-2"
define("ox_edge", " union all ".join([
    "select 'fast' as graph, * from (" + directed("ox_calm_seg", "true", "travel_time_min as cost, segment_id") + ")",
    "select 'distance', * from (" + directed("ox_calm_seg", "true", "distance_km as cost, segment_id") + ")",
    "select 'safe', * from (" + directed("ox_live_seg", SAFE, "travel_time_min*(1e0+2e0*risk_score) as cost, segment_id") + ")",
    "select 'calm', * from (" + directed("ox_calm_seg", SAFE, "travel_time_min*(1e0+2e0*risk_score) as cost, segment_id") + ")",
]))
define("ox_corridor", "select pos as leg_no, node_id as origin, lead(node_id) over (order by pos) as destination from {place}")
define("ox_pair", "select * from {od_pair} union select origin, destination from {ox_corridor} where destination is not null and origin<>destination")
define("ox_sp", """
    select graph, node_id, node_id, 0e0, cast([] as varchar[]), cast(node_id as varchar) from {road_node} cross join (select distinct graph from {ox_edge})
    union
    select e.graph, s.origin, e.dst, min(s.cost+e.cost), arg_min(list_append(s.segs, e.segment_id), s.cost+e.cost), arg_min(concat(s.path, '>', cast(e.dst as varchar)), s.cost+e.cost)
    from {ox_sp} s join {ox_edge} e on e.graph=s.graph and e.src=s.node left join recurring.{ox_sp} k on k.graph=s.graph and k.origin=s.origin and k.node=e.dst
    where k.cost is null or s.cost+e.cost<k.cost group by 1,2,3""", "ox_sp(graph, origin, node, cost, segs, path) using key (graph, origin, node)")
define("ox_found", "select s.graph, p.origin, p.destination, s.cost, s.segs, s.path from {ox_pair} p join {ox_sp} s on s.origin=p.origin and s.node=p.destination where s.cost>0")
define("ox_leg", """
    select graph, origin, destination, leg_idx, segment_id, cast(split_part(path, '>', leg_idx+1) as bigint) as u, cast(split_part(path, '>', leg_idx+2) as bigint) as v from (
      select graph, origin, destination, path, unnest(segs) as segment_id, generate_subscripts(segs, 1)-1 as leg_idx from {ox_found})""")
define("ox_route", """
    select graph, origin, destination, any_value(cost) as cost, any_value(path) as node_path, count(*) as legs, """ + rnd("sum(distance_km)", 2) + " as total_distance_km, "
    + rnd("sum(travel_time_min)", 1) + """ as estimated_travel_time_min from {ox_leg} join (select graph, origin, destination, cost, path from {ox_found}) using (graph, origin, destination)
    join (select segment_id, distance_km, travel_time_min from {ox_collapsed}) using (segment_id) group by 1,2,3""")


def profile_sql(ctx: str) -> str:
    return """
    select graph, origin, destination, """ + rnd("greatest(0e0, least(1e0, 7e-1*max(risk_score)+(1e0-7e-1)*(sum(cast(round(risk_score*1e4) as bigint))/1e4/count(*))))", 4) + """ as aggregate_risk_score,
    max(risk_score) as max_segment_risk, min_by(segment_id, (-risk_score, leg_idx)) as max_risk_segment_id, min_by(risk_level, (-risk_score, leg_idx)) as max_risk_level,
    count_if(risk_level='low') as n_low, count_if(risk_level='moderate') as n_moderate, count_if(risk_level='high') as n_high, count_if(risk_level='critical') as n_critical,
    count_if(closed or risk_score>=65e-2) as unsafe_segment_count from {ox_leg} join {""" + ctx + "} using (segment_id) group by 1,2,3"


define("ox_profile_live", profile_sql("ox_live_seg"))
define("ox_profile_calm", profile_sql("ox_calm_seg"))
define("ox_sum_live", "select * from {ox_route} join {ox_profile_live} using (graph, origin, destination)")
define("ox_sum_calm", "select * from {ox_route} join {ox_profile_calm} using (graph, origin, destination)")


def compare_sql(summary_view: str, safe_graph: str) -> str:
    return f"""
    select p.origin, p.destination, f.node_path as fastest_node_path, s.node_path as recommended_node_path, f.estimated_travel_time_min as fastest_min, s.estimated_travel_time_min as recommended_min,
    f.aggregate_risk_score as fastest_score, s.aggregate_risk_score as recommended_score, f.unsafe_segment_count as fastest_unsafe,
    case when f.node_path is null then 'no_route' when s.node_path is null then 'no_safe_route_available' when s.node_path=f.node_path then 'fastest_route_is_safe' else 'safer_route_selected' end as outcome,
    """ + rnd("s.estimated_travel_time_min-f.estimated_travel_time_min", 1) + f""" as extra_minutes from {{ox_pair}} p
    left join (select * from {{{summary_view}}} where graph='fast') f using (origin, destination) left join (select * from {{{summary_view}}} where graph='{safe_graph}') s using (origin, destination)"""


define("ox_cmp_live", compare_sql("ox_sum_live", "safe"))
define("ox_cmp_calm", compare_sql("ox_sum_calm", "calm"))


def found(w: World, graph: str) -> DataFrame:
    return costs(w, graph).select(*OD, "cost")


@query("h1_fastest_paths", "select origin, destination, " + rnd("cost", 6) + " as cost, legs, node_path from {ox_route} where graph='fast'")
def fastest_paths(w: World) -> DataFrame:
    path = routes(w, "fast").select(*OD, "legs", "node_path")
    return found(w, "fast").select(*OD, round_dp("cost", 6).alias("cost")).join(path, OD)


@query("h2_shortest_by_distance", "select origin, destination, " + rnd("cost", 4) + " as cost from {ox_found} where graph='distance'")
def shortest_by_distance(w: World) -> DataFrame:
    return found(w, "distance").select(*OD, round_dp("cost", 4).alias("cost"))


@query("h3_h4_risk_graph", "select src, dst, segment_id, " + rnd("cost", 5) + " as cost from {ox_edge} where graph='safe'")
def risk_graph(w: World) -> DataFrame:
    cost = R.risk_cost(F.col("travel_time_min"), F.col("risk_score"))
    return risk_edges(w, "live").select("src", "dst", "segment_id", round_dp(cost, 5).alias("cost"))


@query("h5_risk_aware_paths", """
    select p.origin, p.destination, case when s.node_path is not null then 'ok' when f.node_path is not null then 'no_safe_route' else 'no_route' end as status, s.node_path, """ + rnd("s.cost", 5) + """ as cost
    from {ox_pair} p left join (select * from {ox_route} where graph='safe') s using (origin, destination) left join (select * from {ox_route} where graph='fast') f using (origin, destination)""")
def risk_aware_paths(w: World) -> DataFrame:
    costs(w, "fast", "safe")  # in one run
    safe = found(w, "safe").select(*OD, round_dp("cost", 5).alias("cost")).join(routes(w, "safe").select(*OD, "node_path"), OD)
    road = found(w, "fast").select(*OD, F.lit(True).alias("_road"))
    out = pairs(w).join(safe, OD, "left").join(road, OD, "left")
    status = F.when(F.col("node_path").isNotNull(), "ok").when(F.col("_road"), "no_safe_route").otherwise("no_route")
    return out.select(*OD, status.alias("status"), "node_path", "cost")


@query("h6_route_assembly", """
    select graph, origin, destination, legs, node_path, total_distance_km, estimated_travel_time_min, 2*legs+1 as vertices, """ + rnd("lat_sum", 6) + """ as lat_sum from {ox_route} join (
      select graph, origin, destination, sum(latm+b.lat)+any_value(a.lat) as lat_sum from {ox_leg} join (select segment_id, latm from {ox_collapsed}) using (segment_id)
      join {road_node} b on b.node_id=v join {road_node} a on a.node_id=origin group by 1,2,3) using (graph, origin, destination)""")
def route_assembly(w: World) -> DataFrame:
    g = R.route_geometry(legs(w), scored(w, "calm"))
    lat_sum = F.aggregate("geometry", F.lit(0.0), lambda s, p: s + p["lat"])
    shape = g.select(*R.ROUTE, F.size("geometry").cast("long").alias("vertices"), round_dp(lat_sum, 6).alias("lat_sum"))
    return routes(w).join(shape, R.ROUTE)


@query("h7_remaining_routes", """
    select r.origin, r.destination, k as from_leg, count(l.leg_idx) as legs, """ + rnd("coalesce(sum(s.distance_km),0e0)", 2) + " as total_distance_km, " + rnd("coalesce(sum(s.travel_time_min),0e0)", 1) + """ as estimated_travel_time_min
    from (select *, case when origin%10=0 then legs else cast(floor(legs/2) as bigint) end as k from {ox_route} where graph='fast') r
    left join {ox_leg} l on l.graph='fast' and l.origin=r.origin and l.destination=r.destination and l.leg_idx>=k left join {ox_collapsed} s on s.segment_id=l.segment_id group by 1,2,3""")
def remaining_routes(w: World) -> DataFrame:
    start = routes(w, "fast").select(
        *OD, F.when(F.col("origin") % 10 == 0, F.col("legs")).otherwise(F.floor(F.col("legs") / 2)).alias("from_leg")
    )
    own = legs(w, "fast").drop("graph")
    return R.remaining_routes(own, start, scored(w, "calm"), OD).drop("node_path")


@query("h8_leg_risks", "select origin, destination, leg_idx, segment_id, risk_score, risk_level, closed from {ox_leg} join (select segment_id, risk_score, risk_level, closed from {ox_live_seg}) using (segment_id) where graph='fast'")
def leg_risks(w: World) -> DataFrame:
    own = legs(w, "fast")
    return R.leg_risks(own, scored(w, "live")).select(*OD, F.col("leg_idx").cast("long").alias("leg_idx"), "segment_id", "risk_score", "risk_level", "closed")


PROFILE = "aggregate_risk_score, max_segment_risk, max_risk_segment_id, max_risk_level, n_low, n_moderate, n_high, n_critical, unsafe_segment_count"


@query("h9_route_profiles", f"select origin, destination, {PROFILE} from {{ox_profile_live}} where graph='fast'")
def route_profiles(w: World) -> DataFrame:
    return summary(w, "fast", "live").select(*OD, *PROFILE.split(", "))


COMPARED = {
    "fastest_node_path": "fastest_node_path", "recommended_node_path": "recommended_node_path", "fastest_min": "fastest_estimated_travel_time_min",
    "recommended_min": "recommended_estimated_travel_time_min", "fastest_score": "fastest_aggregate_risk_score",
    "recommended_score": "recommended_aggregate_risk_score", "fastest_unsafe": "fastest_unsafe_segment_count",
}


@query("h10_route_comparison", "select * from {ox_cmp_live}")
def route_comparison(w: World) -> DataFrame:
    return comparison(w, "live").select(*OD, *[F.col(c).alias(k) for k, c in COMPARED.items()], "outcome", "extra_minutes")


define("ox_alt", """
    select origin, destination, origin from {ox_pair} union
    select r.origin, r.destination, e.dst from {ox_alt} r join {ox_edge} e on e.graph='fast' and e.src=r.node
    left join (select origin as o, destination as d, u, v from {ox_leg} where graph='fast') l on l.o=r.origin and l.d=r.destination and l.u=e.src and l.v=e.dst where l.u is null""", "ox_alt(origin, destination, node)")


@query("h11_alternative_exists", "select origin, destination, bool_or(node=destination) as has_alternative from {ox_alt} group by 1,2")
def alternative_exists(w: World) -> DataFrame:
    edges = all_edges(w, ["fast"])
    return C.alternative_exists(edges, legs(w, "fast"), pairs(w), places(w))


def previous(w: World) -> DataFrame:
    """What four of five pairs followed before the hazards: the calm recommendation, profiled now."""
    return summary(w, "calm", "live").filter("origin % 5 <> 0")


def decisions(w: World) -> DataFrame:
    def build() -> DataFrame:
        routes(w, "fast", "safe", "calm")  # in one run
        return D.decide(comparison(w, "live"), previous(w))

    return w.keep("decisions", build)


RULE = """case when outcome='no_route' then 'no_route' when outcome='no_safe_route_available' then 'suspend' when v.node_path is null then 'accept' when v.node_path=recommended_node_path then 'unchanged'
    when v.unsafe_segment_count>0 then 'infeasible' when round((v.aggregate_risk_score-recommended_score)*1e4)<500 then 'hysteresis' else 'safer' end"""
define("ox_decision", """
    select *, case when decision_rule in ('infeasible','safer') then 'reroute' when decision_rule in ('no_route','suspend') then decision_rule else 'continue' end as decision,
    case when decision_rule in ('unchanged','hysteresis') then 0e0 when decision_rule in ('infeasible','safer') then """ + rnd("recommended_min-previous_min", 1) + """ end as eta_change_min,
    case when decision_rule in ('unchanged','hysteresis') then previous_node_path when decision_rule in ('accept','infeasible','safer') then recommended_node_path end as decided_node_path from (
      select c.*, v.node_path as previous_node_path, v.estimated_travel_time_min as previous_min, """ + RULE + """ as decision_rule from {ox_cmp_live} c
      left join (select * from {ox_sum_live} where graph='calm' and origin%5<>0) v using (origin, destination))""")


@query("h12_route_decisions", "select origin, destination, outcome, decision_rule, decision, eta_change_min, decided_node_path from {ox_decision}")
def route_decisions(w: World) -> DataFrame:
    return decisions(w).select(*OD, "outcome", "decision_rule", "decision", "eta_change_min", "decided_node_path")


@query("h13_decision_hazards", """
    select origin, destination, decision, (select count(distinct segment_id) from {ox_active}) as affected_segments, (select count(distinct hazard_id) from {ox_active}) as active_hazards from {ox_decision}""")
def decision_hazards(w: World) -> DataFrame:
    return D.attach_hazards(decisions(w).select(*OD, "decision"), active_hazards(w))


@query("h13_affected_segments", "select segment_id, count(distinct hazard_id) as active_hazards from {ox_active} group by 1")
def affected_segments(w: World) -> DataFrame:
    return D.affected_segments(active_hazards(w))


@query("h13_route_hazard_ids", """
    select distinct l.graph, l.origin, l.destination, a.hazard_id, d.decision from {ox_leg} l join {ox_active} a using (segment_id) join {ox_decision} d on d.origin=l.origin and d.destination=l.destination where l.graph in ('fast', 'calm')""")
def route_hazard_ids(w: World) -> DataFrame:
    """The hazards behind each decision: those on the fastest route and on the one followed before."""
    decided = decisions(w).select(*OD, "decision")
    return D.route_hazards(legs(w, "fast", "calm"), active_hazards(w)).join(decided, OD)


@query("h14_corridor_legs", """
    select leg_no, c.origin, c.destination, outcome, fastest_score, recommended_score from {ox_corridor} c join {ox_cmp_live} m on m.origin=c.origin and m.destination=c.destination""")
def corridor_legs(w: World) -> DataFrame:
    found_ = comparison(w, "live").select(*OD, "outcome", F.col("fastest_aggregate_risk_score").alias("fastest_score"), F.col("recommended_aggregate_risk_score").alias("recommended_score"))
    return corridor(w).join(found_, OD).select("leg_no", *OD, "outcome", "fastest_score", "recommended_score")


define("ox_after", """
    select c.origin, c.destination, case when c.outcome='no_route' then 'no_route' when c.outcome='no_safe_route_available' then 'suspend' when v.node_path is null then 'continue' when v.node_path=c.recommended_node_path then 'continue'
    when v.unsafe_segment_count>0 then 'reroute' when round((v.aggregate_risk_score-c.recommended_score)*1e4)<500 then 'continue' else 'reroute' end as decision
    from {ox_cmp_calm} c left join (select * from {ox_sum_calm} where graph='safe') v using (origin, destination)""")


@query("h15_scenario_decisions", """
    select 'before' as scenario, origin, destination, case when outcome='no_safe_route_available' then 'suspend' when outcome='no_route' then 'no_route' else 'continue' end as decision from {ox_cmp_calm}
    union all select 'hazard', origin, destination, decision from {ox_decision} union all select 'after', origin, destination, decision from {ox_after}""")
def scenario_decisions(w: World) -> DataFrame:
    """Before the hazards, under them, and after all are cleared while following the hazard-time route."""
    routes(w, "fast", "safe", "calm")  # in one run
    calm_cmp = comparison(w, "calm")
    none = summary(w, "calm", "calm").filter("false")
    parts = {
        "before": D.decide(calm_cmp, none),
        "hazard": decisions(w),
        "after": D.decide(calm_cmp, summary(w, "safe", "calm")),
    }
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("scenario"), *OD, "decision")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("h16_route_lookup", "select graph, origin, destination, node_path, total_distance_km from {ox_route} where (origin, destination)=(select (max(origin), max_by(destination, (origin, destination))) from {ox_pair})")
def route_lookup(w: World) -> DataFrame:
    last = pairs(w).agg(F.max(F.struct(*OD)).alias("k")).select("k.*")
    return routes(w).join(F.broadcast(last), OD, "left_semi").select("graph", *OD, "node_path", "total_distance_km")


@query("h17_dominant_status", """
    select origin, destination, case when decision='suspend' then 'critical' when decision='reroute' then 'caution' when decision is not null then 'safe' when outcome='no_safe_route_available' then 'critical' else 'safe' end as level,
    case when decision='suspend' then 'Suspend' when decision='reroute' then 'Reroute' when decision is not null then 'Proceed' when outcome='no_safe_route_available' then 'Suspend' else 'Proceed' end as title
    from (select origin, destination, outcome, case when destination%2=0 then decision end as decision from {ox_decision})""")
def dominant_status(w: World) -> DataFrame:
    decided = F.when(F.col("destination") % 2 == 0, F.col("decision"))
    return decisions(w).select(*OD, D.dominant_status(decided, F.col("outcome")).alias("s")).select(*OD, "s.level", "s.title")


@query("h18_route_kpis", """
    select origin, destination, total_distance_km, case when m>=60 then concat(cast(cast(floor(m/60) as bigint) as varchar), 'h ', cast(m%60 as varchar), 'm') else concat(cast(m as varchar), 'm') end as eta_text,
    legs as segments, n_high+n_critical as high_critical_segments, max_risk_level as worst_level, worst_slope_risk, worst_history_risk, worst_weather_risk, worst_incident_risk
    from (select *, cast(floor(estimated_travel_time_min+5e-1) as bigint) as m from {ox_sum_live}) join (select segment_id as max_risk_segment_id, """ + rnd(slope_sql(), 4) + " as worst_slope_risk, "
    + rnd(history_sql("historical_landslide_count", "nearest_landslide_distance_m", "landslide_hazard_score"), 4) + " as worst_history_risk, " + rnd(clamp_sql("weather_factor"), 4) + " as worst_weather_risk, "
    + rnd(clamp_sql("incident_factor"), 4) + " as worst_incident_risk from {ox_live_seg}) using (max_risk_segment_id) where graph='fast'")
def route_kpis(w: World) -> DataFrame:
    own = legs(w, "fast").drop("graph").join(scored(w, "live").select(
        "segment_id", "risk_score", "risk_level", "slope_risk", "historical_landslide_risk", "weather_risk", "incident_risk"), "segment_id")
    return D.route_kpis(summary(w, "fast", "live"), own)


@query("h19_initial_plans", """
    select trip_id, mode, case when mode='fastest' or outcome='no_safe_route_available' then fastest_node_path else recommended_node_path end as node_path,
    case when mode='fastest' or outcome='no_safe_route_available' then fastest_score else recommended_score end as aggregate_risk_score,
    case when fastest_node_path is null then 'no_route' when mode='fastest' or outcome<>'no_safe_route_available' then 'idle' else 'suspended' end as status from {trip} join {ox_cmp_live} using (origin, destination)""")
def initial_plans(w: World) -> DataFrame:
    modes = w["trip"].select("trip_id", *OD, "mode")
    return D.initial_plan(modes, summary(w, "fast", "live"), comparison(w, "live")).drop(*OD)

"""Geometry function queries: column expressions over every projected segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric.functions import geo as G
from tarmetric.functions.rounding import round_dp
from tarmetric.operators.gridjoin import containing_polygons, polyline_edges
from tarmetric.operators.terrain import terrain_samples, with_distance_along
from tarmetric.plans.fixtures import hav, rnd
from tarmetric.plans.q_network import built_network, ways
from tarmetric.plans.q_sources import zone_ring
from tarmetric.plans.registry import World, define, query


def closest_sql(lat: str, lng: str, a: str, b: str, c: str, d: str) -> str:
    """Fraction along one edge for the comparison SQL."""
    k = f"(111.32e0*cos(radians((({a})+({c}))/2e0)))"
    dx, dy = f"((({d})-({b}))*{k})", f"((({c})-({a}))*111.32e0)"
    px, py = f"((({lng})-({b}))*{k})", f"((({lat})-({a}))*111.32e0)"
    sq = f"({dx}*{dx}+{dy}*{dy})"
    return f"greatest(0e0, least(1e0, case when {sq}=0 then 0e0 else ({px}*{dx}+{py}*{dy})/{sq} end))"


define("ox_probe", """
    select e.*, e.lat1+1e-3*(seq*3+length(segment_id)%7-3) as qlat, e.lng1+2e-3*(length(segment_id)%5-1) as qlng from {road_edge} e""")
define("ox_probe_t", "select *, " + closest_sql("qlat", "qlng", "lat1", "lng1", "lat2", "lng2") + " as t from {ox_probe}")
define("ox_probe_d", """
    select *, lat1+(lat2-lat1)*t as clat, lng1+(lng2-lng1)*t as clng, """ + hav("qlat", "qlng", "lat1+(lat2-lat1)*t", "lng1+(lng2-lng1)*t") + """ as km from {ox_probe_t}""")


@query("c1_haversine", "select segment_id, " + rnd(hav("lat1", "lng1", "lat2", "lng2"), 6) + " as km from {road_segment}")
def haversine(w: World) -> DataFrame:
    return w.segments.select("segment_id", round_dp(G.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")), 6).alias("km"))


def probes(w: World) -> DataFrame:
    n = F.length("segment_id")
    return w.edges.select("*", (F.col("lat1") + 0.001 * (F.col("seq") * 3 + n % 7 - 3)).alias("qlat"), (F.col("lng1") + 0.002 * (n % 5 - 1)).alias("qlng"))


@query("c2_closest_on_edge", "select segment_id, cast(seq as bigint) as seq, " + rnd("clat", 8) + " as lat, " + rnd("clng", 8) + " as lng, " + rnd("km", 6) + " as km from {ox_probe_d}")
def closest_on_edge(w: World) -> DataFrame:
    edge = [F.col(c) for c in ("lat1", "lng1", "lat2", "lng2")]
    p = G.closest_on_edge(F.col("qlat"), F.col("qlng"), *edge)
    km = G.edge_distance_km(F.col("qlat"), F.col("qlng"), *edge)
    return probes(w).select(
        "segment_id", F.col("seq").cast("long").alias("seq"), round_dp(p["lat"], 8).alias("lat"), round_dp(p["lng"], 8).alias("lng"), round_dp(km, 6).alias("km")
    )


define("ox_line_probe", """
    select s.segment_id, e.seq, e.lat1, e.lng1, e.lat2, e.lng2, latm+1e-3*(s.way_id%9-4) as qlat, lngm+15e-4*(s.way_id%11-5) as qlng
    from {road_segment} s join {road_edge} e using (segment_id)""")
define("ox_line_t", "select *, " + closest_sql("qlat", "qlng", "lat1", "lng1", "lat2", "lng2") + " as t from {ox_line_probe}")
define("ox_line_d", "select *, " + hav("qlat", "qlng", "lat1+(lat2-lat1)*t", "lng1+(lng2-lng1)*t") + " as km from {ox_line_t}")


@query("c3_nearest_on_polyline", "select segment_id, " + rnd("min(km)", 6) + " as km from {ox_line_d} group by 1")
def nearest_on_polyline(w: World) -> DataFrame:
    lat, lng = F.col("latm") + 0.001 * (F.col("way_id") % 9 - 4), F.col("lngm") + 0.0015 * (F.col("way_id") % 11 - 5)
    near = G.nearest_on_polyline(lat, lng, F.col("geometry"))
    return w.segments.select("segment_id", round_dp(near["dist_km"], 6).alias("km"))


H1, H2 = hav("lat1", "lng1", "latm", "lngm"), hav("latm", "lngm", "lat2", "lng2")


@query("c4_interpolate_along", """
    select segment_id, """ + rnd("case when target<=0 then lat1 when target<=h1 then lat1+(latm-lat1)*target/h1 else latm+(lat2-latm)*least(1e0,(target-h1)/h2) end", 8) + """ as lat,
    """ + rnd("case when target<=0 then lng1 when target<=h1 then lng1+(lngm-lng1)*target/h1 else lngm+(lng2-lngm)*least(1e0,(target-h1)/h2) end", 8) + """ as lng
    from (select *, """ + H1 + " as h1, " + H2 + """ as h2, (way_id%14-1)/1e1*distance_km as target from {road_segment})""")
def interpolate_along(w: World) -> DataFrame:
    p = G.interpolate_along(F.col("geometry"), (F.col("way_id") % 14 - 1) / 10.0 * F.col("distance_km"))
    return w.segments.select("segment_id", round_dp(p["lat"], 8).alias("lat"), round_dp(p["lng"], 8).alias("lng"))


define("ox_cut", """
    select segment_id, seq, lat1, lng1, lat2, lng2, cast(greatest(1, ceil(""" + hav("lat1", "lng1", "lat2", "lng2") + """*1e3/9e1)) as bigint) as n from {ox_built_edge}
    where """ + hav("lat1", "lng1", "lat2", "lng2") + ">0")
define("ox_built_step", """
    select s.segment_id, r.seq, r.lat, r.lng from {ox_runv} r join {ox_kept} k on k.way_id=r.way_id and k.run=r.run
    join {ox_built} s on s.way_id=k.way_id and s.run_index=k.run_index""")
define("ox_built_edge", """
    select * from (select segment_id, row_number() over p - 2 as seq, lag(lat) over p as lat1, lag(lng) over p as lng1, lat as lat2, lng as lng2
    from {ox_built_step} window p as (partition by segment_id order by seq)) where lat1 is not null""")
define("ox_sample", """
    select segment_id, row_number() over (partition by segment_id order by seq, k)-1 as seq, lat, lng from (
      select segment_id, seq, k, lat1+(lat2-lat1)*(k*1e0/n) as lat, lng1+(lng2-lng1)*(k*1e0/n) as lng from (select *, unnest(range(1, n+1)) as k from {ox_cut})
      union all select segment_id, -1, 0, lat1, lng1 from {ox_built_edge} where seq=0)""")
define("ox_along", """
    select *, sum(coalesce(step,0e0)) over (partition by segment_id order by seq)*1e3 as along_m from (
      select *, """ + hav("lag(lat) over p", "lag(lng) over p", "lat", "lng") + """ as step from {ox_sample} window p as (partition by segment_id order by seq))""")


@query("c5_resample_line", "select segment_id, seq, " + rnd("lat", 8) + " as lat, " + rnd("lng", 8) + " as lng from {ox_sample}")
def resample_line(w: World) -> DataFrame:
    return terrain_samples(built_network(w)).select(
        "segment_id", F.col("seq").cast("long").alias("seq"), round_dp("lat", 8).alias("lat"), round_dp("lng", 8).alias("lng")
    )


@query("c6_cumulative_distance", "select segment_id, seq, " + rnd("along_m", 4) + " as along_m from {ox_along}")
def cumulative_distance(w: World) -> DataFrame:
    return with_distance_along(terrain_samples(built_network(w))).select(
        "segment_id", F.col("seq").cast("long").alias("seq"), round_dp("along_m", 4).alias("along_m")
    )


@query("c7_representative_point", """
    select segment_id, lat, lng from (select segment_id, seq, lat, lng, row_number() over (partition by segment_id order by seq)-1 as i,
    count(*) over (partition by segment_id) as n from {ox_built_step}) where i=cast(floor(n/2e0) as bigint)""")
def representative_point(w: World) -> DataFrame:
    p = G.representative_point(F.col("geometry"))
    return built_network(w).select("segment_id", p["lat"].alias("lat"), p["lng"].alias("lng"))


@query("c8_travel_direction", """
    select segment_id, way_id%2=0 as forward, case when way_id%2=0 then lat1 else lat2 end as start_lat, case when way_id%2=0 then lng2 else lng1 end as end_lng from {road_segment}""")
def travel_direction(w: World) -> DataFrame:
    forward = F.col("way_id") % 2 == 0
    entered = F.when(forward, F.col("from_node_id")).otherwise(F.col("to_node_id"))
    g = G.in_travel_direction(F.col("geometry"), F.col("from_node_id"), entered)
    return w.segments.select("segment_id", forward.alias("forward"), g[0]["lat"].alias("start_lat"), F.element_at(g, -1)["lng"].alias("end_lng"))


@query("c9_join_pieces", "select way_id, count(*) as vertices, " + rnd("sum(lat)", 6) + " as lat_sum from {ox_vertex} group by 1")
def join_pieces(w: World) -> DataFrame:
    """Each way cut into its single edges and joined again."""
    pieces = F.transform(G.edges_of(F.col("geometry")), lambda e: F.array(e["a"], e["b"]))
    joined = ways(w).select("way_id", G.join_pieces(pieces).alias("g"))
    return joined.select(
        "way_id", F.size("g").cast("long").alias("vertices"), round_dp(F.aggregate("g", F.lit(0.0), lambda s, p: s + p["lat"]), 6).alias("lat_sum")
    )


@query("c10_point_in_polygon", """
    select slide_no, polygon_id from {landslide} join {landslide_zone} on latitude>y0 and latitude<y1 and longitude>x0 and longitude<x1""")
def point_in_polygon(w: World) -> DataFrame:
    points = w["landslide"].select("slide_no", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return containing_polygons(points, zone_ring(w["landslide_zone"])).select("slide_no", "polygon_id")


@query("c3_polyline_edges", "select segment_id, count(*) as edges, " + rnd("sum(" + hav("lat1", "lng1", "lat2", "lng2") + ")", 6) + " as km from {ox_built_edge} group by 1")
def edges_of_polylines(w: World) -> DataFrame:
    e = polyline_edges(built_network(w))
    km = G.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    return e.groupBy("segment_id").agg(F.count(F.lit(1)).alias("edges"), round_dp(F.sum(km), 6).alias("km"))

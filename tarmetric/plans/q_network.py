"""Network construction queries over the raw ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric.functions.rounding import round_dp
from tarmetric.functions.risk import base_risk, terrain_class
from tarmetric.operators import network as N
from tarmetric.plans.fixtures import SPEED_CASE, hav, rnd
from tarmetric.plans.q_sources import ways_of
from tarmetric.plans.registry import World, define, query


def ways(w: World) -> DataFrame:
    return w.keep("ways", lambda: ways_of(w))


def built_nodes(w: World) -> DataFrame:
    return w.keep("built_nodes", lambda: N.number_nodes(N.junctions(N.way_vertices(ways(w)))))


def built_segments(w: World) -> DataFrame:
    def build() -> DataFrame:
        vertices = N.way_vertices(ways(w))
        runs = N.assemble_runs(N.split_runs(vertices, built_nodes(w)))
        return N.segment_attributes(runs, ways(w))

    return w.keep("built_all_segments", build)


def built_network(w: World) -> DataFrame:
    return w.keep("built_segments", lambda: N.keep_shortest_parallel(built_segments(w)))


# Comparison views.
define("ox_vertex", """
    select v.way_id, row_number() over (partition by v.way_id order by v.seq)-1 as seq, lat, lng, cast(floor(lat*1e6+5e-1) as bigint) as yk, cast(floor(lng*1e6+5e-1) as bigint) as xk,
           row_number() over (partition by v.way_id order by v.seq)=1 or row_number() over (partition by v.way_id order by v.seq desc)=1 as is_end
    from {way_vertex} v join (select way_id from {way_vertex} group by 1 having count(*)>=2) k on k.way_id=v.way_id""")
define("ox_node", """
    select printf('n%05d', row_number() over (order by yk, xk)-1) as node_id, yk, xk, yk/1e6 as lat, xk/1e6 as lng, touches
    from (select yk, xk, count(*) as touches, bool_or(is_end) as e from {ox_vertex} group by 1,2) where touches>=2 or e""")
define("ox_flag", """
    select v.*, n.node_id, sum(case when n.node_id is null then 0 else 1 end) over (partition by way_id order by seq) as j
    from {ox_vertex} v left join {ox_node} n on n.yk=v.yk and n.xk=v.xk""")
define("ox_runv", """
    select way_id, j-1 as run, seq, lat, lng, node_id from {ox_flag}
    union all select way_id, j-2, seq, lat, lng, node_id from {ox_flag} where node_id is not null and j>=2""")
define("ox_step", """
    select *, """ + hav("lag(lat) over p", "lag(lng) over p", "lat", "lng") + """ as km from {ox_runv} window p as (partition by way_id, run order by seq)""")
define("ox_run", """
    select way_id, run, min_by(node_id, seq) as a, max_by(node_id, seq) as b, sum(km) as km, count(*) as vertices
    from {ox_step} group by 1,2 having count(*)>=2""")
define("ox_kept", "select *, row_number() over (partition by way_id order by run)-1 as run_index from {ox_run} where a<>b")
define("ox_built_all", """
    select concat('seg_', cast(way_id as varchar), '_', cast(run_index as varchar)) as segment_id, way_id, run_index, a, b, vertices, name, ref,
           case when highway in ('residential','motorway') then 'unclassified' else highway end as road_type,
           lower(trim(coalesce(oneway,'')))<>'yes' as bidirectional, """ + rnd("km", 4) + """ as distance_km,
           """ + rnd("km/speed*6e1", 2) + """ as travel_time_min, """ + rnd("speed", 1) + """ as assumed_speed_kph
    from (select k.*, t.*, coalesce(nullif(try_cast(split_part(trim(maxspeed),' ',1) as double),0e0), """ + SPEED_CASE.format(c="highway") + """) as speed
          from {ox_kept} k join (select way_id as wid, name, highway, ref, oneway, maxspeed from {way_tag}) t on t.wid=k.way_id)""")
define("ox_built", """
    select * exclude r from (select *, row_number() over (partition by least(a,b), greatest(a,b) order by distance_km, segment_id) as r from {ox_built_all}) where r=1""")


@query("b1_coordinate_keys", "select yk as lat_key, xk as lng_key, count(*) as touches from {ox_vertex} group by 1,2")
def coordinate_keys(w: World) -> DataFrame:
    return N.way_vertices(ways(w)).groupBy("lat_key", "lng_key").agg(F.count(F.lit(1)).alias("touches"))


@query("b2_junctions", "select yk as lat_key, xk as lng_key, touches from {ox_node}")
def junctions(w: World) -> DataFrame:
    return N.junctions(N.way_vertices(ways(w))).select("lat_key", "lng_key", "touches")


@query("b3_node_ids", "select node_id, lat, lng from {ox_node}")
def node_ids(w: World) -> DataFrame:
    return built_nodes(w).select("node_id", "lat", "lng")


@query("b4_way_runs", "select way_id, run, count(*) as vertices, min(seq) as first_seq, max(seq) as last_seq from {ox_runv} group by 1,2")
def way_runs(w: World) -> DataFrame:
    runs = N.split_runs(N.way_vertices(ways(w)), built_nodes(w))
    seq = F.col("seq").cast("long")
    return runs.groupBy("way_id", F.col("raw_run").alias("run")).agg(
        F.count(F.lit(1)).alias("vertices"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq")
    )




@query("b5_kept_runs", "select way_id, run_index, a as from_node_id, b as to_node_id, vertices from {ox_kept}")
def kept_runs(w: World) -> DataFrame:
    return built_segments(w).select(
        "way_id", F.col("run_index").cast("long").alias("run_index"), "from_node_id", "to_node_id", F.size("geometry").cast("long").alias("vertices")
    )


@query("b6_parallel_collapsed", "select segment_id, a as from_node_id, b as to_node_id, distance_km from {ox_built}")
def parallel_collapsed(w: World) -> DataFrame:
    return built_network(w).select("segment_id", "from_node_id", "to_node_id", "distance_km")


define("ox_collapsed", """
    select * exclude r from (select *, row_number() over (partition by least(from_node_id,to_node_id), greatest(from_node_id,to_node_id)
    order by distance_km, segment_id) as r from {road_segment}) where r=1""")


@query("b6_parallel_collapsed_dense", "select segment_id, from_node_id, to_node_id, distance_km from {ox_collapsed}")
def parallel_collapsed_dense(w: World) -> DataFrame:
    return N.keep_shortest_parallel(w.segments).select("segment_id", "from_node_id", "to_node_id", "distance_km")


@query("b7_b10_segment_attributes", """
    select segment_id, road_type, bidirectional, distance_km, travel_time_min, assumed_speed_kph, name, ref from {ox_built_all}""")
def segment_attributes(w: World) -> DataFrame:
    return built_segments(w).select(
        "segment_id", "road_type", "bidirectional", "distance_km", "travel_time_min", "assumed_speed_kph", "name", "ref"
    )


@query("b11_named_place_nodes", """
    select name, node_id, nearest_km from (select p.name, n.node_id, """ + rnd(hav("p.lat", "p.lng", "n.lat", "n.lng"), 7) + """ as nearest_km,
    row_number() over (partition by p.name order by """ + rnd(hav("p.lat", "p.lng", "n.lat", "n.lng"), 7) + """, n.node_id) as r
    from {place} p cross join {ox_node} n) where r=1""")
def named_place_nodes(w: World) -> DataFrame:
    tagged = N.tag_named_places(built_nodes(w), w["place"].drop("node_id"), max_km=60.0)
    return tagged.select("name", "node_id", "nearest_km")


@query("b12_dangling_endpoints", """
    select segment_id, a as node_id from {ox_built} where a in (select node_id from {ox_node} where touches=2)
    union all select segment_id, b from {ox_built} where b in (select node_id from {ox_node} where touches=2)""")
def dangling_endpoints(w: World) -> DataFrame:
    """References that break when the twice-touched nodes are left out of the node table."""
    return N.dangling_endpoints(built_nodes(w).join(N.junctions(N.way_vertices(ways(w))).filter("touches <> 2"), ["lat_key", "lng_key"], "left_semi"), built_network(w))


@query("b12_intact_network", """
    select count(*) as segments, cast(0 as bigint) as dangling from {ox_built}""")
def intact_network(w: World) -> DataFrame:
    bad = N.dangling_endpoints(built_nodes(w), built_network(w)).agg(F.count(F.lit(1)).alias("dangling"))
    return built_network(w).agg(F.count(F.lit(1)).alias("segments")).crossJoin(F.broadcast(bad))


@query("b13_b14_terrain_base_risk", """
    select segment_id, terrain_type, floor(least(1e0, case terrain_type when 'plain' then 5e-2 when 'hill' then 15e-2 else 25e-2 end
      +4e-1*coalesce(landslide_hazard_score,0e0)+2e-1*(way_id%5)/5e0)*1e3+5e-1)/1e3 as base_risk from {road_segment}""")
def terrain_base_risk(w: World) -> DataFrame:
    terrain = terrain_class(F.col("elevation_m"))
    flood = F.col("way_id") % 5 / 5.0
    return w.segments.select(
        "segment_id", terrain.alias("terrain_type"),
        base_risk(terrain, F.coalesce("landslide_hazard_score", F.lit(0.0)), flood).alias("base_risk"),
    )


TERRAIN_SQL = """
    select s.segment_id, s.latm, s.lngm, case when s.way_id%9=0 then null else """ + rnd("s.elevation_m", 1) + """ end as dem,
           p.elevation_m as ref, row_number() over (partition by s.segment_id order by """ + hav("s.latm", "s.lngm", "p.lat", "p.lng") + """, p.elevation_m) as r,
           s.slope_deg
    from {road_segment} s cross join {place} p"""
define("ox_terrain", TERRAIN_SQL)


@query("b15_b16_elevation_fallback", """
    select segment_id, coalesce(dem, ref) as elevation_m, case when dem is null then null else floor(slope_deg*1e2+5e-1)/1e2 end as slope_deg,
           case when coalesce(dem, ref)<3e2 then 'plain' when coalesce(dem, ref)<15e2 then 'hill' else 'mountain' end as terrain_type,
           case when dem is null then 'fallback: nearest reference place' else 'real: elevation samples' end as elevation_source,
           case when dem is null then 'unavailable' when slope_deg is null then 'insufficient samples' else 'real: mean absolute gradient' end as slope_source
    from {ox_terrain} where r=1""")
def elevation_fallback(w: World) -> DataFrame:
    sampled = w.segments.filter("way_id % 9 <> 0").select("segment_id", "elevation_m", "slope_deg")
    out = N.with_terrain(w.segments.drop("elevation_m", "slope_deg", "terrain_type"), sampled, w["place"])
    return out.select(
        "segment_id", "elevation_m", "slope_deg", "terrain_type",
        F.col("source")["elevation_m"].alias("elevation_source"), F.col("source")["slope_deg"].alias("slope_source"),
    )


@query("b17_directed_edges", """
    select src, dst, max(segment_id) as segment_id from (
      select from_node_id as src, to_node_id as dst, segment_id from {road_segment}
      union all select to_node_id, from_node_id, segment_id from {road_segment} where bidirectional) group by 1,2""")
def directed_edges(w: World) -> DataFrame:
    return N.directed_edges(w.segments).select("src", "dst", "segment_id")


# Components of what is left of the network after every steep or high segment is removed.
LOW = "elevation_m < 3000 and slope_deg < 20"
define("ox_low", "select from_node_id as a, to_node_id as b from {ox_collapsed} where " + LOW + " union select to_node_id, from_node_id from {ox_collapsed} where " + LOW)
define("ox_reach", """
    select node_id, node_id from {road_node} union select r.node_id, l.b from {ox_reach} r join {ox_low} l on l.a=r.other""", "ox_reach(node_id, other)")
define("ox_component", "select node_id, min(other) as component from {ox_reach} group by 1")


def components(w: World) -> DataFrame:
    low = N.keep_shortest_parallel(w.segments).filter(LOW)
    return w.keep("component", lambda: N.weak_components(w.nodes, low))


@query("b18_components", "select node_id, component from {ox_component}")
def weak_components(w: World) -> DataFrame:
    return components(w)


define("ox_main", """
    select node_id from {ox_component} where component = (select component from {ox_component} group by 1 order by count(*) desc, component limit 1)""")


@query("b18_main_component", "select node_id from {ox_main}")
def main_component(w: World) -> DataFrame:
    return N.main_component(components(w))


@query("b19_network_box", """
    select slide_no, latitude between lo_y and hi_y and longitude between lo_x and hi_x as inside from {landslide}
    cross join (select min(lat) as lo_y, max(lat) as hi_y, min(lng) as lo_x, max(lng) as hi_x from {road_node}) b""")
def network_box(w: World) -> DataFrame:
    boxed = w["landslide"].crossJoin(F.broadcast(N.bounding_box(w.nodes)))
    return boxed.select("slide_no", N.in_box(F.col("latitude"), F.col("longitude")).alias("inside"))


@query("b20_segment_list", """
    select segment_id, name, road_type, from_node_id, to_node_id, distance_km, slope_deg, elevation_m from {road_segment}""")
def segment_list(w: World) -> DataFrame:
    return w.segments.select("segment_id", "name", "road_type", "from_node_id", "to_node_id", "distance_km", "slope_deg", "elevation_m")


@query("b20_segment_lookup", "select segment_id, name, distance_km from {road_segment} where segment_id=(select max(segment_id) from {road_segment})")
def segment_lookup(w: World) -> DataFrame:
    last = w.segments.agg(F.max("segment_id").alias("segment_id"))
    return w.segments.join(F.broadcast(last), "segment_id", "left_semi").select("segment_id", "name", "distance_km")


@query("b20_network_summary", """
    select road_type, count(*) as segments, floor(sum(distance_km)*1e2+5e-1)/1e2 as total_km, count_if(bidirectional) as two_way from {ox_built_all} group by 1""")
def network_summary(w: World) -> DataFrame:
    return built_segments(w).groupBy("road_type").agg(
        F.count(F.lit(1)).alias("segments"), round_dp(F.sum("distance_km"), 2).alias("total_km"), F.count_if("bidirectional").alias("two_way")
    )

"""Projection of the given star-schema tables onto the road domain.

Each view is one portable SQL text, run by Spark here and by the comparison engine in the
checks. ``{name}`` stands for another view or a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tarmetric import params as P

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]

# Fixed dates of the checks.
RAIN_DATE = "2024-01-15"
AS_OF = "2024-01-16 12:00:00"
TRIP_AS_OF = "2024-01-16 12:00:00"


def case_of(expr: str, values: list[str]) -> str:
    """CASE over 0..n-1 giving quoted text values."""
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {expr} {arms} end"


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"(12742e0*asin(sqrt(sin(radians({lat2}-({lat1}))/2e0)*sin(radians({lat2}-({lat1}))/2e0)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*sin(radians({lng2}-({lng1}))/2e0)*sin(radians({lng2}-({lng1}))/2e0))))"
    )


def rnd(x: str, places: int) -> str:
    return f"(floor(({x})*1e{places}+5e-1)/1e{places})"


ROADS = list(P.ROAD_CLASS_SPEED)
SPEED_CASE = "case {c} " + " ".join(f"when '{k}' then {v:.1f}e0" for k, v in P.ROAD_CLASS_SPEED.items()) + " else 25e0 end"
SEVERITY = "case when value<3e1 then 'minor' when value<12e1 then 'major' else 'blocking' end"
PREFIXES = [
    "Lower Dibang Valley near km 4", "Dibang Valley road", "  West Kameng stretch", "West Siang cut", "Siang bank",
    "Tawang approach", "Unknown place", "Pakke-Kessang bend",
]
MOVEMENTS = [
    "Rock  Cum   Debris slide along cut", "debris flow", "DEBRIS on carriageway", "Subsidence", "Sl.No Movement Type",
    "rock fall", "  soil   slide", "mudstone creep", "earth flow", "Rock Wedge Failure",
]
CLASSES = ["Very Low", "low", "Moderate", "HIGH", "Very High"]

VIEWS: dict[str, str] = {
    "road_param": "select count(*) as n, cast(ceil(sqrt(count(*))) as bigint) as w from {supplier}",
    "road_node": """
        select s_suppkey as node_id, s_name as name,
               2.6e1+5e-2*cast(floor(s_suppkey/w) as bigint) as lat, 9.15e1+5e-2*(s_suppkey % w) as lng
        from {supplier} cross join {road_param}""",
    "road_way": """
        select p_partkey as way_id, f, t, p_size, p_partkey%10<>0 as bidirectional, p_partkey%9 as rt
        from (select p_partkey, p_size, p_partkey % n as f,
                     case when cast(floor(p_partkey/n) as bigint)%2=0 then p_partkey % n + 1 else p_partkey % n + w end as t, n, w
              from {part} cross join {road_param}) x
        where t<n and (t=f+w or (t=f+1 and t%w<>0))""",
    "road_geo": """
        select concat('seg_', cast(way_id as varchar(20)), '_0') as segment_id, way_id, f as from_node_id, t as to_node_id,
               bidirectional, a.lat as lat1, a.lng as lng1, b.lat as lat2, b.lng as lng2,
               5e-1*(a.lat+b.lat)+5e-3*((way_id%5)-2)/2e0 as latm, 5e-1*(a.lng+b.lng)+5e-3*((way_id%7)-3)/3e0 as lngm,
               case when way_id%41=0 then null else ((p_size*13+way_id)%300)/1e1 end as slope_deg,
               (way_id*53)%4500*1e0 as elevation_m, way_id%4 as historical_landslide_count,
               case when way_id%4=0 or way_id%29=0 then null else (way_id*37)%500*1e0 end as nearest_landslide_distance_m,
               case when way_id%6=0 then 45e-2 when way_id%31=0 then 9e-1 else null end as landslide_hazard_score,
               case when way_id%6=0 then 'Moderate' when way_id%31=0 then 'Very High' else null end as landslide_hazard_class,
               """ + case_of("rt", ROADS) + """ as highway,
               case when way_id%3=0 then null else concat('Road ', cast(rt as varchar(3))) end as name,
               case when way_id%100=0 then '0' when way_id%75=0 then 'walk' when way_id%25=0 then concat(cast(20+p_size as varchar(5)), ' kmh') else null end as maxspeed
        from {road_way} join {road_node} a on a.node_id=f join {road_node} b on b.node_id=t""",
    "road_segment": """
        select g.*, """ + rnd("km", 4) + """ as distance_km,
               """ + rnd("km/speed*6e1", 2) + """+way_id*1e-6 as travel_time_min, highway as road_type,
               case when elevation_m<3e2 then 'plain' when elevation_m<15e2 then 'hill' else 'mountain' end as terrain_type
        from (select x.*, case when maxspeed like '% kmh' then cast(replace(maxspeed, ' kmh', '') as double) else """
    + SPEED_CASE.format(c="highway") + """ end as speed,
              """ + hav("lat1", "lng1", "latm", "lngm") + "+" + hav("latm", "lngm", "lat2", "lng2") + """ as km
              from {road_geo} x) g""",
    "road_edge": """
        select segment_id, 0 as seq, lat1, lng1, latm as lat2, lngm as lng2 from {road_segment}
        union all select segment_id, 1, latm, lngm, lat2, lng2 from {road_segment}""",
    "rain_daily": """
        select cast(ts as date) as obs_date, 2.575e1+2.5e-1*(user_id%10) as lat,
               9.15e1+2.5e-1*(cast(floor(user_id/10) as bigint)%7) as lng,
               max(case when (dayofmonth(ts)+user_id%10)%11=0 then null else value*5e-1 end) as rainfall_mm
        from {events} group by 1,2,3""",
    "landslide": """
        select event_id as slide_no,
               case when event_id%13=0 then concat('X/', cast(event_id as varchar(20)))
                    else concat('X/Y/Z/',cast(1995+event_id%7 as varchar(8)),'/',cast(event_id as varchar(20))) end as slide_id,
               2.6e1+1e-3*((event_id*97+user_id*13)%600) as latitude, 9.15e1+1e-3*((event_id*61+user_id*29)%600) as longitude,
               """ + case_of("event_id%8", PREFIXES) + """ as description_before_coordinates,
               concat(""" + case_of("event_id%10", MOVEMENTS) + """,
                      case when event_id%17=0 then concat(' on ', cast(1+event_id%28 as varchar(4)), ' July ', cast(1996+event_id%5 as varchar(6))) else '' end) as description_after_coordinates,
               concat('record ', cast(event_id as varchar(20)), case when event_id%19=0 then ' found Stable' when event_id%23=0 then ' slope unstable' else ' fresh' end) as raw_record
        from {events} where event_type='error'""",
    "hazard": """
        select event_id as hazard_id, case event_id%3 when 0 then 'heavy_rain' when 1 then 'landslide' else 'road_blockage' end as type,
               """ + SEVERITY + """ as severity, (event_id*7)%m as way_id,
               concat('seg_', cast((event_id*7)%m as varchar(20)), '_0') as segment_id, cast(ts as timestamp) as created_at,
               case when event_id%4=0 then null else cast(ts as timestamp) + interval '6' hour end as cleared_at
        from {events} cross join (select count(*) as m from {part}) c where event_type='purchase'""",
    "field_report": """
        select event_id as report_id, """ + case_of("event_id%7", list(P.INCIDENT_TO_HAZARD)) + """ as incident_type,
               """ + SEVERITY + """ as severity, 2.6e1+1e-3*((event_id*89+user_id)%460) as latitude,
               9.15e1+1e-3*((event_id*53+user_id*3)%460) as longitude, props as description, cast(ts as timestamp) as created_at,
               case when event_id%3=0 then cast(ts as timestamp) + interval '30' minute else null end as resolved_at
        from {events} where event_type='click'""",
    "place": """
        select n_name as name, cast(n_nationkey as bigint) as pos, (cast(n_nationkey as bigint)*37+5)%n as node_id,
               2.6e1+2e-2*n_nationkey as lat, 9.15e1+15e-3*((n_nationkey*7)%25) as lng, 1e2*n_nationkey as elevation_m
        from {nation} cross join {road_param}""",
    "od_pair": """
        select distinct c_custkey%n as origin, (c_custkey*17+3)%n as destination
        from {customer} cross join {road_param} where c_custkey%n <> (c_custkey*17+3)%n""",
    "way_vertex": """
        select 1000000+cast(floor(node_id/w) as bigint) as way_id, (node_id%w)*2 as seq, lat, lng from {road_node} cross join {road_param}
        union all
        select 1000000+cast(floor(node_id/w) as bigint), (node_id%w)*2+1, lat+2e-3*((node_id%5)-2), lng+25e-3 from {road_node} cross join {road_param}
        where node_id+1<n and (node_id+1)%w<>0
        union all
        select 1000000+cast(floor(node_id/w) as bigint), 2*w+k, lat+case when k=1 then 4e-3 when k=2 then 4e-3 else 0e0 end, lng+case when k=2 then 4e-3 else 0e0 end
        from {road_node} cross join {road_param} cross join (select 1 as k union all select 2 union all select 3) l
        where (node_id%w=w-1 or node_id=n-1) and cast(floor(node_id/w) as bigint)%3=0
        union all
        select 2000000+node_id%w, cast(floor(node_id/w) as bigint)*2, lat, lng from {road_node} cross join {road_param}
        union all
        select 2000000+node_id%w, cast(floor(node_id/w) as bigint)*2+1, lat+25e-3, lng+2e-3*((node_id%7)-3) from {road_node} cross join {road_param}
        where node_id+w<n
        union all
        select 3000000+cast(floor(node_id/w) as bigint), k, case when k=2 then y.lat when k=1 then x.lat+9e-3 else x.lat end, case when k=2 then y.lng when k=1 then x.lng+2e-2 else x.lng end
        from {road_node} x cross join {road_param} join (select node_id as nid, lat, lng from {road_node}) y on y.nid=x.node_id+1
        cross join (select 0 as k union all select 1 union all select 2) l
        where x.node_id%w=0 and w>1 and cast(floor(x.node_id/w) as bigint)%4=1""",
    "way_tag": """
        select way_id, case when way_id%4=0 then null else concat('Way ', cast(way_id as varchar(20))) end as name,
               """ + case_of("way_id%11", ROADS + ["residential", "motorway"]) + """ as highway, concat('NH', cast(way_id%50 as varchar(5))) as ref,
               case way_id%7 when 0 then 'yes' when 1 then ' YES ' when 2 then 'no' when 3 then 'reversible' else null end as oneway,
               case way_id%6 when 0 then '45' when 1 then '30 mph' when 2 then '0' when 3 then 'signals' else null end as maxspeed
        from (select distinct way_id from {way_vertex}) x""",
    "zone_cell": """
        select distinct cast(floor((lat-2.6e1+1e-9)/1e-1) as bigint) as i, cast(floor((lng-9.15e1+1e-9)/1e-1) as bigint) as j from {road_node}""",
    "landslide_zone": """
        select i*1000+j as polygon_id, """ + case_of("(i*7+j)%5", CLASSES) + """ as hazard_class,
               2.6e1+1e-1*i-1e-2 as y0, 2.6e1+1e-1*i+11e-2 as y1, 9.15e1+1e-1*j-1e-2 as x0, 9.15e1+1e-1*j+11e-2 as x1
        from {zone_cell} where (i+2*j)%4<>0""",
    "flood_zone": """
        select i*1000+j as polygon_id, """ + case_of("(i+j)%3", ["Medium", "Severe", "low"]) + """ as hazard_class,
               2.6e1+1e-1*i as y0, 2.6e1+1e-1*i+5e-2 as y1, 9.15e1+1e-1*j as x0, 9.15e1+1e-1*j+1e-1 as x1
        from {zone_cell} where (i+j)%2=0""",
    "digit": "select 0 as d union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9",
    "grid_step": "select a.d*10+b.d as k from {digit} a cross join {digit} b where a.d*10+b.d<=60",
    "dem_grid": """
        select tile_lat, tile_lng, r.k as row, c.k as col,
               case when (r.k*7+c.k)%23=0 then -32768 else (r.k*37+c.k*53+((r.k*c.k)%17)*11)%3000 end as elev
        from (select distinct cast(floor(lat) as int) as tile_lat, cast(floor(lng) as int) as tile_lng from {road_node}) t
        cross join {grid_step} r cross join {grid_step} c""",
    "trip": """
        select c_custkey as trip_id, c_custkey%n as origin, (c_custkey*17+3)%n as destination, 2e1+c_custkey%60 as speed_kmph,
               cast(timestamp '2024-01-16 08:00:00' as timestamp) + interval '1' second * cast((c_custkey*37)%18000 as int) as started_at,
               case when c_custkey%3=0 then 'fastest' else 'risk-aware' end as mode
        from {customer} cross join {road_param} where c_custkey%n <> (c_custkey*17+3)%n""",
    "trip_event": """
        select event_id, user_id as trip_id, cast(ts as timestamp) as at_time, case when event_type in ('view','error') then 'pause' else 'start' end as action
        from {events}""",
}

_REF = re.compile(r"\{(\w+)\}")


def references(text: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(text)))


def view(spark: SparkSession, sf_dir: str, name: str, _seen: dict | None = None) -> DataFrame:
    """A base table or a projected view as a DataFrame."""
    seen = {} if _seen is None else _seen
    if name not in seen:
        if name in VIEWS:
            parts = {r: view(spark, sf_dir, r, seen) for r in references(VIEWS[name])}
            seen[name] = spark.sql(VIEWS[name], **parts)
        else:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return seen[name]


def with_views(sql: str, extra: dict[str, str] | None = None, heads: dict[str, str] | None = None) -> str:
    """Comparison SQL: prefix the CTEs that ``{name}`` references need, in dependency order.

    ``heads`` gives the text before ``as`` of a recursive CTE.
    """
    texts = {**VIEWS, **(extra or {})}
    heads = heads or {}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in texts and name not in order:
            for r in references(texts[name]):
                if r != name:
                    visit(r)
            order.append(name)

    for r in references(sql):
        visit(r)

    def fill(text: str) -> str:
        return _REF.sub(lambda m: m.group(1), text).strip()

    if not order:
        return fill(sql)
    ctes = ",\n".join(f"{heads.get(n, n)} as ({fill(texts[n])})" for n in order)
    return f"with recursive {ctes}\n{fill(sql)}"

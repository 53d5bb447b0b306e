"""Spatial join, inventory report and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.rounding import round_dp
from tarmetric.functions.text import district, is_negative_observation, movement_type
from tarmetric.operators import landslides as L
from tarmetric.operators import network as N
from tarmetric.operators import terrain as T
from tarmetric.operators import zonation as Z
from tarmetric.operators.gridjoin import nearest_edges, node_edges
from tarmetric.operators.intake import snap_reports
from tarmetric.plans.fixtures import hav, rnd
from tarmetric.plans.q_geometry import closest_sql
from tarmetric.plans.q_network import built_network, components
from tarmetric.plans.q_sources import zone_ring
from tarmetric.plans.registry import World, define, query
from tarmetric.session import scratch_path
from tarmetric.sources import readers, writers


def nearest_sql(points: str, key: str, lat: str, lng: str, edges: str) -> str:
    """Brute-force nearest edge for the comparison SQL: ``key, km, segment_id``."""
    return f"""
    select {key}, min(km) as km, min_by(segment_id, (km, segment_id)) as segment_id from (
      select {key}, segment_id, """ + rnd(hav("qlat", "qlng", "lat1+(lat2-lat1)*t", "lng1+(lng2-lng1)*t"), 7) + f""" as km from (
        select {key}, segment_id, qlat, qlng, lat1, lng1, lat2, lng2, """ + closest_sql("qlat", "qlng", "lat1", "lng1", "lat2", "lng2") + f""" as t
        from (select {key}, {lat} as qlat, {lng} as qlng from {points}) p cross join {edges})) group by 1"""


define("ox_slide_near", nearest_sql("{landslide}", "slide_no", "latitude", "longitude", "{road_edge}"))
define("ox_match", """
    select l.*, """ + rnd("km*1e3", 2) + """ as distance_to_road_m, case when """ + rnd("km*1e3", 2) + """<=5e2 then n.segment_id end as matched_segment_id,
    case when """ + rnd("km*1e3", 2) + """<=5e2 then 'MATCHED' else 'UNMATCHED' end as match_status from {landslide} l join {ox_slide_near} n using (slide_no)""")
define("ox_matched", """
    select m.*, s.name as matched_road_name, s.road_type as matched_highway_class, s.from_node_id, s.to_node_id
    from {ox_match} m left join {road_segment} s on s.segment_id=m.matched_segment_id""")


def matched(w: World) -> DataFrame:
    return w.keep("matched", lambda: L.match_to_segments(w["landslide"], w.edges, w.segments))


@query("d1_landslide_match", """
    select slide_no, distance_to_road_m, matched_segment_id, match_status, matched_road_name, matched_highway_class from {ox_matched}""")
def landslide_match(w: World) -> DataFrame:
    return matched(w).select(
        "slide_no", "distance_to_road_m", "matched_segment_id", "match_status", "matched_road_name", "matched_highway_class"
    )


define("ox_report_near", nearest_sql("{field_report}", "report_id", "latitude", "longitude", "{road_edge}"))


def snapped(w: World) -> DataFrame:
    return w.keep("snapped", lambda: snap_reports(w["field_report"], w.edges))


@query("d2_report_snap", """
    select report_id, km*1e3<=3e2 as accepted, case when km*1e3<=3e2 then segment_id end as segment_id, segment_id as nearest_segment_id, """ + rnd("km*1e3", 1) + """ as distance_to_road_m
    from {ox_report_near}""")
def report_snap(w: World) -> DataFrame:
    return snapped(w).select("report_id", "accepted", "segment_id", "nearest_segment_id", "distance_to_road_m")


define("location_text", """
    select c_custkey as request_id, case c_custkey%4 when 0 then concat(' ', cast(c_custkey%n as varchar(20)), ' ') when 1 then concat('SUPPLIER#', lpad(cast(c_custkey%n as varchar(20)), 9, '0'))
    when 2 then c_name else lower(concat('Supplier#', lpad(cast((c_custkey*3)%n as varchar(20)), 9, '0'))) end as location from {customer} cross join {road_param}""")


@query("d3_location_resolution", """
    select request_id, coalesce(i.node_id, m.node_id) as node_id, case when i.node_id is not null then 'id' when m.node_id is not null then 'name' else 'unknown' end as resolved_by
    from {location_text} left join {road_node} i on lower(cast(i.node_id as varchar))=lower(trim(location)) left join {road_node} m on lower(m.name)=lower(trim(location))""")
def location_resolution(w: World) -> DataFrame:
    n = F.col("n")
    c = F.col("c_custkey")
    pad = lambda x: F.lpad(x.cast("string"), 9, "0")
    text = (
        F.when(c % 4 == 0, F.concat(F.lit(" "), (c % n).cast("string"), F.lit(" ")))
        .when(c % 4 == 1, F.concat(F.lit("SUPPLIER#"), pad(c % n)))
        .when(c % 4 == 2, F.col("c_name"))
        .otherwise(F.concat(F.lit("supplier#"), pad((c * 3) % n)))
    )
    asked = w["customer"].crossJoin(w["road_param"]).select(c.alias("request_id"), text.alias("location"))
    return N.resolve_locations(asked, w.nodes).select("request_id", "node_id", "resolved_by")


@query("d3_point_to_node", """
    select report_id, node_id, km from (select report_id, n.node_id, """ + rnd(hav("latitude", "longitude", "lat", "lng"), 7) + """ as km,
    row_number() over (partition by report_id order by """ + rnd(hav("latitude", "longitude", "lat", "lng"), 7) + """, n.node_id) as r from {field_report} cross join {road_node} n) where r=1""")
def point_to_node(w: World) -> DataFrame:
    near = nearest_edges(w["field_report"], node_edges(w.nodes), 3000.0)
    return near.select("report_id", F.col("nearest_id").alias("node_id"), F.col("nearest_km").alias("km"))


@query("d6_point_zone", """
    select slide_no, case when c is null then 'no_coverage' else 'ok' end as status, c as hazard_class, floor(s*1e4+5e-1)/1e4 as hazard_score,
    case when s>=75e-2 then 'very_high' when s>=5e-1 then 'high' when s>=25e-2 then 'moderate' when s is not null then 'low' end as hazard_level from (
    select slide_no, max_by(hazard_class, (s, -polygon_id)) as c, max(s) as s from {landslide} left join (
      select *, case lower(hazard_class) when 'very low' then 1e-1 when 'low' then 25e-2 when 'moderate' then 45e-2 when 'high' then 7e-1 else 9e-1 end as s from {landslide_zone}) z
      on latitude>y0 and latitude<y1 and longitude>x0 and longitude<x1 group by 1)""")
def point_zone(w: World) -> DataFrame:
    points = w["landslide"].select("slide_no", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return Z.point_zone(points, zone_ring(w["landslide_zone"]), ["slide_no"]).drop("lat", "lng")


SCORE_SQL = "case lower(hazard_class) when 'very low' then 1e-1 when 'low' then 25e-2 when 'moderate' then 45e-2 when 'medium' then 45e-2 when 'high' then 7e-1 else 9e-1 end"
define("ox_zone_sample", """
    select segment_id, frac, case when target<=0 then lat1 when target<=h1 then lat1+(latm-lat1)*(target/h1) else latm+(lat2-latm)*least(1e0,(target-h1)/h2) end as lat,
    case when target<=0 then lng1 when target<=h1 then lng1+(lngm-lng1)*(target/h1) else lngm+(lng2-lngm)*least(1e0,(target-h1)/h2) end as lng
    from (select *, """ + hav("lat1", "lng1", "latm", "lngm") + " as h1, " + hav("latm", "lngm", "lat2", "lng2") + """ as h2, frac*distance_km as target
          from {road_segment} cross join (select 0e0 as frac union all select 25e-2 union all select 5e-1 union all select 75e-2 union all select 1e0) f)""")


def zone_sql(layer: str) -> str:
    return f"""
    select segment_id, max_by(c, (s, -frac)) as c, max(s) as s, count(c) as n from (
      select p.segment_id, p.frac, max_by(hazard_class, (s, -polygon_id)) as c, max(s) as s from {{ox_zone_sample}} p
      left join (select *, {SCORE_SQL} as s from {{{layer}}}) z on lat>y0 and lat<y1 and lng>x0 and lng<x1 group by 1,2) group by 1"""


define("ox_seg_slide_zone", zone_sql("landslide_zone"))
define("ox_seg_flood_zone", zone_sql("flood_zone"))


def zones(w: World) -> DataFrame:
    build = lambda: Z.segment_zones(w.segments, zone_ring(w["landslide_zone"]), zone_ring(w["flood_zone"]))
    return w.keep("segment_zones", build)


@query("d7_segment_zonation", """
    select a.segment_id, a.c as landslide_hazard_class, floor(a.s*1e4+5e-1)/1e4 as landslide_hazard_score, case when a.n>0 then 'ok' else 'no_coverage' end as landslide_hazard_status,
    b.c as flood_hazard_class, floor(b.s*1e4+5e-1)/1e4 as flood_hazard_score, case when b.n>0 then 'ok' else 'no_coverage' end as flood_hazard_status
    from {ox_seg_slide_zone} a join {ox_seg_flood_zone} b using (segment_id)""")
def segment_zonation(w: World) -> DataFrame:
    return zones(w)


@query("e14_zone_coverage", "select count(*) as total_segments, count(a.s) as landslide_covered, count(b.s) as flood_covered from {ox_seg_slide_zone} a join {ox_seg_flood_zone} b using (segment_id)")
def zone_coverage(w: World) -> DataFrame:
    return Z.layer_coverage(zones(w))


define("ox_elev", """
    select p.*, case when void=0 then v else near end as elev from (
      select {key}, sum(case when g.elev is null or g.elev=-32768 then 1 else 0 end) as void,
             sum(wt*g.elev) as v, max(case when g.elev<>-32768 and row_no=round_even(rf,0) and col_no=round_even(cf,0) then g.elev end)*1e0 as near
      from {pts} group by all) p""".replace("{key}", "segment_id, seq").replace("{pts}", """(
        select s.*, dr, dc, r0+dr as row_no, c0+dc as col_no, (case when dr=0 then 1e0-(rf-r0) else rf-r0 end)*(case when dc=0 then 1e0-(cf-c0) else cf-c0 end) as wt from (
          select *, cast(least(floor(rf), 59) as int) as r0, cast(least(floor(cf), 59) as int) as c0 from (
            select segment_id, seq, tl, tg, (tl+1-lat)*60 as rf, (lng-tg)*60 as cf from (
              select *, cast(floor(lat) as int) as tl, cast(floor(lng) as int) as tg from {ox_sample}))) s
        cross join (select 0 as dr union all select 1) a cross join (select 0 as dc union all select 1) b) q
        left join {dem_grid} g on g.tile_lat=q.tl and g.tile_lng=q.tg and g.row=q.row_no and g.col=q.col_no"""))


def elevation_samples(w: World) -> DataFrame:
    def build() -> DataFrame:
        points = T.with_distance_along(T.terrain_samples(built_network(w)))
        return T.sample_elevation(points, w["dem_grid"], ["segment_id", "seq"], tile_samples=61)

    return w.keep("elevation_samples", build)


@query("d8_elevation_sampling", "select segment_id, seq, " + rnd("elev", 4) + " as elev from {ox_elev}")
def elevation_sampling(w: World) -> DataFrame:
    return elevation_samples(w).select("segment_id", F.col("seq").cast("long").alias("seq"), round_dp("elev", 4).alias("elev"))


define("ox_profile", """
    select segment_id, avg(elev) as mean_e, min(elev) as lo, max(elev) as hi, count(*) as samples, count(elev) as valid, sum(climb) as rise,
           max(case when elev is not null then along_m end)-min(case when elev is not null then along_m end) as run from (
      select *, abs(elev-lag(elev ignore nulls) over (partition by segment_id order by seq)) as climb from {ox_along} join {ox_elev} using (segment_id, seq)) group by 1""")
define("ox_slope", "select *, case when valid>=2 and run>0 then degrees(atan(rise/run)) end as slope_deg from {ox_profile}")


def profiles(w: World) -> DataFrame:
    return w.keep("terrain_profile", lambda: T.segment_terrain(elevation_samples(w)))


@query("d9_segment_terrain", """
    select segment_id, """ + rnd("mean_e", 3) + " as elevation_m, " + rnd("lo", 3) + " as min_elevation_m, " + rnd("hi", 3) + " as max_elevation_m, samples as sample_count, valid as valid_sample_count, "
    + rnd("slope_deg", 4) + " as slope_deg, " + rnd("case when valid>=2 and run>0 then rise/run*1e2 end", 3) + " as slope_percent from {ox_slope}")
def segment_terrain(w: World) -> DataFrame:
    return profiles(w).select(
        "segment_id", *[round_dp(c, 3).alias(c) for c in ("elevation_m", "min_elevation_m", "max_elevation_m")],
        "sample_count", "valid_sample_count", round_dp("slope_deg", 4).alias("slope_deg"), round_dp("slope_percent", 3).alias("slope_percent"),
    )


def fine_elev_sql(row: str, col: str, coarse: str) -> str:
    """Sample of a full-size tile: the coarse sample before it plus a small step; voids stay voids."""
    return f"case when {coarse}=-32768 then -32768 else {coarse}+({row}*7+{col}*3)%11 end"


define("ox_fine_key", """
    select *, cast(least(floor(rf), 3599) as int) as r0, cast(least(floor(cf), 3599) as int) as c0 from (
      select segment_id, seq, tl, tg, (tl+1-lat)*3600 as rf, (lng-tg)*3600 as cf from (
        select *, cast(floor(lat) as int) as tl, cast(floor(lng) as int) as tg from {ox_sample}))""")
define("ox_fine_elev", """
    select segment_id, seq, case when void=0 then v else near end as elev from (
      select segment_id, seq, count_if(e is null or e=-32768) as void, sum(wt*e) as v, max(case when e<>-32768 and row_no=round_even(rf,0) and col_no=round_even(cf,0) then e end)*1e0 as near from (
        select q.*, """ + fine_elev_sql("row_no", "col_no", "g.elev") + """ as e from (
          select s.*, r0+dr as row_no, c0+dc as col_no, (case when dr=0 then 1e0-(rf-r0) else rf-r0 end)*(case when dc=0 then 1e0-(cf-c0) else cf-c0 end) as wt
          from {ox_fine_key} s cross join (select 0 as dr union all select 1) a cross join (select 0 as dc union all select 1) b) q
        left join {dem_grid} g on g.tile_lat=q.tl and g.tile_lng=q.tg and g.row=row_no//60 and g.col=col_no//60) group by all)""")
define("ox_fine_profile", """
    select segment_id, avg(elev) as mean_e, min(elev) as lo, max(elev) as hi, count(*) as samples, count(elev) as valid, sum(climb) as rise,
           max(case when elev is not null then along_m end)-min(case when elev is not null then along_m end) as run from (
      select *, abs(elev-lag(elev ignore nulls) over (partition by segment_id order by seq)) as climb from {ox_along} join {ox_fine_elev} using (segment_id, seq)) group by 1""")


def tile_folder(w: World) -> str:
    """Full-size tile files made of the coarse grid, written once per session."""

    def write(path: str) -> None:
        coarse = F.array_sort(F.collect_list(F.struct("col", "elev")))
        lines = w["dem_grid"].groupBy("tile_lat", "tile_lng", "row").agg(F.transform(coarse, lambda x: x["elev"]).alias("coarse"))
        # a coarse line stands for sixty fine ones, the last for one
        rows = F.sequence(F.lit(0), F.when(F.col("row") < 60, 59).otherwise(0))
        lines = lines.select("tile_lat", "tile_lng", "coarse", F.explode(F.transform(rows, lambda i: F.col("row") * 60 + i)).alias("row"))

        def fine(c):
            held = F.get("coarse", F.floor(c / 60).cast("int"))
            return F.when(held == P.TILE_VOID, held).otherwise(held + (F.col("row") * 7 + c * 3) % 11)

        lines = lines.select("tile_lat", "tile_lng", "row", F.transform(F.sequence(F.lit(0), F.lit(3600)), fine).alias("samples"))
        writers.write_tiles(lines, path).write.format("noop").mode("overwrite").save()

    return w.folder("tiles", write)


def tile_blocks(w: World) -> DataFrame:
    return w.keep("tile_blocks", lambda: readers.read_tile_blocks(w.spark, tile_folder(w)))


@query("a5_tile_scan", """
    select tile_lat, tile_lng, count(*) as samples, count_if(e=-32768) as voids, min(case when e<>-32768 then e end) as min_elev, max(case when e<>-32768 then e end) as max_elev,
           cast(sum(case when e<>-32768 then e end) as bigint) as sum_elev, cast(sum(case when e<>-32768 then (r*31+c)%97*e end) as bigint) as place_sum
    from (select tile_lat, tile_lng, r, c, """ + fine_elev_sql("r", "c", "elev") + """ as e from (
      select tile_lat, tile_lng, row*60+i as r, col*60+j as c, elev from {dem_grid} cross join (select k as i from {grid_step} where k<60) cross join (select k as j from {grid_step} where k<60))
      where r<=3600 and c<=3600) group by all""")
def tile_scan(w: World) -> DataFrame:
    """Every sample of the tile files, read back once: counts, range and a sum that depends on the places."""
    e = F.when(F.col("elev") != P.TILE_VOID, F.col("elev"))
    return readers.block_rows(tile_blocks(w)).groupBy("tile_lat", "tile_lng").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(e.isNull()).alias("voids"), F.min(e).alias("min_elev"), F.max(e).alias("max_elev"),
        F.sum(e).alias("sum_elev"), F.sum((F.col("row") * 31 + F.col("col")) % 97 * e).alias("place_sum"),
    )


def tile_samples(w: World) -> DataFrame:
    return w.keep("tile_samples", lambda: T.sample_blocks(T.with_distance_along(T.terrain_samples(built_network(w))), tile_blocks(w)))


@query("d8_tile_sampling", "select segment_id, seq, " + rnd("elev", 4) + " as elev from {ox_fine_elev}")
def tile_sampling(w: World) -> DataFrame:
    return tile_samples(w).select("segment_id", F.col("seq").cast("long").alias("seq"), round_dp("elev", 4).alias("elev"))


@query("d9_tile_terrain", """
    select segment_id, """ + rnd("mean_e", 3) + " as elevation_m, " + rnd("lo", 3) + " as min_elevation_m, " + rnd("hi", 3) + " as max_elevation_m, samples as sample_count, valid as valid_sample_count, "
    + rnd("case when valid>=2 and run>0 then degrees(atan(rise/run)) end", 4) + " as slope_deg from {ox_fine_profile}")
def tile_terrain(w: World) -> DataFrame:
    return T.segment_terrain(tile_samples(w)).select(
        "segment_id", *[round_dp(c, 3).alias(c) for c in ("elevation_m", "min_elevation_m", "max_elevation_m")],
        "sample_count", "valid_sample_count", round_dp("slope_deg", 4).alias("slope_deg"),
    )


KNN_SQL = """
    select p.name, s.segment_id, s.elevation_m, """ + rnd(hav("p.lat", "p.lng", "latm", "lngm"), 7) + """ as km,
    row_number() over (partition by p.name order by """ + rnd(hav("p.lat", "p.lng", "latm", "lngm"), 7) + """, s.segment_id) as r from {place} p cross join {road_segment} s"""
define("ox_knn", KNN_SQL)


@query("d10_knn_by_midpoint", """
    select name, min_by(segment_id, r) as nearest_segment_id, floor(avg(elevation_m)*1e1+5e-1)/1e1 as mean_elevation_5, count(*) as n from {ox_knn} where r<=5 group by 1""")
def knn_by_midpoint(w: World) -> DataFrame:
    near = T.nearest_segments_by_midpoint(w["place"].select("name", "lat", "lng"), w.segments.drop("name"), 5)
    return near.groupBy("name").agg(
        F.min_by("segment_id", "rank").alias("nearest_segment_id"), round_dp(F.avg("elevation_m"), 1).alias("mean_elevation_5"), F.count(F.lit(1)).alias("n")
    )


define("ox_knn_segment", """
    select *, row_number() over (partition by name order by d, segment_id) as r from (
      select a.segment_id as name, b.segment_id, b.elevation_m, floor(""" + hav("a.latm", "a.lngm", "b.latm", "b.lngm") + """*1e7+5e-1)/1e7 as d from {road_segment} a cross join {road_segment} b)""")


@query("d10_knn_of_segments", """
    select name, min_by(segment_id, r) as nearest_segment_id, string_agg(segment_id, ' ' order by r) as nearest_5, floor(avg(elevation_m)*1e1+5e-1)/1e1 as mean_elevation_5 from {ox_knn_segment} where r<=5 group by 1""")
def knn_of_segments(w: World) -> DataFrame:
    """Every segment's midpoint as a place."""
    places = w.segments.select(F.col("segment_id").alias("name"), F.col("latm").alias("lat"), F.col("lngm").alias("lng"))
    near = T.nearest_segments_by_midpoint(places, w.segments.drop("name"), 5)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "segment_id")))
    return near.groupBy("name").agg(
        F.min_by("segment_id", "rank").alias("nearest_segment_id"), F.array_join(F.transform(ordered, lambda x: x["segment_id"]), " ").alias("nearest_5"), round_dp(F.avg("elevation_m"), 1).alias("mean_elevation_5")
    )


define("ox_history", """
    select segment_id, coalesce(n,0) as historical_landslide_count, d as nearest_landslide_distance_m from (select segment_id from {road_segment}) left join (
    select matched_segment_id, count(*) as n, min(distance_to_road_m) as d from {ox_match} where match_status='MATCHED' group by 1) on matched_segment_id=segment_id""")


@query("e1_segment_history", "select * from {ox_history}")
def segment_history(w: World) -> DataFrame:
    return L.segment_history(matched(w), w.segments)


def _longest(expr: str, words: list[str], title: bool = False) -> str:
    arms = " ".join(
        f"when starts_with({expr}, '{x}') then '{x.title() if title else x}'" for x in sorted(words, key=lambda v: (-len(v), v))
    )
    return f"case {arms} end"


CLEAN = "lower(trim(regexp_replace(description_after_coordinates, '\\s+', ' ', 'g')))"
define("ox_text", """
    select slide_no, """ + _longest("trim(description_before_coordinates)", P.DISTRICTS) + """ as district,
    case when """ + " or ".join(f"contains({CLEAN}, '{m}')" for m in P.HEADER_MARKERS) + """ then 'Other/Unspecified (source header artifact)'
    else coalesce(""" + _longest(CLEAN, P.MOVEMENT_TYPES, True) + """, 'Other/Unspecified') end as movement_type from {landslide}""")
define("ox_valid", """
    select m.*, t.district, t.movement_type, m.latitude between b.lo_y and b.hi_y and m.longitude between b.lo_x and b.hi_x as within_network_bbox,
    case when match_status='MATCHED' then (m.latitude between b.lo_y and b.hi_y and m.longitude between b.lo_x and b.hi_x
      and from_node_id in (select node_id from {ox_main}) and to_node_id in (select node_id from {ox_main})) end as geographically_consistent
    from {ox_matched} m join {ox_text} t using (slide_no) cross join (select min(lat) as lo_y, max(lat) as hi_y, min(lng) as lo_x, max(lng) as hi_x from {road_node}) b""")


def validated(w: World) -> DataFrame:
    main = N.main_component(components(w))
    return L.validate_matches(matched(w), w.segments, main, N.bounding_box(w.nodes))


@query("e2_match_validation", "select slide_no, match_status, within_network_bbox, geographically_consistent from {ox_valid}")
def match_validation(w: World) -> DataFrame:
    return validated(w).select("slide_no", "match_status", "within_network_bbox", "geographically_consistent")


@query("e3_e4_text_classes", "select * from {ox_text}")
def text_classes(w: World) -> DataFrame:
    return w["landslide"].select(
        "slide_no", district(F.col("description_before_coordinates")).alias("district"), movement_type(F.col("description_after_coordinates")).alias("movement_type")
    )


@query("e4_k2_document_scan", """
    select doc_id, case when """ + " or ".join(f"contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '{m}')" for m in P.HEADER_MARKERS) + """ then 'header' else 'text' end as kind,
    """ + " or ".join(f"contains(lower(text), '{k}')" for k in P.NEGATIVE_KEYWORDS) + """ as is_negative from {documents}""")
def document_scan(w: World) -> DataFrame:
    """The movement and negative-observation rules over every whole document text."""
    header = movement_type(F.col("text")) == "Other/Unspecified (source header artifact)"
    return w["documents"].select(
        "doc_id", F.when(header, "header").otherwise("text").alias("kind"), is_negative_observation(F.col("text")).alias("is_negative")
    )


@query("e5_match_summary", """
    select count(*) as total, count_if(match_status='MATCHED') as matched, count_if(match_status<>'MATCHED') as unmatched,
    floor(1e2*count_if(match_status='MATCHED')/count(*)*1e1+5e-1)/1e1 as match_rate_pct, count_if(within_network_bbox) as in_bbox,
    count_if(match_status='MATCHED' and not within_network_bbox) as matched_outside_bbox, count_if(match_status<>'MATCHED' and within_network_bbox) as unmatched_inside_bbox,
    any_value(h.a) as segments_with_landslide, any_value(h.b) as max_per_segment from {ox_valid}
    cross join (select count_if(historical_landslide_count>=1) as a, max(historical_landslide_count) as b from {ox_history}) h""")
def match_summary(w: World) -> DataFrame:
    return L.match_summary(validated(w), L.segment_history(matched(w), w.segments))


FREQ = "select '{k}' as breakdown, {e} as label, count(*) as records from {{ox_valid}} where match_status='MATCHED' group by 2"


@query("e6_match_frequencies", " union all ".join([
    FREQ.format(k="district", e="district"),
    FREQ.format(k="road", e="coalesce(matched_road_name, concat('(unnamed ', matched_highway_class, ')'))"),
    FREQ.format(k="movement_type", e="movement_type"),
]))
def match_frequencies(w: World) -> DataFrame:
    return L.match_frequencies(validated(w))


@query("e7_distance_distribution", """
    select min(d) as min_m, """ + rnd("median(d)", 3) + """ as median_m, max(d) as max_m, count_if(d<=50) as within_50m, count_if(d<=100) as within_100m, count_if(d<=500) as within_500m
    from (select distance_to_road_m as d from {ox_match} where match_status='MATCHED')""")
def distance_distribution(w: World) -> DataFrame:
    return L.distance_distribution(matched(w)).withColumn("median_m", round_dp("median_m", 3))


@query("e8_closest_matches", """
    select slide_no, slide_id, matched_segment_id, distance_to_road_m from {ox_match} where match_status='MATCHED' order by distance_to_road_m, slide_no limit 10""")
def closest_matches(w: World) -> DataFrame:
    return L.closest_matches(matched(w)).select("slide_no", "slide_id", "matched_segment_id", "distance_to_road_m")


@query("e9_terrain_quality", """
    select count(*) as total, count(e) as with_elevation, count(s) as with_slope, count_if(dem is not null) as real_elevation, count_if(dem is null) as fallback_elevation,
    floor(1e2*count(s)/count(*)*1e1+5e-1)/1e1 as slope_coverage_pct, min(e) as min_elevation, median(e) as median_elevation, max(e) as max_elevation,
    min(s) as min_slope, """ + rnd("median(s)", 3) + """ as median_slope, max(s) as max_slope, count_if(not (e between -20 and 6000)) as implausible_elevation, count_if(s>25) as suspicious_slope
    from (select dem, coalesce(dem, ref) as e, case when dem is not null then floor(slope_deg*1e2+5e-1)/1e2 end as s from {ox_terrain} where r=1)""")
def terrain_quality(w: World) -> DataFrame:
    sampled = w.segments.filter("way_id % 9 <> 0").select("segment_id", "elevation_m", "slope_deg")
    full = N.with_terrain(w.segments.drop("elevation_m", "slope_deg", "terrain_type"), sampled, w["place"])
    return T.terrain_quality(full).withColumn("median_slope", round_dp("median_slope", 3))


@query("a9_mapped_inventory_sinks", """
    select 'csv' as sink, match_status, count(*) as records, """ + rnd("sum(distance_to_road_m)", 2) + """ as metres from {ox_match} group by 2
    union all select 'geojson', match_status, count(*), """ + rnd("sum(distance_to_road_m)", 2) + " from {ox_match} group by 2")
def mapped_inventory_sinks(w: World) -> DataFrame:
    """The mapped table written as CSV and as GeoJSON, read back and counted."""
    rows = matched(w).select("slide_no", "slide_id", "latitude", "longitude", "match_status", "matched_segment_id", "distance_to_road_m")
    csv, geo = scratch_path(w.spark, "mapped-csv"), scratch_path(w.spark, "mapped-geojson")
    writers.write_csv(rows, csv)
    writers.write_geojson(rows, writers.point_geometry(), ["slide_no", "match_status", "distance_to_road_m"], geo)
    back_csv = w.spark.read.option("header", True).schema(rows.schema).csv(csv)
    feature = "properties struct<slide_no:bigint,match_status:string,distance_to_road_m:double>, geometry struct<coordinates:array<double>>"
    back_geo = w.spark.read.schema(feature).json(geo).select("properties.*")
    both = back_csv.select(F.lit("csv").alias("sink"), "match_status", "distance_to_road_m").unionByName(
        back_geo.select(F.lit("geojson").alias("sink"), "match_status", "distance_to_road_m")
    )
    return both.groupBy("sink", "match_status").agg(
        F.count(F.lit(1)).alias("records"), round_dp(F.sum("distance_to_road_m"), 2).alias("metres")
    )

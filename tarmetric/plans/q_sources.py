"""Source and sink queries: each writes the format from the given tables and scans it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.geo import point
from tarmetric.operators.intake import current_state
from tarmetric.operators.zonation import merge_features, uncovered_ids, unknown_classes
from tarmetric.operators.terrain import tile_name
from tarmetric.operators.gridjoin import containing_polygons, nearest_edges, node_edges
from tarmetric.plans.registry import World, define, query
from tarmetric.functions.rounding import round_dp
from tarmetric.plans.fixtures import hav, rnd
from tarmetric.session import scratch_path
from tarmetric.sources import readers, writers


def ways_of(w: World) -> DataFrame:
    """Raw ways with their vertices as one array and the raw tags."""
    packed = F.array_sort(F.collect_list(F.struct("seq", "lat", "lng")))
    geometry = F.transform("v", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng")))
    rows = w["way_vertex"].groupBy("way_id").agg(packed.alias("v")).select("way_id", geometry.alias("geometry"))
    return rows.join(w["way_tag"], "way_id")


def zone_ring(zones: DataFrame) -> DataFrame:
    corners = [("y0", "x0"), ("y0", "x1"), ("y1", "x1"), ("y1", "x0"), ("y0", "x0")]
    return zones.select("polygon_id", "hazard_class", F.array(*[point(F.col(y), F.col(x)) for y, x in corners]).alias("ring"))


@query(
    "a1_road_geojson_scan",
    """select way_id, count(*) as vertices, """ + rnd("min_by(lat, seq)", 6) + """ as first_lat,
       """ + rnd("max_by(lng, seq)", 6) + """ as last_lng, any_value(highway) as highway, any_value(oneway) as oneway,
       any_value(maxspeed) as maxspeed, any_value(name) as name
       from {way_vertex} join {way_tag} using (way_id) group by way_id having count(*)>=2""",
)
def road_geojson_scan(w: World) -> DataFrame:
    path = scratch_path(w.spark, "ways-geojson")
    ways = ways_of(w).withColumnRenamed("way_id", "osm_id")
    writers.write_geojson(ways, writers.line_geometry(), ["osm_id", "name", "highway", "ref", "oneway", "maxspeed"], path)
    g = F.col("geometry")
    return readers.read_ways(w.spark, path).select(
        "way_id",
        F.size(g).cast("long").alias("vertices"),
        round_dp(g[0]["lat"], 6).alias("first_lat"),
        round_dp(F.element_at(g, -1)["lng"], 6).alias("last_lng"),
        "highway", "oneway", "maxspeed", "name",
    )


@query(
    "a2_inventory_scan",
    """select slide_no, slide_id, case when slide_no%40=0 then 'missing coordinate' when slide_no%41=0 then 'non-numeric coordinate'
       when slide_no%43=0 then 'latitude out of range' end as problem, raw_record from {landslide}""",
)
def inventory_scan(w: World) -> DataFrame:
    path = scratch_path(w.spark, "inventory-csv")
    n = F.col("slide_no")
    bad_lat = F.when(n % 40 == 0, F.lit(None)).when(n % 41 == 0, "n/a").when(n % 43 == 0, "127.5").otherwise(F.col("latitude").cast("string"))
    rows = w["landslide"].select(
        "slide_no", "slide_id", F.lit("AR").alias("state"), "description_before_coordinates", bad_lat.alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"), "description_after_coordinates", "raw_record",
    )
    writers.write_csv(rows, path)
    return readers.read_inventory(w.spark, path, on_problem="keep").select("slide_no", "slide_id", "problem", "raw_record")


@query(
    "a3_daily_rain_scan",
    "select cast(obs_date as varchar) as obs_date, lat, lng, rainfall_mm from {rain_daily}",
)
def daily_rain_scan(w: World) -> DataFrame:
    path = scratch_path(w.spark, "rain-csv")
    writers.write_csv(w.rain.select(F.col("obs_date").alias("date"), "lat", F.col("lng").alias("lon"), "rainfall_mm"), path)
    return readers.read_daily_rain(w.spark, path).withColumn("obs_date", F.col("obs_date").cast("string"))


@query(
    "a4_rain_archive_scan",
    """select cast(obs_date as varchar) as obs_date, lat, lng, rainfall_mm from {rain_daily}
       where lat between 26e0 and 27.5e0 and lng between 91.5e0 and 92.5e0""",
)
def rain_archive_scan(w: World) -> DataFrame:
    path = scratch_path(w.spark, "rain-archive")
    rows = w.rain.select(
        F.year("obs_date").alias("year"),
        F.datediff("obs_date", F.lit(P.RAIN_EPOCH).cast("date")).alias("day"),
        "lat", F.col("lng").alias("lon"),
        F.coalesce("rainfall_mm", F.lit(P.RAIN_MISSING_MM)).alias("mm"),
    )
    rows.write.partitionBy("year").parquet(path)
    read = readers.read_rain_archive(w.spark, path, (26.0, 27.5, 91.5, 92.5))
    return read.withColumn("obs_date", F.col("obs_date").cast("string"))


@query(
    "a5_tile_names",
    """select concat(case when lat>=0 then 'N' else 'S' end, lpad(cast(abs(cast(floor(lat) as bigint)) as varchar), 2, '0'),
       case when lng>=0 then 'E' else 'W' end, lpad(cast(abs(cast(floor(lng) as bigint)) as varchar), 3, '0')) as tile, count(*) as nodes
       from {road_node} group by 1""",
)
def tile_names(w: World) -> DataFrame:
    name = tile_name(F.floor("lat").cast("int"), F.floor("lng").cast("int"))
    return w["road_node"].groupBy(name.alias("tile")).agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "a6_zone_layer_scan",
    """select lower(hazard_class) as hazard_class, count(*) as polygons, cast(0 as bigint) as unknown_classes
       from {landslide_zone} group by 1""",
)
def zone_layer_scan(w: World) -> DataFrame:
    path = scratch_path(w.spark, "zones-geojson")
    writers.write_geojson(zone_ring(w["landslide_zone"]), writers.polygon_geometry(), ["polygon_id", "hazard_class"], path)
    layer = readers.read_zones(w.spark, path)
    bad = unknown_classes(layer).agg(F.count(F.lit(1)).alias("unknown_classes"))
    counts = layer.groupBy(F.lower("hazard_class").alias("hazard_class")).agg(F.count(F.lit(1)).alias("polygons"))
    return counts.crossJoin(F.broadcast(bad))


@query(
    "a6_zone_holes_and_parts",
    """select n.node_id, z.polygon_id from {road_node} n join (select polygon_id, x0, x1, y0, y1 from {landslide_zone}) z on
       (n.lat > y0 - 1e0 and n.lat < y1 + 1e0 and n.lng > x0 - 1e0 and n.lng < x1 + 1e0
        and not (n.lat >= y0 - 5e-2 and n.lat <= y1 + 5e-2 and n.lng >= x0 - 5e-2 and n.lng <= x1 + 5e-2))
       or (n.lat > y0 and n.lat < y1 and n.lng > x0 and n.lng < x1)""",
)
def zone_holes_and_parts(w: World) -> DataFrame:
    """Every zone as two parts: a wide square with a hole around the zone, and the zone itself inside the hole."""

    def box(by: float) -> Column:
        corners = [("y0", "x0"), ("y0", "x1"), ("y1", "x1"), ("y1", "x0"), ("y0", "x0")]
        side = lambda c: F.col(c) + (F.lit(by) if c.endswith("1") else F.lit(-by))
        return F.array(*[F.array(side(x), side(y)) for y, x in corners])

    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(box(1.0), box(0.05)), F.array(box(0.0))).alias("coordinates"))
    path = scratch_path(w.spark, "zones-parts")
    writers.write_geojson(w["landslide_zone"], geometry, ["polygon_id", "hazard_class"], path)
    return containing_polygons(w["road_node"].select("node_id", "lat", "lng"), readers.read_zones(w.spark, path)).select("node_id", "polygon_id")


PLACES_SQL = "select * from (values " + ", ".join(
    f"('{n}', '{t}', {lat}e0, {lng}e0, {e}e0)" for n, t, lat, lng, e in P.NAMED_PLACES
) + ") as p(name, type, lat, lng, elevation_m)"
define("ox_named", PLACES_SQL)


@query(
    "a7_named_places_nearest_node",
    """select name, node_id, nearest_km from (
         select p.name, n.node_id, """ + rnd(hav("p.lat", "p.lng", "n.lat", "n.lng"), 7) + """ as nearest_km,
         row_number() over (partition by p.name order by """ + rnd(hav("p.lat", "p.lng", "n.lat", "n.lng"), 7) + """, n.node_id) as r
         from {ox_named} p cross join {road_node} n) where r=1""",
)
def named_places_nearest_node(w: World) -> DataFrame:
    near = nearest_edges(readers.named_places(w.spark), node_edges(w.nodes), 10_000.0, lat="lat", lng="lng")
    return near.select("name", F.col("nearest_id").alias("node_id"), "nearest_km")


@query(
    "a8_feature_merge_guard",
    """select 'complete' as features, count(*) as rows, count_if(score>=5e-1) as high, count_if(score is null) as empty from (
         select case when elevation_m>2e3 then coalesce(8e-1, landslide_hazard_score) else landslide_hazard_score end as score from {road_segment})
       union all select 'stale', count(*), count_if(landslide_hazard_score>=5e-1), count_if(landslide_hazard_score is null) from {road_segment}""",
)
def feature_merge_guard(w: World) -> DataFrame:
    current = w.segments.select("segment_id", "elevation_m", "landslide_hazard_score")
    complete = current.select("segment_id", F.when(F.col("elevation_m") > 2000, F.lit(0.8)).alias("landslide_hazard_score"))
    stale = complete.join(w.segments.filter("slope_deg is not null"), "segment_id", "left_semi")
    out = None
    for label, features in (("complete", complete), ("stale", stale)):
        merged = merge_features(current, features, ["landslide_hazard_score"])
        score = F.col("landslide_hazard_score")
        row = merged.agg(
            F.lit(label).alias("features"), F.count(F.lit(1)).alias("rows"),
            F.count_if(score >= 0.5).alias("high"), F.count_if(score.isNull()).alias("empty"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "a8_uncovered_segments",
    "select segment_id from {road_segment} where slope_deg is null",
)
def uncovered_segments(w: World) -> DataFrame:
    return uncovered_ids(w.segments, w.segments.filter("slope_deg is not null"))


@query(
    "a11_event_state",
    """select hazard_id, type, cast(epoch_us(created_at) as bigint) as created_us, case when cleared_at is null then null else cast(epoch_us(cleared_at) as bigint) end as cleared_us,
       cleared_at is null as active from {hazard}""",
)
def event_state(w: World) -> DataFrame:
    h = w["hazard"].select("hazard_id", "type", "created_at", "cleared_at")
    created = h.select("hazard_id", "type", "created_at", F.lit(None).cast("timestamp").alias("cleared_at"), F.lit(0).alias("version"))
    cleared = h.filter("cleared_at is not null").withColumn("version", F.lit(1))
    state = current_state(created.unionByName(cleared), "hazard_id", ["version"])
    return state.select(
        "hazard_id", "type", F.unix_micros("created_at").alias("created_us"), F.unix_micros("cleared_at").alias("cleared_us"),
        F.col("cleared_at").isNull().alias("active"),
    )

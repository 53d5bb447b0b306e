"""Road network from way geometries: junctions, runs, segments, directed edges, components.

``ways`` has one row per way: ``way_id, geometry ARRAY<STRUCT<lat,lng>>`` and the raw tags
``name, highway, ref, oneway, maxspeed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarmetric import params as P
from tarmetric.functions.geo import polyline_km, representative_point
from tarmetric.functions.risk import base_risk, lookup, terrain_class
from tarmetric.functions.rounding import round_dp
from tarmetric.functions.text import stripped
from tarmetric.operators.gridjoin import nearest_edges, nearest_points, node_edges
from tarmetric.operators.skew import ordinal, running_sum, salted_join
from tarmetric.session import drop_path, materialize, scratch_path

E6 = 10**P.COORD_DECIMALS


def coord_key(degrees: Column) -> Column:
    """Coordinate rounded to six decimals as an exact integer join key."""
    return F.floor(degrees * E6 + F.lit(0.5)).cast("long")


def way_vertices(ways: DataFrame) -> DataFrame:
    """One row per vertex of every usable way (two vertices at least)."""
    usable = ways.filter(F.size("geometry") >= 2)
    return usable.select("way_id", F.size("geometry").alias("n_vertices"), F.posexplode("geometry").alias("seq", "p")).select(
        "way_id",
        "seq",
        F.col("p.lat").alias("lat"),
        F.col("p.lng").alias("lng"),
        coord_key(F.col("p.lat")).alias("lat_key"),
        coord_key(F.col("p.lng")).alias("lng_key"),
        ((F.col("seq") == 0) | (F.col("seq") == F.col("n_vertices") - 1)).alias("is_end"),
    )


def junctions(vertices: DataFrame) -> DataFrame:
    """Coordinates that become nodes: a way end, or touched at least twice."""
    return (
        vertices.groupBy("lat_key", "lng_key")
        .agg(F.count(F.lit(1)).alias("touches"), F.max("is_end").alias("is_end"))
        .filter((F.col("touches") >= 2) | F.col("is_end"))
    )


def number_nodes(joints: DataFrame) -> DataFrame:
    """Node ids ``n00000...`` in (lat, lng) order.

    Bands of 0.001 degrees of latitude bound the one window over band counts to 180,000 rows.
    """
    placed = ordinal(joints, F.floor(F.col("lat_key") / 1000), ["lat_key", "lng_key"], "rank")
    return placed.select(
        F.format_string("n%05d", F.col("rank").cast("long")).alias("node_id"),
        "lat_key",
        "lng_key",
        (F.col("lat_key") / F.lit(float(E6))).alias("lat"),
        (F.col("lng_key") / F.lit(float(E6))).alias("lng"),
    )


def split_runs(vertices: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices labelled with the run they belong to; an inner junction closes one run and opens the next."""
    flagged = vertices.join(nodes.select("lat_key", "lng_key", "node_id"), ["lat_key", "lng_key"], "left")
    seen = running_sum(
        flagged, ["way_id"], "seq", F.when(F.col("node_id").isNotNull(), 1).otherwise(0), "junctions_so_far"
    )
    # A junction vertex ends run j-2 and starts run j-1 (counting junctions from 1).
    run = F.when(
        F.col("node_id").isNotNull(), F.array(F.col("junctions_so_far") - 2, F.col("junctions_so_far") - 1)
    ).otherwise(F.array(F.col("junctions_so_far") - 1))
    return seen.withColumn("raw_run", F.explode(run)).filter(F.col("raw_run") >= 0)


def assemble_runs(run_vertices: DataFrame) -> DataFrame:
    """One row per run with its end nodes and geometry; self-loops are dropped, then runs are numbered."""
    packed = F.array_sort(F.collect_list(F.struct("seq", "lat", "lng", "node_id")))
    runs = run_vertices.groupBy("way_id", "raw_run").agg(packed.alias("v")).filter(F.size("v") >= 2)
    ends = runs.select(
        "way_id",
        "raw_run",
        F.col("v")[0]["node_id"].alias("from_node_id"),
        F.element_at("v", -1)["node_id"].alias("to_node_id"),
        F.transform("v", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("geometry"),
    )
    kept = ends.filter(F.col("from_node_id").isNotNull() & F.col("to_node_id").isNotNull()).filter(
        F.col("from_node_id") != F.col("to_node_id")
    )
    order = W.partitionBy("way_id").orderBy("raw_run")
    return kept.withColumn("run_index", F.row_number().over(order) - 1).drop("raw_run")


def tagged_speed(maxspeed: Column) -> Column:
    """First token of the raw tag as a number; zero and unparseable values count as missing."""
    token = F.split(stripped(maxspeed), r"(?U)\s+")[0]
    return F.nullif(token.try_cast("double"), F.lit(0.0))


def assumed_speed(maxspeed: Column, highway: Column) -> Column:
    return F.coalesce(tagged_speed(maxspeed), lookup(highway, P.ROAD_CLASS_SPEED), F.lit(P.FALLBACK_SPEED))


def road_type(highway: Column) -> Column:
    return F.when(highway.isin(list(P.ROAD_CLASS_SPEED)), highway).otherwise("unclassified")


def is_bidirectional(oneway: Column) -> Column:
    return F.lower(stripped(F.coalesce(oneway, F.lit("")))) != "yes"


def segment_attributes(runs: DataFrame, ways: DataFrame) -> DataFrame:
    """Length, speed, minutes, class and direction of every run."""
    tags = ways.select("way_id", "name", "highway", "ref", "oneway", "maxspeed")
    km = polyline_km(F.col("geometry"))
    speed = assumed_speed(F.col("maxspeed"), F.col("highway"))
    return runs.join(tags, "way_id").select(
        F.concat(F.lit("seg_"), F.col("way_id").cast("string"), F.lit("_"), F.col("run_index").cast("string")).alias("segment_id"),
        "way_id",
        "run_index",
        "from_node_id",
        "to_node_id",
        "name",
        "ref",
        "oneway",
        "maxspeed",
        road_type(F.col("highway")).alias("road_type"),
        is_bidirectional(F.col("oneway")).alias("bidirectional"),
        round_dp(speed, 1).alias("assumed_speed_kph"),
        round_dp(km, 4).alias("distance_km"),
        round_dp(km / speed * 60.0, 2).alias("travel_time_min"),
        "geometry",
    )


def keep_shortest_parallel(segments: DataFrame) -> DataFrame:
    """One segment per unordered node pair: the shortest, then the lowest id.

    An aggregation, not a window: map-side combine copes with a pair that has very many copies.
    """
    lo, hi = F.least("from_node_id", "to_node_id"), F.greatest("from_node_id", "to_node_id")
    winners = (
        segments.groupBy(lo.alias("_a"), hi.alias("_b"))
        .agg(F.min(F.struct("distance_km", "segment_id")).alias("_w"))
        .select(F.col("_w.segment_id").alias("segment_id"))
    )
    return segments.join(winners, "segment_id", "left_semi")


def build_network(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, segments) of the whole road table."""
    vertices = way_vertices(ways)
    nodes = number_nodes(junctions(vertices))
    runs = assemble_runs(split_runs(vertices, nodes))
    segments = keep_shortest_parallel(segment_attributes(runs, ways))
    return nodes.select("node_id", "lat", "lng"), segments


def tag_named_places(nodes: DataFrame, places: DataFrame, max_km: float = P.NAMED_PLACE_SNAP_KM) -> DataFrame:
    """Each named place with its nearest node; a place farther than ``max_km`` stops the job."""
    snapped = nearest_edges(places, node_edges(nodes), max_km * 1000.0, lat="lat", lng="lng")
    too_far = F.concat(F.lit("no node near "), F.col("name"))
    checked = F.when(F.col("nearest_km") > max_km, F.raise_error(too_far).cast("string")).otherwise(F.col("nearest_id"))
    return snapped.withColumn("node_id", checked).drop("nearest_id", "nearest_lat", "nearest_lng")


def dangling_endpoints(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment ends that reference no node; an intact network returns no rows."""
    ends = segments.select("segment_id", F.explode(F.array("from_node_id", "to_node_id")).alias("node_id"))
    return ends.join(nodes, "node_id", "left_anti")


def with_terrain(segments: DataFrame, terrain: DataFrame, places: DataFrame) -> DataFrame:
    """Sampled elevation and slope where present, else the nearest reference place by midpoint.

    ``terrain``: ``segment_id, elevation_m, slope_deg``. The nearest place is found on the grid, for
    any number of places; of places at one distance the lower elevation counts.
    """
    joined = segments.join(terrain.select("segment_id", F.col("elevation_m").alias("_dem"), "slope_deg"), "segment_id", "left")
    mid = representative_point(F.col("geometry"))
    asked = joined.filter(F.col("_dem").isNull()).select(F.col("segment_id").alias("qid"), mid["lat"].alias("lat"), mid["lng"].alias("lng"))
    refs = nearest_points(asked, places.select(F.col("elevation_m").alias("id"), "lat", "lng"), 1)
    joined = joined.join(refs.select(F.col("qid").alias("segment_id"), F.col("id").alias("_ref")), "segment_id", "left")
    elevation = round_dp(F.coalesce(F.col("_dem"), F.col("_ref"), F.lit(P.FALLBACK_ELEVATION_M)), 1)
    sampled = F.col("_dem").isNotNull()
    out = joined.withColumn("elevation_m", elevation)
    out = out.withColumn("slope_deg", F.when(sampled, round_dp("slope_deg", 2)))
    out = out.withColumn("terrain_type", terrain_class(F.col("elevation_m")))
    out = out.withColumn("base_risk", base_risk(F.col("terrain_type"), F.lit(0.0), F.lit(0.0)))
    origin = F.when(sampled, "real: elevation samples").otherwise("fallback: nearest reference place")
    slope_origin = (
        F.when(sampled & F.col("slope_deg").isNotNull(), "real: mean absolute gradient")
        .when(sampled, "insufficient samples")
        .otherwise("unavailable")
    )
    source = F.create_map(
        F.lit("geometry"), F.lit("real: way geometry"),
        F.lit("travel_time_min"), F.lit("derived: distance over tagged or class speed"),
        F.lit("elevation_m"), origin,
        F.lit("slope_deg"), slope_origin,
        F.lit("terrain_type"), F.lit("derived: elevation thresholds"),
        F.lit("susceptibility"), F.lit("not assessed"),
    )
    return out.withColumn("source", source).drop("_dem", "_ref")


def directed_edges(segments: DataFrame) -> DataFrame:
    """Forward edge of every segment, reverse edge of two-way ones, one edge per ordered pair.

    Where two segments give the same ordered pair the higher id wins.
    """
    carried = [c for c in segments.columns if c not in ("from_node_id", "to_node_id", "geometry")]
    forward = segments.select(F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"), *carried)
    back = segments.filter("bidirectional").select(F.col("to_node_id").alias("src"), F.col("from_node_id").alias("dst"), *carried)
    both = forward.unionByName(back)
    rest = [c for c in carried if c != "segment_id"]
    picked = both.groupBy("src", "dst").agg(F.max(F.struct("segment_id", *rest)).alias("e"))
    return picked.select("src", "dst", "e.*")


def weak_components(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(node_id, component): the lowest node id reachable when direction is ignored.

    Each round takes the lowest neighbouring label and then follows the label once more
    (pointer jumping), so the number of rounds grows with the logarithm of the diameter. Rounds
    are written tables, not lineage.
    """
    spark = nodes.sparkSession
    pairs = segments.select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "component-edges")
    path = scratch_path(spark, "component")
    labels = materialize(nodes.select("node_id", F.col("node_id").alias("component")), "component", path)
    while True:
        low = (
            both.join(labels.withColumnRenamed("node_id", "b"), "b")
            .groupBy(F.col("a").alias("node_id"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(low, "node_id", "left").select(
            "node_id", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        # Written, because the step below reads it more than once.
        hooked_path = scratch_path(spark, "component")
        hooked = materialize(hooked, "component", hooked_path)
        # Only labels that are themselves relabelled matter, and each is looked up once however
        # many nodes carry it.
        used = hooked.select("component").distinct()
        jump = (
            used.join(hooked.select(F.col("node_id").alias("component"), F.col("component").alias("root")), "component")
            .filter(F.col("root") < F.col("component"))
        )
        step = salted_join(hooked, jump, ["component"], "left").select(
            "node_id",
            F.coalesce("root", "component").alias("component"),
            (F.coalesce("root", "component") < F.col("old")).alias("moved"),
        )
        next_path = scratch_path(spark, "component")
        written = materialize(step, "component", next_path)
        moved = not written.filter("moved").isEmpty()
        drop_path(spark, path)
        drop_path(spark, hooked_path)
        labels, path = written.select("node_id", "component"), next_path
        if not moved:
            return labels


def main_component(labels: DataFrame) -> DataFrame:
    """Node ids of the largest component (lowest label on a tie)."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size"), "component").limit(1).select("component")
    return labels.join(F.broadcast(top), "component", "left_semi").select("node_id")


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng")
    )


def in_box(lat: Column, lng: Column) -> Column:
    return lat.between(F.col("min_lat"), F.col("max_lat")) & lng.between(F.col("min_lng"), F.col("max_lng"))


def resolve_locations(requests: DataFrame, nodes: DataFrame, text: str = "location") -> DataFrame:
    """Node for a text location: id first, then name, both without regard to case; NULL if unknown."""
    needle = F.lower(stripped(F.col(text)))
    ids = nodes.groupBy(F.lower(F.col("node_id").cast("string")).alias("_needle")).agg(F.min("node_id").alias("_by_id"))
    names = (
        nodes.filter(F.col("name").isNotNull())
        .groupBy(F.lower("name").alias("_needle"))
        .agg(F.min("node_id").alias("_by_name"))
    )
    asked = requests.withColumn("_needle", needle)
    out = asked.join(ids, "_needle", "left").join(names, "_needle", "left")
    status = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name").otherwise("unknown")
    return (
        out.withColumn("node_id", F.coalesce("_by_id", "_by_name"))
        .withColumn("resolved_by", status)
        .drop("_needle", "_by_id", "_by_name")
    )

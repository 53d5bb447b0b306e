"""Grid joins against brute force, thresholds, skew helpers and network construction."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from tarmetric.functions.geo import edge_distance_km
from tarmetric.functions.rounding import round_dp
from tarmetric.operators import gridjoin as G
from tarmetric.operators import network as N
from tarmetric.operators import rainfall, zonation
from tarmetric.operators import terrain as T
from tarmetric.operators.gridjoin import EDGE, containing_polygons, nearest_edges
from tarmetric.operators.intake import snap_reports
from tarmetric.operators.skew import next_in_group, ordinal, running_sum, salted_join

EDGES = "segment_id string, seq int, lat1 double, lng1 double, lat2 double, lng2 double"


def brute(points, edges):
    d = round_dp(edge_distance_km(F.col("latitude"), F.col("longitude"), *[F.col(c) for c in EDGE]), 7)
    best = points.crossJoin(edges).groupBy("id").agg(F.min(F.struct(d.alias("km"), "segment_id")).alias("m"))
    return {r.id: (r.m.km, r.m.segment_id) for r in best.collect()}


def test_nearest_edge_is_exact_near_and_far(spark):
    rng = random.Random(5)
    edges = []
    for i in range(120):
        a, b = rng.uniform(26, 27), rng.uniform(91, 92)
        edges.append((f"s{i:03d}", 0, a, b, a + rng.uniform(-0.05, 0.05), b + rng.uniform(-0.05, 0.05)))
    edges.append(("far", 0, 60.0, -120.0, 60.1, -120.0))
    points = [(i, rng.uniform(25.5, 27.5), rng.uniform(90.5, 92.5)) for i in range(150)]
    points += [(900, -45.0, 170.0), (901, 61.0, -119.0), (902, 26.5, 91.5), (903, 26.5, 91.5)]
    e = spark.createDataFrame(edges, EDGES)
    p = spark.createDataFrame(points, "id int, latitude double, longitude double")
    got = {r.id: (r.nearest_km, r.nearest_id) for r in nearest_edges(p, e, 500.0).collect()}
    assert got == brute(p, e)


def test_snap_threshold_and_ties(spark):
    e = spark.createDataFrame([("b", 0, 27.0, 92.6, 27.01, 92.6), ("a", 0, 27.01, 92.6, 27.02, 92.6)], EDGES)
    meters = 1 / 111_194.93
    rows = [(1, 27.005, 92.6 + 299 * meters / 0.891), (2, 27.005, 92.6 + 301 * meters / 0.891), (3, 27.01, 92.6)]
    p = spark.createDataFrame(rows, "report_id int, latitude double, longitude double")
    got = {r.report_id: r for r in snap_reports(p, e).collect()}
    assert got[1].accepted and not got[2].accepted and got[2].segment_id is None
    assert got[2].nearest_segment_id == "b" and 299 < got[2].distance_to_road_m < 303
    assert got[3].segment_id == "a" and got[3].distance_to_road_m == 0.0


def test_polygons_of_very_different_size(spark):
    def ring(y0, x0, y1, x1):
        return [{"lat": y, "lng": x} for y, x in ((y0, x0), (y0, x1), (y1, x1), (y1, x0), (y0, x0))]

    polys = spark.createDataFrame(
        [(1, "High", ring(10.0, 20.0, 10.1, 20.1)), (2, "Low", ring(10.0, 20.1, 10.1, 20.2)), (3, "very low", ring(-40.0, -100.0, 60.0, 100.0))],
        "polygon_id bigint, hazard_class string, ring array<struct<lat:double,lng:double>>",
    )
    pts = spark.createDataFrame([(1, 10.05, 20.05), (2, 10.05, 20.15), (3, 10.0, 20.05), (4, 70.0, 20.0)], "id int, lat double, lng double")
    pairs = {(r.id, r.polygon_id) for r in containing_polygons(pts, polys).collect()}
    assert pairs == {(1, 1), (1, 3), (2, 2), (2, 3), (3, 3)}
    zone = {r.id: (r.status, r.hazard_class, r.hazard_score) for r in zonation.point_zone(pts, polys, ["id"]).collect()}
    assert zone[1] == ("ok", "High", 0.7) and zone[3] == ("ok", "very low", 0.1) and zone[4] == ("no_coverage", None, None)


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        salted = salted_join(left, right, ["k"], how, hot_min=100).select("k", "v", "w")
        plain = left.join(right, "k", how).select("k", "v", "w")
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_two_level_windows(spark):
    df = spark.range(200).select(F.col("id").cast("int").alias("i"), (F.col("id") % 2).alias("k"), (F.col("id") * 1.0).alias("x"))
    sums = {r.i: r.s for r in running_sum(df, ["k"], "i", F.col("x"), "s", chunk=16).collect()}
    assert sums[7] == 1 + 3 + 5 + 7 and sums[198] == sum(range(0, 199, 2))
    nxt = {r.i: r.next_x for r in next_in_group(df, ["k"], ["i"], F.floor(F.col("i") / 30), ["x"]).collect()}
    assert nxt[28] == 30.0 and nxt[29] == 31.0 and nxt[198] is None
    pos = {r.i: r.p for r in ordinal(df, F.floor(F.col("x") / 17), ["x"], "p").collect()}
    assert pos == {i: i for i in range(200)}


WAYS = "way_id bigint, geometry array<struct<lat:double,lng:double>>, name string, highway string, ref string, oneway string, maxspeed string"


def way(wid, pts, highway="primary", oneway=None, maxspeed=None):
    return (wid, [{"lat": a, "lng": b} for a, b in pts], None, highway, None, oneway, maxspeed)


def test_network_split_loop_and_parallel(spark):
    ways = spark.createDataFrame(
        [
            way(1, [(0.0, 0.0), (0.0, 0.1), (0.0, 0.2)], maxspeed="30 mph"),
            way(2, [(-0.1, 0.1), (0.0, 0.1), (0.1, 0.1)], "motorway", " YES "),
            way(3, [(0.0, 0.0), (0.05, 0.05), (0.0, 0.1)]),
            way(4, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.1)]),
            way(5, [(9.0, 9.0)]),
        ],
        WAYS,
    )
    nodes, segments = N.build_network(ways)
    assert [r.node_id for r in nodes.orderBy("lat", "lng").collect()] == [f"n{i:05d}" for i in range(5)]
    got = {r.segment_id: r for r in segments.collect()}
    assert set(got) == {"seg_1_0", "seg_1_1", "seg_2_0", "seg_2_1"}
    assert got["seg_1_0"].assumed_speed_kph == 30.0 and got["seg_2_0"].assumed_speed_kph == 25.0
    assert got["seg_2_0"].road_type == "unclassified" and not got["seg_2_0"].bidirectional
    assert N.dangling_endpoints(nodes, segments).isEmpty()
    assert N.directed_edges(segments).count() == 6
    assert {r.component for r in N.weak_components(nodes, segments).collect()} == {"n00000"}


def test_components_of_a_long_chain_and_an_island(spark):
    nodes = spark.range(60).select(F.col("id").alias("node_id"))
    segs = spark.range(48).select((F.col("id") + 1).alias("from_node_id"), F.col("id").alias("to_node_id"))
    labels = {r.node_id: r.component for r in N.weak_components(nodes, segs).collect()}
    assert {labels[i] for i in range(49)} == {0} and labels[55] == 55
    assert N.main_component(N.weak_components(nodes, segs)).count() == 49


def test_elevation_bilinear_void_and_outside(spark):
    grid = [(27, 92, r, c, e) for r, row in enumerate([[10, 20, 30], [40, 51, 60], [70, 80, -32768]]) for c, e in enumerate(row)]
    g = spark.createDataFrame(grid, "tile_lat int, tile_lng int, row int, col int, elev int")
    pts = spark.createDataFrame([(1, 27.75, 92.25), (2, 27.2, 92.6), (3, 27.0, 92.99), (4, 28.5, 92.5)], "id int, lat double, lng double")
    got = {r.id: r.elev for r in T.sample_elevation(pts, g, ["id"], tile_samples=3).collect()}
    assert got[1] == (10 + 20 + 40 + 51) / 4
    assert got[2] == 80.0 and got[3] is None and got[4] is None


def test_rain_statuses(spark):
    rain = spark.createDataFrame(
        [("2023-06-21", 27.0, 92.0, 0.0), ("2023-06-21", 27.0, 92.25, None), ("2023-06-21", 27.25, 92.0, 12.5), ("2023-06-21", 27.25, 92.25, 3.0)],
        "d string, lat double, lng double, rainfall_mm double",
    ).select(F.col("d").cast("date").alias("obs_date"), "lat", "lng", "rainfall_mm")
    pts = spark.createDataFrame(
        [(1, 27.01, 92.01, "2023-06-21"), (2, 27.0, 92.2, "2023-06-21"), (3, 26.75, 92.0, "2023-06-21"), (4, 27.0, 92.0, "2023-06-22"), (5, 27.2, 92.06, "2023-06-21")],
        "id int, lat double, lng double, d string",
    ).withColumn("obs_date", F.col("d").cast("date"))
    got = {r.id: (r.status, r.rainfall_mm, r.weather_factor) for r in rainfall.daily_rainfall(pts, rain).collect()}
    assert got[1] == ("ok", 0.0, 0.0) and got[2] == ("missing_value", None, None)
    assert got[3] == ("no_coverage", None, None) and got[4] == ("no_coverage", None, None) and got[5][0] == "ok"


def test_polygon_holes_and_parts(spark, tmp_path):
    from tarmetric.sources.readers import read_zones

    square = lambda y, x, d: [[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]
    import json

    feature = lambda i, kind, c: json.dumps({"type": "Feature", "properties": {"polygon_id": i, "hazard_class": "High"}, "geometry": {"type": kind, "coordinates": c}})
    lines = [feature(1, "Polygon", [square(0, 0, 10), square(4, 4, 2)]), feature(2, "MultiPolygon", [[square(20, 20, 1)], [square(30, 30, 4), square(31, 31, 1)]])]
    (tmp_path / "zones.json").write_text("\n".join(lines))
    zones = read_zones(spark, str(tmp_path / "zones.json"))
    points = spark.createDataFrame([("in", 1.0, 1.0), ("hole", 5.0, 5.0), ("edge", 4.0, 5.0), ("part", 20.5, 20.5), ("part2", 33.5, 30.5), ("hole2", 31.5, 31.5), ("out", 15.0, 15.0)], "name string, lat double, lng double")
    got = sorted((r["name"], r["polygon_id"]) for r in containing_polygons(points, zones).collect())
    assert got == [("in", 1), ("part", 2), ("part2", 2)]
    (tmp_path / "bad.json").write_text(feature(3, "Point", [1, 2]))
    import pytest

    with pytest.raises(Exception, match="unreadable polygon"):
        read_zones(spark, str(tmp_path / "bad.json")).collect()


def test_nearest_annual_cell_on_an_uneven_lattice(spark):
    rng = random.Random(3)
    cells = sorted({(rng.choice([0.0, 0.75, 1.5, 40.0]), rng.choice([0.0, 0.25, 2.0, 90.0])) for _ in range(9)}) + [(0.25, 0.25)]
    points = [(k, rng.uniform(-5, 60), rng.uniform(-5, 120)) for k in range(60)] + [(100, 0.49, 0.02), (101, 0.02, 0.22), (102, None, 1.0)]
    got = rainfall.nearest_annual_cell(spark.createDataFrame(points, "id long, lat double, lng double"), spark.createDataFrame(cells, "lat double, lng double")).collect()
    assert len(got) == len(points)
    for r in got:
        want = None if r["lat"] is None else min(cells, key=lambda c: ((c[0] - r["lat"]) ** 2 + (c[1] - r["lng"]) ** 2, c))
        assert (r["grid_lat"], r["grid_lng"]) == (want or (None, None))


def test_white_space_and_line_breaks(spark, tmp_path):
    from tarmetric.functions.text import district
    from tarmetric.sources.readers import read_inventory

    row = spark.createDataFrame([("\tTawang road", "\t45", "yes\n")], "d string, s string, o string")
    got = row.select(district(F.col("d")), N.tagged_speed(F.col("s")), N.is_bidirectional(F.col("o"))).first()
    assert tuple(got) == ("Tawang", 45.0, False)
    head = "slide_no,slide_id,state,description_before_coordinates,latitude,longitude,description_after_coordinates,raw_record\n"
    (tmp_path / "inventory.csv").write_text(head + '1,a,s,"two\nlines",27.0,92.0,x,y\n')
    rows = read_inventory(spark, str(tmp_path / "inventory.csv")).collect()
    assert len(rows) == 1 and rows[0]["description_before_coordinates"] == "two\nlines"


def test_raster_blocks_sample_like_the_grid(spark, tmp_path):
    """Blocks of any size give the elevations of the long grid, on edges, voids, far edges and absent tiles."""
    from tarmetric.sources import readers, writers

    rng = random.Random(5)
    n = 8
    lines = [(lat, 91, r, [-32768 if rng.random() < 0.1 else rng.randrange(-50, 3000) for _ in range(n)]) for lat in (26, -1) for r in range(n)]
    df = spark.createDataFrame(lines, "tile_lat int, tile_lng int, row int, samples array<int>")
    path = str(tmp_path / "tiles")
    assert sorted(writers.write_tiles(df, path).collect()) == [("N26E091", n), ("S01E091", n)]
    grid = readers.read_tiles(spark, path, tile_samples=n)
    assert {(r.tile_lat, r.row, r.col): r.elev for r in grid.collect()} == {(t, r, c): e for t, _, r, s in lines for c, e in enumerate(s)}
    pts = [(i, rng.choice([26, -1, 40]) + rng.choice([0.0, 1 / 7, 0.999999, rng.random()]), 91 + rng.choice([0.0, 3 / 7, 0.5, rng.random()])) for i in range(300)]
    points = spark.createDataFrame(pts, "id int, lat double, lng double")
    want = {r.id: r.elev for r in T.sample_elevation(points, grid, ["id"], tile_samples=n).collect()}
    for side in (2, 3, 7):
        blocks = readers.read_tile_blocks(spark, path, tile_samples=n, intervals=side)
        assert {(r.row, r.col, r.tile_lat): r.elev for r in readers.block_rows(blocks, n, side).collect()} == {(r.row, r.col, r.tile_lat): r.elev for r in grid.collect()}
        got = {r.id: r.elev for r in T.sample_blocks(points, blocks, n, side).collect()}
        assert got.keys() == want.keys()
        for i, e in want.items():
            assert got[i] == (None if e is None else pytest.approx(e, abs=1e-9))


def test_exploded_rows_are_not_broadcast(spark):
    """The size of exploded rows is estimated as that of their input, so they would go through the driver."""
    from tarmetric.operators.skew import next_in_group, running_sum, salted_join

    rows = spark.range(50).select("id", F.explode(F.sequence(F.lit(0), F.lit(400))).alias("i"))
    summed = running_sum(rows, ["id"], "i", F.col("i"), "s", chunk=100)
    nexts = next_in_group(rows, ["id"], ["i"], F.floor(F.col("i") / 100), ["i"])
    joined = salted_join(spark.range(50).withColumnRenamed("id", "k"), rows.withColumnRenamed("id", "k"), ["k"])
    for out in (summed, nexts, joined):
        last = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "LeftOuter" not in line][0]
        assert "SortMergeJoin" in last
    assert summed.filter("i = 400 and s = 80200").count() == 50
    assert nexts.filter("next_i = i + 1").count() == 50 * 400 and joined.count() == 50 * 401


def test_near_queries_are_settled_in_the_cells_around_them(spark, monkeypatch):
    rng = random.Random(11)
    points = [(i, 26 + rng.random() * 0.03, 91.5 + rng.random() * 0.03) for i in range(300)] + [(1000 + i, -89.995, 179.999 - 40 * i) for i in range(9)]
    points += [(2000, 10.0, 179.9995), (2001, 10.0, -179.9995), (2002, 10.02, 179.98)]
    asked = [(f"q{i}", 26 + rng.random() * 0.03, 91.5 + rng.random() * 0.03) for i in range(40)] + [("far", 40.0, 100.0), ("pole", -89.99, 0.0), ("line", 10.0, 179.9999)]
    q = spark.createDataFrame(asked, "qid string, lat double, lng double")
    p = spark.createDataFrame(points, "id long, lat double, lng double")
    walked = []
    walk = G._walk_to_points
    monkeypatch.setattr(G, "_walk_to_points", lambda rest, *a: walked.extend(r.qid for r in rest.collect()) or walk(rest, *a))
    got = {(r.qid, r["rank"]): r.id for r in G.nearest_points(q, p, 2).collect()}
    every = q.crossJoin(p.withColumnsRenamed({"lat": "_lat", "lng": "_lng"}))
    d = G.round_dp(G.haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")), 7)
    place = F.row_number().over(W.partitionBy("qid").orderBy(d, "id"))
    want = {(r.qid, r["rank"]): r.id for r in every.withColumn("rank", place).filter("rank <= 2").collect()}
    assert got == want
    assert {"far", "pole", "line"} <= set(walked) and len(walked) < 10

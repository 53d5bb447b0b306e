"""Plans and rows whose cost must not grow faster than their input."""

import random

from pyspark.sql import functions as F

from tarmetric.operators import gridjoin as G, zonation


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def edges_between(spark, n):
    rng = random.Random(11)
    rows = [(f"s{i}", rng.uniform(26, 27), rng.uniform(91, 92)) for i in range(n)]
    rows = [(s, a, b, a + rng.uniform(-0.03, 0.03), b + rng.uniform(-0.03, 0.03)) for s, a, b in rows]
    rows += [("flat", 26.5, 91.2, 26.5, 91.6), ("point", 26.5, 91.5, 26.5, 91.5), ("north", 86.2, 10.0, 86.9, 20.0), ("upright", -10.0, 5.0, -10.3, 5.0)]
    return spark.createDataFrame(rows, "segment_id string, lat1 double, lng1 double, lat2 double, lng2 double")


def test_edge_is_filed_once_under_each_cell_in_reach(spark):
    deg = G._cell_deg(500.0)
    edges = edges_between(spark, 40)
    filed = G._buffered_cells(edges, deg)
    assert "Aggregate" not in plan_of(filed) and "Exchange" not in plan_of(filed)
    cells = [(r.segment_id, r.iy, r.ix) for r in filed.select("segment_id", "iy", "ix").collect()]
    assert len(cells) == len(set(cells))
    # every place up to 500 m off the edge lies in one of its cells
    rng = random.Random(3)
    near = []
    for e in edges.collect():
        for _ in range(40):
            t, up, right = rng.random(), rng.uniform(-0.7, 0.7) * deg / 1.02, rng.uniform(-0.7, 0.7)
            lat = e.lat1 + (e.lat2 - e.lat1) * t + up
            near.append((e.segment_id, lat, e.lng1 + (e.lng2 - e.lng1) * t, right * deg / 1.02))
    points = spark.createDataFrame(near, "segment_id string, lat double, lng double, _right double")
    points = points.select("segment_id", "lat", (F.col("lng") + F.col("_right") / F.cos(F.radians(F.abs("lat")))).alias("lng"))
    for size in (deg, deg * G.COARSE):
        own = G._buffered_cells(edges, size, deg)
        assert G._probes(points, size).join(own, ["segment_id", "iy", "ix"], "left_anti").isEmpty()


def test_nearest_edge_is_kept_without_sorting_candidates(spark):
    edges = G._numbered(edges_between(spark, 20))
    spots = spark.createDataFrame([(26.5, 91.5)], "lat double, lng double")
    best = G._best(spots.crossJoin(edges), ["lat", "lng"])
    assert "SortAggregate" not in plan_of(best)
    # two edges pass through the spot; the lower id wins
    assert [(r.dist_km, r.segment_id) for r in best.join(edges, "edge_no").collect()] == [(0.0, "flat")]


def test_polygon_sides_are_cut_once_a_polygon_and_measure_nothing(spark):
    ring = [{"lat": y, "lng": x} for y, x in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0))]
    polys = spark.createDataFrame([(1, ring)], "polygon_id bigint, ring array<struct<lat:double,lng:double>>")
    spots = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 0.5), (3, 0.0, 0.5)], "id int, lat double, lng double")
    inside = G.containing_polygons(spots, polys)
    plan = plan_of(inside).lower()
    assert "asin" not in plan
    condition = [line for line in plan.splitlines() if "sortmergejoin" in line and "_iy" in line]
    assert condition and not any("slice" in line for line in condition)
    assert [r.id for r in inside.collect()] == [1]


def test_samples_measure_a_segment_once(spark):
    line = [{"lat": 26.0, "lng": 91.0}, {"lat": 26.0, "lng": 91.1}, {"lat": 26.1, "lng": 91.1}]
    segments = spark.createDataFrame([("s", line, 21.0)], "segment_id string, geometry array<struct<lat:double,lng:double>>, distance_km double")
    samples = zonation.segment_samples(segments)
    above = plan_of(samples).lower().split("generate explode")[0]
    assert "asin" not in above
    assert samples.count() == 5

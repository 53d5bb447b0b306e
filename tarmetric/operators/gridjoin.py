"""Nearest-edge and point-in-polygon joins on a grid, exact and without pair explosions.

Nearest edge, two stages:

1. Every edge is written into each grid cell that any point within ``threshold_m`` of it can
   fall into. A query point probes exactly one cell, so the large side is never repeated. This
   settles every point that has an edge within the threshold.
2. Points still open walk down a pyramid of occupied cells. At each level the cells whose
   nearest possible distance exceeds the best guaranteed distance are dropped, so only the edges
   of a few leaf cells are measured. Nothing is capped: the bounds are conservative.

Repeated query coordinates and repeated edges are collapsed before any of this.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tarmetric.functions.geo import closest_on_edge, edge_distance_km, haversine_km, in_ring, sides, within_sides
from tarmetric.functions.rounding import round_dp
from tarmetric.operators.skew import key_counts, salted_join
from tarmetric.params import KM_PER_DEG
from tarmetric.session import materialize

EDGE = ["lat1", "lng1", "lat2", "lng2"]
FANOUT = 4
LEVELS = 8
COARSE = 32
# Levels with no more cells than this may be broadcast; the size is counted first.
ROOT_CELLS = 64
BROADCAST_CELLS = 100_000
# Beyond every edge number; a power of two.
NUMBERS = "9223372036854775808bd"


def polyline_edges(segments: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row per polyline edge: ``segment_id, seq, lat1, lng1, lat2, lng2``."""
    g = F.col(geom)
    pairs = F.arrays_zip(
        F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(1))).alias("a"),
        F.when(F.size(g) == 1, g).otherwise(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(1)))).alias("b"),
    )
    return segments.select("segment_id", F.posexplode(pairs).alias("seq", "e")).select(
        "segment_id",
        "seq",
        F.col("e.a.lat").alias("lat1"),
        F.col("e.a.lng").alias("lng1"),
        F.col("e.b.lat").alias("lat2"),
        F.col("e.b.lng").alias("lng2"),
    )


def node_edges(nodes: DataFrame, id_col: str = "node_id") -> DataFrame:
    """Nodes as zero-length edges, so the nearest-node join is the nearest-edge join."""
    return nodes.select(
        F.col(id_col).alias("segment_id"),
        F.lit(0).alias("seq"),
        F.col("lat").alias("lat1"),
        F.col("lng").alias("lng1"),
        F.col("lat").alias("lat2"),
        F.col("lng").alias("lng2"),
    )


def _cell_deg(threshold_m: float) -> float:
    # A little over the threshold, so that rounding can never push a match out of its cell.
    return max(threshold_m / (KM_PER_DEG * 1000.0) * 1.02, 1e-5)


def _lng_width(band: Column, deg: float) -> Column:
    """Cell width in degrees of longitude for one latitude band (wider towards the poles)."""
    far = F.least(F.lit(89.0), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * deg)
    return F.lit(deg) / F.cos(F.radians(far))


def _pieces(edges: DataFrame, deg: float) -> DataFrame:
    """Cut edges into pieces no longer than about one cell; the full edge stays on the row."""
    longest = F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(F.col("lng2") - F.col("lng1")))
    n = F.greatest(F.lit(1), F.ceil(longest / deg).cast("int"))
    cut = edges.select(*edges.columns, n.alias("_n")).select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"))
    ends = []
    for axis in ("lat", "lng"):
        a, b = F.col(f"{axis}1"), F.col(f"{axis}2")
        p = a + (b - a) * ((F.col("_k") - 1) / F.col("_n"))
        q = a + (b - a) * (F.col("_k") / F.col("_n"))
        ends += [F.least(p, q).alias(f"_{axis}_lo"), F.greatest(p, q).alias(f"_{axis}_hi")]
    return cut.select(*edges.columns, *ends)


def _buffered_cells(edges: DataFrame, deg: float, reach: float | None = None) -> DataFrame:
    """(iy, ix) of every cell of ``deg`` within ``reach`` degrees (one cell size) of an edge, each once.

    Each band of latitude takes the part of the edge in its reach, so no cell comes twice.
    """
    reach = deg if reach is None else reach
    low = F.floor((F.least("lat1", "lat2") - reach) / deg)
    high = F.floor((F.greatest("lat1", "lat2") + reach) / deg)
    bands = edges.select(*edges.columns, F.explode(F.sequence(low, high)).alias("iy"))
    rise = F.col("lat2") - F.col("lat1")
    enters = F.coalesce(F.try_divide(F.col("iy") * deg - reach - F.col("lat1"), rise), F.lit(0.0))
    leaves = F.coalesce(F.try_divide((F.col("iy") + 1) * deg + reach - F.col("lat1"), rise), F.lit(1.0))
    ends = [F.col("lng1") + (F.col("lng2") - F.col("lng1")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) for t in (enters, leaves)]
    width = _lng_width(F.col("iy"), deg)
    side = width * (reach / deg)
    west, east = F.floor((F.least(*ends) - side) / width), F.floor((F.greatest(*ends) + side) / width)
    return bands.select(*edges.columns, "iy", F.explode(F.sequence(west, east)).alias("ix"))


def _probes(queries: DataFrame, deg: float) -> DataFrame:
    iy = F.floor(F.col("lat") / deg)
    return queries.withColumn("iy", iy).withColumn("ix", F.floor(F.col("lng") / _lng_width(F.col("iy"), deg)))


def _numbered(edges: DataFrame) -> DataFrame:
    """``edge_no, segment_id`` and ends of each different edge once, numbered in the order that settles ties."""
    unique = edges.groupBy(*EDGE).agg(F.min("segment_id").alias("segment_id"))
    return materialize(unique.orderBy("segment_id", *EDGE).select(F.monotonically_increasing_id().alias("edge_no"), "segment_id", *EDGE), "numbered-edges")


def _tenths_of_mm(lat: str, lng: str) -> Column:
    # Distances that agree to 0.1 mm are a tie; the lowest id wins it.
    return F.floor(edge_distance_km(F.col(lat), F.col(lng), *[F.col(c) for c in EDGE]) * F.lit(1e7) + F.lit(0.5)).cast("long")


def _best(candidates: DataFrame, query: list[str], within_m: float | None = None) -> DataFrame:
    """``query, dist_km, edge_no`` of the nearest numbered edge, of equally near ones the lowest number.

    Distance and number are one whole number, so the least is kept in a hash table with a row a query: there are many
    candidates to a query, and a struct with text would have them sorted first.
    """
    far = candidates.select(*query, "edge_no", _tenths_of_mm(*query).alias("_u"))
    if within_m is not None:
        far = far.filter(F.col("_u") / F.lit(1e7) * 1000.0 <= within_m)
    key = F.expr(f"cast(_u as decimal(13, 0)) * {NUMBERS} + cast(edge_no as decimal(20, 0))")
    least = far.groupBy(*query).agg(F.min(key).alias("_k"))
    return least.select(*query, (F.expr(f"_k div {NUMBERS}").cast("double") / F.lit(1e7)).alias("dist_km"), F.expr(f"cast(_k % {NUMBERS} as bigint)").alias("edge_no"))


def _pyramid(queries: DataFrame, edges: DataFrame, deg: float) -> DataFrame:
    """Exact nearest edge at any distance by branch and bound over occupied cells.

    The occupied cells are a written table, so the levels below do not recompute them. The walk
    starts at the finest level with at most ``ROOT_CELLS`` occupied cells.
    """
    size = [deg * FANOUT**k for k in range(LEVELS + 1)]
    middle_y, middle_x = (F.col("_lat_lo") + F.col("_lat_hi")) / 2, (F.col("_lng_lo") + F.col("_lng_hi")) / 2
    leaves = _pieces(edges, deg).select(
        *edges.columns, F.floor(middle_y / deg).alias("cy"), F.floor(middle_x / deg).alias("cx")
    )
    up = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    cells = leaves.select("cy", "cx").distinct().select(up, "cy", "cx")
    scale = F.pow(F.lit(float(FANOUT)), F.col("level"))
    cells = cells.select(
        "level", F.floor(F.col("cy") / scale).alias("cy"), F.floor(F.col("cx") / scale).alias("cx")
    ).distinct()
    cells = materialize(cells, "cells")
    per_level = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}
    top = min((k for k, n in per_level.items() if n <= ROOT_CELLS), default=LEVELS)

    def bounded(cand: DataFrame, level: int) -> DataFrame:
        half = size[level] / 2
        # Half diagonal of the cell plus a leaf: a piece is filed under its midpoint.
        reach = (half * math.sqrt(2) + deg) * KM_PER_DEG * 1.01
        to_center = haversine_km(
            F.col("lat"), F.col("lng"), F.col("cy") * size[level] + half, F.col("cx") * size[level] + half
        )
        ranked = cand.select("lat", "lng", "cy", "cx", to_center.alias("_d"))
        best = F.min("_d").over(W.partitionBy("lat", "lng"))
        return ranked.withColumn("_ub", best).filter(F.col("_d") - 2 * reach <= F.col("_ub")).drop("_d", "_ub")

    def at(level: int) -> DataFrame:
        return cells.filter(F.col("level") == level).select("cy", "cx")

    cand = bounded(queries.crossJoin(F.broadcast(at(top))), top)
    for level in range(top - 1, -1, -1):
        parent = (F.floor(F.col("cy") / FANOUT).alias("py"), F.floor(F.col("cx") / FANOUT).alias("px"))
        children = at(level).select(*parent, "cy", "cx")
        if per_level[level] <= BROADCAST_CELLS:
            children = F.broadcast(children)
        parents = cand.select("lat", "lng", F.col("cy").alias("py"), F.col("cx").alias("px"))
        cand = bounded(parents.join(children, ["py", "px"]), level)
    return _best(cand.join(leaves, ["cy", "cx"]), ["lat", "lng"])


def nearest_edges(
    points: DataFrame,
    edges: DataFrame,
    threshold_m: float,
    always: bool = True,
    lat: str = "latitude",
    lng: str = "longitude",
) -> DataFrame:
    """Append ``nearest_id, nearest_km, nearest_lat, nearest_lng`` to every point.

    Ties go to the lowest id. With ``always=False`` a point without an edge inside the threshold
    keeps NULLs and the pyramid stage is skipped.
    """
    deg = _cell_deg(threshold_m)
    numbered = _numbered(edges)
    unique = numbered.select("edge_no", *EDGE)
    keyed = points.withColumn("_lat", F.col(lat)).withColumn("_lng", F.col(lng))
    counts = key_counts(keyed, ["_lat", "_lng"])
    queries = counts.select(F.col("_lat").alias("lat"), F.col("_lng").alias("lng")).dropna()
    # only edges in a coarse cell that a point lies in, or within reach of one, are filed under the fine cells
    coarse = deg * COARSE
    occupied = _probes(queries, coarse).select("iy", "ix").distinct()
    beside = _buffered_cells(unique, coarse, deg).join(occupied, ["iy", "ix"], "left_semi").select("edge_no", *EDGE).distinct()
    near = _best(salted_join(_probes(queries, deg), _buffered_cells(beside, deg), ["iy", "ix"]), ["lat", "lng"], threshold_m)
    if always:
        near = materialize(near, "near")
        open_points = materialize(queries.join(near.select("lat", "lng"), ["lat", "lng"], "left_anti"), "open")
        if not open_points.isEmpty():
            near = near.unionByName(_pyramid(open_points, unique, deg))
    spot = closest_on_edge(F.col("lat"), F.col("lng"), *[F.col(c) for c in EDGE])
    found = near.join(numbered.hint("merge"), "edge_no").select(
        F.col("lat").alias("_lat"),
        F.col("lng").alias("_lng"),
        F.col("segment_id").alias("nearest_id"),
        F.col("dist_km").alias("nearest_km"),
        spot["lat"].alias("nearest_lat"),
        spot["lng"].alias("nearest_lng"),
    )
    return salted_join(keyed, found, ["_lat", "_lng"], "left", counts=counts).drop("_lat", "_lng")


def nearest_points(queries: DataFrame, points: DataFrame, k: int, cell_deg: float = 0.01) -> DataFrame:
    """``qid, id, dist_km, rank``: the ``k`` nearest points of every query, ties to the lower id.

    ``queries``: ``qid, lat, lng``; ``points``: ``id, lat, lng``. A query first meets the points of the nine cells around
    it. If ``k`` of them are nearer than any point outside can be, they are the answer; only the other queries walk
    down the pyramid of cells.
    """
    leaves = points.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.floor(F.col("lat") / cell_deg).alias("cy"), F.floor(F.col("lng") / cell_deg).alias("cx"))
    beside = [F.explode(F.sequence(F.floor(F.col(c) / cell_deg) - 1, F.floor(F.col(c) / cell_deg) + 1)) for c in ("lat", "lng")]
    probes = queries.select("qid", "lat", "lng", beside[0].alias("cy")).select("qid", "lat", "lng", "cy", beside[1].alias("cx"))
    near = salted_join(probes, leaves, ["cy", "cx"])
    dist = round_dp(haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")), 7)
    # A point outside is at least a cell away in latitude, or in longitude within these latitudes.
    narrow = F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + 2 * cell_deg)))
    sure = F.when(F.abs("lng") < 180 - 2 * cell_deg, 0.99 * cell_deg * KM_PER_DEG * narrow).otherwise(0.0)
    rank = F.row_number().over(W.partitionBy("qid").orderBy("dist_km", "id"))
    near = near.select("qid", "id", dist.alias("dist_km"), sure.alias("_sure")).withColumn("rank", rank).filter(F.col("rank") <= k)
    settled = F.max((F.col("rank") == k) & (F.col("dist_km") < F.col("_sure"))).over(W.partitionBy("qid"))
    near = materialize(near.withColumn("_settled", settled).filter("_settled").select("qid", "id", "dist_km", "rank"), "near-points")
    rest = queries.select("qid", "lat", "lng").join(near.filter("rank = 1").select("qid").hint("merge"), "qid", "left_anti")
    rest = materialize(rest, "far-queries")
    return near if rest.isEmpty() else near.unionByName(_walk_to_points(rest, points, k, cell_deg))


def _walk_to_points(queries: DataFrame, points: DataFrame, k: int, cell_deg: float) -> DataFrame:
    """:func:`nearest_points` at any distance.

    Queries walk down a pyramid of occupied cells that know how many points they hold. At each level the cells that
    surely hold ``k`` points bound the k-th distance, and cells that begin beyond it are dropped; only points of the last
    few cells are measured.
    """
    leaves = points.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.floor(F.col("lat") / cell_deg).alias("cy"), F.floor(F.col("lng") / cell_deg).alias("cx"))
    scale = F.pow(F.lit(float(FANOUT)), F.col("level"))
    counted = leaves.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    cells = counted.groupBy("level", F.floor(F.col("cy") / scale).alias("cy"), F.floor(F.col("cx") / scale).alias("cx")).agg(F.sum("n").alias("n"))
    cells = materialize(cells, "counted-cells")
    per_level = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}
    top = min((level for level, n in per_level.items() if n <= ROOT_CELLS), default=LEVELS)

    def bounded(cand: DataFrame, level: int) -> DataFrame:
        size = cell_deg * FANOUT**level
        reach = size / 2 * math.sqrt(2) * KM_PER_DEG * 1.01
        d = haversine_km(F.col("lat"), F.col("lng"), F.col("cy") * size + size / 2, F.col("cx") * size + size / 2)
        ranked = cand.withColumn("_d", d)
        held = F.sum("n").over(W.partitionBy("qid").orderBy("_d", "cy", "cx"))
        # the nearest cells that hold k points together reach no farther than the last of them
        ranked = ranked.withColumn("_enough", F.when(held >= k, F.col("_d")))
        ranked = ranked.withColumn("_ub", F.coalesce(F.min("_enough").over(W.partitionBy("qid")), F.lit(float("inf"))))
        return ranked.filter(F.col("_d") - 2 * reach <= F.col("_ub")).select("qid", "lat", "lng", "cy", "cx")

    def at(level: int) -> DataFrame:
        return cells.filter(F.col("level") == level).select("cy", "cx", "n")

    # at most ROOT_CELLS cells, so they go along as a constant
    root = [F.struct(*[F.lit(r[c]).cast("long").alias(c) for c in ("cy", "cx", "n")]) for r in at(top).collect()]
    if not root:
        none = points.schema["id"].dataType
        return queries.select("qid", F.lit(None).cast(none).alias("id"), F.lit(0.0).alias("dist_km"), F.lit(0).alias("rank")).filter("false")
    cand = bounded(queries.select("qid", "lat", "lng", F.inline(F.array(*root))), top)
    for level in range(top - 1, -1, -1):
        parent = (F.floor(F.col("cy") / FANOUT).alias("py"), F.floor(F.col("cx") / FANOUT).alias("px"))
        parents = cand.select("qid", "lat", "lng", F.col("cy").alias("py"), F.col("cx").alias("px"))
        cand = bounded(parents.join(at(level).select(*parent, "cy", "cx", "n"), ["py", "px"]).drop("py", "px"), level)
    near = salted_join(cand, leaves, ["cy", "cx"])
    near = near.select("qid", "id", round_dp(haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")), 7).alias("dist_km"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("dist_km", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def file_edges(edges: DataFrame, threshold_m: float, table: str, path: str, buckets: int) -> DataFrame:
    """Write the cells of every edge once as a table in ``buckets`` buckets by cell, for many small point sets.

    A network version has one such table; points are shuffled to its buckets and it is not.
    """
    unique = edges.groupBy(*EDGE).agg(F.min("segment_id").alias("segment_id"))
    cells = _buffered_cells(unique, _cell_deg(threshold_m)).repartition(buckets, "iy", "ix")
    cells.write.bucketBy(buckets, "iy", "ix").sortBy("iy", "ix").mode("overwrite").option("path", path).saveAsTable(table)
    return edges.sparkSession.table(table)


def nearest_filed(points: DataFrame, filed: DataFrame, threshold_m: float, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """:func:`nearest_edges` with ``always=False`` against a table of :func:`file_edges` at the same threshold.

    One join and one aggregation; the columns of a point that has no place stay, with NULLs.
    """
    deg = _cell_deg(threshold_m)
    iy = F.floor(F.col(lat) / deg)
    probes = points.withColumns({"iy": iy, "_lat": F.col(lat), "_lng": F.col(lng)}).withColumn("ix", F.floor(F.col(lng) / _lng_width(F.col("iy"), deg)))
    spots = probes.select("iy", "ix", F.col("_lat").alias("lat"), F.col("_lng").alias("lng")).dropna().distinct()
    near = spots.join(filed, ["iy", "ix"]).withColumn("dist_km", _tenths_of_mm("lat", "lng") / F.lit(1e7)).filter(F.col("dist_km") * 1000.0 <= threshold_m)
    near = near.groupBy("lat", "lng").agg(F.min(F.struct("dist_km", "segment_id", *EDGE)).alias("_m"))
    spot = closest_on_edge(F.col("lat"), F.col("lng"), *[F.col(f"_m.{c}") for c in EDGE])
    found = near.select(
        F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("_m.segment_id").alias("nearest_id"), F.col("_m.dist_km").alias("nearest_km"),
        spot["lat"].alias("nearest_lat"), spot["lng"].alias("nearest_lng"),
    )
    return probes.join(found, ["_lat", "_lng"], "left").drop("_lat", "_lng", "iy", "ix")


def polygon_cells(polygons: DataFrame, base_deg: float = 0.01) -> DataFrame:
    """File each polygon under at most 2 x 2 cells of a level that fits its own extent.

    ``polygons`` has ``polygon_id, ring``. A country-sized polygon gets a coarse level instead of
    millions of fine cells.
    """
    lats = F.transform(F.col("ring"), lambda p: p["lat"])
    lngs = F.transform(F.col("ring"), lambda p: p["lng"])
    boxed = polygons.select(
        "*",
        F.array_min(lats).alias("_y0"),
        F.array_max(lats).alias("_y1"),
        F.array_min(lngs).alias("_x0"),
        F.array_max(lngs).alias("_x1"),
    )
    extent = F.greatest(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"), F.lit(base_deg))
    level = F.ceil(F.log2(extent / base_deg)).cast("int")
    sized = boxed.withColumn("_level", level).withColumn("_size", base_deg * F.pow(F.lit(2.0), F.col("_level")))
    rows = sized.withColumn(
        "_iy", F.explode(F.sequence(F.floor(F.col("_y0") / F.col("_size")), F.floor(F.col("_y1") / F.col("_size"))))
    )
    return rows.withColumn(
        "_ix", F.explode(F.sequence(F.floor(F.col("_x0") / F.col("_size")), F.floor(F.col("_x1") / F.col("_size"))))
    ).drop("_size")


def containing_polygons(points: DataFrame, polygons: DataFrame, base_deg: float = 0.01) -> DataFrame:
    """Inner join of points (``lat, lng``) with the polygons that contain them.

    ``polygons`` has ``polygon_id, ring`` and, where polygons have them, ``holes``; a point in a hole or on its
    edge is outside. A point probes one cell per level in use; there are at most 16 levels between 0.01 and 360
    degrees.
    """
    # the sides are cut once a polygon, not once a pair
    filed = polygon_cells(polygons, base_deg).withColumn("_sides", sides(F.col("ring")))
    levels = filed.select("_level").distinct().agg(F.collect_set("_level").alias("_levels"))
    probes = points.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    size = base_deg * F.pow(F.lit(2.0), F.col("_level"))
    probes = probes.withColumn("_iy", F.floor(F.col("lat") / size)).withColumn("_ix", F.floor(F.col("lng") / size))
    pairs = salted_join(probes, filed, ["_level", "_iy", "_ix"])
    boxed = F.col("lat").between(F.col("_y0"), F.col("_y1")) & F.col("lng").between(F.col("_x0"), F.col("_x1"))
    inside = within_sides(F.col("lat"), F.col("lng"), F.col("_sides"))
    if "holes" in polygons.columns:
        inside = inside & ~F.exists(F.coalesce("holes", F.array().cast(polygons.schema["holes"].dataType)), lambda h: in_ring(F.col("lat"), F.col("lng"), h, edge=True))
    return pairs.filter(boxed).filter(inside).drop("_level", "_iy", "_ix", "_y0", "_y1", "_x0", "_x1", "_sides")

"""Geometry as column expressions.

A point is STRUCT<lat, lng>; a polyline is an ARRAY of points. Everything here stays on the
JVM: no Python UDF is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tarmetric.params import EARTH_RADIUS_KM, KM_PER_DEG


def point(lat: Column, lng: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng"))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def edge_fraction(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Position in [0, 1] of the closest point on one edge, in a local flat projection."""
    k = F.cos(F.radians((lat1 + lat2) / 2)) * KM_PER_DEG
    dx, dy = (lng2 - lng1) * k, (lat2 - lat1) * KM_PER_DEG
    px, py = (lng - lng1) * k, (lat - lat1) * KM_PER_DEG
    squared = dx * dx + dy * dy
    t = F.coalesce(F.try_divide(px * dx + py * dy, squared), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def closest_on_edge(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    t = edge_fraction(lat, lng, lat1, lng1, lat2, lng2)
    return point(lat1 + (lat2 - lat1) * t, lng1 + (lng2 - lng1) * t)


def edge_distance_km(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance from a point to the closest point of one edge."""
    t = edge_fraction(lat, lng, lat1, lng1, lat2, lng2)
    return haversine_km(lat, lng, lat1 + (lat2 - lat1) * t, lng1 + (lng2 - lng1) * t)


def edges_of(geom: Column) -> Column:
    """ARRAY of (seq, a, b, len_km) for consecutive vertices; empty below two vertices."""
    pairs = F.arrays_zip(
        F.slice(geom, 1, F.greatest(F.size(geom) - 1, F.lit(0))).alias("a"),
        F.slice(geom, 2, F.greatest(F.size(geom) - 1, F.lit(0))).alias("b"),
    )
    return F.transform(
        pairs,
        lambda e, i: F.struct(
            i.alias("seq"),
            e["a"].alias("a"),
            e["b"].alias("b"),
            haversine_km(e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"]).alias("len_km"),
        ),
    )


def polyline_km(geom: Column) -> Column:
    return F.aggregate(edges_of(geom), F.lit(0.0), lambda acc, e: acc + e["len_km"])


def nearest_on_polyline(lat: Column, lng: Column, geom: Column) -> Column:
    """STRUCT<dist_km, seq, lat, lng> of the closest point over every edge (first edge on a tie)."""

    def probe(e: Column) -> Column:
        p = closest_on_edge(lat, lng, e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"])
        return F.struct(
            haversine_km(lat, lng, p["lat"], p["lng"]).alias("dist_km"),
            e["seq"].alias("seq"),
            p["lat"].alias("lat"),
            p["lng"].alias("lng"),
        )

    single = F.struct(
        haversine_km(lat, lng, geom[0]["lat"], geom[0]["lng"]).alias("dist_km"),
        F.lit(0).alias("seq"),
        geom[0]["lat"].alias("lat"),
        geom[0]["lng"].alias("lng"),
    )
    return F.when(F.size(geom) == 1, single).otherwise(F.array_min(F.transform(edges_of(geom), probe)))


def interpolate_along(geom: Column, target_km: Column, edges: Column | None = None) -> Column:
    """Point at ``target_km`` along the polyline, clamped to both ends; ``edges``: its ``edges_of``, where they are known."""
    start = F.struct(
        F.lit(0.0).alias("walked"),
        F.lit(False).alias("found"),
        geom[0]["lat"].alias("lat"),
        geom[0]["lng"].alias("lng"),
    )
    last = F.size(geom) - 2

    def step(acc: Column, e: Column) -> Column:
        stop = (acc["walked"] + e["len_km"] >= target_km) | (e["seq"] == last)
        f = F.when(e["len_km"] <= 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target_km - acc["walked"]) / e["len_km"]))
        )
        here = F.struct(
            acc["walked"].alias("walked"),
            F.lit(True).alias("found"),
            (e["a"]["lat"] + (e["b"]["lat"] - e["a"]["lat"]) * f).alias("lat"),
            (e["a"]["lng"] + (e["b"]["lng"] - e["a"]["lng"]) * f).alias("lng"),
        )
        onward = F.struct(
            (acc["walked"] + e["len_km"]).alias("walked"),
            F.lit(False).alias("found"),
            acc["lat"].alias("lat"),
            acc["lng"].alias("lng"),
        )
        return F.when(acc["found"], acc).when(stop, here).otherwise(onward)

    # finished in the fold, so that it runs once for both coordinates
    walked = edges_of(geom) if edges is None else edges
    inside = F.aggregate(walked, start, step, lambda acc: F.struct(acc["lat"].alias("lat"), acc["lng"].alias("lng")))
    return F.when((F.size(geom) == 1) | (target_km <= 0), geom[0]).otherwise(inside)


def resample(geom: Column, interval_m: float) -> Column:
    """Every original vertex plus points at most ``interval_m`` apart; zero-length edges add none."""

    def pieces(e: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(e["len_km"] * 1000.0 / interval_m).cast("int"))
        spread = F.transform(
            F.sequence(F.lit(1), n),
            lambda k: point(
                e["a"]["lat"] + (e["b"]["lat"] - e["a"]["lat"]) * (k / n),
                e["a"]["lng"] + (e["b"]["lng"] - e["a"]["lng"]) * (k / n),
            ),
        )
        return F.when(e["len_km"] > 0, spread).otherwise(F.slice(spread, 1, 0))

    return F.concat(F.slice(geom, 1, 1), F.flatten(F.transform(edges_of(geom), pieces)))


def representative_point(geom: Column) -> Column:
    """The vertex at 0-based index ``len // 2``."""
    return F.element_at(geom, (F.floor(F.size(geom) / 2) + 1).cast("int"))


def in_travel_direction(geom: Column, from_id: Column, entered_at: Column) -> Column:
    return F.when(from_id == entered_at, geom).otherwise(F.reverse(geom))


def join_pieces(pieces: Column) -> Column:
    """Concatenate an ordered ARRAY of polylines, dropping an exactly repeated joint."""
    empty = F.slice(pieces[0], 1, 0)
    return F.aggregate(
        pieces,
        empty,
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == p[0]),
            F.concat(acc, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))),
        ).otherwise(F.concat(acc, p)),
    )


def sides(ring: Column) -> Column:
    """ARRAY of (a, b) for consecutive vertices of a ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ring, 1, n).alias("a"), F.slice(ring, 2, n).alias("b"))


def in_ring(lat: Column, lng: Column, ring: Column, edge: bool = False) -> Column:
    """Point in polygon by edge crossings over a closed ring; a point on the boundary is inside only with ``edge``."""
    return within_sides(lat, lng, sides(ring), edge)


def within_sides(lat: Column, lng: Column, edges: Column, edge: bool = False) -> Column:
    """:func:`in_ring` over the ``sides`` of a ring, which many points share."""

    def cross(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at_lng = a["lng"] + F.try_divide(lat - a["lat"], b["lat"] - a["lat"]) * (b["lng"] - a["lng"])
        return spans & F.coalesce(lng < at_lng, F.lit(False))

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        turn = (b["lng"] - a["lng"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lng - a["lng"])
        return (
            (turn == 0)
            & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
            & lng.between(F.least(a["lng"], b["lng"]), F.greatest(a["lng"], b["lng"]))
        )

    odd = F.size(F.filter(edges, cross)) % 2 == 1
    return odd | F.exists(edges, touches) if edge else odd & ~F.exists(edges, touches)


def ladder(x: Column, steps: dict[str, float]) -> Column:
    """First label (from the highest) whose lower bound ``x`` reaches; NULL stays NULL."""
    out: Callable | Column | None = None
    for label, low in sorted(steps.items(), key=lambda kv: -kv[1]):
        out = F.when(x >= low, label) if out is None else out.when(x >= low, label)
    lowest = min(steps, key=steps.get)
    return out.when(x.isNotNull(), lowest)

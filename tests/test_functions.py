"""Boundaries, clamps and three-valued results of the column functions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tarmetric.functions import geo as G
from tarmetric.functions import risk as R
from tarmetric.functions import text as T
from tarmetric.functions.rounding import round_dp


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def line(*points):
    return F.array(*[G.point(F.lit(a), F.lit(b)) for a, b in points])


def test_haversine_and_rounding(spark):
    r = one(spark, d=G.haversine_km(F.lit(27.0), F.lit(92.0), F.lit(28.0), F.lit(92.0)), n=round_dp(F.lit(None).cast("double"), 2), h=round_dp(F.lit(2.5), 0))
    assert r.d == pytest.approx(6371 * math.pi / 180, abs=1e-6)
    assert r.n is None and r.h == 3.0


def test_nearest_on_polyline_checks_every_edge(spark):
    g = line((27.0, 92.0), (27.0, 92.1), (27.1, 92.1))
    r = one(spark, p=G.nearest_on_polyline(F.lit(27.05), F.lit(92.11), g), s=G.nearest_on_polyline(F.lit(27.0), F.lit(92.0), line((27.0, 92.0))))
    assert r.p.seq == 1 and r.p.lng == pytest.approx(92.1) and r.p.lat == pytest.approx(27.05, abs=1e-6)
    assert r.s.dist_km == 0.0


def test_zero_length_edge(spark):
    assert one(spark, t=G.closest_on_edge(F.lit(1.0), F.lit(1.0), *[F.lit(2.0)] * 4)).t.lat == 2.0


def test_interpolate_clamps(spark):
    g = line((0.0, 0.0), (0.0, 1.0), (1.0, 1.0))
    km = 6371 * math.pi / 180
    r = one(spark, a=G.interpolate_along(g, F.lit(-1.0)), b=G.interpolate_along(g, F.lit(1.5 * km)), c=G.interpolate_along(g, F.lit(9 * km)))
    assert (r.a.lat, r.a.lng) == (0.0, 0.0)
    assert r.b.lat == pytest.approx(0.5, abs=1e-4)
    assert (r.c.lat, r.c.lng) == (1.0, 1.0)


def test_resample_keeps_vertices(spark):
    g = line((0.0, 0.0), (0.0, 0.002), (0.0, 0.002), (0.0, 0.0025))
    pts = one(spark, p=G.resample(g, 90.0)).p
    assert len(pts) == 1 + 3 + 1 and pts[-1].lng == 0.0025


def test_join_pieces_drops_exact_joint_only(spark):
    pieces = F.array(line((0.0, 0.0), (0.0, 1.0)), line((0.0, 1.0), (0.0, 2.0)), line((0.0, 2.5), (0.0, 3.0)))
    assert len(one(spark, g=G.join_pieces(pieces)).g) == 5


def test_ring_boundary_is_outside(spark):
    ring = line((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0))
    r = one(spark, i=G.in_ring(F.lit(0.5), F.lit(0.5), ring), b=G.in_ring(F.lit(0.0), F.lit(0.5), ring), v=G.in_ring(F.lit(1.0), F.lit(1.0), ring), o=G.in_ring(F.lit(2.0), F.lit(0.5), ring))
    assert (r.i, r.b, r.v, r.o) == (True, False, False, False)


def test_rain_anchor_points(spark):
    mm = [None, -1.0, 0.0, 2.5, 15.6, 64.5, 204.4, 500.0]
    rows = spark.createDataFrame([(x,) for x in mm], "mm double").select(R.rain_factor(F.col("mm")).alias("f")).collect()
    assert [r.f for r in rows] == [None, 0.0, 0.0, 0.1, 0.3, 0.6, 1.0, 1.0]


def test_score_stays_in_range_and_grows(spark):
    grid = list(itertools.product([None, 0.0, 2.0, 25.0, 89.9], [0, 1, 11, 500], [None, 0.0, 1.0, 50.0], [None, 0.0, 1.0, -3.0]))
    df = spark.createDataFrame(grid, "s double, n bigint, w double, i double")
    null = F.lit(None).cast("double")
    rows = df.select("*", R.score_struct(F.col("s"), F.col("n"), null, null, F.col("w"), F.col("i")).alias("r")).collect()
    assert all(0 <= r.r.risk_score <= 1 for r in rows)
    by = {(r.s, r.n, r.w, r.i): r.r.risk_score for r in rows}
    for (s, n, w, i), v in by.items():
        assert by[(89.9, n, w, i)] >= v and by[(s, 500, w, i)] >= v and by[(s, n, 1.0, i)] >= v


def test_levels_and_missing_zonation(spark):
    r = one(spark, a=R.risk_level(F.lit(0.75)), b=R.risk_level(F.lit(0.4999)), c=R.hazard_level(F.lit(None).cast("double")), t=R.ml_tier(F.lit(0.33)))
    assert (r.a, r.b, r.c, r.t) == ("critical", "moderate", None, "Moderate")
    null = F.lit(None).cast("double")
    z = one(spark, none=R.history_risk(F.lit(0), null, null), zone=R.history_risk(F.lit(0), null, F.lit(0.9)))
    assert (z.none, z.zone) == (0.0, 0.9)


def test_unknown_severity_stops(spark):
    with pytest.raises(Exception, match="unknown severity"):
        one(spark, x=R.lookup_or_fail(F.lit("huge"), {"minor": 0.2}, "severity"))


def test_text_rules(spark):
    r = one(
        spark,
        d=T.district(F.lit(" Lower Dibang Valley, km 3")), d2=T.district(F.lit("in Tawang")), m=T.movement_type(F.lit(" Rock  cum  DEBRIS slide")),
        h=T.movement_type(F.lit("Sl.No 4 debris slide")), y=T.event_year(F.lit("slide on 4 July 2016"), F.lit("A/2011/7")),
        y2=T.event_year(F.lit(None).cast("string"), F.lit("A/2011/7")), y3=T.event_year(F.lit("x"), F.lit("A/1800/7")),
        n=T.is_negative_observation(F.lit("slope UNSTABLE")),
    )
    assert (r.d, r.d2, r.m) == ("Lower Dibang Valley", None, "Rock Cum Debris Slide")
    assert r.h.endswith("(source header artifact)")
    assert (r.y, r.y2, r.y3, r.n) == (2016, 2011, None, True)

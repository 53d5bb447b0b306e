"""Duplicate flags, trips, ranking and segment-year rules against brute force; batch equals stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarmetric.operators import hazards as H
from tarmetric.operators import intake as I
from tarmetric.operators import models as M
from tarmetric.operators import ranking as K
from tarmetric.operators import segment_year as S
from tarmetric.operators import trips as T
from tarmetric.session import scratch_path
from tarmetric.sources import readers
from tarmetric.streaming import live as V

REPORTS = "report_id bigint, incident_type string, segment_id string, created_at timestamp, resolved_at timestamp"
T0 = datetime(2024, 1, 1)


def reports(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + timedelta(seconds=rng.choice([0, 600, 3600, 7200]) + rng.randrange(6) * 600 + rng.randrange(2))
        out.append((i, rng.choice("ab"), rng.choice(["s1", "s1", "s1", "s2"]), at, at + timedelta(minutes=20) if i % 3 == 0 else None))
    return out


def brute_duplicates(rows):
    hour = timedelta(minutes=60)
    return {
        a[0]: any(
            b[1:3] == a[1:3] and (b[3], b[0]) < (a[3], a[0]) and a[3] - b[3] <= hour and (b[4] is None or b[4] > a[3]) for b in rows
        )
        for a in rows
    }


def files(spark, path, schema, batches):
    """A stream of files, one a batch, in the given order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_duplicates_match_brute_force_and_stream(spark, tmp_path):
    rows = reports()
    df = spark.createDataFrame(rows, REPORTS)
    want = brute_duplicates(rows)
    assert {r.report_id: r.possible_duplicate for r in I.flag_duplicates(df).collect()} == want
    events = [tuple(r) for r in V.report_events(df).collect()]
    schema = "kind string, report_id long, incident_type string, segment_id string, at timestamp"
    rng = random.Random(5)
    events.sort(key=lambda e: e[4] + timedelta(minutes=rng.random() * 50))  # up to 50 minutes out of order
    batches = [events[i:i + 80] for i in range(0, len(events), 80)]
    last = max(e[4] for e in events)
    batches += [[("report", 999, "a", "s1", T0), ("resolve", 5, "b", "s1", T0)], [("tick", None, None, None, last + timedelta(days=1))]]
    q = V.start_duplicates(files(spark, str(tmp_path / "in"), schema, batches), str(tmp_path / "out"), str(tmp_path / "offsets"), "60 minutes")
    q.awaitTermination()
    out = spark.read.schema(V.FLAGS).parquet(str(tmp_path / "out")).collect()
    assert len(batches) > 5 and {r.report_id: r.possible_duplicate for r in out if not r.late} == want
    # too late: beside, and no flag changed
    assert sorted((r.kind, r.report_id) for r in out if r.late) == [("report", 999), ("resolve", 5)]
    # quiet keys hold no state and no timer
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_windows_close_by_watermark_and_late_events_stand_beside(spark, tmp_path):
    minute = timedelta(minutes=1)
    schema = "who string, at timestamp"
    batches = [
        [("x", T0), ("x", T0 + 4 * minute), ("y", T0 + 6 * minute)], [("x", T0 + 40 * minute), ("x", T0 + 2 * minute)],
        [("x", T0 + 200 * minute)], [("x", T0 + 3 * minute), ("y", T0 + 190 * minute)], [("x", T0 + 70 * minute)], [(None, T0 + timedelta(days=2))],
    ]
    for k, (length, slide) in enumerate([(300, 300), (600, 300), (1800, None)]):
        out = V.stream_windows(files(spark, str(tmp_path / f"in{k}"), schema, batches), ["who"], "60 minutes", length, slide)
        got = []
        q = out.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / f"o{k}")).trigger(availableNow=True).start()
        q.awaitTermination()
        at = lambda r: (r.who, (r.start_us - int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6)) // 60_000_000, r.events)
        done, late = sorted(at(r) for r in got if not r.late), sorted(at(r) for r in got if r.late)
        assert late == [("x", 3, 1), ("x", 70, 1)]
        if k == 0:
            assert done == [("x", 0, 3), ("x", 40, 1), ("x", 200, 1), ("y", 5, 1), ("y", 190, 1)]
        elif k == 1:
            assert done == [("x", -5, 3), ("x", 0, 3), ("x", 35, 1), ("x", 40, 1), ("x", 195, 1), ("x", 200, 1), ("y", 0, 1), ("y", 5, 1), ("y", 185, 1), ("y", 190, 1)]
        else:
            assert done == [("x", 0, 3), ("x", 40, 1), ("x", 200, 1), ("y", 6, 1), ("y", 190, 1)]
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_trip_state_over_mixed_batches(spark, tmp_path):
    p = lambda lat: {"lat": lat, "lng": 92.0}
    route = ["origin", "destination"]
    segments = spark.createDataFrame([("a", [p(27.0), p(27.1)]), ("b", [p(27.1), p(27.2)]), ("c", [p(27.2), p(27.3)])], "segment_id string, geometry array<struct<lat:double,lng:double>>")
    legs = spark.createDataFrame([(1, 4, 0, "a"), (1, 4, 1, "b"), (1, 4, 2, "c")], "origin long, destination long, leg_idx int, segment_id string")
    geometry = spark.createDataFrame([(1, 4, [p(27.0), p(27.1), p(27.2), p(27.3)])], "origin long, destination long, geometry array<struct<lat:double,lng:double>>")
    trips = spark.createDataFrame([(k, 1, 4, 30.0) for k in (1, 2, 3)], "trip_id long, origin long, destination long, speed_kmph double")
    at = lambda m: T0 + timedelta(minutes=m)
    pings = [[(1, at(5), 27.15, 92.0)], [(1, at(1), 27.02, 92.0), (2, at(2), 27.05, 92.0)], [(2, at(9), 27.3, 92.001)], [(1, at(6), 27.25, 92.0)], [(1, at(7), 27.24, 92.0)]]
    schema = "hazard_id long, segment_id string, weather_factor double, incident_factor double, is_closure boolean, action string, at_us long"
    h = lambda i, seg, what, us: (i, seg, None, 1.0, True, what, us)
    changes = [[h(1, "a", "create", 1)], [h(2, "c", "clear", 9), h(3, "b", "create", 2)], [h(2, "c", "create", 3)], [h(4, "c", "create", 4)], [h(4, "c", "clear", 8), h(5, "c", "create", 9)]]
    stream = V.stream_trips(files(spark, str(tmp_path / "p"), "trip_id long, at timestamp, lat double, lng double", pings), files(spark, str(tmp_path / "h"), schema, changes), trips, V.legs_along(legs, segments, route), geometry, route)
    got = {}
    q = stream.writeStream.foreachBatch(lambda b, i: got.update({(r.trip_id, i): r for r in b.collect()})).outputMode("update")
    q.option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    one, two = got[1, 4], got[2, max(i for t, i in got if t == 2)]
    assert (one.leg_idx, one.current_segment_id, one.pings, one.hazard_ahead, one.progress) == (2, "c", 4, True, 0.8333)
    assert one.distance_remaining_km == pytest.approx(5.56, abs=0.01) and one.eta_minutes == pytest.approx(11.1, abs=0.1)
    # the hazard on the first leg lies behind trip 1 from its first ping on
    assert not got[1, 0].hazard_ahead and got[1, 1].hazard_ahead
    assert two.arrived and two.progress == 1.0 and two.eta_minutes == 0.0 and not any(t == 3 for t, _ in got)


def test_hazard_context_rules(spark):
    rows = [
        (1, "heavy_rain", "blocking", "s1", T0, None), (2, "landslide", "minor", "s1", T0, None), (3, "road_blockage", "blocking", "s2", T0, None),
        (4, "landslide", "blocking", "s1", T0, T0 + timedelta(hours=1)), (5, "landslide", "major", "s9", T0, None),
    ]
    df = H.build_hazards(spark.createDataFrame(rows, "hazard_id bigint, type string, severity string, segment_id string, created_at timestamp, cleared_at timestamp"))
    now = F.lit(T0 + timedelta(hours=2))
    ctx = {r.segment_id: (r.weather_factor, r.incident_factor, r.closed) for r in H.segment_context(H.active_at(df, now)).collect()}
    assert ctx == {"s1": (0.9, 0.2, False), "s2": (None, 1.0, True), "s9": (None, 0.5, False)}
    known = spark.createDataFrame([("s1",), ("s2",)], "segment_id string")
    accepted, rejected = H.split_unknown_segments(df, known)
    assert accepted.count() == 4 and rejected.first().hazard_id == 5


def test_trip_progress_and_pauses(spark):
    legs = spark.createDataFrame([(1, 2, 0, "a"), (1, 2, 1, "b")], "origin int, destination int, leg_idx int, segment_id string")
    seg = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "segment_id string, distance_km double")
    off = T.leg_offsets(legs, seg, ["origin", "destination"])
    totals = spark.createDataFrame([(1, 2, 30.0)], "origin int, destination int, total_distance_km double")
    trips = spark.createDataFrame(
        [(1, 1, 2, 600.0, 0.0, 60.0), (2, 1, 2, 1800.0, 600.0, 60.0), (3, 1, 2, 9e9, 0.0, 60.0), (4, 1, 2, 100.0, 900.0, 60.0)],
        "trip_id int, origin int, destination int, elapsed_s double, paused_s double, speed_kmph double",
    )
    got = {r.trip_id: (r.current_segment_id, r.progress, r.eta_minutes, r.arrived) for r in T.trip_progress(trips, off, totals, ["origin", "destination"]).collect()}
    assert got == {1: ("b", 0.3333, 20.0, False), 2: ("b", 0.6667, 10.0, False), 3: ("b", 1.0, 0.0, True), 4: ("a", 0.0, 30.0, False)}
    day = timedelta(days=1)
    ev = [(1, 7, T0, "pause"), (2, 7, T0 + timedelta(hours=1), "pause"), (3, 7, T0 + 2 * day, "start"), (4, 7, T0 + 3 * day, "pause")]
    events = spark.createDataFrame(ev, "event_id bigint, trip_id bigint, at timestamp, action string")
    assert T.pause_seconds(events, F.lit(T0 + 4 * day)).first().paused_s == 3 * 86400.0


def test_ranks_and_auc_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(y, rng.choice([0.1, 0.2, 0.2, round(rng.random(), 3)]), int(rng.random() < 0.2)) for y in (1, 2) for _ in range(200)] + [(3, 0.5, 1), (3, 0.5, 0)]
    df = spark.createDataFrame(rows, "year int, score double, is_event int")
    for r in K.percentile_ranks(df, ["year"]).collect():
        same = [s for y, s, _ in rows if y == r.year]
        assert r.percentile == pytest.approx(100 * (sum(s < r.score for s in same) + 0.5 * sum(s == r.score for s in same)) / len(same))
    auc = {r.year: r.rank_auc for r in K.group_auc(df, ["year"]).collect()}
    for y in (1, 2):
        pos = [s for yy, s, e in rows if yy == y and e]
        neg = [s for yy, s, e in rows if yy == y and not e]
        assert auc[y] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    assert auc[3] is None


def test_strict_prior_cutoff_and_labels(spark):
    seg = spark.createDataFrame([("seg_1_0",), ("seg_1_1",)], "segment_id string")
    years = spark.createDataFrame([(2015,), (2016,), (2017,)], "year int")
    ev = spark.createDataFrame(
        [("seg_1_0", 1990, 30.0, False, False), ("seg_1_0", 2016, 20.0, False, True), ("seg_1_0", 2017, 5.0, True, False), ("seg_1_1", None, 1.0, False, False)],
        "segment_id string, year int, distance_to_road_m double, is_negative boolean, day_precise boolean",
    )
    grid, yearly = S.segment_years(seg, years), S.yearly_events(ev)
    got = {(r.segment_id, r.year): (r.historical_landslide_count_prior, r.nearest_historical_landslide_distance_m_prior) for r in S.prior_history(grid, yearly).collect()}
    assert [got[("seg_1_0", y)] for y in (2015, 2016, 2017)] == [(1, 30.0), (1, 30.0), (2, 20.0)]
    assert got[("seg_1_1", 2017)] == (0, None)
    labels = grid.join(yearly, ["segment_id", "year"], "left").select("segment_id", "year", S.label_status(F.col("n"), F.col("any_positive")).alias("s"))
    labels = {(r.segment_id, r.year): r.s for r in labels.collect()}
    assert labels[("seg_1_0", 2016)] == "event" and labels[("seg_1_0", 2017)] == "non_event_documented" and labels[("seg_1_1", 2015)] == "unobserved"
    assert spark.range(1).select(S.label_value(F.lit("unobserved")).alias("l")).first().l is None


def test_models_hold_out_whole_groups(spark):
    rng = random.Random(1)
    rows = []
    for g in range(6):
        for k in range(20):
            x = rng.random()
            event = g < 2 and k < 3
            rows.append((f"seg_{g}_{k}", 2000 + k % 2, "event" if event else "unobserved", "hill", str(g), int(event), x + event, x))
    f = spark.createDataFrame(rows, "segment_id string, year int, label_status string, terrain_type string, way_group string, is_event int, a double, b double")
    make = lambda: M.logistic_regression(["a", "b"], max_iter=20)
    assert M.leave_one_group_out(f, make)[0].count() == 40
    ranks, auc = M.leave_one_group_out(f, make, siblings=False)
    got = ranks.collect()
    assert len(got) == 6 and {r.fold for r in got} == {"0", "1"} and auc.first().rank_auc > 0.7
    folds = M.assign_folds(f, 3)
    assert folds.groupBy("fold").count().count() == 3
    model = M.fit(f, M.random_forest(["a", "b"], trees=5))
    path = scratch_path(spark, "test-model")
    M.save_artifact(model, f, ["a", "b"], path, {"auc": 0.5})
    loaded, names = M.load_artifact(spark, path)
    assert names == ["a", "b"] and loaded is not None
    assert M.load_artifact(spark, path, expected="other") == (None, [])


def test_readers(spark, tmp_path):
    import gzip

    import numpy as np

    tiles = tmp_path / "tiles"
    tiles.mkdir()
    grid = np.arange(9, dtype=">i2").reshape(3, 3)
    (tiles / "S01W002.hgt.gz").write_bytes(gzip.compress(grid.tobytes()))
    (tiles / "N27E092.hgt").write_bytes(b"\0\0")
    (tiles / "notes.hgt").write_bytes(b"not a tile")
    rows = readers.read_tiles(spark, str(tiles), tile_samples=3, strict=False).collect()
    assert {(r.tile_lat, r.tile_lng) for r in rows} == {(-1, -2)} and {(r.row, r.col): r.elev for r in rows}[(2, 1)] == 7
    with pytest.raises(Exception, match="2 bytes, not 18"):
        readers.read_tiles(spark, str(tiles), tile_samples=3).collect()
    fc = tmp_path / "ways.geojson"
    fc.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"osm_id":7,"highway":"trunk"},"geometry":{"type":"LineString","coordinates":[[92.0,27.0],[92.1,27.1]]}},'
                  '{"type":"Feature","properties":{"osm_id":8},"geometry":{"type":"LineString","coordinates":[[92.0,27.0]]}}]}')
    got = readers.read_ways(spark, str(fc), lines=False).collect()
    assert len(got) == 1 and got[0].way_id == 7 and got[0].geometry[0].lat == 27.0
    csv = tmp_path / "inv.csv"
    csv.write_text("slide_no,slide_id,state,description_before_coordinates,latitude,longitude,description_after_coordinates,raw_record\n1,a,AR,x,27.0,92.0,y,z\n2,b,AR,x,95.0,92.0,y,z\n")
    assert [r.problem for r in readers.read_inventory(spark, str(csv), "keep").orderBy("slide_no").collect()] == [None, "latitude out of range"]
    with pytest.raises(Exception, match="latitude out of range"):
        readers.read_inventory(spark, str(csv)).collect()
    rain = tmp_path / "rain.csv"
    rain.write_text("date,lat,lon,rainfall_mm\n2023-06-21,27.0,92.0,\n2023-06-21,27.25,92.0,0.0\n")
    assert [r.rainfall_mm for r in readers.read_daily_rain(spark, str(rain)).orderBy("lat").collect()] == [None, 0.0]


def test_clear_may_arrive_before_its_create(spark, tmp_path):
    from tarmetric.streaming import live

    schema = "hazard_id long, segment_id string, weather_factor double, incident_factor double, is_closure boolean, action string, at_us long"
    create = lambda h, at: (h, "s", 0.2, 0.9, True, "create", at)
    clear = lambda h, at: (h, "s", 0.2, 0.9, True, "clear", at)
    for k, rows in enumerate([[clear(1, 50)], [create(1, 10), create(2, 20)], [(9, "z", None, None, False, "clear", 40)], [clear(2, 30)], [create(3, 5)], [(None, None, None, None, None, None, 9 * 86_400_000_000)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.start_context(stream, str(tmp_path / "out"), str(tmp_path / "offsets"), "1 day", merge_every=3)
    q.awaitTermination()
    rows = {r.segment_id: r for r in live.read_context(spark, str(tmp_path / "out")).collect()}
    assert (rows["s"]["active"], rows["s"]["closed"]) == (1, True) and rows["z"]["active"] == 0
    names = lambda kind: sorted(x.name for x in (tmp_path / "out" / kind).iterdir())
    assert len(names("snapshots")) >= 1 and len(names("batches")) < len(names("pointers")) + 4
    # hazard 3 is open; the mark of a clear without its create has gone with the watermark
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_each_leakage_check_can_fail(spark):
    """A sound table passes all seven checks; one fault at a time fails the check that is meant for it."""
    from tarmetric.operators import quality as C

    cells = [(26.0, 92.0, y, 100.0 + y) for y in (2015, 2016, 2017)]
    events = [("seg_1_0", 2010), ("seg_1_0", 2015), ("seg_1_0", 2016), ("seg_2_0", 2016), ("seg_2_0", None)]
    past = lambda s, y: sum(e == s and d is not None and d < y for e, d in events)
    rows = []
    for s in ("seg_1_0", "seg_1_1", "seg_2_0"):
        for y in (2015, 2016, 2017):
            hit = (s, y) in events
            rows.append([s, y, 26.0, 92.0, 100.0 + y, past(s, y), "event" if hit else "unobserved", 1.0 if hit else None])
    ways = [("seg_1_0", 1), ("seg_1_1", 1), ("seg_2_0", 2)]

    def failed(rows=rows, inputs=("historical_landslide_count_prior",), fold=lambda s, y: int(s[4]), ways=ways):
        schema = "segment_id string, year int, rainfall_grid_lat double, rainfall_grid_lon double, annual_rainfall_mm double, historical_landslide_count_prior bigint, label_status string, label double"
        dataset = spark.createDataFrame(rows, schema)
        dealt = spark.createDataFrame([(r[0], r[1], r[0][4], fold(r[0], r[1])) for r in rows], "segment_id string, year int, way_group string, fold int")
        found = C.leakage_checks(
            dataset, spark.createDataFrame(ways, "segment_id string, way_id bigint"), spark.createDataFrame(events, "segment_id string, year int"),
            spark.createDataFrame(cells, "lat double, lng double, year int, annual_mm double"), list(inputs), dealt,
        ).collect()
        assert len(found) == 7 and all(r.passed == (r.violations == 0) for r in found)
        return {r.name: r.violations for r in found if not r.passed}

    def changed(i, at, value):
        return [r[:at] + [value] + r[at + 1:] if k == i else r for k, r in enumerate(rows)]

    assert failed() == {}
    assert failed(changed(1, 4, 2115.0)) == {"future_rainfall": 1}
    assert failed(changed(2, 5, 0)) == {"prior_cutoff": 1}
    assert failed(changed(0, 5, 3)) == {"no_lifetime_feature": 1}
    assert failed(inputs=["nearest_landslide_distance_m", "slope_deg"]) == {"no_lifetime_feature": 1}
    assert failed(fold=lambda s, y: y % 2 if s == "seg_2_0" else 0) == {"group_isolation": 1, "sibling_grouping": 1}
    assert failed(fold=lambda s, y: int(s[6])) == {"sibling_grouping": 1}
    assert failed(ways=[*ways, ("seg_3_0", 3)]) == {"candidate_pool": 1}
    assert failed([*rows, rows[4]]) == {"single_label": 1}
    assert failed(changed(1, 7, 0.0)) == {"single_label": 1}


def test_profile_of_every_column(spark):
    from tarmetric.operators import quality as C

    rows = [(i, None if i % 4 == 0 else float(i % 5), "ab"[i % 2], i % 3 == 0, "event" if i % 10 == 3 else "unobserved") for i in range(100)]
    df = spark.createDataFrame(rows, "segment_id int, x double, t string, flag boolean, label_status string")
    got = {r.feature: r for r in C.profile(df).collect()}
    assert set(got) == set(df.columns) and {got[c].kind for c in ("segment_id", "x")} == {"number"} and got["t"].kind == "text" and got["flag"].kind == "flag"
    x = sorted(v for _, v, *_ in rows if v is not None)
    assert (got["x"].nulls, got["x"].distinct_values, got["x"].p50, got["x"].max_value) == (25, 5, x[(len(x) - 1) // 2], 4.0)
    assert got["x"].mean_all == pytest.approx(sum(x) / len(x), abs=1e-4) and got["t"].mean_all is None and got["t"].distinct_values == 2
    empty = C.profile(df.filter("false")).collect()
    assert empty == []


def test_folds_fitted_together_equal_single_fits(spark):
    """Coefficients of all folds equal those of one fit a fold, and so do the ranks; one feature is constant in a fold."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        g, x = i % 12, rng.gauss(0, 1)
        event = int(rng.random() < 1 / (1 + 2.7 ** (2 - 1.5 * x)) and g < 5)
        rows.append((f"seg_{g}_{i}", 2015 + i % 3, "event" if event else "unobserved", "hill" if i % 2 else "plain", str(g), event, x, 1000 + 50 * rng.random(), float(g == 3)))
    f = spark.createDataFrame(rows, "segment_id string, year int, label_status string, terrain_type string, way_group string, is_event int, a double, b double, c double")
    names = ["a", "b", "c"]
    groups, weights, intercept = M.fit_all_folds(f, names)
    assert groups == sorted({r[4] for r in rows if r[5]}) and len(groups) >= 4
    for i, g in enumerate(groups):
        model = M.fit(f.filter(F.col("way_group") != g), M.logistic_regression(names, 300))
        scaler, last = model.stages[1], model.stages[2]
        std = scaler.std.toArray()
        want = [c / s if s else 0.0 for c, s in zip(last.coefficients.toArray(), std)]
        assert weights[i].tolist() == pytest.approx(want, rel=2e-2, abs=2e-3)
        assert intercept[i] == pytest.approx(last.intercept - sum(v * m for v, m in zip(want, scaler.mean.toArray())), rel=2e-2, abs=0.2)
    got, auc = M.leave_one_group_out_jointly(f, names)
    want, auc2 = M.leave_one_group_out(f, lambda: M.logistic_regression(names, 300))
    want = {(r.fold, r.segment_id, r.year): (r.percentile, r.within_terrain_percentile) for r in want.collect()}
    got = {(r.fold, r.segment_id, r.year): (r.percentile, r.within_terrain_percentile) for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2 for k in want)
    assert auc.first().rank_auc == pytest.approx(auc2.first().rank_auc, abs=5e-3)
    assert M.fit_all_folds(f.filter("is_event = 0"), names)[0] == []

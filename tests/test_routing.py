"""Shortest paths, alternatives and decisions on small hand-made graphs and a random one."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmetric.operators import cells as C
from tarmetric.operators import decisions as D
from tarmetric.operators import routing as R
from tarmetric.operators import trips as T

EDGES = "graph string, src bigint, dst bigint, cost double, segment_id string"
REQUESTS = "graph string, origin bigint, destination bigint"


def dijkstra(edges, origin):
    out, heap, done = {}, [(0.0, origin)], set()
    while heap:
        c, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        out[u] = c
        for s, t, w in edges:
            if s == u and t not in done:
                heapq.heappush(heap, (c + w, t))
    return out


@pytest.mark.parametrize("hops", [1, 3])
def test_random_graph_matches_dijkstra(spark, hops):
    rng = random.Random(3)
    edges = {(a, b): rng.uniform(1, 9) for a in range(30) for b in rng.sample(range(30), 3) if a != b}
    rows = [("g", a, b, w, f"s{a}_{b}") for (a, b), w in edges.items()]
    e = spark.createDataFrame(rows, EDGES)
    wanted = [("g", o, d) for o in (0, 7, 13) for d in (3, 21, 29)] + [("g", 4, 4)]
    req = spark.createDataFrame(wanted, REQUESTS)
    labels = R.shortest_paths(e, req, hops_per_round=hops, compact_every=2).cache()
    flat = [(a, b, w) for (a, b), w in edges.items()]
    got = {(r.origin, r.node): r.cost for r in labels.collect()}
    for _, o, d in wanted:
        assert got[(o, d)] == pytest.approx(dijkstra(flat, o)[d], abs=1e-9)
    legs = R.route_legs(labels, req).collect()
    for _, o, d in wanted:
        own = sorted((r for r in legs if (r.origin, r.destination) == (o, d)), key=lambda r: r.leg_idx)
        assert [r.leg_idx for r in own] == list(range(len(own)))
        if o == d:
            assert own == []
            continue
        assert own[0].u == o and own[-1].v == d
        assert all(x.v == y.u for x, y in zip(own, own[1:]))
        assert sum(edges[(r.u, r.v)] for r in own) == pytest.approx(got[(o, d)], abs=1e-9)
        assert all(r.segment_id == f"s{r.u}_{r.v}" for r in own)


def test_hub_falls_back_to_plain_edges(spark):
    rows = [("g", i, 0, 1.0, f"i{i}") for i in range(1, 40)] + [("g", 0, i, 1.0, f"o{i}") for i in range(1, 40)]
    plain = spark.createDataFrame(rows, EDGES).withColumn("units", F.lit(1).cast("long"))
    assert R.shortcut_edges(plain, 3).count() == 78


# Diamond: 1-2-4 short, 1-3-4 long.
SEGMENTS = [("a", 1, 2, 5.0, 10.0), ("b", 2, 4, 5.0, 10.0), ("c", 1, 3, 8.0, 16.0), ("d", 3, 4, 8.0, 16.0)]


def world(spark, scores, closed=()):
    """(fastest, safe) summaries of the pair 1 -> 4 under the given scores."""
    rows = [(s, u, v, km, m, scores.get(s, 0.1), s in closed) for s, u, v, km, m in SEGMENTS]
    seg = spark.createDataFrame(
        rows, "segment_id string, src bigint, dst bigint, distance_km double, travel_time_min double, risk_score double, closed boolean"
    ).withColumn("risk_level", F.lit("low"))
    safe = seg.filter(R.is_usable(F.col("risk_score"), F.col("closed")))
    edges = R.weighted(seg, "fast", F.col("travel_time_min")).unionByName(
        R.weighted(safe, "safe", R.risk_cost(F.col("travel_time_min"), F.col("risk_score")))
    )
    req = spark.createDataFrame([("fast", 1, 4), ("safe", 1, 4)], REQUESTS)
    legs = R.route_legs(R.shortest_paths(edges, req), req)

    def summary(graph):
        own = legs.filter(F.col("graph") == graph).drop("graph")
        profile = R.risk_profiles(R.leg_risks(own, seg), D.OD)
        return R.assemble_routes(own, seg, D.OD).join(profile, D.OD)

    pairs = req.select(*D.OD).distinct()
    return pairs, summary("fast"), summary("safe"), edges, legs


def test_fastest_is_safe(spark):
    pairs, fast, safe, edges, legs = world(spark, {})
    r = D.compare_routes(pairs, fast, safe).first()
    assert r.outcome == "fastest_route_is_safe" and r.fastest_node_path == "1>2>4"
    assert r.fastest_estimated_travel_time_min == 20.0
    assert R.alternative_exists(edges.filter("graph = 'fast'"), legs.filter("graph = 'fast'"), pairs).first().has_alternative
    assert D.decide(D.compare_routes(pairs, fast, safe), fast.filter("false")).first().decision == "continue"


def test_unsafe_segment_reroutes_at_the_limit(spark):
    pairs, fast, safe, _, _ = world(spark, {"a": 0.65})
    cmp = D.compare_routes(pairs, fast, safe)
    r = cmp.first()
    assert r.outcome == "safer_route_selected" and r.recommended_node_path == "1>3>4" and r.extra_minutes == 12.0
    d = D.decide(cmp, fast).first()
    assert (d.decision, d.decision_rule, d.eta_change_min) == ("reroute", "infeasible", 12.0)


def test_closed_everywhere_suspends(spark):
    pairs, fast, safe, _, _ = world(spark, {}, closed=("a", "c"))
    cmp = D.compare_routes(pairs, fast, safe)
    assert cmp.first().outcome == "no_safe_route_available"
    assert D.decide(cmp, fast).first().decision == "suspend"


@pytest.mark.parametrize("gain,decision", [(0.05, "reroute"), (0.0499, "continue")])
def test_hysteresis_boundary(spark, gain, decision):
    cols = D.SUMMARY
    best = spark.createDataFrame([(1, 4, "1>3>4", 32.0, 16.0, 0.3, 0.3, 0)], ["origin", "destination", *cols])
    prev = spark.createDataFrame([(1, 4, "1>2>4", 20.0, 10.0, 0.3 + gain, 0.4, 0)], ["origin", "destination", *cols])
    cmp = D.compare_routes(best.select(*D.OD), prev, best)
    assert D.decide(cmp, prev).first().decision == decision


def test_profile_blend_and_counts(spark):
    pairs, fast, _, _, _ = world(spark, {"a": 0.6, "b": 0.2})
    r = fast.first()
    assert r.aggregate_risk_score == pytest.approx(0.7 * 0.6 + 0.3 * 0.4) and r.max_risk_segment_id == "a" and r.unsafe_segment_count == 0


def test_trips_are_decided_on_what_lies_ahead(spark):
    """Route 1>2>3>4 with the first segment closed; 3>5>4 is a way round the last one."""
    legs = spark.createDataFrame([(1, 4, 0, 1, 2, "a"), (1, 4, 1, 2, 3, "b"), (1, 4, 2, 3, 4, "c")], "origin int, destination int, leg_idx int, u int, v int, segment_id string")
    rows = [("a", 1.0, 1.0, 0.9, "critical", True), ("b", 1.0, 1.0, 0.1, "low", False), ("c", 1.0, 1.0, 0.9, "critical", False), ("d", 2.0, 2.0, 0.1, "low", False), ("e", 2.0, 2.0, 0.1, "low", False)]
    risk = spark.createDataFrame(rows, "segment_id string, distance_km double, travel_time_min double, risk_score double, risk_level string, closed boolean")
    safe = spark.createDataFrame([(1, "g", 2, 3, 1.2, "b"), (1, "g", 3, 5, 2.4, "d"), (1, "g", 5, 4, 2.4, "e")], "x int, g string, src int, dst int, cost double, segment_id string")
    safe = safe.select(F.lit("safe").alias("graph"), "src", "dst", "cost", "segment_id")
    trips = spark.createDataFrame(
        [(1, 0, True, False, False, True), (2, 1, True, False, False, True), (3, 2, True, False, False, True), (4, 2, True, False, True, False), (5, 1, True, False, False, False), (6, 0, False, False, False, True), (7, 2, True, True, False, True)],
        "trip_id int, leg_idx int, started boolean, arrived boolean, was_suspended boolean, hazard_ahead boolean",
    ).withColumns({"origin": F.lit(1), "destination": F.lit(4)})
    checked = T.checked_starts(trips, legs)
    # a suspended trip stands at the start, a moving one at the beginning of its current leg; trips 5 to 7 are not checked
    assert {r.trip_id: (r.from_leg, r.reroute_from_node) for r in checked.collect()} == {1: (0, 1), 2: (1, 2), 3: (2, 3), 4: (0, 1)}
    plan = {r.from_leg: (r.decision, r.decision_rule, r.decided_node_path) for r in T.decide_under_way(checked, legs, risk, safe).collect()}
    assert plan[0][:2] == ("suspend", "suspend")
    # past the closed segment nobody is suspended: the unsafe last one is driven round
    assert plan[1] == ("reroute", "infeasible", "2>3>5>4") and plan[2] == ("reroute", "infeasible", "3>5>4")


def test_trees_grown_backwards_give_forward_paths(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 30, 120), rng.integers(0, 30, 120), rng.uniform(1, 9, 120), strict=True) if a != b]
    table = spark.createDataFrame([("g", a, b, c, f"s{i}") for i, (a, b, c) in enumerate(edges)], "graph string, src int, dst int, cost double, segment_id string")
    asked = spark.createDataFrame([("g", o, d) for d in (3, 17) for o in range(30) if o != d], "graph string, origin int, destination int")
    forward = R.route_legs(R.shortest_paths(table, asked), asked)
    back = R.legs_to_destinations(table, asked)
    cost = {f"s{i}": c for i, (_, _, c) in enumerate(edges)}

    def paths(legs):
        out = {}
        for r in sorted(legs.collect(), key=lambda r: r.leg_idx):
            out.setdefault((r.origin, r.destination), []).append((r.u, r.v, r.segment_id))
        return out

    a, b = paths(forward), paths(back)
    assert a.keys() == b.keys() and a
    for key, path in b.items():
        assert path[0][0] == key[0] and path[-1][1] == key[1] and all(x[1] == y[0] for x, y in zip(path, path[1:], strict=False))
        assert sum(cost[s] for *_, s in path) == pytest.approx(sum(cost[s] for *_, s in a[key]))


@pytest.mark.parametrize("places", [True, False])
def test_routes_over_cells_cost_what_trees_cost(spark, places):
    """A 12 x 12 grid in cells of 4 nodes, one-way streets, a part cut off and a long way round outside a pair's cell."""
    rng = random.Random(5)
    rows = []
    for g in ("a", "b"):
        for i in range(12):
            for j in range(12):
                for k, l in ((i + 1, j), (i, j + 1)):
                    if k < 12 and l < 12 and (i, j) != (0, 0):
                        u, v = 12 * i + j, 12 * k + l
                        rows.append((g, u, v, rng.uniform(1, 9) * (40 if g == "b" and 2 < i < 8 and j == 5 else 1), f"s{u}_{v}"))
                        if rng.random() < 0.8:
                            rows.append((g, v, u, rng.uniform(1, 9), f"s{v}_{u}"))
    rows.append(("a", 5, 6, 0.5, "twin"))
    e = spark.createDataFrame(rows, EDGES)
    wanted = [(g, o, d) for g in ("a", "b") for o, d in [(rng.randrange(144), rng.randrange(144)) for _ in range(60)] + [(0, 143), (143, 0), (7, 7), (5, 6), (900, 3)]]
    where = spark.createDataFrame([(n, 26 + n // 12 * 0.05, 91 + n % 12 * 0.05) for n in range(144)], "node long, lat double, lng double") if places else None
    req = spark.createDataFrame(wanted, REQUESTS)
    legs = C.routes_between(e, req, where, leaf_bits=2)
    cost = {(r.graph, r.origin, r.destination): r.cost for r in C.route_costs(legs, e).collect()}
    trees = {(g, o): dijkstra([r[1:4] for r in rows if r[0] == g], o) for g, o, _ in set(wanted)}
    assert cost.keys() == {(g, o, d) for g, o, d in wanted if o != d and d in trees[(g, o)]} and len(cost) > 100
    assert all(c == pytest.approx(trees[k[:2]][k[2]], abs=1e-9) for k, c in cost.items())
    paths = {}
    for r in sorted(legs.collect(), key=lambda r: r.leg_idx):
        paths.setdefault((r.graph, r.origin, r.destination), []).append(r)
    for (_, o, d), p in paths.items():
        assert [r.leg_idx for r in p] == list(range(len(p))) and p[0].u == o and p[-1].v == d
        assert all(x.v == y.u for x, y in zip(p, p[1:], strict=False))
    assert paths[("a", 5, 6)][0].segment_id == "twin"
    # a cell beyond the limit: the label rounds give the same costs
    few = spark.createDataFrame(wanted[:8], REQUESTS)
    other = C.route_costs(C.routes_between(e, few, where, leaf_bits=2, max_nodes=3), e).collect()
    assert other and all(r.cost == cost[(r.graph, r.origin, r.destination)] for r in other)


def test_alternatives_within_the_cells_of_a_route(spark):
    """A grid with a stub that only one street reaches; a bridge whose other side no cell of the route tells."""
    rows = []
    for i in range(8):
        for j in range(8):
            rows += [(8 * i + j, 8 * k + l) for k, l in ((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1)) if 0 <= k < 8 and 0 <= l < 8 and 4 not in {*({j, l} if j != l else ())} or (i == k == 5)]
    rows = [r for r in rows if 0 <= r[0] < 64 and 0 <= r[1] < 64] + [(9, 100), (100, 9), (63, 200)]
    e = spark.createDataFrame([("g", u, v, 1.0 + (u * 7 + v) % 5 / 10, f"s{u}_{v}") for u, v in set(rows)], EDGES)
    where = spark.createDataFrame([(n, 26 + n // 8 * 0.05, 91 + n % 8 * 0.05) for n in range(64)], "node long, lat double, lng double")
    pairs = spark.createDataFrame([(o, d) for o in (0, 9, 27, 100) for d in (18, 63, 3, 100, 200)] + [(200, 5), (5, 5), (777, 3)], "origin long, destination long")
    legs = C.routes_between(e, pairs.withColumn("graph", F.lit("g")), where, leaf_bits=2)
    want = {(r.origin, r.destination): r.has_alternative for r in R.alternative_exists(e, legs, pairs).collect()}
    for widenings in (1, 3):
        got = {(r.origin, r.destination): r.has_alternative for r in C.alternative_exists(e, legs, pairs, where, leaf_bits=2, widenings=widenings).collect()}
        assert got == want
    assert set(want.values()) == {True, False}


def test_only_the_variants_named_and_not_yet_written_are_routed(spark):
    from tarmetric.plans.registry import World

    w, built = World(spark, "unused"), []

    def build(new):
        built.append(list(new))
        return spark.createDataFrame([(g, i) for g in new for i in (1, 2)], "graph string, x int")

    assert w.keep_parts("t", "graph", ["fast"], build).count() == 2
    got = w.keep_parts("t", "graph", ["fast", "safe", "calm"], build)
    assert sorted(map(tuple, got.collect())) == [(g, i) for g in ("calm", "fast", "safe") for i in (1, 2)]
    assert [r.graph for r in w.keep_parts("t", "graph", ["calm"], build).select("graph").distinct().collect()] == ["calm"]
    assert built == [["fast"], ["safe", "calm"]]


def test_small_networks_take_few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert C._tasks(spark, 6000, C.ROWS_PER_TASK) == 2 * spark.sparkContext.defaultParallelism
        assert C._tasks(spark, 10**9, C.ROWS_PER_TASK) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

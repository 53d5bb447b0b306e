"""Shortest paths, path assembly and reachability for many requests at once.

``edges``: ``graph, src, dst, cost, segment_id`` (cost > 0). ``graph`` names a variant of the
network (fastest, by distance, risk-aware under some context), so all variants share the rounds
of one run. ``requests``: ``graph, origin, destination``.

Labels are an append-only table, compacted now and then: each round writes only the labels it
improved, and reads the frontier it extends from the round before. Nothing is kept in driver memory but a round number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.geo import in_travel_direction, join_pieces
from tarmetric.functions.rounding import clamp01, round_dp
from tarmetric.session import drop_path, materialize, scratch_path

NODE = ["graph", "origin", "node"]
UNITS = 1e12
HOPS_PER_ROUND = 3
COMPACT_EVERY = 4
SHORTCUT_GROWTH = 8


def risk_cost(minutes: Column, score: Column, weight: float = P.RISK_COST_WEIGHT) -> Column:
    return minutes * (1.0 + weight * score)


def is_usable(score: Column, closed: Column, limit: float = P.HARD_UNSAFE_SCORE) -> Column:
    """Edges of a closed or too risky segment never enter the risk-aware graph."""
    return ~closed & (score < limit)


def weighted(edges: DataFrame, graph: str, cost: Column) -> DataFrame:
    return edges.select(F.lit(graph).alias("graph"), "src", "dst", cost.cast("double").alias("cost"), "segment_id")


def shortcut_edges(edges: DataFrame, hops: int) -> DataFrame:
    """Lowest cost over up to ``hops`` edges per node pair: ``graph, src, dst, units``.

    A round over these covers several hops, so it takes fewer rounds to cross the network. Road
    junctions have few arms; if the connections through nodes would outgrow ``SHORTCUT_GROWTH``
    times the edges (a hub), the plain edges are used instead.
    """
    arms_in = edges.groupBy("graph", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_i"))
    arms_out = edges.groupBy("graph", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_o"))
    through = F.coalesce(F.sum(F.col("_i") * F.col("_o")), F.lit(0))
    size = arms_in.join(arms_out, ["graph", "node"]).agg(through.alias("n")).first()["n"]
    out = edges.select("graph", "src", "dst", "units")
    if size > SHORTCUT_GROWTH * edges.count():
        return out
    step = edges.select("graph", F.col("src").alias("mid"), F.col("dst").alias("_to"), F.col("units").alias("_u"))
    for _ in range(hops - 1):
        longer = (
            out.withColumnRenamed("dst", "mid")
            .join(step, ["graph", "mid"])
            .filter(F.col("src") != F.col("_to"))
            .select("graph", "src", F.col("_to").alias("dst"), (F.col("units") + F.col("_u")).alias("units"))
        )
        out = out.unionByName(longer).groupBy("graph", "src", "dst").agg(F.min("units").alias("units"))
    return out


def _limits(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Dearest destination of every origin whose destinations are all reached."""
    arrived = known.select("graph", "origin", F.col("node").alias("destination"), "units")
    return (
        wanted.join(arrived, ["graph", "origin", "destination"], "left")
        .groupBy("graph", "origin", "destination")
        .agg(F.min("units").alias("units"))
        .groupBy("graph", "origin")
        .agg(F.when(F.count("units") == F.count(F.lit(1)), F.max("units")).alias("_limit"))
        .filter(F.col("_limit").isNotNull())
    )


def _within(labels: DataFrame, limits: DataFrame) -> DataFrame:
    kept = labels.join(limits, ["graph", "origin"], "left")
    return kept.filter(F.col("_limit").isNull() | (F.col("units") <= F.col("_limit"))).drop("_limit")


def shortest_paths(
    edges: DataFrame, requests: DataFrame, hops_per_round: int = HOPS_PER_ROUND, compact_every: int = COMPACT_EVERY
) -> DataFrame:
    """Labels ``graph, origin, node, cost, pred, segment_id`` of the shortest-path trees.

    Only improved labels are extended. Every few rounds the label table is compacted, and once
    all destinations of an origin are reached its labels dearer than the dearest of them are
    dropped: with positive costs they cannot lie on a best path, so the answer stays exact.

    Costs are summed as integers (10**-12 units). Sums are therefore exact, and the predecessor
    of a label is found once at the end as the neighbour whose cost plus edge gives its cost
    (lowest id on a tie); the rounds carry nothing but the key and one number.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "labels")
    units = F.floor(F.col("cost") * F.lit(UNITS) + F.lit(0.5)).cast("long")
    plain = materialize(edges.select("graph", "src", "dst", units.alias("units"), "segment_id"), "edges")
    steps = materialize(shortcut_edges(plain, hops_per_round), "steps")
    wanted = materialize(requests.select("graph", "origin", "destination").distinct(), "requests")
    start = wanted.select("graph", "origin").distinct()
    paths = [f"{root}/round=0"]
    frontier = start.select("graph", "origin", F.col("origin").alias("node"), F.lit(0).cast("long").alias("units"))
    frontier = materialize(frontier, "labels", paths[0])
    schema = frontier.schema
    limits, limits_path, round_no = None, None, 0
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def read() -> DataFrame:
        return spark.read.schema(schema).parquet(*paths)

    def best_of(labels: DataFrame) -> DataFrame:
        return labels.groupBy(*NODE).agg(F.min("units").alias("units"))

    while not frontier.isEmpty():
        if round_no and round_no % compact_every == 0:
            fresh = scratch_path(spark, "limits")
            limits = materialize(_limits(wanted, read()), "limits", fresh)
            packed = f"{root}/packed={round_no}"
            materialize(_within(best_of(read()), limits), "labels", packed)
            for path in [limits_path, *paths[:-1]]:
                if path:
                    drop_path(spark, path)
            limits_path, paths = fresh, [packed, paths[-1]]
        known = read()
        # A frontier of few files must not grow into many candidates in few tasks.
        spread = frontier.repartition(tasks, *NODE).withColumnRenamed("node", "src").withColumnRenamed("units", "_u")
        grown = spread.join(steps, ["graph", "src"])
        grown = grown.select("graph", "origin", F.col("dst").alias("node"), (F.col("_u") + F.col("units")).alias("units"))
        if limits is not None:
            grown = _within(grown, limits)
        # One aggregation over candidates and known labels: the candidates are computed once and
        # combined map-side before the only shuffle of the round.
        none = F.lit(None).cast("long")
        both = grown.withColumn("_old", none).unionByName(known.select(*NODE, none.alias("units"), F.col("units").alias("_old")))
        merged = both.groupBy(*NODE).agg(F.min("units").alias("units"), F.min("_old").alias("_old"))
        improved = merged.filter(F.col("units").isNotNull() & (F.col("_old").isNull() | (F.col("units") < F.col("_old"))))
        round_no += 1
        paths.append(f"{root}/round={round_no}")
        frontier = materialize(improved.select(*NODE, "units"), "labels", paths[-1])
    final = materialize(_within(best_of(read()), _limits(wanted, read())), "trees")
    for path in paths:
        drop_path(spark, path)
    reached = final.join(
        plain.select("graph", F.col("src").alias("node"), "dst", F.col("units").alias("_u"), "segment_id"), ["graph", "node"]
    ).select("graph", "origin", F.col("dst").alias("_v"), (F.col("units") + F.col("_u")).alias("units"), F.col("node").alias("pred"), "segment_id")
    labels = final.join(reached.withColumnRenamed("_v", "node"), [*NODE, "units"], "left")
    best = labels.groupBy(*NODE, "units").agg(F.min(F.struct("pred", "segment_id")).alias("_p"))
    return best.select(*NODE, (F.col("units") / F.lit(UNITS)).alias("cost"), "_p.pred", "_p.segment_id")


def route_legs(labels: DataFrame, requests: DataFrame) -> DataFrame:
    """``graph, origin, destination, leg_idx, u, v, segment_id`` of every reachable request.

    Predecessors are followed by pointer jumping: after k rounds each label knows its ancestor
    2**k steps back and each request knows 2**k nodes of its path, so a path of h legs takes
    log2(h) rounds instead of h.
    """
    spark = labels.sparkSession
    key = ["graph", "origin", "destination"]
    tree = labels.filter(F.col("pred").isNotNull())
    jump = materialize(tree.select(*NODE, F.col("pred").alias("up")), "jump")
    root = scratch_path(spark, "path")
    schema = "graph string, origin {0}, destination {0}, node {0}, back int".format(labels.schema["node"].dataType.simpleString())
    ends = requests.select(*key).distinct().withColumn("node", F.col("destination")).withColumn("back", F.lit(0))
    parts, step, used = [f"{root}/step=0"], 1, None
    newest = materialize(ends.join(tree.select(*NODE), NODE, "left_semi").select(*key, "node", "back"), "path", parts[0])
    while not newest.isEmpty():
        on_path = spark.read.schema(schema).parquet(*parts)
        further = on_path.join(jump, NODE).select(*key, F.col("up").alias("node"), (F.col("back") + step).alias("back"))
        parts.append(f"{root}/step={step}")
        newest = materialize(further, "path", parts[-1])
        hop = jump.select("graph", "origin", F.col("node").alias("up"), F.col("up").alias("_up"))
        path = scratch_path(spark, "jump")
        jump = materialize(jump.join(hop, ["graph", "origin", "up"]).select(*NODE, F.col("_up").alias("up")), "jump", path)
        if used:
            drop_path(spark, used)
        used, step = path, step * 2
    on_path = spark.read.schema(schema).parquet(*parts)
    longest = on_path.groupBy(*key).agg(F.max("back").alias("_n"))
    legs = on_path.join(tree.select(*NODE, "pred", "segment_id"), NODE).join(longest, key)
    return legs.select(
        *key, (F.col("_n") - 1 - F.col("back")).alias("leg_idx"), F.col("pred").alias("u"), F.col("node").alias("v"), "segment_id"
    )


def legs_to_destinations(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Legs of the cheapest paths of ``requests``, from trees grown backwards from the destinations.

    Many starts with one destination share its tree, so re-planning a fleet costs a tree per
    destination and not one per position. Same columns as :func:`route_legs`.
    """
    back = edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "segment_id")
    asked = materialize(requests.select("graph", F.col("destination").alias("origin"), F.col("origin").alias("destination")).distinct(), "back-requests")
    legs = materialize(route_legs(shortest_paths(back, asked), asked), "back-legs")
    last = legs.groupBy(*ROUTE).agg(F.max("leg_idx").alias("_last"))
    return legs.join(last, ROUTE).select(
        "graph", F.col("destination").alias("origin"), F.col("origin").alias("destination"),
        (F.col("_last") - F.col("leg_idx")).alias("leg_idx"), F.col("v").alias("u"), F.col("u").alias("v"), "segment_id",
    )


ROUTE = ["graph", "origin", "destination"]


def assemble_routes(legs: DataFrame, segments: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Route header: legs, totals (2 and 1 decimals) and the node path as text."""
    joined = legs.join(segments.select("segment_id", "distance_km", "travel_time_min"), "segment_id")
    path = F.array_sort(F.collect_list(F.struct("leg_idx", "u", "v", "distance_km", "travel_time_min")))

    def total(name: str) -> Column:
        """Added up leg by leg from the destination: a sum in the order of arrival may round to another last digit."""
        return F.aggregate(F.reverse("_p"), F.lit(0.0), lambda s, x: s + x[name])

    return joined.groupBy(*route).agg(F.count(F.lit(1)).alias("legs"), path.alias("_p")).select(
        *route,
        "legs",
        round_dp(total("distance_km"), 2).alias("total_distance_km"),
        round_dp(total("travel_time_min"), 1).alias("estimated_travel_time_min"),
        "_p",
    ).withColumn(
        "node_path",
        F.concat_ws(">", F.concat(F.array(F.col("_p")[0]["u"].cast("string")), F.transform("_p", lambda x: x["v"].cast("string")))),
    ).drop("_p")


def route_geometry(legs: DataFrame, segments: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """One polyline per route, each leg turned into the travel direction, joints not repeated."""
    joined = legs.join(segments.select("segment_id", "from_node_id", "geometry"), "segment_id")
    turned = joined.withColumn("_g", in_travel_direction(F.col("geometry"), F.col("from_node_id"), F.col("u")))
    pieces = turned.groupBy(*route).agg(F.array_sort(F.collect_list(F.struct("leg_idx", "_g"))).alias("_p"))
    return pieces.select(*route, join_pieces(F.transform("_p", lambda x: x["_g"])).alias("geometry"))


def remaining_legs(legs: DataFrame, start: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Legs at or after ``start.from_leg`` of each route."""
    return legs.join(start, route).filter(F.col("leg_idx") >= F.col("from_leg"))


def remaining_routes(legs: DataFrame, start: DataFrame, segments: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Totals of the unfinished part; a route without legs left is a zero route at its destination."""
    totals = assemble_routes(remaining_legs(legs, start, route), segments, route)
    out = start.join(totals, route, "left")
    return out.select(
        *route,
        "from_leg",
        F.coalesce("legs", F.lit(0)).alias("legs"),
        F.coalesce("total_distance_km", F.lit(0.0)).alias("total_distance_km"),
        F.coalesce("estimated_travel_time_min", F.lit(0.0)).alias("estimated_travel_time_min"),
        F.coalesce("node_path", F.col("destination").cast("string")).alias("node_path"),
    )


def leg_risks(legs: DataFrame, risk: DataFrame) -> DataFrame:
    """Legs with ``risk_score, risk_level, closed`` of their segment."""
    return legs.join(risk.select("segment_id", "risk_score", "risk_level", "closed"), "segment_id")


def risk_profiles(risky_legs: DataFrame, route: list[str] = ROUTE, limit: float = P.HARD_UNSAFE_SCORE) -> DataFrame:
    """Aggregate, maximum, level counts and unsafe count per route (first leg on a tie)."""
    score = F.col("risk_score")
    # Scores carry four decimals: an integer sum keeps the mean independent of row order.
    mean = F.sum(F.rint(score * 10_000).cast("long")) / 10_000.0 / F.count(F.lit(1))
    blend = P.ROUTE_MAX_SHARE * F.max(score) + (1.0 - P.ROUTE_MAX_SHARE) * mean
    worst = F.min_by(F.struct("segment_id", "risk_level"), F.struct(-score, F.col("leg_idx")))
    return risky_legs.groupBy(*route).agg(
        round_dp(clamp01(blend), 4).alias("aggregate_risk_score"),
        F.max(score).alias("max_segment_risk"),
        worst["segment_id"].alias("max_risk_segment_id"),
        worst["risk_level"].alias("max_risk_level"),
        *[F.count_if(F.col("risk_level") == k).alias(f"n_{k}") for k in P.RISK_LEVEL_ORDER],
        F.count_if(F.col("closed") | (score >= limit)).alias("unsafe_segment_count"),
    )


def complete_profiles(requests: DataFrame, profiles: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Zero profile for routes without legs (origin equals destination)."""
    zeros = {c: 0 for c in profiles.columns if c.startswith("n_") or c == "unsafe_segment_count"}
    zeros |= {"aggregate_risk_score": 0.0, "max_segment_risk": 0.0}
    return requests.join(profiles, route, "left").fillna(zeros)


def alternative_exists(edges: DataFrame, legs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether ``origin`` still reaches ``destination`` without the directed edges of its route.

    ``edges``: ``src, dst``; ``legs``: ``origin, destination, u, v``; ``pairs``: ``origin,
    destination``. A breadth-first search per pair, all pairs together; a pair leaves the search
    as soon as it is decided.
    """
    spark = edges.sparkSession
    od = ["origin", "destination"]
    edges = materialize(edges.select("src", "dst").distinct(), "reach-edges")
    used = materialize(legs.select(*od, F.col("u").alias("src"), F.col("v").alias("dst")), "reach-used")
    asked = pairs.select(*od).distinct()
    root = scratch_path(spark, "reach")
    frontier = materialize(asked.withColumn("node", F.col("origin")), "reach", f"{root}/round=0")
    schema, round_no = frontier.schema, 0
    while not frontier.isEmpty():
        seen = spark.read.schema(schema).parquet(*[f"{root}/round={i}" for i in range(round_no + 1)])
        done = seen.filter(F.col("node") == F.col("destination")).select(*od)
        open_ = frontier.join(done, od, "left_anti").withColumnRenamed("node", "src")
        step = open_.join(edges, "src").join(used, [*od, "src", "dst"], "left_anti")
        fresh = step.select(*od, F.col("dst").alias("node")).distinct()
        fresh = fresh.join(seen, [*od, "node"], "left_anti")
        round_no += 1
        frontier = materialize(fresh, "reach", f"{root}/round={round_no}")
    seen = spark.read.schema(schema).parquet(*[f"{root}/round={i}" for i in range(round_no + 1)])
    hit = seen.filter(F.col("node") == F.col("destination")).select(*od, F.lit(True).alias("_hit"))
    return asked.join(hit, od, "left").select(*od, F.coalesce("_hit", F.lit(False)).alias("has_alternative"))

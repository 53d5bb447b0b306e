"""Exact routes of many pairs over nested cells of the network.

A tree per origin holds a label for every node, which grows with the square of the network. Here the nodes are put
on a space-filling curve and cut into cells of equally many nodes, four of which make a cell of the next level. A
cell knows the costs between its border nodes on paths inside it, made from the same tables of the cells it is
made of. A pair carries its costs to the border of its cells upwards until both ends meet in one cell, and in the
cells above, since the cheapest path may leave the first; the best level gives the route, whose hops are opened
level by level down to legs. Borders of a road network grow with the root of the nodes, so the work does with their
power of 1.5, as do the legs themselves.

Costs are summed as integers as in :mod:`routing`. Of paths of equal cost one is taken, fixed by the order of the cells.
Any layout gives exact costs; coordinates only keep borders short. Where a cell would have more than
``MAX_CELL_NODES`` nodes (hubs, networks without places) the label rounds of :func:`routing.shortest_paths` are taken.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tarmetric.operators.routing import ROUTE, UNITS, alternative_exists as alternative_by_rounds, route_legs, shortest_paths
from tarmetric.operators.skew import ordinal
from tarmetric.session import materialize

LEAF_BITS = 7
MAX_CELL_NODES = 6000
ROWS_PER_CHUNK = 8192
ROWS_PER_TASK, CELLS_PER_TASK = 2048, 8
PAIRS_PER_BUCKET = 512
BANDS = 4096
NONE = np.int64(1) << 61
UP, DOWN, ACROSS, LEG = 1, 2, 0, 3
CELL_KEY = ["graph", "cell"]
CELL = "graph string, cell long, nodes binary, ranks binary, dist binary, step binary"


def curve_position(lat: pd.Series, lng: pd.Series) -> pd.Series:
    """Place on a Hilbert curve of 2**20 steps a side over the globe; unknown coordinates lie at zero."""
    side = 1 << 20
    y = ((lat.fillna(0.0).clip(-90, 90) + 90) / 180 * (side - 1)).to_numpy().astype(np.int64)
    x = ((lng.fillna(0.0).clip(-180, 180) + 180) / 360 * (side - 1)).to_numpy().astype(np.int64)
    out, s = np.zeros(len(x), np.int64), side >> 1
    while s:
        rx, ry = (x & s) > 0, (y & s) > 0
        out += s * s * ((3 * rx) ^ ry)
        flip = ~ry & rx
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(~ry, y, x), np.where(~ry, x, y)
        s >>= 1
    return pd.Series(out)


def curve_order(edges: DataFrame, places: DataFrame | None) -> DataFrame:
    """``node, pos``: the nodes of ``edges`` and ``places`` numbered along the curve (by node where no place is known).

    All places are numbered, so that the cells, and with them the choice among equal costs, do not depend on which
    variants of the network are routed together.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    if places is None:
        nodes = nodes.withColumns({"lat": F.lit(0.0), "lng": F.lit(0.0)})
    else:
        nodes = nodes.unionByName(places.select("node")).distinct()
        nodes = nodes.join(places.groupBy("node").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng")), "node", "left")
    nodes = materialize(nodes.select("node", F.pandas_udf(curve_position, "long")(F.col("lat").cast("double"), F.col("lng").cast("double")).alias("_h")), "curve")
    ends = nodes.agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    band = F.floor((F.col("_h") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * BANDS)
    out = ordinal(nodes.crossJoin(F.broadcast(ends)), band, ["_h", "node"], "pos")
    return materialize(out.select("node", F.col("pos").cast("long").alias("pos")), "curve-order")


def _cell(pos: Column, level: int, bits: int) -> Column:
    return F.shiftright(pos, bits + 2 * level)


def _closed(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest costs between all nodes of a cell and the next node on the way."""
    step = np.where(dist < NONE, np.arange(len(dist), dtype=np.int32)[None, :], np.int32(-1))
    for k in range(len(dist)):
        via = dist[:, k, None] + dist[None, k, :]
        better = via < dist
        np.copyto(dist, via, where=better)
        np.copyto(step, step[:, k, None], where=better)
    return dist, step


def _combined(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Cheapest sum over the shared axis: (p, k) and (k, m) to (p, m)."""
    out = np.full((len(rows), table.shape[1]), NONE, np.int64)
    for j in range(table.shape[0]):
        np.minimum(out, rows[:, j, None] + table[j][None, :], out=out)
    return out


class _Table:
    """A cell row read back. ``inner``: nodes of each cell of the level below, in order."""

    def __init__(self, row, level: int, bits: int):
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        self.ranks = np.frombuffer(row["ranks"], np.int32)
        m = len(self.nodes)
        self.dist = np.frombuffer(row["dist"], np.int64).reshape(m, m)
        self.step = np.frombuffer(row["step"], np.int32).reshape(m, m) if "step" in row else None
        self.shift = bits + 2 * (level - 1) if level else 0
        self.child = self.nodes >> self.shift
        self.border = np.flatnonzero(self.ranks > level)

    def inner(self, child: int) -> np.ndarray:
        return np.arange(np.searchsorted(self.child, child), np.searchsorted(self.child, child, "right"))

    def children(self, pos: np.ndarray) -> np.ndarray:
        return pos >> self.shift

    def index(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, pos)


def _stack(vectors: pd.Series) -> np.ndarray:
    """Vectors of equal length as rows; null is the single cost 0 of a node to itself."""
    return np.stack([np.zeros(1, np.int64) if v is None else np.frombuffer(v, np.int64) for v in vectors])


def _merge(level: int):
    """Cell of ``level`` from the border nodes of its parts and the arcs between them."""

    def merge(key: tuple, parts: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        if not len(parts):
            return pd.DataFrame(columns=["graph", "cell", "nodes", "ranks", "dist", "step"])
        if level == 0:
            parts = parts.sort_values("pos")
            nodes, ranks = parts["pos"].to_numpy(np.int64), parts["rank"].to_numpy(np.int32)
            dist = np.full((len(nodes), len(nodes)), NONE, np.int64)
        else:
            found = []
            for _, r in parts.sort_values("cell").iterrows():
                n, k = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["ranks"], np.int32)
                on = np.flatnonzero(k >= level)
                found.append((n[on], k[on], np.frombuffer(r["dist"], np.int64).reshape(len(n), len(n))[np.ix_(on, on)]))
            nodes, ranks = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            dist, at = np.full((len(nodes), len(nodes)), NONE, np.int64), 0
            for n, _, d in found:
                dist[at : at + len(n), at : at + len(n)] = d
                at += len(n)
        np.fill_diagonal(dist, 0)
        np.minimum.at(dist, (np.searchsorted(nodes, arcs["ps"]), np.searchsorted(nodes, arcs["pd"])), arcs["units"].to_numpy(np.int64))
        dist, step = _closed(dist)
        row = (key[0], key[1], nodes.tobytes(), ranks.tobytes(), dist.tobytes(), step.tobytes())
        return pd.DataFrame([row], columns=["graph", "cell", "nodes", "ranks", "dist", "step"])

    return merge


def _lift(level: int, bits: int):
    """Costs of ends to (or from) the border of their part of a cell, carried to the border of the cell."""

    def lift(key: tuple, ends: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = {"graph": [], "side": [], "pos": [], "vec": []}
        if len(cells) and len(ends):
            t = _Table(cells.iloc[0], level, bits)
            if len(t.border):
                for (side, child), own in ends.groupby(["side", t.children(ends["pos"].to_numpy())]):
                    on = t.inner(child)
                    table = t.dist[np.ix_(on, t.border)] if side == UP else t.dist[np.ix_(t.border, on)].T
                    costs = _combined(_stack(own["vec"]), table)
                    some = (costs < NONE).any(axis=1)
                    out["pos"] += own["pos"][some].tolist()
                    out["vec"] += [c.tobytes() for c in costs[some]]
                    out["side"] += [side] * int(some.sum())
            out["graph"] = [key[0]] * len(out["pos"])
        return pd.DataFrame(out) if out["pos"] else pd.DataFrame(columns=list(out))

    return lift


def _meet(bits: int):
    """Cheapest way of pairs inside one cell that goes through the borders of its parts."""
    names = ["graph", "origin", "destination", "po", "pd", "level", "cost", "b1", "b2", "at", "until"]

    def meet(key: tuple, pairs: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        found, level = [], key[1]
        if len(cells) and len(pairs):
            t = _Table(cells.iloc[0], level, bits)
            for (c1, c2), own in pairs.groupby([t.children(pairs["po"].to_numpy()), t.children(pairs["pd"].to_numpy())]):
                i, j = t.inner(c1), t.inner(c2)
                if not len(i) or not len(j):  # an end without any arc in this graph
                    continue
                table, up, down = t.dist[np.ix_(i, j)], _stack(own["up"]), _stack(own["down"])
                total = _combined(up, table) + down
                b2 = total.argmin(axis=1)
                b1 = (up + table[:, b2].T).argmin(axis=1)
                rows = np.arange(len(own))
                cost = total[rows, b2]
                own = own[["graph", "origin", "destination", "po", "pd"]].assign(
                    level=level, cost=cost, b1=t.nodes[i[b1]], b2=t.nodes[j[b2]], at=up[rows, b1], until=cost - down[rows, b2]
                )
                found.append(own[cost < NONE])
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    return meet


def _open(level: int, bits: int):
    """Hops of a cell as arcs (legs) and hops of its parts, with the cost at which each begins."""
    names = ["graph", "origin", "destination", "kind", "a", "b", "at"]

    def open_(key: tuple, hops: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(hops):
            return pd.DataFrame(columns=names)
        t = _Table(cells.iloc[0], level, bits)
        hops, out = hops.reset_index(drop=True), []
        start, end, at = hops["a"].to_numpy().copy(), hops["b"].to_numpy().copy(), hops["at"].to_numpy().copy()
        for (kind, child), own in hops[hops["kind"] != ACROSS].groupby(["kind", t.children(np.where(hops["kind"] == UP, hops["a"], hops["b"]))[hops["kind"] != ACROSS]]):
            on, vec, rows = t.inner(child), _stack(own["vec"]), own.index.to_numpy()
            if kind == UP:
                best = (vec + t.dist[np.ix_(on, t.index(end[rows]))].T).argmin(axis=1)
                border = t.nodes[on[best]]
                rest = own.assign(b=border)
                start[rows], at[rows] = border, vec[np.arange(len(rows)), best]
            else:
                table = t.dist[np.ix_(t.index(start[rows]), on)]
                best = (vec + table).argmin(axis=1)
                border = t.nodes[on[best]]
                rest = own.assign(a=border, at=at[rows] + table[np.arange(len(rows)), best])
                end[rows] = border
            if level:
                out.append(rest[names])
        cur, goal, row = t.index(start), t.index(end), np.arange(len(hops))
        while True:
            live = cur != goal
            cur, goal, row, at = cur[live], goal[live], row[live], at[live]
            if not len(cur):
                break
            nxt = t.step[cur, goal]
            kind = np.where(t.child[cur] == t.child[nxt], ACROSS, LEG)
            out.append(hops.loc[row, ["graph", "origin", "destination"]].assign(kind=kind, a=t.nodes[cur], b=t.nodes[nxt], at=at))
            at, cur = at + t.dist[cur, nxt], nxt
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    return open_


def _tasks(spark: SparkSession, n: int, each: int) -> int:
    """Tasks for ``n`` rows or cells, ``each`` to a task: a call into Python costs more than a few rows, so small
    networks take two tasks a core and large ones the session's partitions."""
    least = 2 * spark.sparkContext.defaultParallelism
    return max(least, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // each))


def _by_cell(
    rows: DataFrame, counted: DataFrame, cells: DataFrame, salt: list[str], run, schema: str, tasks: int, of: list[str] = CELL_KEY, most: int | None = None
) -> DataFrame:
    """``run`` over the rows of each cell, at most about ``ROWS_PER_CHUNK`` of them in one call.

    ``counted`` has a row for each of ``rows`` and is read once more for the counts. Where the caller knows that no
    cell has more than ``most`` rows and these are one chunk, nothing is counted.
    """
    if most is not None and most <= ROWS_PER_CHUNK:
        return rows.repartition(tasks, *of).groupBy(*of).cogroup(cells.repartition(tasks, *of).groupBy(*of)).applyInPandas(run, schema)
    key = [*of, "chunk"]
    chunks = counted.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_CHUNK).cast("int").alias("_chunks"))
    dealt = rows.join(chunks, of).withColumn("chunk", F.pmod(F.xxhash64(*salt), F.col("_chunks")).cast("int")).drop("_chunks")
    copies = cells.join(chunks, of).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    left, right = dealt.repartition(tasks, *key).groupBy(*key), copies.repartition(tasks, *key).groupBy(*key)
    return left.cogroup(right).applyInPandas(run, schema)


def routes_between(
    edges: DataFrame, requests: DataFrame, places: DataFrame | None = None, leaf_bits: int = LEAF_BITS, max_nodes: int = MAX_CELL_NODES
) -> DataFrame:
    """Legs ``graph, origin, destination, leg_idx, u, v, segment_id`` of the cheapest path of every reachable request.

    ``edges`` and ``requests`` as in :mod:`routing`; ``places``: ``node, lat, lng``. A request whose ends are one
    node has no legs.
    """
    spark, bits = edges.sparkSession, leaf_bits
    edges, requests = materialize(edges.select("graph", "src", "dst", "cost", "segment_id"), "cell-edges"), materialize(requests.select(*ROUTE).distinct(), "cell-requests")
    order = curve_order(edges, places)
    n = order.count()
    top = 0
    while n > 1 << (bits + 2 * top):
        top += 1
    units = F.floor(F.col("cost") * F.lit(UNITS) + F.lit(0.5)).cast("long")
    one = edges.filter("src <> dst").groupBy("graph", "src", "dst").agg(F.min(F.struct(units.alias("units"), "segment_id")).alias("_e"))
    arcs = one.select("graph", "src", "dst", "_e.units", "_e.segment_id")
    arcs = arcs.join(order.select(F.col("node").alias("src"), F.col("pos").alias("ps")), "src").join(order.select(F.col("node").alias("dst"), F.col("pos").alias("pd")), "dst")
    same = [F.when(_cell(F.col("ps"), k, bits) == _cell(F.col("pd"), k, bits), F.lit(k)) for k in range(top + 1)]
    arcs = materialize(arcs.withColumn("level", F.coalesce(*same)), "cell-arcs")
    ends = arcs.select("graph", F.col("ps").alias("pos"), "level").unionByName(arcs.select("graph", F.col("pd").alias("pos"), "level"))
    ranks = materialize(ends.groupBy("graph", "pos").agg(F.max("level").cast("int").alias("rank")), "cell-ranks")
    met = ranks.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("rank"))))
    met = met.groupBy("graph", "level", F.expr(f"shiftright(pos, {bits} + 2 * level)").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    shape = met.groupBy("graph").agg(F.max("n").alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("graphs")).first()
    if (shape["n"] or 0) > max_nodes:
        return route_legs(shortest_paths(edges, requests), requests)
    graphs = shape["graphs"]

    cells: list[DataFrame] = []
    for level in range(top + 1):
        if level:
            parts = cells[-1].select("graph", F.shiftright("cell", 2).alias("up"), "cell", "nodes", "ranks", "dist")
        else:
            parts = ranks.withColumn("up", _cell(F.col("pos"), 0, bits))
        tasks = _tasks(spark, graphs * (n >> (bits + 2 * level)), CELLS_PER_TASK)
        own = arcs.filter(F.col("level") == level).select("graph", _cell(F.col("ps"), level, bits).alias("up"), "ps", "pd", "units")
        left, right = parts.repartition(tasks, "graph", "up").groupBy("graph", "up"), own.repartition(tasks, "graph", "up").groupBy("graph", "up")
        cells.append(materialize(left.cogroup(right).applyInPandas(_merge(level), CELL), f"cells-{level}"))

    pairs = requests.join(order.select(F.col("node").alias("origin"), F.col("pos").alias("po")), "origin")
    pairs = pairs.join(order.select(F.col("node").alias("destination"), F.col("pos").alias("pd")), "destination")
    pairs = materialize(pairs.filter("po <> pd").select(*ROUTE, "po", "pd"), "cell-pairs")
    by_graph = pairs.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    asked, most = by_graph["n"] or 0, by_graph["most"] or 0
    none = F.lit(None).cast("binary")
    ends = pairs.select("graph", F.lit(UP).alias("side"), F.col("po").alias("pos")).unionByName(pairs.select("graph", F.lit(DOWN).alias("side"), F.col("pd").alias("pos")))
    lifted = [materialize(ends.distinct().withColumn("vec", none), "cell-ends")]
    for level in range(top):
        rows = lifted[-1].withColumn("cell", _cell(F.col("pos"), level, bits))
        to = _by_cell(rows, rows, cells[level].drop("step"), ["side", "pos"], _lift(level, bits), "graph string, side int, pos long, vec binary", _tasks(spark, 2 * asked, ROWS_PER_TASK), most=2 * min(most, 1 << (bits + 2 * level)))
        lifted.append(materialize(to, f"cell-ends-{level}"))

    # all levels in one go: a pair takes part in every level at which one cell holds both ends
    def tagged(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(k)) for k, t in enumerate(tables)])

    whole = tagged([c.drop("step") for c in cells])
    reach = tagged(lifted)
    up = reach.filter(F.col("side") == UP).select("graph", "level", F.col("pos").alias("po"), F.col("vec").alias("up"))
    down = reach.filter(F.col("side") == DOWN).select("graph", "level", F.col("pos").alias("pd"), F.col("vec").alias("down"))
    at_level = [F.when(_cell(F.col("po"), k, bits) == _cell(F.col("pd"), k, bits), F.struct(F.lit(k).alias("level"), _cell(F.col("po"), k, bits).alias("cell"))) for k in range(top + 1)]
    here = pairs.withColumn("_at", F.explode(F.array_compact(F.array(*at_level)))).select(*pairs.columns, "_at.*")
    rows = here.join(up, ["graph", "level", "po"]).join(down, ["graph", "level", "pd"])

    kind = {c: pairs.schema[c].dataType.simpleString() for c in ROUTE}
    route = f"graph string, origin {kind['origin']}, destination {kind['destination']}"
    way = f"{route}, po long, pd long, level int, cost long, b1 long, b2 long, at long, until long"
    best = _by_cell(rows, here, whole, ["po", "pd"], _meet(bits), way, _tasks(spark, asked * (top + 1), ROWS_PER_TASK), ["graph", "level", "cell"], most)
    rest = [F.col(c) for c in ("cost", "level", "po", "pd", "b1", "b2", "at", "until")]
    best = materialize(best.groupBy(*ROUTE).agg(F.min(F.struct(*rest)).alias("_b")).select(*ROUTE, "_b.*"), "cell-ways")

    def hop(level: int, kind: int, a: str, b: str, at: Column) -> DataFrame:
        return best.filter(F.col("level") == level).select(*ROUTE, F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), at.alias("at"))

    opened: list[DataFrame] = []
    for level in range(top, -1, -1):
        hops = hop(level, ACROSS, "b1", "b2", F.col("at"))
        if level < top:
            hops = hops.unionByName(hop(level + 1, UP, "po", "b1", F.lit(0).cast("long"))).unionByName(hop(level + 1, DOWN, "b2", "pd", F.col("until")))
            hops = hops.unionByName(opened[-1].filter(F.col("kind") != LEG))
        own = lifted[level].select("graph", F.col("side").alias("kind"), F.col("pos").alias("_pos"), "vec")
        end = F.when(F.col("kind") == UP, F.col("a")).when(F.col("kind") == DOWN, F.col("b"))
        hops = hops.withColumn("_pos", end).withColumn("cell", _cell(F.col("b"), level, bits))
        rows = hops.join(own, ["graph", "kind", "_pos"], "left").drop("_pos")
        # a route passes about twice as many cells on each level down, and a cell about once
        tasks = _tasks(spark, asked << (top - level), ROWS_PER_TASK)
        to = _by_cell(rows, hops, cells[level], ["origin", "destination", "a"], _open(level, bits), f"{route}, kind int, a long, b long, at long", tasks, most=most)
        opened.append(materialize(to, f"cell-hops-{level}"))
    legs = opened[0]
    for more in opened[1:]:
        legs = legs.unionByName(more)
    known = arcs.select("graph", F.col("ps").alias("a"), F.col("pd").alias("b"), F.col("src").alias("u"), F.col("dst").alias("v"), "segment_id")
    legs = legs.filter(F.col("kind") == LEG).join(known, ["graph", "a", "b"])
    place = F.row_number().over(W.partitionBy(*ROUTE).orderBy("at")) - 1
    return legs.select(*ROUTE, place.alias("leg_idx"), "u", "v", "segment_id")


def route_costs(legs: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, origin, destination, cost`` of routes, summed in integers."""
    units = F.floor(F.col("cost") * F.lit(UNITS) + F.lit(0.5)).cast("long")
    arcs = edges.groupBy("graph", F.col("src").alias("u"), F.col("dst").alias("v"), "segment_id").agg(F.min(units).alias("units"))
    joined = legs.join(arcs, ["graph", "u", "v", "segment_id"])
    return joined.groupBy(*ROUTE).agg((F.sum("units") / F.lit(UNITS)).alias("cost"))


def _search(start: int, goal: int, arms: dict, used: set, inside: set, shift: int) -> tuple[bool, bool]:
    """(goal reached, nothing left unseen) from ``start`` over arcs that are not ``used`` in the cells ``inside``."""
    seen, todo, closed = {start}, [start], True
    while todo:
        node = todo.pop()
        for to in arms.get(node, ()):
            if to in seen or (node, to) in used:
                continue
            if to == goal:
                return True, True
            if to >> shift in inside:
                seen.add(to)
                todo.append(to)
            else:
                closed = False
    return False, closed


def _detour(shift: int):
    """Whether pairs reach their goal beside their route within the cells it passes; null where these do not tell."""

    def detour(key: tuple, pairs: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out, back, told = {}, {}, []
        for packed in cells["arcs"]:
            for u, v in np.frombuffer(packed, np.int64).reshape(-1, 2).tolist():
                out.setdefault(u, set()).add(v)
                back.setdefault(v, set()).add(u)
        for r in pairs.itertuples():
            used = set(zip(r.us.tolist(), r.vs.tolist()))
            inside = {n >> shift for leg in used for n in leg} | {r.po >> shift, r.pd >> shift}
            hit, closed = _search(r.po, r.pd, out, used, inside, shift)
            if not hit and not closed:
                closed = _search(r.pd, r.po, back, {(v, u) for u, v in used}, inside, shift)[1]
            told.append(True if hit else False if closed else None)
        return pairs[["origin", "destination"]].assign(has_alternative=pd.Series(told, index=pairs.index, dtype=object))

    return detour


def alternative_exists(
    edges: DataFrame, legs: DataFrame, pairs: DataFrame, places: DataFrame | None = None, leaf_bits: int = LEAF_BITS, widenings: int = 3
) -> DataFrame:
    """:func:`routing.alternative_exists`, searched first in the cells that a route passes.

    A way found there is a way; an origin or destination whose reachable nodes all lie inside has none. The few pairs
    that neither tells are searched again in cells four times as large, and in the end by rounds over the whole network.
    """
    od = ["origin", "destination"]
    edges = materialize(edges.select("src", "dst").distinct(), "detour-edges")
    order = curve_order(edges, places)
    at = {c: order.select(F.col("node").alias(c), F.col("pos").alias(f"p{c}")) for c in ("u", "v", "src", "dst", *od)}
    arcs = materialize(edges.join(at["src"], "src").join(at["dst"], "dst").select("psrc", "pdst"), "detour-arcs")
    asked = materialize(pairs.select(*od).distinct(), "detour-pairs")
    steps = legs.join(at["u"], "u").join(at["v"], "v").groupBy(*od).agg(F.collect_list("pu").alias("us"), F.collect_list("pv").alias("vs"))
    empty = F.array().cast("array<bigint>")
    known = asked.filter("origin <> destination").join(at["origin"], "origin").join(at["destination"], "destination").join(steps, od, "left")
    known = known.select(*od, F.col("porigin").alias("po"), F.col("pdestination").alias("pd"), *[F.coalesce(c, empty).alias(c) for c in ("us", "vs")])
    open_, told = materialize(known, "detour-routes"), []
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * edges.sparkSession.sparkContext.defaultParallelism)
    kind = {c: asked.schema[c].dataType.simpleString() for c in od}
    schema = f"origin {kind['origin']}, destination {kind['destination']}, has_alternative boolean"
    for shift in range(leaf_bits, leaf_bits + 2 * widenings, 2):
        left = open_.count()
        if not left:
            break
        cell = [F.shiftright(F.col(c), shift) for c in ("psrc", "pdst")]
        packed = arcs.withColumn("cell", F.explode(F.array_distinct(F.array(*cell)))).groupBy("cell").applyInPandas(
            lambda key, rows: pd.DataFrame({"cell": [key[0]], "arcs": [rows[["psrc", "pdst"]].to_numpy(np.int64).tobytes()]}), "cell long, arcs binary"
        )
        rows = open_.withColumn("bucket", F.pmod(F.xxhash64(*od), F.lit(max(tasks, -(-left // PAIRS_PER_BUCKET)))))
        passed = F.array_distinct(F.transform(F.concat("us", "vs", F.array("po", "pd")), lambda x: F.shiftright(x, shift)))
        needed = materialize(rows.select("bucket", F.explode(passed).alias("cell")).distinct().join(packed, "cell"), "detour-cells")
        run = rows.repartition(tasks, "bucket").groupBy("bucket").cogroup(needed.repartition(tasks, "bucket").groupBy("bucket"))
        told.append(materialize(run.applyInPandas(_detour(shift), schema), "detour-told"))
        open_ = materialize(open_.join(told[-1].filter("has_alternative is null"), od, "left_semi"), "detour-open")
    rest = alternative_by_rounds(edges, legs, open_.select(*od)) if open_.count() else None
    out = None
    for part in [*told, *([rest] if rest is not None else [])]:
        sure = part.filter("has_alternative is not null")
        out = sure if out is None else out.unionByName(sure)
    if out is None:
        return asked.select(*od, (F.col("origin") == F.col("destination")).alias("has_alternative"))
    return asked.join(out, od, "left").select(*od, F.coalesce("has_alternative", F.col("origin") == F.col("destination")).alias("has_alternative"))

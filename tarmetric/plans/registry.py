"""Registry of named queries with their comparison SQL, and shared derived tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarmetric.functions.geo import point
from tarmetric.plans.fixtures import view, with_views
from tarmetric.session import materialize, scratch_path

# A plan of hundred joins sends each table that Spark broadcasts unasked through the driver; their sum must stay small.
BROADCAST = "1m"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
EXTRA: dict[str, str] = {}
HEADS: dict[str, str] = {}


class World:
    """The projected tables of one data folder; derived network tables are written once per session."""

    _open: dict[tuple[str, str], World] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}
        self._kept: dict[str, DataFrame] = {}
        self._parts: dict[tuple[str, str], DataFrame] = {}
        self._folders: dict[str, str] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> World:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", BROADCAST)
        key = (spark.sparkContext.applicationId, str(sf_dir))
        if key not in cls._open:
            cls._open[key] = cls(spark, str(sf_dir))
        return cls._open[key]

    def __getitem__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self._views)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write a shared table on first use; later queries read the written table."""
        if name not in self._kept:
            self._kept[name] = materialize(build(), name)
        return self._kept[name]

    def keep_parts(self, name: str, column: str, parts: Sequence[str], build: Callable[[list[str]], DataFrame]) -> DataFrame:
        """The rows of a shared table whose ``column`` is among ``parts``; ``build`` makes those not yet written, all at once."""
        new = [p for p in parts if (name, p) not in self._parts]
        if new:
            written = materialize(build(new), name)
            self._parts.update({(name, p): written for p in new})
        tables: dict[int, tuple[DataFrame, list[str]]] = {}
        for p in parts:
            held = self._parts[(name, p)]
            tables.setdefault(id(held), (held, []))[1].append(p)
        return reduce(DataFrame.unionByName, [held.filter(F.col(column).isin(own)) for held, own in tables.values()])

    def folder(self, name: str, run: Callable[[str], None]) -> str:
        """A folder of tables that ``run`` fills on first use, such as the output of a stream."""
        if name not in self._folders:
            path = scratch_path(self.spark, name)
            run(path)
            self._folders[name] = path
        return self._folders[name]

    @property
    def segments(self) -> DataFrame:
        """All projected segments with geometry and score inputs."""
        g = F.array(
            point(F.col("lat1"), F.col("lng1")), point(F.col("latm"), F.col("lngm")), point(F.col("lat2"), F.col("lng2"))
        )

        def build() -> DataFrame:
            # the ways are few bytes, which one task reads; their segments are dealt out before they are worked out
            dealt = self["road_way"].repartition(2 * self.spark.sparkContext.defaultParallelism)
            return view(self.spark, self.sf_dir, "road_segment", {"road_way": dealt}).withColumn("geometry", g)

        return self.keep("road_segment", build)

    @property
    def edges(self) -> DataFrame:
        return self.keep("road_edge", lambda: self["road_edge"])

    @property
    def nodes(self) -> DataFrame:
        return self.keep("road_node", lambda: self["road_node"])

    @property
    def rain(self) -> DataFrame:
        return self.keep("rain_daily", lambda: self["rain_daily"])


def query(name: str, sql: str | None = None):
    """Register ``fn(world) -> DataFrame`` under ``name`` with optional comparison SQL."""

    def add(fn: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(World.of(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def define(name: str, sql: str, head: str | None = None) -> None:
    """A helper view of the comparison SQL; ``head`` for a recursive one."""
    EXTRA[name] = sql
    if head:
        HEADS[name] = head


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, EXTRA, HEADS) for name, sql in ORACLE.items()}

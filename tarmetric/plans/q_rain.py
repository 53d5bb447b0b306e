"""Rainfall queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.risk import rain_factor
from tarmetric.operators import rainfall as R
from tarmetric.plans.fixtures import RAIN_DATE, rnd
from tarmetric.plans.registry import World, define, query


def factor_sql(mm: str) -> str:
    arms = [f"when {mm}<=0 then 0e0"]
    for (x0, y0), (x1, y1) in zip(P.RAIN_ANCHORS, P.RAIN_ANCHORS[1:]):
        arms.append(f"when {mm}<={x1!r}e0 then " + rnd(f"{y0!r}e0+({mm}-{x0!r}e0)/({x1!r}e0-{x0!r}e0)*({y1!r}e0-{y0!r}e0)", 4))
    return "case " + " ".join(arms) + f" when {mm} is not null then 1e0 end"


define("ox_axis_y", "select distinct lat as gy from {rain_daily}")
define("ox_axis_x", "select distinct lng as gx from {rain_daily}")
define("ox_seg_cell", """
    select segment_id, case when sqrt(dy*dy+dx*dx)<=2e-1 then gy end as gy, case when sqrt(dy*dy+dx*dx)<=2e-1 then gx end as gx, any_cell[1] as any_gy, any_cell[2] as any_gx from (
      select segment_id, (select min_by([lat, lng], ((lat-latm)*(lat-latm)+(lng-lngm)*(lng-lngm), lat, lng)) from (select distinct lat, lng from {rain_daily})) as any_cell, (select min_by(gy, (abs(gy-latm), gy)) from {ox_axis_y}) as gy, (select min(abs(gy-latm)) from {ox_axis_y}) as dy,
             (select min_by(gx, (abs(gx-lngm), gx)) from {ox_axis_x}) as gx, (select min(abs(gx-lngm)) from {ox_axis_x}) as dx from {road_segment})""")
define("ox_seg_rain", """
    select c.segment_id, d.obs_date, c.gy as grid_lat, c.gx as grid_lng, r.rainfall_mm, case when c.gy is null then 'no_coverage' when r.rainfall_mm is null then 'missing_value' else 'ok' end as status
    from {ox_seg_cell} c cross join (select distinct obs_date from {rain_daily}) d left join {rain_daily} r on r.obs_date=d.obs_date and r.lat=c.gy and r.lng=c.gx""")
define("ox_day_rain", "select *, " + factor_sql("rainfall_mm") + f" as weather_factor from {{ox_seg_rain}} where obs_date=date '{RAIN_DATE}'")


def day():
    return F.lit(RAIN_DATE).cast("date")


def day_rain(w: World) -> DataFrame:
    return w.keep("day_rain", lambda: R.segment_rainfall(w.segments, w.rain, day()))


@query("d4_segment_daily_rain", """
    select segment_id, cast(obs_date as varchar) as obs_date, grid_lat, grid_lng, rainfall_mm, status, """ + factor_sql("rainfall_mm") + " as weather_factor from {ox_seg_rain}")
def segment_daily_rain(w: World) -> DataFrame:
    """Every segment on every loaded day."""
    dates = w.rain.select("obs_date").distinct()
    places = w.segments.select("segment_id", F.col("latm").alias("lat"), F.col("lngm").alias("lng"))
    points = R.attach_lattice_cell(places, w.rain).crossJoin(F.broadcast(dates))  # one row a calendar day
    read = R.daily_rainfall(points, w.rain)
    return read.select("segment_id", F.col("obs_date").cast("string").alias("obs_date"), "grid_lat", "grid_lng", "rainfall_mm", "status", "weather_factor")


@query("d4_unloaded_day", """
    select segment_id, cast(null as double) as grid_lat, cast(null as double) as rainfall_mm, 'no_coverage' as status from {road_segment}""")
def unloaded_day(w: World) -> DataFrame:
    return R.segment_rainfall(w.segments, w.rain, F.lit("2019-01-01").cast("date")).select("segment_id", "grid_lat", "rainfall_mm", "status")


@query("d5_annual_cell", "select segment_id, any_gy as grid_lat, any_gx as grid_lng from {ox_seg_cell}")
def annual_cell(w: World) -> DataFrame:
    points = w.segments.select("segment_id", F.col("latm").alias("lat"), F.col("lngm").alias("lng"))
    return R.nearest_annual_cell(points, w.rain.select("lat", "lng")).select("segment_id", "grid_lat", "grid_lng")


@query("e10_rain_inventory", """
    select count(distinct lat)*count(distinct lng) as grid_cells, count(*) as observations, cast(min(obs_date) as varchar) as first_date, cast(max(obs_date) as varchar) as last_date,
    count(distinct obs_date) as days, min(lat) as min_lat, max(lat) as max_lat, min(lng) as min_lng, max(lng) as max_lng, count_if(rainfall_mm is null) as missing,
    floor(1e2*count_if(rainfall_mm is null)/count(*)*1e1+5e-1)/1e1 as missing_pct from {rain_daily}""")
def rain_inventory(w: World) -> DataFrame:
    return R.rainfall_inventory(w.rain).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query("e11_daily_max", "select cast(obs_date as varchar) as obs_date, max(rainfall_mm) as max_mm from {rain_daily} group by 1")
def daily_max(w: World) -> DataFrame:
    return R.daily_max(w.rain).withColumn("obs_date", F.col("obs_date").cast("string"))


@query("e11_wettest_days", """
    select cast(obs_date as varchar) as obs_date, max(rainfall_mm) as max_mm from {rain_daily} group by rain_daily.obs_date having max(rainfall_mm) is not null
    order by max_mm desc, rain_daily.obs_date desc limit 5""")
def wettest_days(w: World) -> DataFrame:
    return R.wettest_days(w.rain).withColumn("obs_date", F.col("obs_date").cast("string"))


# Long archive derived from orders: readings over seven years on a lattice.
ARCHIVE = """
    select cast(o_orderdate as date) as obs_date, 2.575e1+2.5e-1*(o_custkey%10) as lat, 9.15e1+2.5e-1*(cast(floor(o_custkey/10) as bigint)%7) as lng,
           max(case when o_orderkey%13=0 or (o_custkey%10=3 and cast(floor(o_custkey/10) as bigint)%7=5) then null else floor(o_totalprice/2e3*1e1)/1e1 end) as rainfall_mm
    from {orders} group by 1,2,3"""
define("rain_archive", ARCHIVE)


def archive(w: World) -> DataFrame:
    return w.keep("rain_archive", lambda: w.spark.sql(ARCHIVE, orders=w["orders"]))


def cell_years(w: World) -> DataFrame:
    return w.keep("cell_years", lambda: R.cell_years(archive(w)))


define("ox_cell_year", """
    select lat, lng, year(obs_date) as year, """ + rnd("sum(rainfall_mm)", 2) + " as annual_mm, " + rnd("sum(case when month(obs_date) between 6 and 9 then rainfall_mm end)", 2)
    + " as monsoon_mm, " + rnd("max(rainfall_mm)", 2) + """ as max_day_mm, case when count(rainfall_mm)>0 then count_if(rainfall_mm>1) end as rainy_days,
    count_if(rainfall_mm is null) as missing_days, count(*) as total_days from {rain_archive} group by 1,2,3""")


@query("e12_cell_years", "select * from {ox_cell_year}")
def cell_year_table(w: World) -> DataFrame:
    return cell_years(w)


@query("e13_corridor_places", """
    select p.name, r.rainfall_mm, case when p.gy is null then 'no_coverage' when r.rainfall_mm is null then 'missing_value' else 'ok' end as status, """ + factor_sql("r.rainfall_mm") + f"""
    as weather_factor from (select name, case when sqrt(dy*dy+dx*dx)<=2e-1 then gy end as gy, case when sqrt(dy*dy+dx*dx)<=2e-1 then gx end as gx from (
      select name, (select min_by(gy, (abs(gy-lat), gy)) from {{ox_axis_y}}) as gy, (select min(abs(gy-lat)) from {{ox_axis_y}}) as dy,
             (select min_by(gx, (abs(gx-lng), gx)) from {{ox_axis_x}}) as gx, (select min(abs(gx-lng)) from {{ox_axis_x}}) as dx from {{place}})) p
    left join {{rain_daily}} r on r.lat=p.gy and r.lng=p.gx and r.obs_date=date '{RAIN_DATE}'""")
def corridor_places(w: World) -> DataFrame:
    points = w["place"].select("name", "lat", "lng", day().alias("obs_date"))
    return R.daily_rainfall(points, w.rain).select("name", "rainfall_mm", "status", "weather_factor")


@query("e13_high_rain_segments", """
    select segment_id, rainfall_mm, weather_factor, (select count(*) from {ox_day_rain} where weather_factor>=3e-1) as high_segment_count
    from {ox_day_rain} where weather_factor>=3e-1 order by weather_factor desc, segment_id limit 20""")
def high_rain_segments(w: World) -> DataFrame:
    return R.high_rain_segments(day_rain(w)).select("segment_id", "rainfall_mm", "weather_factor", "high_segment_count")


@query("f10_rain_factor", """
    select cast(obs_date as varchar) as obs_date, lat, lng, """ + factor_sql("rainfall_mm") + " as weather_factor from {rain_daily}")
def rain_factors(w: World) -> DataFrame:
    return w.rain.select(F.col("obs_date").cast("string").alias("obs_date"), "lat", "lng", rain_factor(F.col("rainfall_mm")).alias("weather_factor"))


@query("f14_segment_weather", "select segment_id, grid_lat, grid_lng, rainfall_mm, status, weather_factor from {ox_day_rain}")
def segment_weather(w: World) -> DataFrame:
    return day_rain(w).select("segment_id", "grid_lat", "grid_lng", "rainfall_mm", "status", "weather_factor")


@query("g7_rain_context", "select segment_id, weather_factor from {ox_day_rain} where status='ok'")
def rain_context(w: World) -> DataFrame:
    return R.rain_context(w.segments, w.rain, day())

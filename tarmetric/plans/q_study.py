"""Segment-year study queries on the network built from the raw ways.

Its way groups are whole lattice rows and columns, so one held-out group is a whole road.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarmetric import params as P
from tarmetric.functions.risk import ml_tier, terrain_class
from tarmetric.functions.rounding import round_dp
from tarmetric.functions.text import event_year, is_day_precise, is_negative_observation
from tarmetric.operators import landslides as L
from tarmetric.operators import models as M
from tarmetric.operators import quality as C
from tarmetric.operators import ranking as K
from tarmetric.operators import segment_year as S
from tarmetric.operators.gridjoin import polyline_edges
from tarmetric.plans.fixtures import rnd
from tarmetric.plans.q_network import built_network
from tarmetric.plans.q_rain import cell_years, factor_sql
from tarmetric.plans.q_risk import score_sql
from tarmetric.plans.q_spatial import nearest_sql, profiles
from tarmetric.plans.registry import World, define, query
from tarmetric.session import scratch_path

MONTHS = "|".join(P.MONTHS)
DATE = rf"([0-9]{{1,2}})\s+({MONTHS})\s+([0-9][0-9][0-9][0-9])"
define("ox_slide_text", f"""
    select slide_no, regexp_matches(description_after_coordinates, '{DATE}') as day_precise,
    case when regexp_matches(description_after_coordinates, '{DATE}') then cast(regexp_extract(description_after_coordinates, '{DATE}', 3) as int)
         when try_cast(regexp_extract(slide_id, '/([0-9][0-9][0-9][0-9])/', 1) as int) between 1900 and 2100 then try_cast(regexp_extract(slide_id, '/([0-9][0-9][0-9][0-9])/', 1) as int) end as year,
    """ + " or ".join(f"contains(lower(raw_record), '{k}')" for k in P.NEGATIVE_KEYWORDS) + " as is_negative from {landslide}")


@query("k1_k2_event_text", "select slide_no, cast(year as bigint) as year, day_precise, is_negative from {ox_slide_text}")
def event_text(w: World) -> DataFrame:
    text = F.col("description_after_coordinates")
    return w["landslide"].select(
        "slide_no", event_year(text, F.col("slide_id")).cast("long").alias("year"), is_day_precise(text).alias("day_precise"),
        is_negative_observation(F.col("raw_record")).alias("is_negative"),
    )


define("ox_study_near", nearest_sql("{landslide}", "slide_no", "latitude", "longitude", "{ox_built_edge}"))
define("ox_event", """
    select n.slide_no, n.segment_id, t.year, t.day_precise, t.is_negative, """ + rnd("km*1e3", 2) + """ as distance_to_road_m from {ox_study_near} n join {ox_slide_text} t using (slide_no)
    where """ + rnd("km*1e3", 2) + "<=5e2")


def events(w: World) -> DataFrame:
    def build() -> DataFrame:
        net = built_network(w)
        return L.landslide_events(L.match_to_segments(w["landslide"], polyline_edges(net), net))

    return w.keep("study_events", build)


@query("k3_event_index", "select slide_no, segment_id, cast(year as bigint) as year, day_precise, is_negative, distance_to_road_m from {ox_event}")
def event_index(w: World) -> DataFrame:
    return events(w).withColumn("year", F.col("year").cast("long")).select("slide_no", "segment_id", "year", "day_precise", "is_negative", "distance_to_road_m")


define("ox_study_seg", """
    select b.segment_id, b.way_id, b.road_type, b.distance_km, case when b.way_id%19=0 then null else floor(p.slope_deg*1e2+5e-1)/1e2 end as slope_deg, floor(p.mean_e*1e1+5e-1)/1e1 as elevation_m,
    case when p.mean_e is null then null when floor(p.mean_e*1e1+5e-1)/1e1<3e2 then 'plain' when floor(p.mean_e*1e1+5e-1)/1e1<15e2 then 'hill' else 'mountain' end as terrain_type,
    case when b.way_id%5=0 then 45e-2 end as landslide_hazard_score, m.lat, m.lng
    from {ox_built} b join {ox_slope} p using (segment_id) join (select segment_id, lat, lng from (select segment_id, lat, lng, row_number() over (partition by segment_id order by seq)-1 as i,
      count(*) over (partition by segment_id) as n from {ox_built_step}) where i=cast(floor(n/2e0) as bigint)) m using (segment_id)""")


def study_segments(w: World) -> DataFrame:
    def build() -> DataFrame:
        net = built_network(w).join(profiles(w).select("segment_id", "elevation_m", "slope_deg"), "segment_id")
        mid = F.element_at("geometry", (F.floor(F.size("geometry") / 2) + 1).cast("int"))
        elevation = round_dp("elevation_m", 1)
        return net.select(
            "segment_id", "way_id", "road_type", "distance_km", F.when(F.col("way_id") % 19 != 0, round_dp("slope_deg", 2)).alias("slope_deg"),
            elevation.alias("elevation_m"), terrain_class(elevation).alias("terrain_type"),
            F.when(F.col("way_id") % 5 == 0, F.lit(0.45)).alias("landslide_hazard_score"), mid["lat"].alias("lat"), mid["lng"].alias("lng"),
        )

    return w.keep("study_segments", build)


define("ox_year", "select distinct year from {ox_cell_year}")
define("ox_study_cell", """
    select segment_id, (select min_by(y, (abs(y-lat), y)) from (select distinct lat as y from {ox_cell_year})) as gy, (select min_by(x, (abs(x-lng), x)) from (select distinct lng as x from {ox_cell_year})) as gx from {ox_study_seg}""")
define("ox_dataset", """
    select s.segment_id, s.way_id, y.year, s.road_type, s.terrain_type, s.distance_km, s.slope_deg, s.elevation_m, s.landslide_hazard_score,
    (select count(*) from {ox_event} e where e.segment_id=s.segment_id and e.year<y.year) as historical_landslide_count_prior,
    (select min(distance_to_road_m) from {ox_event} e where e.segment_id=s.segment_id and e.year<y.year) as nearest_historical_landslide_distance_m_prior,
    (select count(*) from {ox_event} e where e.segment_id=s.segment_id and e.year is null) as undated_historical_match_count,
    g.gy as rainfall_grid_lat, g.gx as rainfall_grid_lon, c.annual_mm as annual_rainfall_mm, c.monsoon_mm as monsoon_jun_sep_rainfall_mm, c.max_day_mm as max_daily_rainfall_mm, c.rainy_days as rainy_days_count, c.missing_days as rainfall_missing_days,
    coalesce(t.n,0) as event_report_count, coalesce(t.dp,false) as event_day_precision,
    case when t.pos then 'event' when t.n>0 then 'non_event_documented' else 'unobserved' end as label_status, case when t.pos then 1e0 when t.n>0 then 0e0 end as label
    from {ox_study_seg} s cross join {ox_year} y join {ox_study_cell} g on g.segment_id=s.segment_id left join {ox_cell_year} c on c.lat=g.gy and c.lng=g.gx and c.year=y.year
    left join (select segment_id, year, count(*) as n, bool_or(not is_negative) as pos, bool_or(day_precise) as dp from {ox_event} where year is not null group by 1,2) t on t.segment_id=s.segment_id and t.year=y.year""")


def dataset(w: World) -> DataFrame:
    def build() -> DataFrame:
        years = cell_years(w).select("year").distinct()
        return S.build_dataset(study_segments(w), events(w), cell_years(w), years)

    return w.keep("segment_year", build)


@query("k4_k7_segment_years", "select * exclude way_id from {ox_dataset}")
def segment_years(w: World) -> DataFrame:
    return dataset(w)


@query("k8_dataset_audit", """
    select count(*) as rows, count(distinct segment_id) as segments, count(distinct year) as years, count(*)=count(distinct segment_id)*count(distinct year) as full_grid, count_if(label_status='event') as event_rows,
    count_if(label_status='non_event_documented') as non_event_rows, count_if(label_status='unobserved') as unobserved_rows, floor(1e2*count_if(label_status='event')/count(*)*1e3+5e-1)/1e3 as event_pct,
    count(distinct case when label_status='event' then segment_id end) as event_segments, count_if(label_status='event' and event_day_precision) as day_precise_events,
    count_if(historical_landslide_count_prior>0) as rows_with_history, count(distinct case when undated_historical_match_count>0 then segment_id end) as undated_segments, count_if(rainfall_missing_days>0) as rows_with_missing_rain from {ox_dataset}""")
def dataset_audit(w: World) -> DataFrame:
    return S.dataset_audit(dataset(w))


@query("k8_status_by_year", "select year, count_if(label_status='event') as event, count_if(label_status='non_event_documented') as non_event_documented, count_if(label_status='unobserved') as unobserved from {ox_dataset} group by 1")
def status_by_year(w: World) -> DataFrame:
    return S.status_by_year(dataset(w))


COLUMNS = {
    "number": [
        "year", "distance_km", "slope_deg", "elevation_m", "landslide_hazard_score", "historical_landslide_count_prior",
        "nearest_historical_landslide_distance_m_prior", "undated_historical_match_count", "rainfall_grid_lat", "rainfall_grid_lon",
        "annual_rainfall_mm", "monsoon_jun_sep_rainfall_mm", "max_daily_rainfall_mm", "rainy_days_count", "rainfall_missing_days",
        "event_report_count", "label",
    ],
    "text": ["segment_id", "road_type", "terrain_type", "label_status"],
    "flag": ["event_day_precision"],
}


def profile_sql(c: str, kind: str) -> str:
    shared = f"'{c}' as feature, '{kind}' as kind, count(*)-count({c}) as nulls, count(distinct {c}) as distinct_values"
    if kind != "number":
        none = ("min_value", "max_value", "mean_all", "spread", "p25", "p50", "p75", "mean_event", "correlation")
        return f"select {shared}, " + ", ".join(f"cast(null as double) as {x}" for x in none) + " from {ox_dataset}"
    quartile = ", ".join(f"quantile_disc({c}, {q})*1e0 as {n}" for n, q in (("p25", "0.25"), ("p50", "0.5"), ("p75", "0.75")))
    corr = f"corr({c}, case when label_status='event' then 1e0 else 0e0 end)"
    return (
        f"select {shared}, min({c})*1e0 as min_value, max({c})*1e0 as max_value, " + rnd(f"avg({c})", 4) + " as mean_all, " + rnd(f"stddev_samp({c})", 4) + f" as spread, {quartile}, "
        + rnd(f"avg(case when label_status='event' then {c} end)", 4) + f" as mean_event, case when not isnan({corr}) then " + rnd(corr, 4) + " end as correlation from {ox_dataset}"
    )


@query("e15_dataset_profile", " union all ".join(profile_sql(c, kind) for kind, names in COLUMNS.items() for c in names))
def dataset_profile(w: World) -> DataFrame:
    return C.profile(dataset(w))


@query("e15_label_counts", "select label_status, count(*) as rows, count(distinct segment_id) as segments, min(year) as first_year, max(year) as last_year from {ox_dataset} group by 1")
def label_counts(w: World) -> DataFrame:
    return C.label_counts(dataset(w))


def _hot(c: str) -> list[str]:
    return [f"case when {c}='{v}' then 1 else 0 end as {c}_{v}" for v in S.CATEGORIES[c]]


FEATURES = ", ".join(
    ["segment_id", "year", "cast(way_id as varchar) as way_group", "case when label_status='event' then 1 else 0 end as is_event", "distance_km", "slope_deg", "elevation_m", "historical_landslide_count_prior",
     "coalesce(nearest_historical_landslide_distance_m_prior, 5e3) as nearest_historical_landslide_distance_m_prior", "case when historical_landslide_count_prior>0 then 1 else 0 end as has_prior_history"]
)


def features(w: World, with_rain: bool) -> DataFrame:
    return S.feature_columns(dataset(w), with_rain)


@query("k9_k11_features_with_rain", "select " + FEATURES + ", annual_rainfall_mm, monsoon_jun_sep_rainfall_mm, max_daily_rainfall_mm, rainy_days_count, " + ", ".join(_hot("road_type") + _hot("terrain_type")) + " from {ox_dataset}")
def features_with_rain(w: World) -> DataFrame:
    return features(w, True).drop("label_status", "terrain_type")


@query("k10_features_without_rain", "select " + FEATURES + ", " + ", ".join(_hot("road_type") + _hot("terrain_type")) + " from {ox_dataset}")
def features_without_rain(w: World) -> DataFrame:
    return features(w, False).drop("label_status", "terrain_type")


define("ox_scored", "select *, " + score_sql("historical_landslide_count_prior", "nearest_historical_landslide_distance_m_prior", "landslide_hazard_score", factor_sql("max_daily_rainfall_mm"), "cast(null as double)") + " as score, case when label_status='event' then 1 else 0 end as is_event from {ox_dataset}")


def scored(w: World) -> DataFrame:
    out = S.baseline_scores(dataset(w)).withColumn("is_event", (F.col("label_status") == "event").cast("int"))
    return out.select("segment_id", "year", "terrain_type", "score", "is_event")


@query("k12_baseline_scores", "select segment_id, year, score from {ox_scored}")
def baseline_scores(w: World) -> DataFrame:
    return scored(w).select("segment_id", "year", "score")


define("ox_pct", """
    select a.segment_id, a.year, a.is_event, a.terrain_type, 1e2*(count_if(b.score<a.score)+5e-1*count_if(b.score=a.score))/count(*) as percentile from {ox_scored} a join {ox_scored} b on b.year=a.year group by 1,2,3,4""")


@query("k16_percentile_ranks", "select segment_id, year, " + rnd("percentile", 6) + " as percentile from {ox_pct}")
def percentile_ranks(w: World) -> DataFrame:
    return K.percentile_ranks(scored(w), ["year"]).select("segment_id", "year", round_dp("percentile", 6).alias("percentile"))


@query("k20_within_terrain_percentile", """
    select a.segment_id, a.year, """ + rnd("1e2*(count_if(b.score<a.score)+5e-1*count_if(b.score=a.score))/count(*)", 6) + """ as percentile from {ox_scored} a join {ox_scored} b on b.year=a.year and b.terrain_type=a.terrain_type group by 1,2""")
def within_terrain_percentile(w: World) -> DataFrame:
    known = scored(w).filter("terrain_type is not null")
    return K.percentile_ranks(known, ["year", "terrain_type"]).select("segment_id", "year", round_dp("percentile", 6).alias("percentile"))


def auc_sql(view: str) -> str:
    return f"""
    select year, count_if(is_event=1) as n_events, count_if(is_event=0) as n_unlabeled, case when count_if(is_event=1)>0 and count_if(is_event=0)>0 and count(distinct score)>1 then
    (select sum(case when p.score>q.score then 1e0 when p.score=q.score then 5e-1 else 0e0 end) from {view} p join {view} q on q.year=p.year and q.is_event=0 and p.is_event=1 where p.year=s.year)/(count_if(is_event=1)*count_if(is_event=0)) end as rank_auc
    from {view} s group by year"""


define("ox_auc", auc_sql("{ox_scored}"))
define("ox_upland", "select * from {ox_scored} where terrain_type in ('mountain','hill')")
define("ox_auc_upland", auc_sql("{ox_upland}"))


@query("k17_rank_auc", "select year, n_events, n_unlabeled, " + rnd("rank_auc", 6) + " as rank_auc from {ox_auc}")
def rank_auc(w: World) -> DataFrame:
    return K.group_auc(scored(w), ["year"]).withColumn("rank_auc", round_dp("rank_auc", 6))


@query("k18_yearly_evaluation", "select year, n_events, n_unlabeled, " + rnd("rank_auc", 6) + " as rank_auc, " + rnd("m", 6) + " as mean_percentile from {ox_auc} join (select year, avg(percentile) as m from {ox_pct} where is_event=1 group by 1) using (year)")
def yearly_evaluation(w: World) -> DataFrame:
    return K.evaluate_years(scored(w)).withColumns({c: round_dp(c, 6) for c in ("rank_auc", "mean_percentile")})


@query("k18_summary", "select p.event_rows, " + rnd("p.m", 6) + " as mean_percentile, a.event_years, " + rnd("a.m", 6) + """ as mean_auc from (select count(*) as event_rows, avg(percentile) as m from {ox_pct} where is_event=1) p
    cross join (select count(*) as event_years, avg(rank_auc) as m from {ox_auc} where n_events>0) a""")
def evaluation_summary(w: World) -> DataFrame:
    return K.summarize_years(scored(w)).withColumns({c: round_dp(c, 6) for c in ("mean_percentile", "mean_auc")})


@query("k22_upland_evaluation", "select year, n_events, n_unlabeled, " + rnd("rank_auc", 6) + " as rank_auc from {ox_auc_upland} where n_events>0")
def upland_evaluation(w: World) -> DataFrame:
    rows = K.evaluate_years(scored(w).filter(F.col("terrain_type").isin("mountain", "hill")))
    return rows.select("year", "n_events", "n_unlabeled", round_dp("rank_auc", 6).alias("rank_auc"))


define("ox_fold", """
      select *, case when cast(floor(r/5) as bigint)%2=0 then r%5 else 4-r%5 end as fold from (
        select g, n, positive, row_number() over (order by n desc, g)-1 as r from (
          select cast(way_id as varchar) as g, count(*) as n, max(case when label_status='event' then 1 else 0 end) as positive from {ox_dataset} group by 1))""")


@query("k21_fold_assignment", """
    select fold, (select count(distinct way_id) from {ox_dataset} where label_status='event')-sum(positive) as train_positive_groups, sum(positive) as val_positive_groups, sum(n) as val_rows from {ox_fold}
    group by 1""")
def fold_assignment(w: World) -> DataFrame:
    f = features(w, False)
    return M.fold_summary(f, M.assign_folds(f)).withColumn("fold", F.col("fold").cast("long"))


@query("k23_leakage_checks", """
    select name, v=0 as passed, v as violations from (
      select 'future_rainfall' as name, count(*) as v from {ox_dataset} d left join {ox_cell_year} c on c.lat=d.rainfall_grid_lat and c.lng=d.rainfall_grid_lon and c.year=d.year where c.annual_mm is distinct from d.annual_rainfall_mm
      union all select 'prior_cutoff', count(*) from {ox_dataset} d where historical_landslide_count_prior<(select count(*) from {ox_dataset} e where e.segment_id=d.segment_id and e.year<d.year and e.label_status='event')
      union all select 'no_lifetime_feature', count(*) from {ox_dataset} d where historical_landslide_count_prior>(select count(*) from {ox_event} e where e.segment_id=d.segment_id and e.year<d.year)
      union all select 'group_isolation', count(*) from (select segment_id from {ox_dataset} join {ox_fold} on g=cast(way_id as varchar) group by 1 having count(distinct fold)>1)
      union all select 'candidate_pool', count(*) from {ox_study_seg} where segment_id not in (select segment_id from {ox_dataset})
      union all select 'sibling_grouping', count(*) from (select d.way_id from {ox_dataset} d join {ox_fold} on g=split_part(d.segment_id, '_', 2) group by 1 having count(distinct fold)>1)
      union all select 'single_label', count(*) from (select segment_id, year from {ox_dataset} group by 1,2 having count(*)>1 or max(case when label_status='event' and label<>1 then 1 else 0 end)=1))""")
def leakage_checks(w: World) -> DataFrame:
    """The checks read the columns of the saved model's pipeline and the rows as the folds deal them."""
    f = features(w, False)
    assigned = f.join(M.assign_folds(f).select("way_group", "fold"), "way_group")
    model, _ = M.load_artifact(w.spark, artifact(w))
    return C.leakage_checks(dataset(w), study_segments(w), events(w), cell_years(w), model.stages[0].getInputCols(), assigned)


@query("k25_schema_fingerprint", """
    select (select count(*) from {ox_dataset}) as rows, count(*) as features, substr(sha256(string_agg(n, '|' order by i, n)), 1, 16) as fingerprint from (
      select i, n from (values """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(S.NUMERIC_FEATURES)) + """) v(i, n)
      union all select distinct 100, concat('road_type_', road_type) from {ox_dataset} where terrain_type is not null
      union all select distinct 200, concat('terrain_type_', terrain_type) from {ox_dataset} where terrain_type is not null)""")
def schema_fingerprint(w: World) -> DataFrame:
    """Fingerprint of the feature schema built from the categories that occur in the data."""
    seen = S.observed_categories(dataset(w).filter("terrain_type is not null"))
    names = S.feature_names(False, seen)
    return dataset(w).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(names)).alias("features"), S.schema_fingerprint(F.array(*[F.lit(n) for n in names])).alias("fingerprint")
    )


@query("k26_ml_tier", "select segment_id, year, case when score>=66e-2 then 'Elevated' when score>=33e-2 then 'Moderate' else 'Low' end as tier from {ox_scored}")
def tiers(w: World) -> DataFrame:
    return scored(w).select("segment_id", "year", ml_tier(F.col("score")).alias("tier"))


def training(w: World, with_rain: bool = False) -> tuple[DataFrame, list[str]]:
    """Complete feature rows; a missing slope or rainfall value leaves the row out of the fit."""
    names = S.feature_names(with_rain)
    return w.keep(f"training_{with_rain}", lambda: features(w, with_rain).dropna(subset=names)), names


@query("k13_k15_logistic_coefficients")
def logistic_coefficients(w: World) -> DataFrame:
    rows, names = training(w, True)
    return M.coefficient_table(M.fit(rows, M.logistic_regression(names)), names, w.spark)


@query("k14_k15_forest_importances")
def forest_importances(w: World) -> DataFrame:
    rows, names = training(w)
    return M.coefficient_table(M.fit(rows, M.random_forest(names)), names, w.spark)


@query("k19_leave_one_group_out")
def leave_one_group_out(w: World) -> DataFrame:
    rows, names = training(w)
    return with_pooled(M.leave_one_group_out_jointly(rows, names))


@query("k19_leave_one_group_out_forest")
def leave_one_group_out_forest(w: World) -> DataFrame:
    rows, names = training(w)
    return with_pooled(M.leave_one_group_out(rows, lambda: M.random_forest(names)))


def with_pooled(result: tuple[DataFrame, DataFrame]) -> DataFrame:
    ranks, auc = result
    return ranks.crossJoin(F.broadcast(auc.select(F.col("rank_auc").alias("pooled_auc"))))


@query("k21_group_kfold")
def group_kfold(w: World) -> DataFrame:
    rows, names = training(w)
    return M.group_kfold(rows, lambda: M.random_forest(names))


def artifact(w: World) -> str:
    """Folder of the saved model and manifest, written once per session."""
    if "artifact" not in w.__dict__:
        rows, names = training(w)
        model = M.fit(rows, M.random_forest(names))
        w.__dict__["artifact"] = scratch_path(w.spark, "artifact")
        M.save_artifact(model, dataset(w), names, w.__dict__["artifact"], {})
    return w.__dict__["artifact"]


@query("a10_model_manifest", f"""
    select '{P.ML_EXPERIMENT_ID}' as experiment_id, count(*) as row_count, count(distinct segment_id) as segments, count(distinct year) as years, count_if(label_status='event') as event_rows,
    count(distinct case when label_status='event' then segment_id end) as event_segments, '{"|".join(S.feature_names(False))}' as feature_names, {len(S.feature_names(False))} as feature_count,
    substr(sha256('{"|".join(S.feature_names(False))}'), 1, 16) as schema_fingerprint, true as hash_of_rows""" + " from {ox_dataset}")
def model_manifest(w: World) -> DataFrame:
    """The manifest read back; the hash of the rows, which no SQL here shares, is held against the rows themselves."""
    manifest = w.spark.read.json(f"{artifact(w)}/manifest")
    rows = dataset(w).agg(M.rows_hash(dataset(w).columns).alias("_hash"))
    return manifest.crossJoin(F.broadcast(rows)).withColumn("hash_of_rows", F.col("dataset_hash") == F.col("_hash")).drop("dataset_hash", "_hash")


@query("k24_ml_risk_signal", """
    select segment_id, slope_deg is not null and elevation_m is not null as available, slope_deg is not null and elevation_m is not null as scored, case when slope_deg is null then 'slope_unavailable' when elevation_m is null then 'elevation_unavailable' else 'ok' end as reason from {ox_study_seg}""")
def ml_risk_signal(w: World) -> DataFrame:
    sane = F.col("score").isNotNull() & F.col("score").between(0, 1)
    return risk_signal(w).select("segment_id", "available", sane.alias("scored"), "reason")


@query("k24_ml_scores")
def ml_scores(w: World) -> DataFrame:
    """The advisory scores themselves, which follow from a fitted forest."""
    return risk_signal(w)


def risk_signal(w: World) -> DataFrame:
    model, names = M.load_artifact(w.spark, artifact(w))
    history = L.segment_history(events(w).select(F.col("segment_id").alias("matched_segment_id"), "distance_to_road_m", F.lit("MATCHED").alias("match_status")), study_segments(w))
    return M.ml_risk_signal(study_segments(w).join(history, "segment_id"), model, names, as_of_year=2026)

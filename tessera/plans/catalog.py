"""The evidence queries by operator id, and the SQL that must give the same rows.

``shared`` queries are one statement that both engines run; ``built`` ones are DataFrame operators held against plain SQL
(nested-loop joins instead of cell joins, ordinary windows instead of combining aggregates).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alerts, raster, spatial, trajectory
from ..sources.fixtures import FIXTURES, fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SHARED: dict[str, str] = {}
BUILT: dict[str, tuple[Query, str | None]] = {}


def shared(name: str, sql: str) -> None:
    SHARED[name] = sql


def built(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        BUILT[name] = (f, sql)
        return f

    return add


def _run(sql: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        used: dict[str, DataFrame] = {}

        def name(m: re.Match) -> str:
            n = m[0]
            used[n] = fixture(spark, sf_dir, n) if n in FIXTURES else spark.read.parquet(f"{sf_dir}/{n}.parquet")
            return "{" + n + "}"

        pattern = "|".join(rf"(?<=from ){n}\b|(?<=join ){n}\b" for n in [*FIXTURES, *TABLES])
        return spark.sql(re.sub(pattern, name, sql), **used)

    return query


def queries() -> dict[str, Query]:
    return {k: _run(v) for k, v in SHARED.items()} | {k: f for k, (f, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {k: with_fixtures(v) for k, v in SHARED.items()} | {k: with_fixtures(v) for k, (_, v) in BUILT.items() if v is not None}


# --- the flagship: the most urgent hazard ahead of each fix

_SEVERITY = """(case cls when 'shoal' then 4.0 when 'drawdown' then 3.0 when 'rock' then 2.0 else 1.0 end)
  * (case tier when 'confirmed' then 1.0 when 'likely' then 0.75 else 0.4 end)"""
_SCAN = f"""
with h as (select id as hazard_id, x as hx, y as hy, cast({_SEVERITY} as double) as severity, tier = 'confirmed' as confirmed from fx_naip),
f as (select *, speed >= 1.5 and heading is not null as moving, greatest(60.0, least(600.0, speed * 20)) as reach from fx_fix),
p as (
  select f.*, h.*, sqrt((hx - x) * (hx - x) + (hy - y) * (hy - y)) as range_m,
    greatest(0.0, least(1.0, ((hx - x) * (cos(heading) * reach) + (hy - y) * (sin(heading) * reach)) / (reach * reach))) as s
  from f join h on abs(hx - x) <= 635 and abs(hy - y) <= 635
), hit as (
  select *, case when moving then range_m / speed else cast('Infinity' as double) end as ttc from p
  where case when moving then sqrt((hx - x - s * cos(heading) * reach) * (hx - x - s * cos(heading) * reach) + (hy - y - s * sin(heading) * reach) * (hy - y - s * sin(heading) * reach)) <= 35
    else range_m <= 60 end
)"""


@built("j16_corridor_scan", _SCAN + "select seq, hazard_id, round(range_m, 6) as range_m, round(ttc, 6) as ttc, severity, confirmed from hit")
def _j16(spark, d):
    hits = alerts.corridor_scan(fixture(spark, d, "fx_fix"), fixture(spark, d, "fx_naip"))
    return hits.withColumn("range_m", F.round("range_m", 6)).withColumn("ttc", F.round("ttc", 6))


_URGENT = _SCAN + """, ranked as (
  select *, row_number() over (partition by seq order by ttc, severity desc, confirmed desc, range_m, hazard_id) as rn from hit)
select seq, hazard_id, round(range_m, 6) as range_m, round(ttc, 6) as ttc, severity, confirmed,
  case when ttc <= 6 or range_m <= 40 then 'danger' when ttc <= 15 or range_m <= 120 then 'caution' else 'clear' end as level
from ranked where rn = 1"""


@built("o1_most_urgent_hazard", _URGENT)
def most_urgent_hazard(spark, d):
    out = alerts.most_urgent(alerts.corridor_scan(fixture(spark, d, "fx_fix"), fixture(spark, d, "fx_naip")))
    return out.withColumn("range_m", F.round("range_m", 6)).withColumn("ttc", F.round("ttc", 6))


# --- projections and predicates

shared("p1_ndwi", "select t, r, c, round(case when green + nir > 0 then (green - nir) / (green + nir) end, 9) as ndwi, round((green - nir) / (green + nir + 0.000001), 9) as ndwi_eps from fx_pixel")
shared("p2_boa_offset", """select p.t, p.r, p.c, round(cast(greatest(p.green - coalesce(s.boa_offset, case when s.date >= date '1998-01-25' then 1000 else 0 end), 1) as double), 9) as green
  from fx_pixel p join fx_scene s on p.t = s.t""")
shared("p12_local_projection", """select id, round(radians(x / 1000) * 6378137 * cos(radians(45.0)), 6) as px, round(radians(y / 1000) * 6378137, 6) as py,
  round(degrees(radians(x / 1000) * 6378137 * cos(radians(45.0)) / (6378137 * cos(radians(45.0)))) * 1000, 6) as back_x from fx_naip""")
shared("p13_haversine", """select a.id, b.id as ref_id, round(2 * 6371000 * asin(sqrt(power(sin(radians(b.y - a.y) / 2000), 2)
  + cos(radians(a.y / 1000)) * cos(radians(b.y / 1000)) * power(sin(radians(b.x - a.x) / 2000), 2))), 4) as m from fx_sentinel a join fx_ref b on a.id % 25 = b.id""")
shared("p21_island_promotion", "select id, case when cls = 'rock' and area_m2 >= 40 then 'island' else cls end as cls from fx_naip")
shared("p22_class_by_dryness", "select id, case when dry_frac >= 0.5 and area_m2 >= 30 then 'island' when dry_frac >= 0.5 then 'rock' else 'shoal' end as cls from fx_bright")
shared("p27_severity", f"select id, cast({_SEVERITY} as double) as severity from fx_naip")
shared("p31_cell_key", "select id, cast(floor(x / 5) as bigint) as cx, cast(floor(y / 5) as bigint) as cy from fx_naip")
shared("p32_reach_quantise", "select r, c, cast(least(254, ceil(ft * 7 / 8)) as bigint) as reach_q, cast(coalesce(ft, 255) as bigint) as ft_q from fx_grid")
shared("p33_terrace", "select r, c, cast(floor(ft / 5) * 5 as double) as ft from fx_grid where ft is not null")
shared("p36_reach_opacity", "select r, c, round(least(1.0, greatest(0.0, (ft * 10 - 100) / (2.5 * 100 - 100))), 9) as opacity from fx_grid where ft is not null")
shared("p37_marker_radius", "select id, round(least(18.0, greatest(4.0, sqrt(area_m2 / pi()) * 2)), 9) as radius from fx_naip")
shared("f8_observation_gates", "select r, c, sum(case when valid then 1 else 0 end) as n_valid from fx_pixel group by r, c having sum(case when valid then 1 else 0 end) >= 4")
shared("f9_size_floor", "select id, area_m2 from fx_naip where coalesce(area_m2, 0) >= 10")
shared("f11_fix_quality", "select seq, trip, coalesce(accuracy <= 12, false) as swept_ok, speed >= 1 and coalesce(accuracy <= 25, true) as log_ok from fx_fix")
shared("f16_flag_alerts", "select id, case status when 'confirmed' then true when 'rejected' then false else reporter = 3 end as visible from fx_flag")

# --- joins

_PAIR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@built("j1_sensor_distance_join", f"""
with m as (
  select a.id, b.id as naip_id, b.cls, b.area_m2, b.flights, row_number() over (partition by a.id order by {_PAIR}, b.id) as rn
  from fx_sentinel a join fx_naip b on {_PAIR} <= 15 and b.area_m2 >= 10)
select s.id, m.naip_id, coalesce(m.cls, s.cls) as cls, m.area_m2, m.flights, case when m.id is null then 'sentinel_only' else 'both' end as evidence,
  case when m.id is null then 1 else 3 end as confidence_rank
from fx_sentinel s left join m on s.id = m.id and m.rn = 1""")
def _j1(spark, d):
    sentinel, naip = fixture(spark, d, "fx_sentinel"), fixture(spark, d, "fx_naip").where("area_m2 >= 10")
    hit = spatial.nearest_within(sentinel, naip, 15.0).select(F.col("l_id").alias("id"), F.col("r_id").alias("naip_id"), F.col("r_cls").alias("ncls"), F.col("r_area_m2").alias("area_m2"), F.col("r_flights").alias("flights"))
    return sentinel.join(hit, "id", "left").select("id", "naip_id", F.coalesce("ncls", "cls").alias("cls"), "area_m2", "flights", F.when(F.col("naip_id").isNull(), "sentinel_only").otherwise("both").alias("evidence"), F.when(F.col("naip_id").isNull(), 1).otherwise(3).alias("confidence_rank"))


@built("j2_unmatched_naip", f"""
with m as (select a.id, b.id as naip_id, row_number() over (partition by a.id order by {_PAIR}, b.id) as rn from fx_sentinel a join fx_naip b on {_PAIR} <= 15 and b.area_m2 >= 10)
select id, cls, area_m2 from fx_naip where area_m2 >= 10 and id not in (select naip_id from m where rn = 1)""")
def _j2(spark, d):
    naip = fixture(spark, d, "fx_naip").where("area_m2 >= 10")
    hit = spatial.nearest_within(fixture(spark, d, "fx_sentinel"), naip, 15.0).select(F.col("r_id").alias("id"))
    return naip.join(hit, "id", "left_anti").select("id", "cls", "area_m2")


@built("j3_corroboration", f"select a.id, exists (select 1 from fx_bright b where b.area_m2 >= 10 and {_PAIR} <= 15) as bright_confirmed from fx_naip a where a.area_m2 >= 10")
def _j3(spark, d):
    naip, bright = fixture(spark, d, "fx_naip").where("area_m2 >= 10"), fixture(spark, d, "fx_bright").where("area_m2 >= 10")
    seen = spatial.has_within(naip, bright, 15.0).select("id", F.lit(True).alias("s"))
    return naip.join(seen, "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("bright_confirmed"))


@built("j4_unmatched_bright", f"select a.id, a.dry_frac from fx_bright a where a.area_m2 >= 10 and not exists (select 1 from fx_naip b where b.area_m2 >= 10 and {_PAIR} <= 15)")
def _j4(spark, d):
    return spatial.has_none_within(fixture(spark, d, "fx_bright").where("area_m2 >= 10"), fixture(spark, d, "fx_naip").where("area_m2 >= 10"), 15.0).select("id", "dry_frac")


@built("j7_recall_precision", f"""
select (select count(*) from fx_ref a where exists (select 1 from fx_naip b where {_PAIR} <= 15)) as hit_refs, (select count(*) from fx_ref) as refs,
  (select count(*) from fx_naip a where exists (select 1 from fx_ref b where {_PAIR} <= 15)) as hit_dets, (select count(*) from fx_naip) as dets""")
def _j7(spark, d):
    ref, naip = fixture(spark, d, "fx_ref"), fixture(spark, d, "fx_naip")
    n = lambda df, c: df.agg(F.count("*").alias(c))
    parts = [n(spatial.has_within(ref, naip, 15.0), "hit_refs"), n(ref, "refs"), n(spatial.has_within(naip, ref, 15.0), "hit_dets"), n(naip, "dets")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


@built("j8_nearest_detection", f"""
with m as (select a.id, b.id as naip_id, {_PAIR} as d, row_number() over (partition by a.id order by {_PAIR}, b.id) as rn from fx_ref a join fx_naip b on {_PAIR} <= 30)
select id, naip_id, round(d, 6) as d from m where rn = 1""")
def _j8(spark, d):
    return spatial.nearest_within(fixture(spark, d, "fx_ref"), fixture(spark, d, "fx_naip"), 30.0).select(F.col("l_id").alias("id"), F.col("r_id").alias("naip_id"), F.round("d", 6).alias("d"))


shared("j12_point_in_section", "select cast(floor(x / 400) as bigint) as sx, cast(floor(y / 400) as bigint) as sy, count(*) as n from fx_naip group by 1, 2")
shared("j15_verdicts", "select n.id, coalesce(f.status, 'unchecked') as verdict from fx_naip n left join fx_flag f on n.id = f.id")
shared("j18_vote_weights", "select v.item, v.year, coalesce(w.weight, 0.15) as weight from fx_vote v left join (select 1994 as year, 1.0 as weight union all select 1996, 0.5) w on v.year = w.year")

# --- aggregates

_NDWI = "case when green + nir > 0 then (green - nir) / (green + nir) end"
shared("a1_persistence", f"select r, c, sum(case when valid and {_NDWI} < 0 then 1 else 0 end) as land, sum(case when valid then 1 else 0 end) as seen, round(coalesce(sum(case when valid and {_NDWI} < 0 then 1 else 0 end) / cast(nullif(sum(case when valid then 1 else 0 end), 0) as double), 0), 9) as frac from fx_pixel group by r, c")
shared("a3_stage_proxy", f"select t, sum(case when valid and {_NDWI} >= 0 then 1 else 0 end) / cast(greatest(sum(case when valid then 1 else 0 end), 1) as double) as stage from fx_pixel group by t")
shared("a6_vote_counters", "select item, count(*) as obs, sum(case when bright then 1 else 0 end) as votes from fx_vote group by item")
shared("a7_weighted_evidence", "select item, sum(case when bright then year - 1990 else 0 end) as hit_w, sum(year - 1990) as total_w, round(sum(case when bright then year - 1990 else 0 end) / cast(sum(year - 1990) as double), 9) as score from fx_vote group by item")
shared("a12_class_counts", "select cls, tier, count(*) as n from fx_naip group by cls, tier")
shared("a13_crosstab", "select cls, sum(case when tier = 'confirmed' then 1 else 0 end) as confirmed, sum(case when tier = 'likely' then 1 else 0 end) as likely, sum(case when tier = 'unverified' then 1 else 0 end) as unverified, round(cast(100 * sum(case when tier = 'confirmed' then 1 else 0 end) as double) / count(*), 6) as pct from fx_naip group by cls")
shared("a14_tier_share", "select tier, count(*) as n, round(cast(100 * count(*) as double) / sum(count(*)) over (), 6) as pct from fx_naip group by tier")
shared("a15_depth_summary", "select min(depth_ft) as lo, median(depth_ft) as mid, max(depth_ft) as hi, count(*) as n from fx_sounding")
shared("a26_shallow_share", "select round(avg(cast(case when depth_ft < 10 then 1 else 0 end as double)), 9) as shallow, median(depth_ft) as mid from fx_sounding")
shared("a29_coverage", "select count(distinct (cast(floor(x / 5) as bigint) * 1000000 + cast(floor(y / 5) as bigint))) as cells, count(distinct (cast(floor(x / 5) as bigint) * 1000000 + cast(floor(y / 5) as bigint))) * cast(25 as double) / 3000 as km_driven from fx_fix where accuracy <= 12")
shared("a31_block_min", "select cast(floor(r / 4.0) as bigint) as br, cast(floor(c / 4.0) as bigint) as bc, min(ft) as ft from fx_grid group by 1, 2")
shared("a4_stage_cuts", f"with s as (select t, sum(case when valid and {_NDWI} >= 0 then 1 else 0 end) / cast(greatest(sum(case when valid then 1 else 0 end), 1) as double) as stage from fx_pixel group by t), q as (select percentile_cont(0.3) within group (order by stage) as lo, percentile_cont(0.7) within group (order by stage) as hi from s) select t, stage <= lo as low, stage >= hi as high from s cross join q")

_OTSU = f"""
with v as (select t as g, {_NDWI} as v from fx_pixel where valid and {_NDWI} is not null),
span as (select g, min(v) as lo, max(v) as hi, count(*) as n from v group by g),
counts as (select v.g, least(511, cast(floor((v - lo) / (hi - lo) * 512) as int)) as bin, count(*) as m from v join span on v.g = span.g where hi > lo group by 1, 2),
run as (select g, bin, sum(m) over (partition by g order by bin) as w0, sum(m * (2 * bin + 1)) over (partition by g order by bin) as s0, sum(m) over (partition by g) as w, sum(m * (2 * bin + 1)) over (partition by g) as s from counts),
scored as (select g, bin, round(cast(w0 as double) * (w - w0) * pow(cast(s0 as double) / w0 - cast(s - s0 as double) / (w - w0), 2), 3) as between_ from run where w > w0),
best as (select g, bin from (select *, row_number() over (partition by g order by between_ desc, bin) as rn from scored) where rn = 1)
select span.g as t, round(case when n >= 100 and best.bin is not null then lo + (hi - lo) * (2 * best.bin + 1) / 1024 else -0.25 end, 9) as threshold from span left join best on span.g = best.g"""


@built("a5_otsu_threshold", _OTSU)
def _a5(spark, d):
    pixels = fixture(spark, d, "fx_pixel").where("valid").select("t", raster.ndwi(F.col("green"), F.col("nir")).alias("v"))
    return raster.otsu_thresholds(pixels, "t", "v").withColumn("threshold", F.round("threshold", 9))


# --- sequences

_GOOD = """with p as (
  select *, coalesce(accuracy <= 12, false) as good,
    last_value(case when accuracy <= 12 then seq end ignore nulls) over (partition by trip order by t_ms, seq rows between unbounded preceding and 1 preceding) as prev_seq from fx_fix)"""


@built("w1_last_good_fix", _GOOD + " select p.seq, p.trip, p.good, q.x as prev_x, q.t_ms as prev_t from p left join fx_fix q on p.prev_seq = q.seq")
def _w1(spark, d):
    return trajectory.last_good_fix(fixture(spark, d, "fx_fix")).select("seq", "trip", "good", F.col("prev.x").alias("prev_x"), F.col("prev.t_ms").alias("prev_t"))


_LEGS = _GOOD + """, q as (select p.*, f.x as qx, f.y as qy, f.t_ms as qt from p left join fx_fix f on p.prev_seq = f.seq where p.good),
l as (select *, case when qt is not null and t_ms - qt < 30000 then sqrt(power(x - qx, 2) + power(y - qy, 2)) end as leg_m from q),
k as (select *, case when leg_m is null then 'point' when leg_m > 120 then 'rejected' else 'leg' end as kind from l)"""


@built("w3_legs", _LEGS + " select seq, trip, kind, round(leg_m, 6) as leg_m from k")
def _w3(spark, d):
    return trajectory.legs(fixture(spark, d, "fx_fix")).select("seq", "trip", "kind", F.round("leg_m", 6).alias("leg_m"))


_POINTS = _LEGS + """, n as (select *, case when kind = 'leg' then greatest(1, cast(ceil(leg_m / 2.5) as int)) else 0 end as n from k where kind <> 'rejected'),
s as (select *, unnest(range(0, n + 1)) as i from n),
pts as (select *, case when kind = 'leg' then qx + (x - qx) * (i / cast(n as double)) else x end as px, case when kind = 'leg' then qy + (y - qy) * (i / cast(n as double)) else y end as py from s),
c as (select *, cast(floor(px / 5) as bigint) as cx, cast(floor(py / 5) as bigint) as cy, speed > 6 as planing from pts)"""


@built("w5_densified_legs", _POINTS + " select seq, count(*) as points, count(distinct cx * 1000003 + cy) as cells from c group by seq")
def _w5(spark, d):
    return trajectory.swept_points(fixture(spark, d, "fx_fix")).groupBy("seq").agg(F.count("*").alias("points"), F.countDistinct(F.col("cx") * 1000003 + F.col("cy")).alias("cells"))


@built("a34_strongest_claim", _POINTS + """, o as (select *, row_number() over (partition by cx, cy order by planing, t_ms desc, seq) as rn from c)
select cx, cy, t_ms, seq, accuracy, speed, planing from o where rn = 1""")
def _a34(spark, d):
    points = trajectory.swept_points(fixture(spark, d, "fx_fix")).withColumn("planing", F.col("speed") > trajectory.PLANING_MS)
    return trajectory.strongest_claims(points)


shared("w7_flight_rank", "select year, n, row_number() over (order by n desc, year) as rank, round(greatest(0.15, n / cast(max(n) over () as double)), 3) as weight from (select year, count(*) as n from fx_vote group by year) v")
shared("w13_recent_history", "select seq, trip from (select seq, trip, row_number() over (partition by trip order by t_ms desc, seq desc) as rn from fx_fix) f where rn <= 50")
shared("o4_sections_by_count", "select sx, sy, row_number() over (order by n desc, sx, sy) - 1 as id from (select cast(floor(x / 400) as bigint) as sx, cast(floor(y / 400) as bigint) as sy, count(*) as n from fx_naip group by 1, 2) s")
shared("u1_evidence_union", """select 'sentinel' as source, id, cls, cast(null as double) as area_m2, cast(null as double) as dry_frac from fx_sentinel
  union all select 'naip', id, cls, area_m2, null from fx_naip union all select 'bright', id, null, area_m2, dry_frac from fx_bright
  union all select 'human', id, kind, null, null from fx_ref union all select 'buoy', id, null, null, null from fx_buoy""")
shared("u3_flag_merge", """select id, status, reviewed_t, src from (
  select *, row_number() over (partition by id order by case when status <> 'pending' then 0 else 1 end, coalesce(reviewed_t, 0) desc, src) as rn from (
    select id, status, reviewed_t, 0 as src from fx_flag union all
    select id, case when id % 3 = 0 then 'confirmed' else status end, case when id % 3 = 0 then t + 5 else reviewed_t end, 1 from fx_flag where id % 2 = 0) b) m where rn = 1""")
shared("u4_reference_union", "select id, x, y, kind, 'osm' as source from fx_ref union all select id, x, y, 'buoy', 'state' from fx_buoy")
shared("u9_set_difference", "select id from fx_naip except select id from fx_bright")

# --- rasters


@built("r1_window_mean_sd", """
with w as (select g.r as wr, g.c as wc, v.ft as v from fx_grid g cross join (select unnest(range(-2, 3)) as dr) a cross join (select unnest(range(-2, 3)) as dc) b
  join fx_grid v on v.r = greatest(0, least((select max(r) from fx_grid), g.r + dr)) and v.c = greatest(0, least(49, g.c + dc)) where v.ft is not null)
select wr as r, wc as c, count(*) as n, case when count(*) > 1.25 then round(avg(v), 6) end as mean, case when count(*) > 1.25 then round(sqrt(greatest(0.000001, avg(v * v) - avg(v) * avg(v))), 6) end as sd from w group by wr, wc""")
def _r1(spark, d):
    grid = fixture(spark, d, "fx_grid")
    rows = (grid.agg(F.max("r")).first()[0] or 0) + 1
    out = raster.window_mean_sd(grid, "ft", 2, rows, 50).join(grid.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")), ["r", "c"])
    return out.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


shared("r17_resample_average", "select cast(floor(r / 3.0) as bigint) as r, cast(floor(c / 3.0) as bigint) as c, round(avg(ft), 9) as ft from fx_grid group by 1, 2")


@built("r12_marching_squares", """
with k as (select a.r, a.c, a.ft as a, b.ft as b, d.ft as d, e.ft as e, lv as level from fx_grid a join fx_grid b on b.r = a.r and b.c = a.c + 1 join fx_grid d on d.r = a.r + 1 and d.c = a.c + 1
  join fx_grid e on e.r = a.r + 1 and e.c = a.c cross join (select unnest([10.5, 25.5, 40.5]) as lv) l where a.ft is not null and b.ft is not null and d.ft is not null and e.ft is not null),
m as (select *, (a >= level)::int + 2 * (b >= level)::int + 4 * (d >= level)::int + 8 * (e >= level)::int as code from k)
select cast(level as double) as level, sum(case when code in (5, 10) then 2 else 1 end)::bigint as segments, count(*) as cells from m where code not in (0, 15) group by level""")
def _r12(spark, d):
    seg = raster.marching_squares(fixture(spark, d, "fx_grid"), [10.5, 25.5, 40.5])
    return seg.groupBy("level").agg(F.count("*").alias("segments"), F.countDistinct("r", "c").alias("cells"))


@built("r9_tile_halo", """
with t as (select id, x, y, cast(floor((x + dx) / 200) as bigint) as tx, cast(floor((y + dy) / 200) as bigint) as ty from fx_naip cross join (select unnest([-20, 0, 20]) as dx) a cross join (select unnest([-20, 0, 20]) as dy) b)
select tx, ty, count(distinct id) as held, count(distinct case when floor(x / 200) = tx and floor(y / 200) = ty then id end) as core from t group by tx, ty""")
def _r9(spark, d):
    keys = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + s) / 200).cast("long") for s in (-20, 0, 20)])))
    tiles = fixture(spark, d, "fx_naip").withColumn("tx", keys("x")).withColumn("ty", keys("y"))
    core = (F.floor(F.col("x") / 200) == F.col("tx")) & (F.floor(F.col("y") / 200) == F.col("ty"))
    return tiles.groupBy("tx", "ty").agg(F.count("*").alias("held"), F.sum(core.cast("long")).alias("core"))


@built("n5_deterministic_split", "select id, ((id * 7919 + 17) % 1000) / 1000.0 < 0.7 as train from fx_sounding")
def _n5(spark, d):
    return fixture(spark, d, "fx_sounding").select("id", (((F.col("id") * 7919 + 17) % 1000) / 1000.0 < 0.7).alias("train"))


@built("k8_tracks", "select trip, count(*) as n, round(sum(x), 6) as sx from fx_fix where accuracy <= 12 group by trip having count(*) >= 2")
def _k8(spark, d):
    good = fixture(spark, d, "fx_fix").where("accuracy <= 12")
    return good.groupBy("trip").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sx")).where("n >= 2")


@built("k9_upsert_latest", "select reporter, id, t from (select *, row_number() over (partition by reporter order by t desc, id desc) as rn from fx_flag) f where rn = 1")
def _k9(spark, d):
    return fixture(spark, d, "fx_flag").withColumn("rn", F.row_number().over(Window.partitionBy("reporter").orderBy(F.desc("t"), F.desc("id")))).where("rn = 1").select("reporter", "id", "t")


@built("j13_landmasses_near_section", f"""with s as (select cast(floor(x / 400) as bigint) as sx, cast(floor(y / 400) as bigint) as sy from fx_naip group by 1, 2),
a as (select sx * 1000 + sy as id, sx * 400 + 200.0 as x, sy * 400 + 200.0 as y from s)
select a.id, count(distinct b.cls) as kinds, count(*) as n from a join fx_sentinel b on {_PAIR} <= 300 group by a.id""")
def _j13(spark, d):
    cells = fixture(spark, d, "fx_naip").select(F.floor(F.col("x") / 400).cast("long").alias("sx"), F.floor(F.col("y") / 400).cast("long").alias("sy")).distinct()
    centres = cells.select((F.col("sx") * 1000 + F.col("sy")).alias("id"), (F.col("sx") * 400 + 200.0).alias("x"), (F.col("sy") * 400 + 200.0).alias("y"))
    pairs = spatial.distance_join(centres, fixture(spark, d, "fx_sentinel"), 300.0)
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.countDistinct("r_cls").alias("kinds"), F.count("*").alias("n"))

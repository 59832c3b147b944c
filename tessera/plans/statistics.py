"""Further evidence queries, as one statement for both engines: gates, lookups, grouped statistics, sampling, text."""

from __future__ import annotations

from .catalog import shared

shared("f1_scene_pushdown", "select o_orderkey as id, o_totalprice as price from orders where o_totalprice < 25000 and o_orderstatus = 'F'")
shared("f2_season", "select o_orderkey as id, month(o_orderdate) as m from orders where month(o_orderdate) in (6, 7, 8, 9, 10)")
shared("f3_year_window", "select o_orderkey as id from orders where year(o_orderdate) >= 1995 and o_orderdate < date '1997-01-01'")
shared("f4_scene_validity", "select t, avg(cast(case when valid then 1 else 0 end as double)) as valid_share from fx_pixel group by t having avg(cast(case when valid then 1 else 0 end as double)) >= 0.5")
shared("f6_trusted_months", "select t, date from fx_scene where month(date) in (7, 8) and usable > 0.6")
shared("f7_pixel_validity", "select t, count(*) as n from fx_pixel where valid and green is not null and nir is not null and green + nir > 0 group by t")
shared("f10_bbox_prefilter", "select id from fx_sounding where x between 500 and 1500 and y between 500 and 1500 and (x - 1000) * (x - 1000) + (y - 1000) * (y - 1000) <= 250000")
shared("f12_dismissed_hazards", "select n.id from fx_naip n left join (select id from fx_flag where status = 'rejected') f on n.id = f.id where f.id is null")
shared("f13_display_filters", "select id from fx_naip where cls <> 'island' and tier <> 'unverified' and x > 50")
shared("f15_stride_sample", "select seq, trip from (select seq, trip, row_number() over (partition by trip order by t_ms, seq) as rn from fx_fix) f where rn % 4 = 1")
shared("f17_payload_bounds", "select trip, case when count(*) > 150 then 413 when min(accuracy) is null then 400 else 200 end as status from fx_fix group by trip")
shared("f19_minimum_sample", "select cls, avg(area_m2) as area_m2 from fx_naip group by cls having count(*) >= 5")
shared("f20_coverage_gate", "select t, avg(cast(case when nir > 100 then 1 else 0 end as double)) as got from fx_pixel group by t having avg(cast(case when nir > 100 then 1 else 0 end as double)) >= 0.3")
shared("p3_clamp", "select t, r, c, round(cast(greatest(0.2, least(0.4, green)) as double), 9) as green from fx_pixel")
shared("p5_luminance", "select t, r, c, round((green + nir + green) / 3, 9) as lum from fx_pixel")
shared("p7_stumpf_ratio", "select t, r, c, round(ln(greatest(nir, 1)) / nullif(ln(greatest(nir / 10, 1)), 0), 6) as ratio from fx_pixel")
shared("p8_lyzenga", "select t, r, c, round(ln(greatest(nir - 50, 0.000001)), 6) as v from fx_pixel")
shared("p26_flight_weight", "select year, round(greatest(0.15, n / cast(max(n) over () as double)), 3) as weight, case when n >= 0.8 * max(n) over () then 'CLEAR' when n >= 0.4 * max(n) over () then 'usable' else 'GLARY' end as verdict from (select year, count(*) as n from fx_vote group by year) v")
shared("p34_depth_at_point", "select s.id, g.ft from fx_sounding s left join fx_grid g on cast(floor(s.x / 50 + 0.5) as bigint) = g.r and cast(floor(s.y / 40.06) as bigint) = g.c")
shared("p38_pixel_affine", "select id, round((x - 12.5) / 0.6, 6) as px, round((2003 - y) / 0.6, 6) as py from fx_naip")
shared("p42_lake_code", "select distinct upper(trim(c_mktsegment)) as code, length(trim(c_mktsegment)) between 4 and 12 as ok from customer")
shared("p44_summary_text", "select cls, concat(cls, ': ', cast(count(*) as string)) as line from fx_naip group by cls")
shared("p45_defaults", "select n.id, coalesce(f.status, 'unchecked') as verdict, coalesce(cast(f.accuracy as double), -1) as accuracy from fx_naip n left join fx_flag f on n.id = f.id")
shared("j10_sounding_window", "select s.id, median(g.ft) as mid, avg(g.ft) as mean from (select id, cast(floor(x / 50) as bigint) + dr as r, cast(floor(y / 41) as bigint) + dc as c from fx_sounding cross join (select -1 as dr union all select 0 union all select 1) a cross join (select -1 as dc union all select 0 union all select 1) b) s join fx_grid g on s.r = g.r and s.c = g.c group by s.id having count(g.ft) >= 5")
shared("j14_reviewed_sections", "select cast(floor(n.x / 400) as bigint) as sx, cast(floor(n.y / 400) as bigint) as sy from fx_naip n join (select distinct id from fx_flag where reviewed_t is not null) f on n.id = f.id group by 1, 2")
shared("j17_results_by_index", "select n.id, coalesce(b.dry_frac, -1.0) as dry_frac, case when b.id is null then 'unchecked' else 'checked' end as state from fx_naip n left join fx_bright b on n.id = b.id")
shared("j20_items_by_year", "select year, count(distinct item) as items, count(*) as n from fx_vote group by year")
shared("j21_new_flags", "select f.id from fx_flag f left join (select id from fx_flag where id % 3 = 0) k on f.id = k.id where k.id is null")
shared("a2_valid_count", "select r, c, sum(case when valid then 1 else 0 end) as n from fx_pixel group by r, c")
shared("a16_group_percentiles", "select tier, median(area_m2) as mid, percentile_cont(0.9) within group (order by area_m2) as p90, max(area_m2) as hi, avg(cast(case when area_m2 <= 25 then 1 else 0 end as double)) as small from fx_naip group by tier")
shared("a17_flight_contrast", "select year, round(median(contrast), 6) as contrast from (select year, item % 8 as chip, (percentile_cont(0.999) within group (order by cents) - median(cents)) / (percentile_cont(0.75) within group (order by cents) - percentile_cont(0.25) within group (order by cents) + 0.000001) as contrast from fx_vote group by year, item % 8) v group by year")
shared("a19_median_composite", "select r, c, median(nir) as nir, avg(cast(case when green > nir then 1 else 0 end as double)) > 0.5 as water from fx_pixel where valid group by r, c")
shared("a20_deep_baseline", "select t, percentile_cont(0.005) within group (order by nir) as deep, percentile_cont(0.02) within group (order by nir) as low from fx_pixel group by t")
shared("a21_band_correlation", "select band, round(corr(depth_ft, x), 6) as r, count(*) as n from (select depth_ft, x, band, lo, hi from fx_sounding cross join (select 'shallow' as band, 0 as lo, 40 as hi union all select 'mid', 20, 80 union all select 'all', 0, 1000) b) s where depth_ft >= lo and depth_ft < hi group by band having count(*) >= 2")
shared("a24_precision_recall_f1", "select tier, hit, n, coalesce(cast(2 * hit as double) / nullif(hit + n, 0), 0) as f1 from (select tier, sum(case when cls = 'rock' then 1 else 0 end) as hit, count(*) as n from fx_naip group by tier) t")
shared("a27_detection_ceiling", "select sum(case when area_m2 % 7 >= 3 or area_m2 % 5 >= 2 then 1 else 0 end) as seen, count(*) as covered, sum(case when area_m2 % 7 >= 3 or area_m2 % 5 >= 2 then 1 else 0 end) / cast(count(*) as double) as ceiling from fx_naip")
shared("a32_reach_share", "select sum(case when ft > 25 then 1 else 0 end) as far, count(ft) as cells, max(ft) as hi from fx_grid")
shared("a36_density", "select count(*) as n, count(*) / (1999 * 2003 / cast(1000000 as double)) as per_km2 from fx_naip")
shared("a40_mark_counts", "select sum(case when status = 'confirmed' then 1 else 0 end) as confirmed, sum(case when status = 'rejected' then 1 else 0 end) as rejected, count(*) as n from fx_flag")
shared("o3_oldest_scenes", "select t, date from (select t, date, row_number() over (order by date) as rn from fx_scene) s where rn <= 250")
shared("o6_best_flights", "select year, n from (select year, n, row_number() over (order by n desc, year) as rn from (select year, count(*) as n from fx_vote group by year) v) r where rn <= 3")
shared("o9_latest_scene_wins", "select r, c, t, nir from (select r, c, t, nir, row_number() over (partition by r, c order by t desc) as rn from fx_pixel where valid) m where rn = 1")
shared("r10_snapped_grid", "select id, floor(x / 30) * cast(30 as double) as gx, ceil(y / 30) * cast(30 as double) as gy from fx_naip")
shared("r19_distance_bands", "select id, case when sqrt((x - 1000) * (x - 1000) + (y - 1000) * (y - 1000)) <= 200 then 'core' when sqrt((x - 1000) * (x - 1000) + (y - 1000) * (y - 1000)) <= 600 then 'ring' else 'out' end as band from fx_naip")
shared("g8_track_length", "select trip, round(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 4) as m from (select trip, x, y, lag(x) over (partition by trip order by t_ms, seq) as px, lag(y) over (partition by trip order by t_ms, seq) as py from fx_fix) f where px is not null group by trip")
shared("g14_grid_index", "select cast(floor(x / 200) as bigint) as cx, cast(floor(y / 200) as bigint) as cy, count(*) as n, min(id) as first_id from fx_naip group by 1, 2")
shared("n6_two_scopes", "select scope, count(*) as n, round(avg(area_m2), 6) as area_m2 from (select 'ALL' as scope, area_m2 from fx_naip union all select 'OFFSHORE', area_m2 from fx_naip where x > 50 and y > 50) s group by scope")
shared("u6_contour_levels", "select distinct cast(level as double) as level, level % 10 = 0 as major from (select floor(ft / 5) * 5 as level from fx_grid where ft is not null union all select floor(ft / 10) * 10 from fx_grid where ft is not null) l")
shared("t10s_stale_cells", "select cast(floor(x / 5) as bigint) as cx, cast(floor(y / 5) as bigint) as cy, max(t_ms) as newest from fx_fix where accuracy <= 12 group by 1, 2 having max(t_ms) < (select max(t_ms) - 86400 from fx_fix)")
shared("w12_grid_risers", "select a.r, a.c, a.ft - e.ft as riser_e, a.ft - n.ft as riser_n from fx_grid a join fx_grid e on a.r = e.r and a.c + 1 = e.c join fx_grid n on a.r + 1 = n.r and a.c = n.c where e.ft > a.ft or n.ft > a.ft")

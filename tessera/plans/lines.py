"""Contour lines, points along lines, points in polygons and what a view shows, held against SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, ranges, raster, spatial
from ..sources.fixtures import fixture
from .catalog import BUILT, _PAIR, built
from .shapes import LAKE
from .surfaces import _CORNERS, _CROSSED, _RING


def _at(ch: str, node: str) -> str:
    """One of a side's number, x or y, by the side's letter."""
    forms = {
        "n": ("(r * 1000 + c) * 2", "((r + 1) * 1000 + c) * 2", "(r * 1000 + c) * 2 + 1", "(r * 1000 + c + 1) * 2 + 1"),
        "x": ("c + (level - a) / (b - a)", "c + (level - e) / (d - e)", "c", "c + 1"),
        "y": ("r", "r + 1", "r + (level - a) / (e - a)", "r + (level - b) / (d - b)"),
    }[node]
    return f"case {ch} when 's' then {forms[0]} when 'n' then {forms[1]} when 'w' then {forms[2]} else {forms[3]} end"


@built("r13_contour_lines", f"""with recursive {_CORNERS.format(levels="[7.5, 22.5, 37.5]::double[]")}, {_CROSSED},
p as (select *, unnest(case when so and ea and no and we then case when a >= level then ['ws', 'en'] else ['se', 'nw'] end
  else [(case when so then 's' else '' end) || (case when ea then 'e' else '' end) || (case when no then 'n' else '' end) || (case when we then 'w' else '' end)] end) as pair from s where so or ea or no or we),
g as (select level, {_at('pair[1]', 'n')} as u, {_at('pair[2]', 'n')} as v, sqrt(power({_at('pair[1]', 'x')} - ({_at('pair[2]', 'x')}), 2) + power({_at('pair[1]', 'y')} - ({_at('pair[2]', 'y')}), 2)) as m from p),
ways as (select level, u, v from g union all select level, v, u from g),
reach as (select level, u as k, u as other from ways union select reach.level, k, w.v from reach join ways w on w.level = reach.level and w.u = reach.other),
b as (select level, k, min(other) as line from reach group by level, k),
n as (select level, line, count(*) as vertices from b group by level, line)
select g.level, count(*) + 1 as points, count(*) = any_value(vertices) as closed, round(sum(m), 5) as length from g join b on b.level = g.level and b.k = g.u join n on n.level = b.level and n.line = b.line group by g.level, b.line having count(*) > 1""")
def _r13(spark, d):
    """Contours chained to lines: their points, whether they close, and their length from point to point in order."""
    seg = raster.marching_squares(fixture(spark, d, "fx_grid"), [7.5, 22.5, 37.5])
    return raster.polylines(seg, 400.0).groupBy("level", "line").agg(F.count("*").alias("points"), F.bool_or("closed").alias("closed"), F.round(F.sum("step"), 5).alias("length")).drop("line")


@built("g5_tolerant_containment", f"select id, inside and shore_m >= 50 as eroded, inside or shore_m <= 50 as dilated from ({BUILT['g6_point_in_lake'][1]}) p")
def _g5(spark, d):
    """Whether detections lie in the lake shrunk by 50 m, and in the lake grown by 50 m."""
    at = geometry.inside_and_shore(fixture(spark, d, "fx_naip"), geometry.edges(spark, LAKE))
    return at.select("id", (F.col("inside") & (F.col("shore_m") >= 50)).alias("eroded"), (F.col("inside") | (F.col("shore_m") <= 50)).alias("dilated"))


@built("g11_representative_point", f"""with {_RING}, b as (select id, (min(y) + max(y)) / 2 as my from fx_ring where ring = 0 group by id),
x as (select e.id, my, list_sort(list(x0 + (my - y0) / (y1 - y0) * (x1 - x0))) as xs from e join b on e.id = b.id where (y0 > my) <> (y1 > my) group by e.id, my),
i as (select id, my, xs[2 * j + 1] as lo, xs[2 * j + 2] as hi from (select *, unnest(range(0, len(xs) // 2)) as j from x) u)
select id, round(arg_max((lo + hi) / 2, hi - lo), 5) as x, round(my, 5) as y from i group by id, my""")
def _g11(spark, d):
    at = geometry.representative_points(geometry.ring_edges(fixture(spark, d, "fx_ring")))
    return at.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def _shells(spark, d):
    """Each shell as a line that ends where it begins."""
    v = fixture(spark, d, "fx_ring").where("ring = 0").select("id", "seq", "x", "y")
    return v.unionByName(v.where("seq = 0").withColumn("seq", F.lit(4)))


_ALONG = f"""{_RING}, l as (select id, seq, x0, y0, x1, y1, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) as m, coalesce(sum(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) over (partition by id order by seq rows between unbounded preceding and 1 preceding), 0) as before
  from e where ring = 0), t as (select id, sum(m) as total from l group by id)"""
_LOCATED = "d as (select p.id, k, x0 + (x1 - x0) * (far - before) / m as x, y0 + (y1 - y0) * (far - before) / m as y, row_number() over (partition by p.id, k order by seq desc) as rn from p join l on l.id = p.id and before <= far + 0.0000001)"


@built("w6_densified_lines", f"with {_ALONG}, n as (select *, greatest(2, floor(total / 15)::int) as n from t), p as (select id, k, k * total / n as far from (select *, unnest(range(0, n + 1)) as k from n) u), {_LOCATED} select id, k::int as k, round(x, 5) as x, round(y, 5) as y from d where rn = 1")
def _w6(spark, d):
    """Shells with a point about every 15 m, at even shares of the length (W6, G12)."""
    return geometry.densified(_shells(spark, d), 15.0).select("id", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@built("w11_items_along_lines", f"with {_ALONG}, p as (select id, k, k * 22.0::double as far from (select *, unnest(range(0, ceil(total / 22)::int)) as k from t) u), {_LOCATED} select id, k::int as k, round(x, 5) as x, round(y, 5) as y from d where rn = 1")
def _w11(spark, d):
    return geometry.placed_along(_shells(spark, d), 22.0).select("id", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@built("w10_ring_edges", """select a.id, a.ring, a.seq, b.x as x1, b.y as y1 from fx_ring a join (select id, ring, max(seq) + 1 as n from fx_ring group by id, ring) m on a.id = m.id and a.ring = m.ring
  join fx_ring b on b.id = a.id and b.ring = a.ring and b.seq = (a.seq + 1) % n""")
def _w10(spark, d):
    return geometry.ring_edges(fixture(spark, d, "fx_ring")).select("id", "ring", "seq", "x1", "y1")


@built("f14_in_view", "select a.id, count(*) as shown from fx_sentinel a join fx_naip b on abs(a.x - b.x) <= 150 and abs(a.y - b.y) <= 150 group by a.id")
def _f14(spark, d):
    """How many detections a view of 300 m shows around each point."""
    return ranges.sums_around(fixture(spark, d, "fx_sentinel"), fixture(spark, d, "fx_naip"), [150.0], box=True).where("n_0 > 0").select("id", F.col("n_0").alias("shown"))


@built("j23_hit_test", f"select id, hit from (select a.id, b.id as hit, row_number() over (partition by a.id order by {_PAIR}, b.id) as rn from fx_flag a join fx_naip b on {_PAIR} <= 22) t where rn = 1")
def _j23(spark, d):
    """The detection that a tap at each flag hits: the nearest within 22."""
    return spatial.nearest_within(fixture(spark, d, "fx_flag"), fixture(spark, d, "fx_naip"), 22.0).select(F.col("l_id").alias("id"), F.col("r_id").alias("hit"))


# an edge and a box share a point unless an axis or the edge's own line parts them
@built("g10_box_meets_polygon", f"""with {_RING}, b as (select id, floor(min(x) / 25) * 25 + 37.3::double as l, floor(min(y) / 25) * 25 + 12.3::double as m from fx_ring group by id),
o as (select e.*, l, m from e join b on e.id = b.id),
s as (select *, (x1 - x0) * (m - y0) - (y1 - y0) * (l - x0) as p, (x1 - x0) * (m - y0) - (y1 - y0) * (l + 20 - x0) as q, (x1 - x0) * (m + 15 - y0) - (y1 - y0) * (l - x0) as t, (x1 - x0) * (m + 15 - y0) - (y1 - y0) * (l + 20 - x0) as w from o)
select id, bool_or(least(x0, x1) <= l + 20 and greatest(x0, x1) >= l and least(y0, y1) <= m + 15 and greatest(y0, y1) >= m and least(p, q, t, w) <= 0 and greatest(p, q, t, w) >= 0)
  or sum(case when (y0 > m) <> (y1 > m) and l < x0 + (m - y0) / (y1 - y0) * (x1 - x0) then 1 else 0 end) % 2 = 1 as meets from s group by id""")
def _g10(spark, d):
    """Whether each polygon and a box of 20 x 15 near its lower left corner share a point."""
    vertices = fixture(spark, d, "fx_ring")
    low = lambda c, by: (F.floor(F.min(c) / 25) * 25 + by).cast("double")
    e = geometry.ring_edges(vertices).join(vertices.groupBy("id").agg(low("x", 37.3).alias("l"), low("y", 12.3).alias("m")), "id")
    return geometry.meets_box(e, F.col("l"), F.col("m"), F.col("l") + 20, F.col("m") + 15)

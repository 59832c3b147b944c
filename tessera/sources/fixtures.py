"""Evidence tables derived from the given star-schema tables, one SQL text each for Spark and for the oracle.

``{name}`` stands for a table: a DataFrame in Spark, a view elsewhere. Every row of the source tables is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "fx_pixel": """
        select cast(year(l_shipdate) - 1995 as int) as t, cast(l_partkey % 40 as int) as r, cast(l_suppkey % 25 as int) as c,
          sum(cast(round(l_extendedprice * 100) as bigint)) / (10000.0 * count(*)) as green,
          10 * sum(cast(l_quantity as bigint)) / cast(count(*) as double) as nir,
          min(l_linenumber) = 1 as valid
        from {lineitem} group by 1, 2, 3""",
    "fx_scene": """
        select t, make_date(1995 + t, 7, 1 + t) as date, sum(case when valid then 1 else 0 end) / cast(count(*) as double) as usable,
          case when t % 3 = 0 then null when t >= 4 then 1000 else 0 end as boa_offset
        from {fx_pixel} group by t""",
    "fx_sentinel": """
        select cast(s_suppkey as bigint) as id, cast((7919 * cast(s_suppkey as bigint)) % 1999 as double) as x, cast((10473 * cast(s_suppkey as bigint)) % 2003 as double) as y,
          case s_nationkey % 4 when 0 then 'shoal' when 1 then 'rock' when 2 then 'exposed' else 'island' end as cls
        from {supplier}""",
    "fx_naip": """
        select cast(p_partkey as bigint) as id, cast((6007 * cast(p_partkey as bigint)) % 1999 as double) as x, cast((3571 * cast(p_partkey as bigint)) % 2003 as double) as y,
          case when p_size % 3 = 0 then 'rock' else 'shoal' end as cls, cast(p_size as double) as area_m2, cast(2 + p_size % 5 as int) as flights,
          case p_partkey % 3 when 0 then 'confirmed' when 1 then 'likely' else 'unverified' end as tier
        from {part}""",
    "fx_bright": """
        select cast(c_custkey as bigint) as id, cast((4621 * cast(c_custkey as bigint)) % 1999 as double) as x, cast((8737 * cast(c_custkey as bigint)) % 2003 as double) as y,
          cast(c_custkey % 40 as double) as area_m2, cast(c_custkey % 11 as double) / 10 as dry_frac
        from {customer}""",
    "fx_ref": """
        select cast(n_nationkey as bigint) as id, cast((5381 * cast(n_nationkey as bigint)) % 1999 as double) as x, cast((2909 * cast(n_nationkey as bigint)) % 2003 as double) as y,
          case when n_regionkey = 0 then 'reef' else 'bare_rock' end as kind
        from {nation}""",
    "fx_buoy": """
        select cast(r_regionkey as bigint) as id, cast((401 * cast(r_regionkey as bigint)) % 1999 as double) as x, cast((733 * cast(r_regionkey as bigint)) % 2003 as double) as y
        from {region}""",
    "fx_fix": """
        select cast(event_id as bigint) as seq, cast(user_id as bigint) as trip, cast({epoch} as bigint) as t_ms,
          cast(10 * cast(user_id as bigint) + event_id % 150 as double) as x, cast(cast({k} as bigint) as double) as y,
          value / 5 as accuracy, cast(event_id % 130 as double) / 10 as speed, radians(event_id % 360) as heading
        from {events}""",
    "fx_flag": """
        select cast(event_id as bigint) as id, cast(10 * cast(user_id as bigint) + event_id % 150 as double) as x, cast(cast({k} as bigint) as double) as y,
          cast({epoch} as bigint) as t, cast(user_id % 7 as bigint) as reporter, value / 5 as accuracy,
          case event_id % 5 when 0 then 'confirmed' when 1 then 'rejected' else 'pending' end as status,
          case when event_id % 5 < 2 then cast({epoch} as bigint) + event_id % 1000 end as reviewed_t
        from {events}""",
    "fx_sounding": """
        select cast(s_suppkey as bigint) as id, cast((7919 * cast(s_suppkey as bigint)) % 1999 as double) as x, cast((10473 * cast(s_suppkey as bigint)) % 2003 as double) as y,
          cast(floor(abs(s_acctbal) / 100) as double) as depth_ft
        from {supplier}""",
    "fx_grid": """
        select cast(floor(p_partkey / 50.0) as bigint) as r, cast(p_partkey % 50 as bigint) as c, case when p_partkey % 17 <> 0 then cast(p_size as double) end as ft
        from {part}""",
    "fx_vote": """
        select cast(o_custkey as bigint) as item, cast(year(o_orderdate) as bigint) as year, cast(round(o_totalprice * 100) as bigint) as cents, o_orderstatus = 'F' as bright
        from {orders}""",
    "fx_hazard": """
        select n.id, n.x, n.y, n.area_m2, n.flights, b.dry_frac,
          case n.id % 6 when 0 then 'island' when 1 then 'exposed' when 2 then 'drawdown' when 3 then 'rock' else 'shoal' end as cls,
          case n.id % 5 when 0 then 'both' when 1 then 'naip_only' when 2 then 'bright_only' when 3 then 'sentinel_only' else 'human_mapped' end as evidence,
          cast(n.id % 29 as double) / 400 as land_frac, case when n.id % 7 <> 0 then cast(n.id % 11 as double) / 4 end as sigma,
          cast(n.id % 17 as double) / 4 as z_nir, cast(n.id * 7 % 13 as double) / 4 as z_green
        from {fx_naip} n left join {fx_bright} b on n.id = b.id""",
    "fx_take": """
        select cast(o_orderkey as bigint) as id, o_orderdate as date, cast(o_orderkey % 24 as double) + 0.25 as hour, cast(30 + o_custkey % 40 as double) as lat, cast(o_orderkey % 97 - 120 as double) as lon,
          cast(o_orderkey % 101 as double) / 100 as usable, case o_orderkey % 4 when 0 then '05.09' when 1 then '02.14' when 2 then 'unknown' else '04.00' end as baseline
        from {orders}""",
    "fx_element": """
        select cast(o_orderkey as bigint) as id, case when o_orderkey % 3 = 0 then 'node' else 'way' end as kind,
          chr(123) || case o_orderkey % 7 when 0 then '"building":"yes"' when 1 then '"man_made":"pier","tourism":"x"' when 2 then '"leisure":"slipway","name":"ramp &amp; dock "'
            when 3 then '"tourism":"camp_site"' when 4 then '"seamark:type":"rock","natural":"bare_rock"' when 5 then '"man_made":"mast"' else '' end || chr(125) as tags,
          case when o_orderkey % 12 <> 0 then cast(o_custkey % 1800 as double) / 10 - 90 end as lon, case when o_orderkey % 12 <> 0 then cast(o_orderkey % 700 as double) / 10 end as lat,
          case when o_orderkey % 2 = 0 then 3 else 4 end as corners, cast(o_custkey % 1800 as double) as x0, cast(o_orderkey % 700 as double) as y0
        from {orders}""",
    "fx_ring": """
        select cast(s_suppkey as bigint) as id, v.ring, v.seq,
          cast((7919 * cast(s_suppkey as bigint)) % 1999 as double) + (40 + s_suppkey % 50) * v.u as x, cast((10473 * cast(s_suppkey as bigint)) % 2003 as double) + (30 + s_suppkey % 40) * v.w as y
        from {supplier} cross join (select 0 as ring, 0 as seq, cast(0.0 as double) as u, cast(0.0 as double) as w union all select 0, 1, 1.0, 0.125 union all select 0, 2, 1.25, 1.0 union all select 0, 3, 0.0, 0.875
          union all select 1, 0, 0.25, 0.25 union all select 1, 1, 0.5, 0.25 union all select 1, 2, 0.25, 0.5) v""",
}
#: How the two dialects spell the parts that differ.
SPARK = {"epoch": "unix_timestamp(ts)", "k": "get_json_object(props, '$.k')"}
DUCKDB = {"epoch": "floor(epoch(ts))", "k": "json_extract_string(props, '$.k')"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {x: fixture(spark, sf_dir, x) if x in FIXTURES else spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in re.findall(r"{(\w+)}", text) if x not in SPARK}
    for key, spelling in SPARK.items():
        text = text.replace("{" + key + "}", spelling)
    return spark.sql(text, **used)


def with_fixtures(sql: str) -> str:
    """``sql`` preceded by the common table expressions of the fixtures that it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in FIXTURES and name not in order:
                need(FIXTURES[name])
                order.append(name)

    need(sql)
    ctes = ", ".join(f"{n} as ({re.sub(r'{(\w+)}', lambda m: DUCKDB.get(m[1], m[1]), FIXTURES[n])})" for n in order)
    sql = sql.strip()
    if not order:
        return sql
    if sql.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {sql[len('with recursive') :].strip()}"
    return f"with {ctes}, {sql[4:].strip()}" if sql.lower().startswith("with ") else f"with {ctes} {sql}"

"""Dispatch data bound to the driver's tables by integer arithmetic on keys; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# fixed values: hall id, latitude, longitude
HALLS = (("1", 49.29109654571679, -122.79072561861948), ("2", 49.2622197420057, -122.81747986099539), ("3", 49.24803974681661, -122.86546062387211), ("4", 49.29510006403205, -122.74247651791484))
NOW = "2024-01-01 00:30:00"

FIXTURES = {
    "zones": """select n_nationkey as k, concat('', n_nationkey + 1) as map_name, concat('', n_regionkey % 4 + 1) as hall_id,
        -122.92D + 0.044D * (n_nationkey % 5) as x0, 49.20D + 0.038D * ((n_nationkey - n_nationkey % 5) / 5) as y0 from {nation}""",
    "parcels": """select c_custkey as parcel_id, concat('G', c_custkey) as gis_id, concat('', c_custkey % 400 + 100) as house, concat('STREET', c_custkey % 40) as street,
        case c_custkey % 4 when 0 then 'AVE' when 1 then 'ST' when 2 then 'RD' else 'DR' end as street_type,
        case when c_custkey % 10 = 0 then concat('', c_custkey % 7 + 1) end as unit,
        49.20D + (c_custkey * 7919 % 1900) / 10000D as lat, -122.92D + (c_custkey * 104729 % 2200) / 10000D as lng, c_acctbal as value from {customer}""",
    "hydrants": """select p_partkey as object_id, case when p_size % 9 = 0 then 'ABANDONED' when p_size % 7 = 0 then null else 'IN SERVICE' end as status,
        case p_partkey % 5 when 0 then 'AA' when 1 then 'A' when 2 then 'B' when 3 then 'C' end as flow_class,
        49.20D + (p_partkey * 6151 % 1900) / 10000D as lat, -122.92D + (p_partkey * 86243 % 2200) / 10000D as lng from {part}""",
    "dispatches": """select o_orderkey as id, concat('D', o_orderkey) as dispatch_id, o_orderdate as ts, concat('STREET', o_custkey % 40) as street,
        case when o_orderkey % 11 = 0 then null else 49.20D + (o_orderkey * 7907 % 1900) / 10000D end as lat, -122.92D + (o_orderkey * 99991 % 2200) / 10000D as lng,
        concat('E', o_orderkey % 4 + 1) as u1, case o_orderkey % 6 when 0 then 'SQ2' when 1 then 'WT4' when 2 then 'L1' when 3 then 'chief' when 4 then 'Q5' else 'LAV4' end as u2,
        case o_orderkey % 3 when 0 then null when 1 then '' else concat('', o_orderkey % 25 + 1) end as map_grid,
        case when o_orderkey % 5 = 0 then 'none' else 'CH 2' end as radio_channel, o_totalprice % 100 as confidence_score,
        case o_orderstatus when 'F' then true when 'O' then false end as feedback_submitted,
        case o_orderkey % 4 when 0 then 'Medical Aid' when 1 then 'medical aid ' when 2 then 'Structure Fire' else o_orderpriority end as incident_type from {orders}""",
    "crowded": """select o_orderkey as id, case when o_orderkey % 10 > 0 then 49.2301D + (o_orderkey * 7907 % 9887) / 1000000D else 49.20D + (o_orderkey * 7907 % 1900) / 10000D end as lat,
        case when o_orderkey % 10 > 0 then -122.8799D + (o_orderkey * 99991 % 9901) / 1000000D else -122.92D + (o_orderkey * 99991 % 2200) / 10000D end as lng from {orders}""",
    "segments": """select s_suppkey as road_id, concat('STREET', s_suppkey % 40) as canon,
        -122.92D + (s_suppkey * 37 % 200) / 1000D as x1, 49.20D + (s_suppkey * 53 % 180) / 1000D as y1,
        -122.92D + (s_suppkey * 37 % 200) / 1000D + (s_suppkey % 7 - 3) / 30D as x2, 49.20D + (s_suppkey * 53 % 180) / 1000D + (s_suppkey % 5 - 1.5D) / 30D as y2,
        cast(100 + 100 * (s_suppkey % 4) as int) as left_begin, cast(198 + 100 * (s_suppkey % 4) as int) as left_end,
        cast(199 + 100 * (s_suppkey % 3) as int) as right_begin, cast(101 + 100 * (s_suppkey % 3) as int) as right_end from {supplier}""",
    "closures": """select concat('C', event_id) as closure_id, ts as start_time, ts + interval '1' hour * (event_id % 30) as end_time, event_type, event_id from {events}""",
    "readings": """select user_id % 20 as device, event_id as seq, ts, value from {events}""",
    "changes": """select event_id as seq, ts, concat('D', user_id % 300) as dispatch_id, case event_type when 'error' then 'DELETE' when 'signup' then 'INSERT' else 'UPDATE' end as op,
        case when event_id % 2 = 0 then concat('A', event_id) end as address, case when event_id % 3 = 0 then event_type end as incident_type, case when event_id % 5 > 1 then value end as confidence_score from {events}""",
}


def sql_of(name: str) -> str:
    """The fixture for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", re.sub(r"(\d)D\b", r"\1::DOUBLE", FIXTURES[name]))


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({sql_of(n)})" for n in names)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name].replace("interval '1' hour * (event_id % 30)", "make_dt_interval(0, cast(event_id % 30 as int))")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **tables)


def zone_shapes(zones: DataFrame) -> DataFrame:
    """Rectangles of 0.044 by 0.038 degrees; zones 8 and 18 lack their upper right quarter."""
    from pyspark.sql import functions as F

    p = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    box = F.array(p(0.0, 0.0), p(0.044, 0.0), p(0.044, 0.038), p(0.0, 0.038))
    ell = F.array(p(0.0, 0.0), p(0.044, 0.0), p(0.044, 0.019), p(0.022, 0.019), p(0.022, 0.038), p(0.0, 0.038))
    return zones.select("map_name", "hall_id", F.array(F.when(F.col("k").isin(7, 17), ell).otherwise(box)).alias("rings"))


def ratio_sql(a: str, b: str) -> str:
    """FN-07 for DuckDB: the ratio by a table of common subsequences."""
    cell = f"CASE WHEN ascii({b}[j[1]::INT]) = x[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[len(acc)]) END"
    row = f"list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len({b}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, {cell}))"
    lcs = f"list_reduce(list_concat([list_transform(range(0, len({b}) + 1), lambda i: 0::BIGINT)], list_transform(string_split({a}, ''), lambda ch: [ascii(ch)::BIGINT])), lambda prev, x: {row})[-1]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 100 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE round_even({lcs} * 200 / (len({a}) + len({b})), 0)::INT END"

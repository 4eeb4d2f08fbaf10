"""Registered queries, with SQL, of operators whose rules are short but were met by no query before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sirenflow.functions import fuzzy
from sirenflow.operators import geocode, streets, tones, views
from sirenflow.plans.fixtures import load, ratio_sql, with_sql, zone_shapes
from sirenflow.plans.name_queries import ORACLE, QUERIES
from sirenflow.plans.reference_queries import _requests
from sirenflow.plans.street_queries import _CLIPPED, _shifted, _shifted_sql, query

__all__ = ["ORACLE", "QUERIES"]

_VIEWS = "SELECT c_custkey AS id, c_name AS name, concat('', c_nationkey) AS grid, c_acctbal AS balance FROM {customer} WHERE c_custkey % 17 > 0"
_VIEWS_NEW = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN concat(c_nationkey, 'x') ELSE concat('', c_nationkey) END AS grid, c_acctbal AS balance FROM {customer} WHERE c_custkey % 19 > 0"


@query(
    f"""WITH o AS ({_VIEWS.format(customer="customer")}), n AS ({_VIEWS_NEW.format(customer="customer")}), j AS (SELECT coalesce(o.id, n.id) AS id, o.name AS on_, n.name AS nn, o.grid AS og, n.grid AS ng, o.id AS oid, n.id AS nid FROM o FULL JOIN n ON o.id = n.id)
SELECT id, 'name' AS field, on_ AS old, nn AS new FROM j WHERE on_ IS DISTINCT FROM nn UNION ALL SELECT id, 'grid', og, ng FROM j WHERE og IS DISTINCT FROM ng
UNION ALL SELECT id, 'key', oid::VARCHAR, nid::VARCHAR FROM j WHERE oid IS DISTINCT FROM nid"""
)
def view_changes(spark: SparkSession, d: str) -> DataFrame:
    """QC-05: fields in which two views of all customers differ, rows of one view alone included."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    old, new = (spark.sql(q, customer=c).withColumn("key", F.col("id")) for q in (_VIEWS, _VIEWS_NEW))
    return views.view_changes(old, new, "id", ["name", "grid", "key"])


_REVIEWED = """SELECT concat('D', o_orderkey) AS dispatch_id, o_orderkey % 3 > 0 AS feedback_submitted, CASE WHEN o_orderkey % 4 = 0 THEN 'C6,E1' WHEN o_orderkey % 4 = 1 THEN '' END AS verified, CASE o_orderkey % 6 WHEN 0 THEN 'L1' WHEN 1 THEN 'e3,R1' WHEN 2 THEN 'WT4' WHEN 3 THEN '' WHEN 4 THEN 'R2,L1' END AS responding,
 CASE o_orderkey % 11 WHEN 0 THEN 'Engine Tone' WHEN 1 THEN 'PA Tone, Chief Tone' WHEN 2 THEN '' END AS tone_name, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS incident_type FROM {orders}"""


@query(
    f"""WITH d AS ({_REVIEWED.format(orders="orders")}), u AS (SELECT *, coalesce(nullif(verified, ''), nullif(responding, '')) AS units FROM d WHERE feedback_submitted)
SELECT dispatch_id AS clip_id, units, coalesce(incident_type, 'Unknown') AS incident, CASE WHEN contains(tone_name, 'Engine') THEN 'Engine' WHEN contains(tone_name, 'Rescue') THEN 'Rescue' WHEN contains(tone_name, 'Chief') THEN 'Chief' WHEN contains(tone_name, 'PA') THEN 'PA'
 WHEN regexp_matches(upper(units), 'E[1-4]') THEN 'Engine' WHEN regexp_matches(upper(units), 'R[12]') THEN 'Rescue' WHEN regexp_matches(upper(units), 'C[619]') THEN 'Chief' WHEN contains(upper(units), 'L1') THEN 'Ladder' ELSE 'All' END AS category
FROM u WHERE units IS NOT NULL AND substr(dispatch_id, 2)::BIGINT % 13 > 0"""
)
def clip_categories(spark: SparkSession, d: str) -> DataFrame:
    """JN-16 for a clip of most orders."""
    t = spark.sql(_REVIEWED, orders=spark.read.parquet(f"{d}/orders.parquet"))
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    t = t.withColumns({"verified_units": listed("verified"), "responding_units": listed("responding")})
    clips = t.where("cast(substr(dispatch_id, 2) as bigint) % 13 > 0").select(F.col("dispatch_id").alias("clip_id"))
    return tones.clip_categories(clips, t).withColumn("units", F.array_join("units", ","))


@query(_shifted_sql() + f", c AS (SELECT canon, map_name, round(sum({_CLIPPED}))::BIGINT AS length_m FROM clip WHERE tb - ta > 1e-9 GROUP BY 1, 2) SELECT concat(canon, '/', map_name) AS request_id, length_m FROM c WHERE map_name::INT % 3 > 0")
def self_paired_sections(spark: SparkSession, d: str) -> DataFrame:
    """TXT-11: requests whose two streets are one, in capitals or not, give the street's section in the grid; the other requests none."""
    s, z = _shifted(spark, d), zone_shapes(load(spark, d, "zones"))
    r = s.select("canon").distinct().crossJoin(F.broadcast(z.select("map_name")))  # streets by the 25 zones
    r = r.select(F.concat("canon", F.lit("/"), "map_name").alias("request_id"), "canon", F.concat(F.lit("Grid "), "map_name").alias("map_grid"), "map_name")
    second = F.when(F.col("map_name").cast("int") % 3 > 0, F.concat(F.lit(" "), F.lower("canon"))).otherwise("ELSEWHERE")
    paired = streets.self_paired(r, F.array("canon", second))
    return streets.street_sections(paired.select("request_id", "street", "map_grid"), s, z).select("request_id", "length_m")


_WORDS = "list_filter(regexp_split_to_array({t}, '[\\s]+'), lambda w: w <> '')"
_EDITS = """list_reduce(list_concat([list_transform(range(0, len(h) + 1), lambda i: i)], list_transform(range(1, len(r) + 1), lambda i: [i])), lambda prev, i: list_reduce(list_concat([[prev[1] + 1]], list_transform(range(1, len(h) + 1), lambda j: [j])),
 lambda acc, j: list_append(acc, least(prev[j[1] + 1] + 1, acc[len(acc)] + 1, prev[j[1]] + CASE WHEN h[j[1]] = r[i[1]] THEN 0 ELSE 1 END))))[-1]"""


@query(
    f"""WITH p AS (SELECT conv_id, turn, substr(lower(text), 1, 120) AS hyp, lag(substr(lower(text), 1, 120)) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations), w AS (SELECT conv_id, turn, {_WORDS.format(t="ref")} AS r, {_WORDS.format(t="hyp")} AS h FROM p WHERE ref IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(r) = 0 THEN (len(h) > 0)::INT WHEN len(h) = 0 THEN 1.0 ELSE {_EDITS}::DOUBLE / len(r) END, 6) AS wer FROM w"""
)
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08: word errors of each turn's opening (what a radio call has room for) against that of the turn before."""
    opening = F.substring(F.lower("text"), 1, 120)
    p = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", opening.alias("hyp"), F.lag(opening).over(Window.partitionBy("conv_id").orderBy("turn")).alias("ref")).where("ref is not null")
    return p.select("conv_id", "turn", F.round(fuzzy.word_error_rate(F.col("ref"), F.col("hyp")), 6).alias("wer"))


_TOKENS = "list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda w: w <> '')))"
_SAID = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN concat('Main Street ', c_custkey % 30) WHEN 1 THEN concat('street main, North ', c_custkey % 30) WHEN 2 THEN concat('Mane Street ', c_custkey % 9) WHEN 3 THEN '...' ELSE concat('oak-', c_custkey % 30) END AS a, CASE c_custkey % 3 WHEN 0 THEN concat('MAIN STREET ', c_custkey % 30) WHEN 1 THEN concat('Oak ', c_custkey % 9) ELSE 'main street' END AS b FROM {customer}"


@query(
    f"""WITH t AS ({_SAID.format(customer="customer")}), w AS (SELECT k, {_TOKENS.format(t="a")} AS x, {_TOKENS.format(t="b")} AS y FROM t),
s AS (SELECT k, len(x) AS nx, len(y) AS ny, list_sort(list_filter(x, lambda v: list_contains(y, v))) AS i, list_filter(x, lambda v: NOT list_contains(y, v)) AS dx, list_filter(y, lambda v: NOT list_contains(x, v)) AS dy FROM w),
q AS (SELECT k, nx, ny, len(i) AS ni, len(dx) AS ndx, len(dy) AS ndy, array_to_string(i, ' ') AS shared, array_to_string(list_concat(i, dx), ' ') AS l, array_to_string(list_concat(i, dy), ' ') AS r FROM s)
SELECT k, CASE WHEN nx = 0 OR ny = 0 THEN 0 WHEN ni > 0 AND (ndx = 0 OR ndy = 0) THEN 100 WHEN ni > 0 THEN greatest({ratio_sql("l", "r")}, {ratio_sql("shared", "l")}, {ratio_sql("shared", "r")}) ELSE {ratio_sql("l", "r")} END AS score FROM q"""
)
def token_set_scores(spark: SparkSession, d: str) -> DataFrame:
    """FN-07: token-set ratios of two spoken forms."""
    t = spark.sql(_SAID, customer=spark.read.parquet(f"{d}/customer.parquet"))
    return t.select("k", fuzzy.token_set_ratio("a", "b").alias("score"))


# a road's thirds, the middle one first and backwards: the line starts at the end of the second part, the road's end
@query(ORACLE["block_range"].replace("y1 + t * (y2 - y1) AS lat, x1 + t * (x2 - x1) AS lng", "round(y2 + t * (y1 - y2), 9) AS lat, round(x2 + t * (x1 - x2), 9) AS lng"))
def block_range_parts(spark: SparkSession, d: str) -> DataFrame:
    """JN-02 and LIN-02 on roads of three parts each, joined by their ends."""
    at = lambda t: F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("lng"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("lat"))
    a, b = 1 / 3, 2 / 3
    lines = F.array(F.array(at(b), at(0.5), at(a)), F.array(at(b), at(1.0)), F.array(at(0.0), at(a)))
    roads = load(spark, d, "segments").withColumns({"fullname": F.concat("canon", F.lit(" LANE")), "roadname": F.col("canon"), "lines": lines})
    got = geocode.block_range(_requests(load(spark, d, "parcels")), roads)
    return got.withColumns({"lat": F.round("lat", 9), "lng": F.round("lng", 9)})

"""Registered queries of the similarity join and what stands on it, with SQL that compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.operators import junction_lookup as jl
from sirenflow.operators import reports, similarity, spatial, streets, upsert
from sirenflow.operators.lineage import fresh
from sirenflow.plans.fixtures import load, ratio_sql, sql_of, with_sql
from sirenflow.plans.reference_queries import _REQ, _XING
from sirenflow.plans.stream_queries import ORACLE, QUERIES
from sirenflow.plans.street_queries import _intersections, _rounded, query
from sirenflow.sources import tables

__all__ = ["ORACLE", "QUERIES"]

# names with a letter changed, doubled, dropped or moved, by key
_SPELT = """SELECT DISTINCT CASE c_custkey % 6 WHEN 0 THEN concat('STREAT', c_custkey % 40) WHEN 1 THEN concat('STREEET', c_custkey % 40) WHEN 2 THEN concat('STRET', c_custkey % 40) WHEN 3 THEN concat('ST', c_custkey % 40, 'REET')
 WHEN 4 THEN concat('OLD STREET', c_custkey % 40, ' AND A TAIL THAT IS FAR LONGER THAN ANY NAME OF A STREET IN TOWN') ELSE concat('TREETS', c_custkey % 40) END AS street FROM {customer}"""
_KNOWN = "SELECT DISTINCT concat('STREET', c_custkey % 40) AS known FROM {customer} UNION SELECT concat('OLD STREET', c_custkey % 40, ' AND A TAIL WHICH IS FAR LONGER THAN ANY NAME OF A STREET IN TOWN') FROM {customer} WHERE c_custkey % 5 = 0"
_PAIRS = f"w AS ({_SPELT.format(customer='customer')}), k AS ({_KNOWN.format(customer='customer')}), s AS (SELECT street, known, {ratio_sql('street', 'known')} AS score FROM w, k)"


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return spark.sql(_SPELT, customer=c), spark.sql(_KNOWN, customer=c)


@query(f"WITH {_PAIRS} SELECT * FROM s WHERE score >= 85")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """FN-07: all pairs of misspelt and known names of ratio 85 or more, found by their rarest character pairs."""
    return similarity.near_names(*_names(spark, d), 85)


@query(
    f"""WITH {_PAIRS.replace("w AS (", "w AS (SELECT lower(street) AS street, street AS name FROM (").replace("), k AS (", ")), k AS (SELECT lower(known) AS known FROM (", 1).replace("), s AS (SELECT street", ")), s AS (SELECT name, street")},
b AS (SELECT name, arg_min(known, (-score, known)) AS best FROM s WHERE score >= CASE WHEN len(street) <= 4 THEN 90 ELSE 75 END GROUP BY name)
SELECT name, coalesce(list_reduce(list_transform(string_split(best, ' '), lambda t: upper(t[1]) || t[2:]), lambda x, y: x || ' ' || y), name) AS corrected FROM w LEFT JOIN b USING (name)"""
)
def corrected_names(spark: SparkSession, d: str) -> DataFrame:
    """TXT-07 over the misspelt names."""
    wanted, known = _names(spark, d)
    return jl.corrected_names(wanted.withColumnRenamed("street", "name"), known.withColumnRenamed("known", "street"))


_JUNCTIONS = """i AS (SELECT least(canon_a, canon_b) || ' & ' || greatest(canon_a, canon_b) AS key, x, y, row_number() OVER (PARTITION BY canon_a, canon_b ORDER BY x, y) - 1 AS candidate_index FROM n),
k AS (SELECT DISTINCT unnest(string_split(key, ' & ')) AS known FROM i),
r AS (SELECT c_custkey AS request_id, 'STREAT' || (c_custkey % 40) AS a, 'STREET' || (c_custkey * 7 % 40) AS b{more} FROM customer),
u AS (SELECT DISTINCT unnest([a, b]) AS street FROM r),
z AS (SELECT street, known, {ratio} AS score FROM u, k),
v AS (SELECT street, known, score FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY score DESC, known) AS o, bool_or(street = known) OVER (PARTITION BY street) AS same FROM z WHERE score >= 85) WHERE CASE WHEN same THEN street = known ELSE o <= 4 END),
pr AS (SELECT request_id, least(x.known, y.known) || ' & ' || greatest(x.known, y.known) AS key, max(least(x.score, y.score)) AS score FROM r JOIN v x ON x.street = a JOIN v y ON y.street = b WHERE x.known <> y.known GROUP BY 1, 2),
c AS (SELECT request_id, key, candidate_index, y AS lat, x AS lng, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, key, candidate_index) AS rank FROM pr JOIN i USING (key))"""
ORACLE["junction_suggestions"] = with_sql("segments") + _XING + ", " + _JUNCTIONS.format(more="", ratio=ratio_sql("street", "known")) + " SELECT request_id, key, candidate_index, lat, lng, score, rank FROM c WHERE rank <= 6"

_EXISTS = ", CASE WHEN c_custkey % 3 > 0 THEN concat('', c_custkey % 40 + 100) END AS house, concat('STREET', (c_custkey + c_custkey % 2) % 40) AS street"


@query(
    with_sql("segments") + _XING + f", parcels AS ({sql_of('parcels')}), " + _JUNCTIONS.format(more=_EXISTS, ratio=ratio_sql("street", "known"))
    + f""", e AS (SELECT request_id, 0 AS o, 100 AS score, key AS match FROM (SELECT *, least(a, b) || ' & ' || greatest(a, b) AS key FROM r) JOIN (SELECT DISTINCT key FROM i) USING (key)
 UNION ALL SELECT request_id, 0, score, key FROM c WHERE rank = 1 AND score >= 80),
f AS (SELECT request_id, max(CASE WHEN r.street = p.street THEN 100 ELSE {ratio_sql("r.street", "p.street")} END) AS score FROM r JOIN (SELECT DISTINCT house, street FROM parcels) p USING (house) GROUP BY 1)
SELECT request_id, coalesce(g.score, f.score, 0) AS score, coalesce(g.match, CASE WHEN f.score IS NOT NULL THEN 'parcel' END) AS match
FROM r LEFT JOIN (SELECT request_id, max(score) AS score, arg_max(match, score) AS match FROM e GROUP BY 1) g USING (request_id) LEFT JOIN (SELECT * FROM f WHERE score >= 80) f USING (request_id)"""
)
def known_addresses(spark: SparkSession, d: str) -> DataFrame:
    """TXT-12: misspelt street pairs, else house numbers of streets that may be the next one's."""
    r = spark.sql("SELECT c_custkey AS request_id, 'STREAT' || (c_custkey % 40) AS street_a, 'STREET' || (c_custkey * 7 % 40) AS street_b" + _EXISTS + " FROM {customer}", customer=spark.read.parquet(f"{d}/customer.parquet"))
    p = load(spark, d, "parcels")
    for kind in ("lat", "lng"):
        p = p.withColumns({f"front_{kind}": F.lit(None).cast("double"), f"entrance_{kind}": F.lit(None).cast("double")})
    return jl.address_exists(r, _intersections(spark, d), p)


_FRONT = "CASE WHEN parcel_id % 2 = 0 THEN {k} + 0.0001 ELSE {k} END"
ORACLE["geocode_cascade"] = (
    with_sql("parcels", "segments") + _REQ
    + f""", l AS (SELECT parcel_id, house::INT AS pn, street, street_type, unit, lat, lng, {_FRONT.format(k="lat")} AS la, {_FRONT.format(k="lng")} AS lo FROM parcels),
e AS (SELECT request_id, parcel_id, la, lo, 100 AS score FROM r JOIN l ON n = pn AND r.street = l.street),
q AS (SELECT * FROM r WHERE request_id NOT IN (SELECT request_id FROM e)), z AS (SELECT a, b, {ratio_sql("a", "b")} AS score FROM (SELECT DISTINCT q.street AS a, l.street AS b FROM q JOIN l ON n = pn)),
x AS (SELECT request_id, min((-score, parcel_id, la, lo)) AS b FROM (FROM e UNION ALL SELECT request_id, parcel_id, la, lo, score FROM q JOIN l ON n = pn JOIN z ON a = q.street AND b = l.street WHERE score >= 80) GROUP BY 1),
h AS (SELECT request_id, 0 AS side, road_id, n, left_begin AS a, left_end AS b, x1, y1, x2, y2 FROM r JOIN segments s ON s.canon = r.street WHERE n BETWEEN left_begin AND left_end
 UNION ALL SELECT request_id, 1, road_id, n, right_begin, right_end, x1, y1, x2, y2 FROM r JOIN segments s ON s.canon = r.street WHERE n BETWEEN right_end AND right_begin),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY side, road_id) AS k, (n - a)::DOUBLE / (b - a) AS t FROM h),
j AS (SELECT request_id, min((abs(n - pn), pn, parcel_id, lat, lng)) AS b FROM r JOIN l ON r.street = l.street AND r.street_type = l.street_type WHERE unit IS NULL GROUP BY 1),
m AS (SELECT street, street_type, avg(lat) AS lat, avg(lng) AS lng FROM parcels GROUP BY 1, 2),
y AS (SELECT request_id, 0 AS step, b[3] AS lat, b[4] AS lng, -b[1] AS confidence, NULL AS note FROM x UNION ALL SELECT request_id, 2, y1 + t * (y2 - y1), x1 + t * (x2 - x1), 70, NULL FROM o WHERE k = 1
 UNION ALL SELECT request_id, 4, b[4], b[5], CASE WHEN b[1] <= 20 THEN 70 WHEN b[1] <= 100 THEN 60 ELSE 55 END, 'nearest civic number ' || b[2] FROM j
 UNION ALL SELECT request_id, 5, lat, lng, 50, NULL FROM r JOIN m USING (street, street_type))
SELECT request_id, min(step) AS step, arg_min(lat, step) AS lat, arg_min(lng, step) AS lng, arg_min(confidence, step) AS confidence, arg_min({{'x': note}}, step).x AS note FROM y GROUP BY 1"""
)


# chains of points along each crossing, some links just over 25 m
_CHAIN = "SELECT canon_a, canon_b, x + (step * 0.00033D + step * step * 0.000004D) AS x, y + 0.00001D * step AS y FROM {crossings} LATERAL VIEW explode(sequence(0, cast(abs(x * 1000000) as bigint) % 7)) AS step"
_CHAIN_SQL = "SELECT DISTINCT canon_a, canon_b, x + (step * 0.00033::DOUBLE + step * step * 0.000004::DOUBLE) AS x, y + 0.00001::DOUBLE * step AS y FROM (SELECT *, unnest(range(0, round(abs(x * 1000000))::BIGINT % 7 + 1)) AS step FROM n)"
_LINKED = """, d AS (SELECT *, cos(radians(avg(y) OVER (PARTITION BY canon_a, canon_b))) AS k FROM g),
e AS (SELECT a.canon_a, a.canon_b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM d a JOIN d b ON a.canon_a = b.canon_a AND a.canon_b = b.canon_b AND sqrt(((a.x - b.x) * a.k) ** 2 + (a.y - b.y) ** 2) * 6371000.0 * pi() / 180 <= 25),
w AS (SELECT canon_a, canon_b, ax, ay, bx, by_ FROM e UNION SELECT w.canon_a, w.canon_b, w.ax, w.ay, e.bx, e.by_ FROM w JOIN e ON e.canon_a = w.canon_a AND e.canon_b = w.canon_b AND e.ax = w.bx AND e.ay = w.by_),
h AS (SELECT canon_a, canon_b, ax, ay, min((bx, by_)) AS head FROM w GROUP BY 1, 2, 3, 4), j AS (SELECT canon_a, canon_b, avg(ax) AS x, avg(ay) AS y, count(*) AS nodes FROM h GROUP BY canon_a, canon_b, head)
SELECT canon_a, canon_b, round(x, 8) AS x, round(y, 8) AS y, nodes, row_number() OVER (PARTITION BY canon_a, canon_b ORDER BY x, y) - 1 AS candidate_index FROM j"""
_RECURSIVE = (with_sql("segments") + _XING).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["junction_clusters"] = _RECURSIVE + ", g AS (SELECT * FROM n)" + _LINKED


@query(_RECURSIVE + f", g AS ({_CHAIN_SQL})" + _LINKED)
def junction_chains(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-10 and WIN-01 on chains of points, linked step by step."""
    n = spatial.line_crossings(load(spark, d, "segments"))
    return _rounded(spatial.number_candidates(streets.junctions(spark.sql(_CHAIN.replace("cast(abs(x * 1000000) as bigint)", "cast(round(abs(x * 1000000)) as bigint)"), crossings=n))))


@query(ORACLE["parcel_upsert"])
def parcel_table(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01 as a table that changes in place: one load, then four changes, each of which writes the buckets that it touches."""
    p = load(spark, d, "parcels")
    new = p.select("parcel_id", "gis_id", F.concat("street", F.lit(" NEW")).alias("street"), F.when(F.col("parcel_id") % 4 != 0, F.col("value") + 1).alias("value"), F.lit(None).cast("string").alias("hazard"))
    t = tables.BucketedTable(spark, fresh(spark, "parcels"), "gis_id", buckets=16)
    merge = lambda old, rows: rows if old is None else upsert.upsert(old, rows, "gis_id", ["street", "value"], ["hazard"])
    t.merge(p.where("parcel_id % 3 <> 0").select("gis_id", "street", "value", F.concat(F.lit("note "), F.col("parcel_id").cast("string")).alias("hazard")), merge, "load")
    for part in (0, 2, 4, 6):
        t.merge(new.where(f"parcel_id % 8 = {part}").drop("parcel_id"), merge, f"part {part}")
    return t.read()


_TILED = "SELECT z, cast(floor((lng + 180) * 100 * z) as bigint) AS x, cast(floor(lat * 100 * z) as bigint) AS y, parcel_id FROM {p} {zooms}"
_TILED_SQL = "SELECT z, floor((lng + 180) * 100 * z)::BIGINT AS x, floor(lat * 100 * z)::BIGINT AS y, parcel_id FROM parcels, (SELECT unnest(range(1, 6)) AS z)"


@query(
    with_sql("parcels")
    + f""", t AS ({_TILED_SQL}), r AS (SELECT DISTINCT z, x, y FROM t WHERE parcel_id % 4 <> 0), p AS (SELECT DISTINCT z, x, y FROM t WHERE parcel_id % 3 = 0)
SELECT z, count(r.x) AS required, count(p.x) AS present, count(*) FILTER (p.x IS NULL) AS missing FROM r FULL JOIN p USING (z, x, y) GROUP BY z"""
)
def tile_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17: tiles per zoom, there and missing, on grids of five sizes over the parcels."""
    t = spark.sql(_TILED.replace("{zooms}", "LATERAL VIEW explode(sequence(1L, 5L)) AS z"), p=load(spark, d, "parcels"))
    return reports.tiles_per_zoom(t.where("parcel_id % 4 <> 0"), t.where("parcel_id % 3 = 0"))

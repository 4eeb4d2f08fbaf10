"""Registered queries of the dispatch library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sirenflow.functions import fuzzy, geo, text
from sirenflow.operators import dispatch, geocode, spatial, upsert
from sirenflow.plans.fixtures import HALLS, NOW, load, with_sql, zone_shapes
from sirenflow.streaming import changes as ch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


_ZONE_OF = """(SELECT map_name FROM zones z WHERE p.lng BETWEEN x0 - 1e-9 AND x0 + 0.044 + 1e-9 AND p.lat BETWEEN y0 - 1e-9 AND y0 + 0.038 + 1e-9
  AND NOT (k IN (7, 17) AND p.lng > x0 + 0.022 + 1e-9 AND p.lat > y0 + 0.019 + 1e-9) ORDER BY map_name::INT LIMIT 1)"""


@query(with_sql("zones", "parcels") + f" SELECT parcel_id, {_ZONE_OF} AS zone_id FROM parcels p")
def zone_for_point(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-01 over all parcels."""
    return spatial.with_zone(load(spark, d, "parcels"), zone_shapes(load(spark, d, "zones"))).select("parcel_id", "zone_id")


@query(
    with_sql("dispatches", "hydrants")
    + f""", t AS (SELECT dispatch_id, lat, lng FROM dispatches), n AS (
  SELECT dispatch_id, object_id, flow_class, {_HAV.format(a="t.lat", b="h.lat", c="t.lng", d="h.lng")} AS m FROM t JOIN hydrants h
  ON abs(t.lat - h.lat) < 0.0075 AND abs(t.lng - h.lng) < 0.0115 WHERE upper(coalesce(status, '')) NOT IN ('ABANDONED', 'OUT_OF_SERVICE', 'INACTIVE')
), c AS (SELECT dispatch_id, arg_min(object_id, (m, object_id)) AS city_id, min(m) AS city_m FROM n WHERE flow_class IS NOT NULL AND m <= 800 GROUP BY 1),
p AS (SELECT dispatch_id, arg_min(object_id, (m, object_id)) AS private_id, min(m) AS private_m FROM n WHERE flow_class IS NULL AND m <= 400 GROUP BY 1)
SELECT dispatch_id, city_id, round(city_m)::BIGINT AS city_m, private_id, round(private_m)::BIGINT AS private_m FROM t LEFT JOIN c USING (dispatch_id) LEFT JOIN p USING (dispatch_id)"""
)
def nearest_hydrants(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-12 over all dispatches."""
    got = spatial.nearest_hydrants(load(spark, d, "dispatches"), load(spark, d, "hydrants"))
    return got.select("dispatch_id", "city_id", F.round("city_m").cast("long").alias("city_m"), "private_id", F.round("private_m").cast("long").alias("private_m"))


@query(with_sql("hydrants") + " SELECT status, count(*) AS total, count(flow_class) AS rated, count(*) - count(flow_class) AS unrated, count(*) FILTER (flow_class NOT IN ('AA','A','B','C')) AS bad FROM hydrants GROUP BY status")
def hydrant_stats(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.hydrant_stats(load(spark, d, "hydrants"))


@query(with_sql("dispatches") + " SELECT count(*) AS total, count(*) FILTER (coalesce(feedback_submitted, false)) AS reviewed, count(*) FILTER (NOT coalesce(feedback_submitted, false)) AS unreviewed, coalesce(round(avg(confidence_score), 1), 0.0) AS mean_confidence FROM dispatches")
def dispatch_stats(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.stats(load(spark, d, "dispatches"))


@query(with_sql("dispatches") + " SELECT dispatch_id FROM dispatches WHERE NOT coalesce(feedback_submitted, false) AND coalesce(confidence_score, 100) < 80 AND (u1 LIKE '%Q%' OR upper(u2) LIKE '%Q%')")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04 and FLT-05."""
    rows = load(spark, d, "dispatches").withColumn("units", F.array("u1", "u2"))
    return dispatch.review_list(dispatch.unreviewed(rows), low_only=True, unit="q").select("dispatch_id")


@query(with_sql("dispatches") + " SELECT id, dispatch_id, ts FROM dispatches ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100")
def newest_page(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06: the limit is the page."""
    return dispatch.page(load(spark, d, "dispatches").select("id", "dispatch_id", "ts"), 50, 100)


@query(with_sql("dispatches", "parcels") + " SELECT street, coalesce(a.n, 0) AS dispatched, coalesce(b.n, 0) AS parcels FROM (SELECT street, count(*) AS n FROM dispatches GROUP BY 1) a FULL JOIN (SELECT street, count(*) AS n FROM parcels GROUP BY 1) b USING (street)")
def street_frequency(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.street_frequency(load(spark, d, "dispatches"), load(spark, d, "parcels"))


@query(with_sql("dispatches") + " SELECT 'call_type' AS category, min(trim(incident_type)) AS term, 999 AS sort_order, 'learned' AS source FROM dispatches WHERE lower(trim(incident_type)) <> 'structure fire' GROUP BY lower(trim(incident_type))")
def new_incident_types(spark: SparkSession, d: str) -> DataFrame:
    vocab = spark.sql("select 'call_type' as category, 'Structure Fire' as term")
    return dispatch.new_incident_types(load(spark, d, "dispatches"), vocab)


_UNITS = ", u AS (SELECT dispatch_id, lat, lng, upper(u1) AS unit FROM dispatches UNION SELECT dispatch_id, lat, lng, upper(u2) FROM dispatches)"
_TYPE = """CASE WHEN unit LIKE 'SQ%' THEN 'Squad' WHEN unit LIKE 'LAV%' THEN 'Light Attack Vehicle' WHEN unit LIKE 'L%' THEN 'Ladder' WHEN unit LIKE 'WT%' THEN 'Water Tender'
 WHEN unit LIKE 'E%' THEN 'Engine' WHEN unit LIKE 'Q%' THEN 'Quint' WHEN unit LIKE 'C%' THEN 'Chief' END"""
_CLASS = "CASE WHEN unit LIKE 'SQ%' OR unit LIKE 'LAV%' OR unit LIKE 'C%' THEN 'light' WHEN unit LIKE 'L%' OR unit LIKE 'WT%' THEN 'heavy' ELSE 'general' END"
_HALL = "CASE WHEN unit = 'CHIEF' THEN '1' WHEN unit = 'Q5' THEN '3' ELSE regexp_extract(unit, '[0-9]+') END"
_HALLS = ", halls(hall_id, hlat, hlng) AS (VALUES " + ", ".join(f"('{h}', {a}::DOUBLE, {o}::DOUBLE)" for h, a, o in HALLS) + ")"


@query(
    with_sql("dispatches") + _UNITS + _HALLS
    + f""", w AS (SELECT *, {_TYPE} AS unit_type, {_CLASS} AS unit_class, {_HALL} AS hall_id FROM u)
SELECT dispatch_id, unit, unit_type, unit_class, w.hall_id, round({_HAV.format(a="w.lat", b="hlat", c="w.lng", d="hlng")})::BIGINT AS distance_m, NULL::INT AS eta_min, 'degraded_no_router' AS source
FROM w LEFT JOIN halls USING (hall_id)"""
)
def unit_responses(spark: SparkSession, d: str) -> DataFrame:
    """JN-19 with CLN-20, no router."""
    rows = load(spark, d, "dispatches").withColumn("units", F.array("u1", "u2"))
    halls = spark.createDataFrame(HALLS, "hall_id string, lat double, lng double")
    return dispatch.unit_responses(rows, halls).drop("crow_m").withColumn("distance_m", F.round("distance_m").cast("long"))


@query(
    with_sql("dispatches")
    + """, s AS (SELECT dispatch_id, greatest(0.0, confidence_score - CASE WHEN lat IS NULL THEN 30 ELSE 0 END - CASE WHEN coalesce(trim(map_grid), '') = '' THEN 15 ELSE 0 END
  - CASE WHEN radio_channel = 'none' THEN 15 ELSE 0 END) AS score FROM dispatches) SELECT dispatch_id, round(score, 4) AS score, score < 90 AS verify FROM s"""
)
def confidence(spark: SparkSession, d: str) -> DataFrame:
    """FN-06 over all dispatches."""
    c = text.confidence(F.col("confidence_score"), F.col("lat"), F.col("lng"), F.array("u1", "u2"), F.col("map_grid"), F.col("radio_channel"), F.lit(False))
    return load(spark, d, "dispatches").select("dispatch_id", c.alias("c")).select("dispatch_id", F.round("c.score", 4).alias("score"), "c.verify")


_RAW = """, raw AS (SELECT parcel_id, CASE parcel_id % 6 WHEN 0 THEN house || ' ' || lower(street) || ' Avenue, Coquitlam, BC' WHEN 1 THEN house || ' block of ' || street || ' Street' WHEN 2 THEN 'Unit 7 ' || house || ' ' || street || ' Rd.'
 WHEN 3 THEN street || ' AND Main Road, Port Moody' WHEN 4 THEN house || ' ' || street || ' Crescent near Main St use map' ELSE 'n/a' END AS a FROM parcels)"""


@query(
    with_sql("parcels") + _RAW
    + r""", n AS (SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(upper(a), '[,.]', '', 'g'), '\b(BLOCK|BLK|OF)\b', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM raw)
SELECT parcel_id, CASE WHEN len(w) > 1 THEN array_to_string(w[1:-2], ' ') || ' ' || coalesce(map {'AVENUE':'AVE','STREET':'ST','ROAD':'RD','CRESCENT':'CRES','RD':'RD'}[w[-1]], w[-1]) ELSE array_to_string(w, ' ') END AS normal,
 trim(regexp_replace(regexp_replace(a, ',\s*(BC|British Columbia)\b.*', '', 'i'), ',\s*(Coquitlam|Port Moody)\b.*', '', 'i')) AS bare,
 nullif(trim(regexp_extract(a, '\bnear\s+(.+?)(\s+use\b|\s+map\b|\s*$)', 1, 'i')), '') AS near, lower(replace(replace(a, ',', ''), '.', '')) AS training,
 CASE WHEN parcel_id % 6 = 3 THEN street_of END AS street_a
FROM n JOIN (SELECT parcel_id, street AS street_of FROM parcels) USING (parcel_id)"""
)
def clean_addresses(spark: SparkSession, d: str) -> DataFrame:
    """CLN-03, CLN-06, CLN-08, CLN-10, CLN-16 over address texts."""
    p, k = load(spark, d, "parcels"), F.col("parcel_id") % 6
    h, s = F.col("house"), F.col("street")
    a = (
        F.when(k == 0, F.concat(h, F.lit(" "), F.lower(s), F.lit(" Avenue, Coquitlam, BC"))).when(k == 1, F.concat(h, F.lit(" block of "), s, F.lit(" Street")))
        .when(k == 2, F.concat(F.lit("Unit 7 "), h, F.lit(" "), s, F.lit(" Rd."))).when(k == 3, F.concat(s, F.lit(" AND Main Road, Port Moody")))
        .when(k == 4, F.concat(h, F.lit(" "), s, F.lit(" Crescent near Main St use map"))).otherwise("n/a")
    )
    r = p.select("parcel_id", a.alias("a"))
    parts = F.when(F.col("a").contains(" AND "), text.intersection_parts(F.col("a"))[0])
    return r.select("parcel_id", text.street_name(F.col("a")).alias("normal"), text.without_region(F.col("a")).alias("bare"), text.near_clause(F.col("a")).alias("near"), text.training_text(F.col("a")).alias("training"), parts.alias("street_a"))


@query(
    with_sql("closures")
    + f""" SELECT closure_id, CASE WHEN TIMESTAMP '{NOW}' < start_time THEN 'future' WHEN TIMESTAMP '{NOW}' > end_time THEN 'expired' ELSE 'active' END AS state,
 TIMESTAMP '{NOW}' < start_time AND start_time <= TIMESTAMP '{NOW}' + INTERVAL 24 HOUR AS in_24h, TIMESTAMP '{NOW}' < start_time AND start_time <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY AS in_7d FROM closures"""
)
def closure_state(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07."""
    return dispatch.closure_state(load(spark, d, "closures"), F.lit(NOW).cast("timestamp_ntz")).select("closure_id", "state", "in_24h", "in_7d")


@query(
    with_sql("closures")
    + f""", e AS (SELECT closure_id, start_time, end_time, true AS active, start_time AS updated_at FROM closures WHERE event_id % 3 <> 0), n AS (SELECT closure_id, start_time, end_time + INTERVAL 1 HOUR AS end_time FROM closures WHERE event_id % 2 = 0),
k AS (SELECT *, end_time < TIMESTAMP '{NOW}' OR start_time <= TIMESTAMP '{NOW}' AS stop FROM e WHERE closure_id NOT IN (SELECT closure_id FROM n))
SELECT closure_id, start_time, end_time, NOT end_time < TIMESTAMP '{NOW}' AS active, TIMESTAMP '{NOW}' AS updated_at FROM n
UNION ALL SELECT closure_id, start_time, end_time, NOT stop, CASE WHEN stop THEN TIMESTAMP '{NOW}' ELSE updated_at END FROM k"""
)
def sync_closures(spark: SparkSession, d: str) -> DataFrame:
    """STR-04."""
    c = load(spark, d, "closures")
    old = c.where("event_id % 3 <> 0").select("closure_id", "start_time", "end_time", F.lit(True).alias("active"), F.col("start_time").alias("updated_at"))
    new = c.where("event_id % 2 = 0").select("closure_id", "start_time", (F.col("end_time") + F.expr("interval 1 hour")).alias("end_time"))
    return dispatch.sync_closures(old, new, F.lit(NOW).cast("timestamp_ntz"))


@query(
    with_sql("parcels")
    + """, o AS (SELECT gis_id, street, value, concat('note ', parcel_id) AS hazard FROM parcels WHERE parcel_id % 3 <> 0), n AS (SELECT gis_id, concat(street, ' NEW') AS street, CASE WHEN parcel_id % 4 = 0 THEN NULL ELSE value + 1 END AS value FROM parcels WHERE parcel_id % 2 = 0)
SELECT coalesce(o.gis_id, n.gis_id) AS gis_id, CASE WHEN n.gis_id IS NULL THEN o.street ELSE n.street END AS street, CASE WHEN n.gis_id IS NULL THEN o.value ELSE n.value END AS value, hazard FROM o FULL JOIN n ON o.gis_id = n.gis_id"""
)
def parcel_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01 and SNK-02: refreshed and kept columns."""
    p = load(spark, d, "parcels")
    old = p.where("parcel_id % 3 <> 0").select("gis_id", "street", "value", F.concat(F.lit("note "), F.col("parcel_id").cast("string")).alias("hazard"))
    new = p.where("parcel_id % 2 = 0").select("gis_id", F.concat("street", F.lit(" NEW")).alias("street"), F.when(F.col("parcel_id") % 4 != 0, F.col("value") + 1).alias("value"))
    return upsert.upsert(old, new, "gis_id", ["street", "value"], ["hazard"])


@query(
    with_sql("hydrants")
    + """, o AS (SELECT * FROM hydrants WHERE object_id % 5 <> 0), n AS (SELECT object_id, CASE WHEN object_id % 4 = 0 THEN NULL ELSE status END AS status, CASE WHEN object_id % 6 = 0 THEN 'AA' ELSE flow_class END AS flow_class FROM hydrants WHERE object_id % 7 <> 0),
j AS (SELECT coalesce(o.object_id, n.object_id) AS object_id, o.object_id IS NULL AS added, n.object_id IS NULL AS deleted, concat_ws(',', CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END, CASE WHEN o.flow_class IS DISTINCT FROM n.flow_class THEN 'flow_class' END) AS f FROM o FULL JOIN n ON o.object_id = n.object_id)
SELECT object_id, CASE WHEN added THEN 'added' WHEN deleted THEN 'deleted' ELSE 'modified' END AS change, CASE WHEN added OR deleted THEN '' ELSE f END AS fields FROM j WHERE added OR deleted OR f <> ''"""
)
def hydrant_diff(spark: SparkSession, d: str) -> DataFrame:
    """JN-18."""
    h = load(spark, d, "hydrants")
    old = h.where("object_id % 5 <> 0")
    new = h.where("object_id % 7 <> 0").withColumns({"status": F.when(F.col("object_id") % 4 != 0, F.col("status")), "flow_class": F.when(F.col("object_id") % 6 == 0, "AA").otherwise(F.col("flow_class"))})
    return upsert.snapshot_diff(old, new, "object_id", ["status", "flow_class"])


@query(
    with_sql("readings")
    + """, l AS (SELECT device, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts)) > 3000000 THEN 1 WHEN lag(ts) OVER (PARTITION BY device ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM readings WHERE value >= 30),
r AS (SELECT device, ts, sum(new) OVER (PARTITION BY device ORDER BY ts) AS run FROM l), p AS (SELECT *, floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY device, run))) / 75000000) AS part FROM r)
SELECT device, min(ts) AS start, max(ts) AS "end", count(*) AS readings FROM p GROUP BY device, run, part"""
)
def capture_sessions(spark: SparkSession, d: str) -> DataFrame:
    """STR-03 over all readings."""
    return ch.sessions(load(spark, d, "readings").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("value", "rms")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


_XING = """, p AS (SELECT a.canon AS ca, b.canon AS cb, a.x1, a.y1, a.x2 - a.x1 AS ax, a.y2 - a.y1 AS ay, b.x2 - b.x1 AS bx, b.y2 - b.y1 AS by_, b.x1 - a.x1 AS ox, b.y1 - a.y1 AS oy FROM segments a JOIN segments b ON a.canon < b.canon),
q AS (SELECT *, (ox * by_ - oy * bx) / (ax * by_ - ay * bx) AS t, (ox * ay - oy * ax) / (ax * by_ - ay * bx) AS u FROM p WHERE abs(ax * by_ - ay * bx) > 1e-18),
n AS (SELECT DISTINCT ca AS canon_a, cb AS canon_b, round(x1 + t * ax, 6) AS x, round(y1 + t * ay, 6) AS y FROM q WHERE t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9)"""


@query(with_sql("segments") + _XING + " SELECT canon_a, canon_b, x, y, row_number() OVER (PARTITION BY canon_a, canon_b ORDER BY x, y) - 1 AS candidate_index FROM n")
def street_crossings(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-09 and WIN-01."""
    return spatial.number_candidates(spatial.line_crossings(load(spark, d, "segments")))


def _requests(p: DataFrame) -> DataFrame:
    return p.select(F.col("parcel_id").alias("request_id"), ((F.col("house").cast("int") + F.when(F.col("parcel_id") % 3 == 0, 1).otherwise(0)).cast("string")).alias("house"), "street", "street_type")


_REQ = ", r AS (SELECT parcel_id AS request_id, house::INT + CASE WHEN parcel_id % 3 = 0 THEN 1 ELSE 0 END AS n, street, street_type FROM parcels)"


@query(
    with_sql("parcels") + _REQ
    + """, j AS (SELECT request_id, abs(n - house::INT) AS gap, house::INT AS pn, parcel_id, lat, lng FROM r JOIN parcels p ON r.street = p.street AND r.street_type = p.street_type WHERE unit IS NULL),
b AS (SELECT request_id, min((gap, pn, parcel_id)) AS k FROM j GROUP BY 1)
SELECT b.request_id, 4 AS step, lat, lng, CASE WHEN gap <= 20 THEN 70 WHEN gap <= 100 THEN 60 ELSE 55 END AS confidence, 'nearest civic number ' || pn AS note FROM b JOIN j ON b.request_id = j.request_id AND b.k = (j.gap, j.pn, j.parcel_id)"""
)
def nearest_civic(spark: SparkSession, d: str) -> DataFrame:
    """JN-04."""
    p = load(spark, d, "parcels")
    return geocode.nearest_civic(_requests(p), p)


@query(
    with_sql("parcels", "segments") + _REQ
    + """, h AS (SELECT request_id, 0 AS side, road_id, n, left_begin AS a, left_end AS b, x1, y1, x2, y2 FROM r JOIN segments s ON s.canon = r.street WHERE n BETWEEN left_begin AND left_end
 UNION ALL SELECT request_id, 1, road_id, n, right_begin, right_end, x1, y1, x2, y2 FROM r JOIN segments s ON s.canon = r.street WHERE n BETWEEN right_end AND right_begin),
f AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY side, road_id) AS k, (n - a)::DOUBLE / (b - a) AS t FROM h)
SELECT request_id, 2 AS step, y1 + t * (y2 - y1) AS lat, x1 + t * (x2 - x1) AS lng, 70 AS confidence, NULL::VARCHAR AS note FROM f WHERE k = 1"""
)
def block_range(spark: SparkSession, d: str) -> DataFrame:
    """JN-02 and LIN-02."""
    roads = load(spark, d, "segments").withColumns({"fullname": F.concat("canon", F.lit(" LANE")), "roadname": F.col("canon")})
    return geocode.block_range(_requests(load(spark, d, "parcels")), roads)


@query()
def geocode_cascade(spark: SparkSession, d: str) -> DataFrame:
    """WIN-03 over JN-01, JN-02, JN-04, AGG-05, AGG-06; the fuzzy step has no SQL form."""
    p = load(spark, d, "parcels")
    for kind in ("lat", "lng"):
        p = p.withColumn(f"front_{kind}", F.when(F.col("parcel_id") % 2 == 0, F.col(kind) + 0.0001)).withColumn(f"entrance_{kind}", F.lit(None).cast("double"))
    roads = load(spark, d, "segments").withColumns({"fullname": F.concat("canon", F.lit(" LANE")), "roadname": F.col("canon")})
    r = _requests(p)
    return geocode.cascade(r, geocode.exact_parcel(r, p), geocode.block_range(r, roads), geocode.nearest_civic(r, p), geocode.street_centroid(r, p), geocode.road_centroid(r, roads))


@query(
    with_sql("parcels")
    + """, q AS (SELECT 14 AS z, * FROM parcels), t AS (SELECT z, trunc((lng + 180.0) / 360.0 * 16384)::BIGINT AS x, trunc((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 16384)::BIGINT AS y FROM q)
SELECT z, x, y, 16383 - y AS tms_y, count(*) AS n FROM t GROUP BY ALL"""
)
def tiles(spark: SparkSession, d: str) -> DataFrame:
    """FN-02 and AGG-17: parcels per tile."""
    t = load(spark, d, "parcels").select(F.lit(14).alias("z"), geo.tile_of(F.col("lat"), F.col("lng"), F.lit(14)).alias("t"))
    return t.select("z", "t.x", "t.y", geo.tms_row(F.col("t.y"), F.lit(14)).alias("tms_y")).groupBy("z", "x", "y", "tms_y").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT conv_id, turn, role, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS hyp, lag(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
c AS (SELECT role, CASE WHEN length(ref) = 0 THEN CASE WHEN length(hyp) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(ref, hyp)::DOUBLE / length(ref) END AS cer FROM p WHERE ref IS NOT NULL)
SELECT role, count(*) AS n, round(avg(cer), 6) AS mean_cer, count(*) FILTER (cer = 0) AS perfect, count(*) FILTER (cer > 0 AND cer < 0.2) AS operational, count(*) FILTER (cer >= 0.2) AS failed FROM c GROUP BY role"""
)
def transcript_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08 and AGG-09: character error rate of each turn against the one before, and its rating."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    plain = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")  # CLN-17 without suffix rules
    p = c.select("role", plain.alias("hyp"), F.lag(plain).over(Window.partitionBy("conv_id").orderBy("turn")).alias("ref")).where("ref is not null")
    p = p.withColumn("cer", fuzzy.char_error_rate(F.col("ref"), F.col("hyp")))
    return p.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.count_if(F.col("cer") == 0).alias("perfect"), F.count_if((F.col("cer") > 0) & (F.col("cer") < 0.2)).alias("operational"), F.count_if(F.col("cer") >= 0.2).alias("failed"))

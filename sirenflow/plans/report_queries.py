"""Registered queries of the reports, added to those of the dispatch library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.operators import reports
from sirenflow.plans.fixtures import load, with_sql
from sirenflow.plans.reference_queries import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

# the same expressions bind the tables in Spark and in SQL
_PARCELS = (
    "parcel_id", "street", "unit", "lat", "CASE WHEN parcel_id % 9 <> 0 THEN lng END AS geom", "CASE WHEN parcel_id % 13 <> 0 THEN concat('', parcel_id % 25 + 1) END AS zone_id",
    "parcel_id % 90 AS units", "CASE parcel_id % 3 WHEN 0 THEN lat WHEN 1 THEN lat + 1 END AS front_lat",
)
_REVIEWED = (
    "dispatch_id", "feedback_submitted", "concat(id % 700, ' ', street, CASE id % 2 WHEN 0 THEN ' AVE' ELSE ' ST' END, CASE id % 3 WHEN 0 THEN ', Coquitlam' ELSE '' END) AS verified_address",
    "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(id % 700, ' ', street, ' AVE') ELSE concat(street, ' ST') END AS address",
)
_PAIRS = (
    "id", "dispatch_id", "CASE id % 5 WHEN 0 THEN concat(street, ' Avenue and Main Road') WHEN 1 THEN NULL ELSE concat(id % 900, ' ', street, ' Street') END AS ref_address",
    "CASE id % 7 WHEN 0 THEN concat('main rd & ', street, ' ave') WHEN 1 THEN '' WHEN 2 THEN concat(id % 900, ' ', street, ' st, unit 4') ELSE concat(id % 900, ' ', street, ' Street') END AS hyp_address",
    "u1", "u2", "incident_type AS ref_incident", "CASE WHEN id % 3 = 0 THEN lower(incident_type) ELSE 'Medical Aid' END AS hyp_incident",
    "map_grid AS ref_grid", "CASE WHEN id % 4 <> 0 THEN map_grid ELSE '7' END AS hyp_grid", "radio_channel AS ref_channel", "CASE WHEN id % 6 <> 0 THEN radio_channel END AS hyp_channel",
    "CASE WHEN id % 8 = 0 THEN 'contact dispatch for location information' ELSE 'fire' END AS ref_text", "CASE WHEN id % 16 = 0 THEN 'Contact Dispatch' ELSE 'fire' END AS hyp_text",
)


def _bound(spark: SparkSession, d: str, table: str, columns: tuple[str, ...]) -> DataFrame:
    return load(spark, d, table).selectExpr(*columns)


def _sql(table: str, columns: tuple[str, ...]) -> str:
    return with_sql(table) + f", t AS (SELECT {', '.join(columns)} FROM {table})"


def _comparable_sql(c: str) -> str:
    s = f"lower({c})"
    for long, short in reports.COMPARED:
        s = rf"regexp_replace({s}, '\b{long}\b', '{short}', 'g')"
    return rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}]', '', 'g')"


@query(_sql("parcels", _PARCELS) + " SELECT count(*) AS total, count(geom) AS with_geometry, count(DISTINCT zone_id) AS zones, count(*) FILTER (units > 50) AS high_rises, count(*) FILTER (unit <> '') AS multi_unit, count(*) FILTER (front_lat <> lat) AS front_aligned FROM t")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04."""
    return reports.import_summary(_bound(spark, d, "parcels", _PARCELS))


@query(_sql("parcels", _PARCELS) + " SELECT DISTINCT zone_id, upper(street) AS street FROM t WHERE zone_id IS NOT NULL AND street <> ''")
def streets_in_grid(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07 for every zone."""
    return reports.streets_in_grid(_bound(spark, d, "parcels", _PARCELS))


@query(_sql("parcels", _PARCELS) + " SELECT street, count(*) AS cnt FROM t WHERE street <> '' GROUP BY street ORDER BY cnt DESC, street LIMIT 100")
def top_streets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: the limit is the report."""
    return reports.top_streets(_bound(spark, d, "parcels", _PARCELS))


_STREET = r"array_to_string(list_transform(string_split(lower(trim(CASE WHEN regexp_matches(trim(split_part({c}, ',', 1)), '^\d+\s+') THEN regexp_replace(trim(split_part({c}, ',', 1)), '^\d+\s+', '') ELSE {c} END)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(_sql("dispatches", _REVIEWED) + f", s AS (SELECT {_STREET.format(c='verified_address')} AS street, {_STREET.format(c='address')} AS own FROM t WHERE feedback_submitted) SELECT street, count(*) AS n FROM s WHERE street <> '' AND own <> '' AND street <> own GROUP BY street")
def corrected_streets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14."""
    return reports.corrected_streets(_bound(spark, d, "dispatches", _REVIEWED))


_BOTH = "((ref_text LIKE '%contact dispatch%') AND (lower(hyp_text) LIKE '%contact dispatch%'))"


@query(
    _sql("dispatches", _PAIRS)
    + f""", m AS (SELECT ({_BOTH} OR lower(trim(coalesce(ref_address, ''))) = lower(trim(coalesce(hyp_address, ''))))::INT AS address, (list_sort([u1, u2]) = list_sort(CASE WHEN id % 2 = 0 THEN [u2, u1] ELSE [u1] END))::INT AS units,
 (lower(trim(coalesce(ref_incident, ''))) = lower(trim(coalesce(hyp_incident, ''))))::INT AS incident, ({_BOTH} OR trim(coalesce(ref_grid, '')) = trim(coalesce(hyp_grid, '')))::INT AS grid,
 ({_BOTH} OR trim(coalesce(ref_channel, '')) = trim(coalesce(hyp_channel, '')))::INT AS channel FROM t), r AS (SELECT avg(address) AS address, avg(units) AS units, avg(incident) AS incident, avg(grid) AS grid, avg(channel) AS channel FROM m)
SELECT *, round((address + units + incident + grid + channel) / 5, 9) AS overall FROM r"""
)
def match_rates(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10."""
    t = _bound(spark, d, "dispatches", _PAIRS).withColumns({"ref_units": F.array("u1", "u2"), "hyp_units": F.expr("CASE WHEN id % 2 = 0 THEN array(u2, u1) ELSE array(u1) END")})
    return reports.match_rates(t).withColumn("overall", F.round("overall", 9))


_PARTS = r"list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower({c}), '\s+and\s+|\s*&\s*'), lambda p: trim(p) <> ''), lambda p: " + _comparable_sql("p").replace("{", "{{").replace("}", "}}") + ")))"


@query(
    _sql("dispatches", _PAIRS)
    + f""", c AS (SELECT *, {_comparable_sql("coalesce(ref_address, '')")} AS ca, {_comparable_sql("coalesce(hyp_address, '')")} AS cb FROM t)
SELECT dispatch_id, coalesce(ca <> '' AND cb <> '' AND (contains(ca, cb) OR contains(cb, ca) OR (regexp_matches(lower(ref_address), 'and|&') OR regexp_matches(lower(hyp_address), 'and|&')) AND {_PARTS.format(c="ref_address")} = {_PARTS.format(c="hyp_address")}), false) AS matched FROM c"""
)
def address_matches(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12 with CLN-17."""
    return _bound(spark, d, "dispatches", _PAIRS).select("dispatch_id", F.coalesce(reports.address_match(F.col("ref_address"), F.col("hyp_address")), F.lit(False)).alias("matched"))


@query("""WITH f AS (SELECT event_type AS category, unnest([value, value * 2]) AS f FROM events), b AS (SELECT category, (round_even(f / 5, 0) * 5)::BIGINT AS bucket FROM f WHERE f IS NOT NULL),
n AS (SELECT category, bucket, count(*) AS n, 0 AS e FROM b GROUP BY ALL UNION ALL SELECT 'All', bucket, count(*), 1 FROM b GROUP BY ALL),
r AS (SELECT category, bucket, n, row_number() OVER (PARTITION BY e, category ORDER BY n DESC, bucket) AS rank FROM n) SELECT category, bucket, n, rank::INT AS rank FROM r WHERE rank <= 10""")
def frequency_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13 over all events: top ten buckets are the report."""
    return reports.frequency_histogram(spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type AS category", "array(value, value * 2) AS freqs"))


@query(with_sql("closures", "zones") + """, z AS (SELECT map_name AS zone_id, CASE k % 6 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E3' WHEN 3 THEN 'Q5' WHEN 4 THEN 'E4' ELSE 'X9' END AS unit_id FROM zones)
SELECT closure_id, c.zone_id, h AS hall, list_position(['2', '1', '3', '4', 'OTHER'], h)::BIGINT AS place, start_time FROM (SELECT closure_id, start_time, concat('', event_id % 30 + 1) AS zone_id FROM closures) c LEFT JOIN
(SELECT zone_id, CASE unit_id WHEN 'E1' THEN '1' WHEN 'E2' THEN '2' WHEN 'E3' THEN '3' WHEN 'Q5' THEN '3' WHEN 'E4' THEN '4' END AS hh FROM z) y ON y.zone_id = c.zone_id, LATERAL (SELECT coalesce(hh, 'OTHER') AS h)""")
def closures_by_hall(spark: SparkSession, d: str) -> DataFrame:
    """JN-17 seen from hall 2."""
    zones = load(spark, d, "zones").selectExpr("map_name AS zone_id", "CASE k % 6 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E3' WHEN 3 THEN 'Q5' WHEN 4 THEN 'E4' ELSE 'X9' END AS unit_id")
    return reports.closures_by_hall(load(spark, d, "closures").selectExpr("closure_id", "start_time", "concat('', event_id % 30 + 1) AS zone_id"), zones, "2")


@query(with_sql("dispatches") + " SELECT dispatch_id, coalesce(CASE WHEN id % 3 = 0 THEN 'kept.wav' END, '/api/audio/' || dispatch_id || '.wav') AS audio_url, CASE WHEN id % 2 = 0 THEN radio_channel ELSE 'Coquitlam' END AS channel FROM dispatches")
def audio_and_channels(spark: SparkSession, d: str) -> DataFrame:
    """SNK-07 and CLN-21."""
    t = load(spark, d, "dispatches").selectExpr("dispatch_id", "CASE WHEN id % 3 = 0 THEN 'kept.wav' END AS audio_url", "CASE WHEN id % 2 = 0 THEN concat('Coquitlam Talk Group ', radio_channel) ELSE 'Coquitlam' END AS raw")
    return reports.with_audio_url(t).select("dispatch_id", "audio_url", reports.channel_name(F.col("raw")).alias("channel"))


@query(with_sql("parcels") + " SELECT DISTINCT street_type AS roadtype FROM parcels WHERE street_type NOT IN ('AVE', 'ST')")
def missing_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """QC-01 against a vocabulary of two active entries and an inactive one."""
    vocabulary = spark.createDataFrame([("street_suffix", "AVE", True), ("street_suffix", "ST", True), ("street_suffix", "RD", False)], "category string, term string, is_active boolean")
    return reports.missing_suffixes(load(spark, d, "parcels").selectExpr("concat(' ', lower(street_type)) AS roadtype"), vocabulary)


@query(with_sql("parcels") + " SELECT house, street, street_type, count(*) AS n FROM parcels GROUP BY ALL HAVING count(*) > 1")
def repeated_addresses(spark: SparkSession, d: str) -> DataFrame:
    """QC-02."""
    return reports.repeated_keys(load(spark, d, "parcels"), "house", "street", "street_type")

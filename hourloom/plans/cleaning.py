"""Queries over raw records: quarantine, flags, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import stamp
from ..operators import clean, profile, selection
from ..sources.tables import TRIPS, dense_events, open_all, read, trips
from . import sql

KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def classed(s: SparkSession, d: str) -> DataFrame:
    return clean.classify(clean.require_known(trips(s, d)), TRIPS)


def flagged(s: SparkSession, d: str) -> DataFrame:
    return clean.flags(classed(s, d).where("reason is null"))


def with_band(s: SparkSession, d: str, place: bool = False) -> DataFrame:
    rows = trips(s, d, place)
    return rows.withColumn("micros", clean.duration()).withColumn("band", profile.band(clean.duration()))


def normalised(s: SparkSession, d: str) -> DataFrame:
    """Two layouts of supplier as one table: a renamed column, one that is missing, integers for doubles."""
    base = read(s, d, "supplier")
    old = base.where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("weight"))
    new = base.where("s_suppkey % 2 = 1").select("s_suppkey", "s_name", F.col("s_nationkey").cast("double").alias("weight"), F.col("s_acctbal").alias("fee"))
    schema = T.StructType.fromDDL("s_suppkey long, s_name string, weight double, fee double")
    return open_all([old, new], schema, aliases={"name": "s_name"}, optional=("fee",))


def zones(s: SparkSession, d: str) -> DataFrame:
    """Totals of all five classes: trips by zone against a lookup without zones 21 and up, with one nameless and one outside."""
    name = F.when(F.col("n_nationkey") == 3, "N/A").when(F.col("n_nationkey") == 4, "Outside").otherwise(F.col("n_name"))
    lookup = read(s, d, "nation").where("n_nationkey < 21").select(F.col("n_nationkey").cast("long").alias("id"), name.alias("name"))
    ids = trips(s, d).select(F.when(F.col("zone") == 0, None).otherwise(F.col("zone")).alias("zone"))
    counts = ids.groupBy("zone").agg(F.count("*").alias("n")).join(lookup, F.col("zone") == F.col("id"), "left")
    named = counts.groupBy(profile.zone_class(F.col("name"), F.col("zone"), F.col("id").isNotNull()).alias("class")).agg(F.sum("n").alias("n"))
    every = s.range(1).select(F.explode(F.array(*map(F.lit, profile.CLASSES))).alias("class"))
    return every.join(named, "class", "left").na.fill(0)


def longest(s: SparkSession, d: str) -> DataFrame:
    rows = trips(s, d, place=True).withColumn("micros", clean.duration())
    return profile.longest(rows.select("micros", "file", "row", *KEYS), "micros").drop("file")


def quantiles(s: SparkSession, d: str) -> DataFrame:
    """Of all durations, of the positive ones and of the events' values: one selection for all."""
    minutes = selection.counted(trips(s, d).where("pickup is not null and dropoff is not null").select((clean.duration() / 60_000_000.0).alias("v")), "v")
    subjects = F.explode(F.when(F.col("value") > 0, F.array(F.lit("all"), F.lit("positive"))).otherwise(F.array(F.lit("all"))))
    minutes = minutes.select(subjects.alias("subject"), "value", "copies")
    values = selection.counted(read(s, d, "events"), "value").select(F.lit("value").alias("subject"), "value", "copies")
    return selection.quantiles(minutes.unionByName(values), profile.PROBABILITIES)


def zone_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Of the events' values, for each zone."""
    counts = selection.counted(dense_events(s, d), "value", "zone").withColumnRenamed("zone", "subject")
    return selection.quantiles(counts, profile.PROBABILITIES)


FLAG_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, micros > 86400000000 AS q_duration_gt_24h, coalesce(distance = 0, false) AS q_distance_zero, coalesce(distance < 0, false) AS q_distance_negative,
  coalesce(fare < 0, false) AS q_fare_negative, coalesce(total < 0, false) AS q_total_negative, passengers IS NULL AS q_passenger_missing, coalesce(passengers = 0, false) AS q_passenger_zero, round(micros / 60000000.0, 6) AS duration_minutes
  FROM classed WHERE reason IS NULL"""
BAND_SQL = "CASE WHEN micros IS NULL THEN 'missing_time' WHEN micros < 0 THEN 'negative' WHEN micros = 0 THEN 'zero' " + " ".join(f"WHEN micros <= {b * 60_000_000} THEN '{n}'" for b, n in zip(profile.BOUNDS, profile.NAMES, strict=True)) + " ELSE '>24 hours' END"
BAND_LIST = ", ".join(f"('{b}')" for b in profile.BANDS)
LINE = {"l_orderkey": 0, "l_partkey": 0, "l_suppkey": 0, "l_linenumber": 0, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 1}

QUERIES = {
    "trip_disposition_counts": lambda s, d: clean.disposition_counts(classed(s, d)),
    "trip_disposition_rows": lambda s, d: classed(s, d).select(*KEYS, stamp(F.col("pickup")).alias("pickup"), "disposition", "reason"),
    "quarantine_reasons": lambda s, d: classed(s, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")),
    "quality_flags": lambda s, d: flagged(s, d).select(*KEYS, *clean.FLAGS, F.round("duration_minutes", 6).alias("duration_minutes")),
    "quality_flag_counts": lambda s, d: clean.flag_counts(flagged(s, d)),
    "duration_sensitivity": lambda s, d: clean.sensitivity(flagged(s, d), F.date_format("pickup", "yyyy-MM-dd")),
    "duration_bands": lambda s, d: profile.band_profile(with_band(s, d)),
    "duration_quantiles": quantiles,
    "longest_trips": longest,
    "band_samples": lambda s, d: profile.samples(with_band(s, d, place=True).select("band", "file", "row", *KEYS), "band").select("band", "r", "row", *KEYS),
    "zone_quantiles": zone_quantiles,
    "column_profile": lambda s, d: profile.columns(read(s, d, "lineitem")),
    "nonfinite_counts": lambda s, d: profile.nonfinite(read(s, d, "lineitem")),
    "issue_counts": lambda s, d: profile.issues(trips(s, d), TRIPS),
    "counts_by_month": lambda s, d: trips(s, d).where("pickup is not null").groupBy(F.date_format("pickup", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")),
    "counts_by_day": lambda s, d: trips(s, d).where(~F.coalesce(clean.reason(TRIPS), F.lit("")).startswith("pickup_")).groupBy(F.date_format("pickup", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")),
    "counts_by_zone": lambda s, d: trips(s, d).groupBy(F.coalesce(F.col("zone").cast("string"), F.lit("None")).alias("zone")).agg(F.count("*").alias("n")),
    "duplicate_groups": lambda s, d: profile.duplicate_groups(read(s, d, "lineitem").select("l_orderkey", "l_linenumber")),
    "duplicate_examples": lambda s, d: profile.duplicate_examples(read(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]),
    "duration_sensitivity_max": lambda s, d: clean.sensitivity(flagged(s, d), F.date_format("pickup", "yyyy-MM-dd")).agg(F.count("*").alias("cells"), F.max("difference").alias("max_difference")),
    "zone_counts_ranked": lambda s, d: trips(s, d).groupBy("zone").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "zone"),
    "duplicate_rows": lambda s, d: profile.duplicate_groups(read(s, d, "lineitem")),
    "zone_classification": zones,
    "schema_normalised": lambda s, d: normalised(s, d),
}
ORACLE_SQL = {
    "trip_disposition_counts": f"WITH {sql.TRIP} SELECT count(*) AS raw, count_if(reason LIKE 'pickup%')::BIGINT AS outside_interval, count_if(reason LIKE 'excluded%')::BIGINT AS excluded_zone, count_if(reason LIKE '%duration')::BIGINT AS nonpositive_duration, count_if(reason IS NULL)::BIGINT AS retained FROM classed",
    "trip_disposition_rows": f"WITH {sql.TRIP} SELECT l_orderkey, l_linenumber, l_partkey, {sql.stamp('pickup')} AS pickup, CASE WHEN reason IS NULL THEN 'retained' WHEN reason LIKE 'pickup%' THEN 'outside_interval' WHEN reason LIKE 'excluded%' THEN 'excluded_zone' ELSE 'nonpositive_duration' END AS disposition, reason FROM classed",
    "quarantine_reasons": f"WITH {sql.TRIP} SELECT reason, count(*) AS n FROM classed WHERE reason IS NOT NULL GROUP BY reason",
    "quality_flags": f"WITH {sql.TRIP} {FLAG_SQL}",
    "quality_flag_counts": f"WITH {sql.TRIP}, f AS ({FLAG_SQL}) SELECT " + ", ".join(f"count_if({c})::BIGINT AS {c}" for c in clean.FLAGS) + " FROM f",
    "duration_sensitivity": f"WITH {sql.TRIP} SELECT * FROM (SELECT zone, strftime(pickup, '%Y-%m-%d') AS bucket, count(*) AS with_long, count(*) - count_if(micros > 86400000000)::BIGINT AS without_long, count_if(micros > 86400000000)::BIGINT AS difference FROM classed WHERE reason IS NULL GROUP BY ALL) WHERE difference > 0",
    "duration_bands": f"WITH {sql.TRIP}, b AS (SELECT *, {BAND_SQL} AS band FROM classed) SELECT l.band, count(b.band) AS n, coalesce(count_if(b.band IS NOT NULL AND distance = 0), 0)::BIGINT AS distance_zero, coalesce(count_if(b.band IS NOT NULL AND distance < 0), 0)::BIGINT AS distance_negative, coalesce(count_if(b.band IS NOT NULL AND distance IS NULL), 0)::BIGINT AS distance_missing, coalesce(count_if(b.band IS NOT NULL AND fare < 0), 0)::BIGINT AS fare_negative, coalesce(count_if(b.band IS NOT NULL AND total < 0), 0)::BIGINT AS total_negative, coalesce(count_if(b.band IS NOT NULL AND total = 0), 0)::BIGINT AS total_zero, coalesce(count_if(b.band IS NOT NULL AND passengers IS NULL), 0)::BIGINT AS passenger_missing FROM (VALUES {BAND_LIST}) l(band) LEFT JOIN b ON l.band = b.band GROUP BY l.band",
    "duration_quantiles": f"WITH {sql.TRIP}, m AS (SELECT micros / 60000000.0 AS v FROM classed WHERE micros IS NOT NULL), p AS (SELECT unnest([0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1])::DOUBLE AS p), "
    "q AS (" + " UNION ALL ".join(f"SELECT '{n}' AS subject, quantile_cont(v, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1]) AS q FROM ({t})" for n, t in (("all", "SELECT v FROM m"), ("positive", "SELECT v FROM m WHERE v > 0"), ("value", "SELECT value AS v FROM events"))) + ") "
    f"SELECT subject, unnest([0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1])::DOUBLE AS p, round(unnest(q), 6) AS value FROM q",
    "longest_trips": f"WITH {sql.TRIP_PLACED}, m AS (SELECT micros, file_row AS row, l_orderkey, l_linenumber, l_partkey FROM classed WHERE micros IS NOT NULL), least AS (SELECT min(micros) AS v FROM (SELECT micros FROM m ORDER BY micros DESC LIMIT 5)), "
    "early AS (SELECT m.* FROM m, least WHERE micros >= v ORDER BY row LIMIT 5), either AS (SELECT m.* FROM m, least WHERE micros > v UNION ALL SELECT early.* FROM early, least WHERE micros = v) SELECT * FROM either ORDER BY micros DESC, row DESC LIMIT 5",
    "band_samples": f"WITH {sql.TRIP_PLACED}, b AS (SELECT {BAND_SQL} AS band, file_row AS row, l_orderkey, l_linenumber, l_partkey FROM classed) SELECT band, r::INT AS r, row, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY row) AS r FROM b) WHERE r <= 3",
    "zone_quantiles": "WITH q AS (SELECT event_type AS subject, quantile_cont(value, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1]) AS q FROM events GROUP BY event_type) SELECT subject, unnest([0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1])::DOUBLE AS p, round(unnest(q), 6) AS value FROM q",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, {f'count_if(isnan({c}))::BIGINT' if real else '0::BIGINT'} AS nans, min({c} + 0)::DOUBLE AS lowest, max({c} + 0)::DOUBLE AS highest FROM lineitem" for c, real in LINE.items()),
    "nonfinite_counts": "SELECT " + ", ".join(f"count_if(NOT isfinite({c}))::BIGINT AS {c}" for c, real in LINE.items() if real) + " FROM lineitem",
    "issue_counts": f"WITH {sql.TRIP} SELECT count_if(pickup < TIMESTAMP '1996-01-01')::BIGINT AS pickup_before_start, count_if(pickup >= TIMESTAMP '2000-01-01')::BIGINT AS pickup_at_or_after_end, count_if(dropoff < pickup)::BIGINT AS dropoff_before_pickup, count_if(dropoff = pickup)::BIGINT AS dropoff_equal_pickup, count_if(distance < 0)::BIGINT AS distance_negative, count_if(distance = 0)::BIGINT AS distance_zero, count_if(passengers < 0)::BIGINT AS passengers_negative, count_if(passengers = 0)::BIGINT AS passengers_zero, count_if(fare < 0)::BIGINT AS fare_negative, count_if(fare = 0)::BIGINT AS fare_zero, count_if(total < 0)::BIGINT AS total_negative, count_if(total = 0)::BIGINT AS total_zero FROM classed",
    "counts_by_month": f"WITH {sql.TRIP} SELECT strftime(pickup, '%Y-%m') AS month, count(*) AS n FROM classed GROUP BY ALL",
    "counts_by_day": f"WITH {sql.TRIP} SELECT strftime(pickup, '%Y-%m-%d') AS day, count(*) AS n FROM classed WHERE reason IS NULL OR reason NOT LIKE 'pickup%' GROUP BY ALL",
    "counts_by_zone": f"WITH {sql.TRIP} SELECT coalesce(zone::VARCHAR, 'None') AS zone, count(*) AS n FROM classed GROUP BY ALL",
    "duplicate_groups": "SELECT count(*) AS groups, sum(n - 1)::BIGINT AS excess FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "duplicate_examples": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY l_orderkey, l_linenumber LIMIT 3",
    "duration_sensitivity_max": f"WITH {sql.TRIP}, c AS (SELECT count_if(micros > 86400000000)::BIGINT AS difference FROM classed WHERE reason IS NULL GROUP BY zone, strftime(pickup, '%Y-%m-%d')) SELECT count(*) AS cells, max(difference) AS max_difference FROM c WHERE difference > 0",
    "zone_counts_ranked": f"WITH {sql.TRIP} SELECT zone, count(*) AS n FROM trip GROUP BY zone ORDER BY n DESC, zone",
    "duplicate_rows": "SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS excess FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"),
    "zone_classification": f"WITH {sql.TRIP}, l AS (SELECT n_nationkey AS id, CASE n_nationkey WHEN 3 THEN 'N/A' WHEN 4 THEN 'Outside' ELSE n_name END AS name FROM nation WHERE n_nationkey < 21), z AS (SELECT nullif(zone, 0) AS zone FROM trip), k AS (SELECT CASE WHEN zone IS NULL THEN 'missing_id' WHEN id IS NULL THEN 'not_in_lookup' WHEN name IN ('N/A', 'Unknown', '') THEN 'unknown_zone' WHEN name = 'Outside' THEN 'outside_unspecified' ELSE 'named_zone' END AS class FROM z LEFT JOIN l ON zone = id) SELECT v.class, count(k.class) AS n FROM (VALUES " + ", ".join(f"('{c}')" for c in profile.CLASSES) + ") v(class) LEFT JOIN k ON v.class = k.class GROUP BY v.class",
    "schema_normalised": "SELECT s_suppkey, s_name, s_nationkey::DOUBLE AS weight, CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END AS fee FROM supplier",
}

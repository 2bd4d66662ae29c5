"""Quarantine in order, quality flags, counts and the duration sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import micros_between, ntz
from ..sources.tables import Plan

DAY = 86_400_000_000
#: Reasons by stage, the first that applies holds.
STAGES = {"outside_interval": ("pickup_before_start", "pickup_at_or_after_end"), "excluded_zone": ("excluded_zone",), "nonpositive_duration": ("negative_duration", "zero_duration")}


def duration() -> Column:
    return micros_between(F.col("pickup"), F.col("dropoff"))


def reason(plan: Plan) -> Column:
    """Why a row is quarantined; null for retained rows."""
    d = duration()
    return (
        F.when(F.col("pickup") < ntz(plan.start), "pickup_before_start")
        .when(F.col("pickup") >= ntz(plan.end), "pickup_at_or_after_end")
        .when(F.col("zone").isin(*plan.excluded), F.concat(F.lit("excluded_zone_"), F.col("zone").cast("string")))
        .when(d < 0, "negative_duration")
        .when(d == 0, "zero_duration")
    )


def classify(df: DataFrame, plan: Plan) -> DataFrame:
    """Every row with its reason and disposition; one scan serves the retained and all quarantined sets."""
    r = F.col("reason")
    out = df.withColumn("reason", reason(plan))
    return out.withColumn("disposition", F.when(r.isNull(), "retained").when(r.startswith("pickup_"), "outside_interval").when(r.startswith("excluded_"), "excluded_zone").otherwise("nonpositive_duration"))


def require_known(df: DataFrame) -> DataFrame:
    """Unknown conditions stop the run: null times or zones fail the row instead of passing a made-up rule."""
    bad = F.col("pickup").isNull() | F.col("dropoff").isNull() | F.col("zone").isNull()
    return df.withColumn("pickup", F.when(bad, F.raise_error(F.lit("null time or zone")).cast("timestamp_ntz")).otherwise(F.col("pickup")))


def disposition_counts(classified: DataFrame) -> DataFrame:
    def n(kind: str) -> Column:
        return F.count_if(F.col("disposition") == kind).alias(kind)

    return classified.agg(F.count("*").alias("raw"), n("outside_interval"), n("excluded_zone"), n("nonpositive_duration"), n("retained"))


def flags(df: DataFrame) -> DataFrame:
    """Seven flags; a null predicate is false, and no row is dropped or altered."""
    conditions = {
        "q_duration_gt_24h": duration() > DAY, "q_distance_zero": F.col("distance") == 0, "q_distance_negative": F.col("distance") < 0, "q_fare_negative": F.col("fare") < 0,
        "q_total_negative": F.col("total") < 0, "q_passenger_missing": F.col("passengers").isNull(), "q_passenger_zero": F.col("passengers") == 0,
    }
    return df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()} | {"duration_minutes": duration() / 60_000_000.0})


FLAGS = ("q_duration_gt_24h", "q_distance_zero", "q_distance_negative", "q_fare_negative", "q_total_negative", "q_passenger_missing", "q_passenger_zero")


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(*[F.count_if(F.col(f)).alias(f) for f in FLAGS])


def sensitivity(flagged: DataFrame, bucket: Column) -> DataFrame:
    """Counts of (zone, bucket) with and without rows longer than a day, where they differ."""
    long = F.count_if("q_duration_gt_24h")
    return flagged.groupBy("zone", bucket.alias("bucket")).agg(F.count("*").alias("with_long"), (F.count("*") - long).alias("without_long"), long.alias("difference")).where("difference > 0")

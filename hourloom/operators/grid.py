"""The dense entity-by-hour grid: null (no source), 0 (source, no event) and masked stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import inside, masked_day
from ..sources.tables import Plan, hour_axis


def observed(df: DataFrame) -> DataFrame:
    return df.groupBy("zone", "hour").agg(F.count("*").alias("trips"))


def coverage(raw: DataFrame, plan: Plan) -> DataFrame:
    """Hours with any source row, before quality rules."""
    return raw.where(inside(F.col("pickup"), plan.start, plan.end)).select("hour").distinct()


def dense(counts: DataFrame, covered: DataFrame, zones: DataFrame, plan: Plan) -> DataFrame:
    """zone, hour, recorded, target and four flags for every zone and hour.

    The hour axis is a sequence over the plan's interval; the cross join is the grid itself, its size zones times hours.
    """
    spark = counts.sparkSession
    grid = zones.select("zone").crossJoin(hour_axis(spark, plan))
    grid = grid.join(covered.withColumn("covered", F.lit(True)), "hour", "left").join(counts, ["zone", "hour"], "left")
    recorded = F.when(F.col("covered"), F.coalesce("trips", F.lit(0)))
    masked = masked_day(F.col("hour"), plan.masked)
    out = grid.select("zone", "hour", recorded.alias("recorded"), F.col("covered").isNull().alias("q_source_missing"), masked.alias("q_masked_day"))
    eligible = ~F.col("q_source_missing") & ~F.col("q_masked_day")
    return out.select("zone", "hour", "recorded", F.when(eligible, F.col("recorded")).alias("target"), "q_source_missing", "q_masked_day", F.coalesce(F.col("recorded") == 0, F.lit(False)).alias("q_zero"), eligible.alias("eligible"))


def totals(grid: DataFrame) -> DataFrame:
    n = [F.count_if(c).alias(f"n_{c}") for c in ("q_source_missing", "q_masked_day", "q_zero", "eligible")]
    return grid.agg(F.count("*").alias("rows"), *n, F.sum("recorded").alias("recorded"), F.sum("target").alias("target"))


def zone_coverage(grid: DataFrame) -> DataFrame:
    return grid.groupBy("zone").agg(F.count("*").alias("hours"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


def missing_hours(covered: DataFrame, plan: Plan) -> DataFrame:
    return hour_axis(covered.sparkSession, plan).join(covered, "hour", "left_anti")

"""Profiles of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import ntz
from ..sources.tables import Plan

#: Upper bounds of the duration bands in minutes (inclusive) and their names.
BOUNDS = (1, 5, 15, 30, 60, 120, 360, 1440)
NAMES = ("(0,1] min", "(1,5] min", "(5,15] min", "(15,30] min", "(30,60] min", "(1,2] hours", "(2,6] hours", "(6,24] hours")
BANDS = ("missing_time", "negative", "zero", *NAMES, ">24 hours")
#: The quantiles of a profile.
PROBABILITIES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0)


def band(micros: Column) -> Column:
    out = F.when(micros.isNull(), "missing_time").when(micros < 0, "negative").when(micros == 0, "zero")
    for bound, name in zip(BOUNDS, NAMES, strict=True):
        out = out.when(micros <= bound * 60_000_000, name)
    return out.otherwise(">24 hours")


def band_profile(df: DataFrame) -> DataFrame:
    """Counters of every band, also of those without rows."""
    spark = df.sparkSession
    bands = spark.range(1).select(F.explode(F.array(*map(F.lit, BANDS))).alias("band"))
    counters = {
        "distance_zero": F.col("distance") == 0, "distance_negative": F.col("distance") < 0, "distance_missing": F.col("distance").isNull(), "fare_negative": F.col("fare") < 0,
        "total_negative": F.col("total") < 0, "total_zero": F.col("total") == 0, "passenger_missing": F.col("passengers").isNull(),
    }
    sums = df.groupBy("band").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counters.items()])
    return bands.join(sums, "band", "left").na.fill(0)


def longest(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """The ``n`` rows of the largest values of ``df`` (with file and row, its rows' places): value, then place descending.

    Of rows equal to the least of these values only those count that are among the first ``n`` rows, by place, of that value or more; of them the last are taken.
    """
    place = ["file", "row"]
    least = df.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(n).agg(F.min(value).alias("_least"))
    rows = df.crossJoin(F.broadcast(least))  # one row
    above = rows.where(F.col(value) > F.col("_least")).drop("_least")
    early = rows.where(F.col(value) >= F.col("_least")).orderBy(*place).limit(n)  # n rows
    equal = early.where(F.col(value) == F.col("_least")).drop("_least")
    return above.unionByName(equal).orderBy(F.desc(value), *map(F.desc, place)).limit(n)


def samples(df: DataFrame, group: str, n: int = 3) -> DataFrame:
    """The first rows of each group by their places in the files. Rows of one file and salt are cut to ``n`` first, so no task holds a whole large group."""
    place = ["file", "row"]
    salted = Window.partitionBy(group, "file", F.pmod(F.xxhash64("row"), F.lit(256))).orderBy("row")
    first = df.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= n)
    return first.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*place))).where(F.col("r") <= n)


def columns(df: DataFrame) -> DataFrame:
    """name, nulls, nans, lowest and highest of each numeric column; NaN is no bound."""
    numeric = [f for f in df.schema if isinstance(f.dataType, T.NumericType)]
    out = []
    for f in numeric:
        c, real = F.col(f.name), isinstance(f.dataType, (T.DoubleType, T.FloatType))
        value = F.when(~F.isnan(c), c) if real else c
        out.append(F.struct(F.lit(f.name).alias("name"), F.count_if(c.isNull()).alias("nulls"), (F.count_if(F.isnan(c)) if real else F.lit(0).cast("long")).alias("nans"), F.min(value).cast("double").alias("lowest"), F.max(value).cast("double").alias("highest")))
    return df.agg(F.array(*out).alias("a")).select(F.inline("a"))


def nonfinite(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.agg(*[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in names])


def issues(df: DataFrame, plan: Plan) -> DataFrame:
    """Twelve counters; a null is in none of them."""
    rules = {
        "pickup_before_start": F.col("pickup") < ntz(plan.start), "pickup_at_or_after_end": F.col("pickup") >= ntz(plan.end),
        "dropoff_before_pickup": F.col("dropoff") < F.col("pickup"), "dropoff_equal_pickup": F.col("dropoff") == F.col("pickup"),
    }
    for name in ("distance", "passengers", "fare", "total"):
        rules |= {f"{name}_negative": F.col(name) < 0, f"{name}_zero": F.col(name) == 0}
    return df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])


def duplicate_examples(df: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` groups of equal rows by their keys, with the rows in each."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies")).where("copies > 1").orderBy(*keys, F.xxhash64(*df.columns)).limit(n).select(*keys, "copies")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """groups of equal rows (null equals null), rows in excess of one for each."""
    groups = df.groupBy(*df.columns).count().where("count > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess"))


def zone_class(name: Column, zone: Column, known: Column) -> Column:
    """Five classes of a zone id."""
    return F.when(zone.isNull(), "missing_id").when(~known, "not_in_lookup").when(name.isin("N/A", "Unknown", ""), "unknown_zone").when(name == "Outside", "outside_unspecified").otherwise("named_zone")


CLASSES = ("missing_id", "not_in_lookup", "unknown_zone", "outside_unspecified", "named_zone")

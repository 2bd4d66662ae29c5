"""Period summaries and bounded serving queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import inside, monday_weekday, ntz


def summaries(grid: DataFrame) -> DataFrame:
    """Daily (D) and monthly (M) sums by zone in one pass; recorded is null where every hour's is."""
    periods = F.array(F.struct(F.lit("D").alias("kind"), F.date_format("hour", "yyyyMMdd").alias("period")), F.struct(F.lit("M").alias("kind"), F.date_format("hour", "yyyyMM").alias("period")))
    rows = grid.select("zone", "recorded", "q_source_missing", "q_masked_day", F.explode(periods).alias("x"))
    return rows.groupBy("x.kind", "x.period", "zone").agg(F.sum("recorded").alias("recorded"), F.count("*").alias("hours"), F.count_if("q_source_missing").alias("missing"), F.count_if("q_masked_day").alias("masked"))


def check_range(start: str, end: str, first: str, last: str, max_days: int = 31) -> int:
    """Days from start to end, both included; an error outside the data, reversed or too long."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    days = (b - a).days + 1
    if not (date.fromisoformat(first) <= a <= b <= date.fromisoformat(last)) or days > max_days:
        raise ValueError("the range is reversed, too long or outside the data")
    return days


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """``df``, failing when it has not exactly n rows; n is small, as ranges are checked first. The check is a filter over the row of the count, so it holds for an empty ``df`` and whatever columns are read."""
    held = df.agg(F.count("*").alias("_n"))
    both = held.join(df.withColumn("_there", F.lit(True)), F.lit(True), "left")
    wrong = F.raise_error(F.lit("the range is not complete")).cast("boolean")
    return both.where(F.when(F.col("_n") != n, wrong).otherwise(F.col("_there"))).drop("_n", "_there")


def history(grid: DataFrame, zone, start: str, end: str) -> DataFrame:
    """Hours of a zone from one midnight to another."""
    return grid.where((F.col("zone") == zone) & inside(F.col("hour"), start, end))


def snapshot(grid: DataFrame, hour: str) -> DataFrame:
    return grid.where(F.col("hour") == ntz(hour))


def joined(grid: DataFrame, forecasts: DataFrame, forecast_from: str | None = None) -> DataFrame:
    """History with forecasts, one to one: a repeated forecast is an error, and so is an eligible hour from ``forecast_from`` on without one."""
    one = forecasts.groupBy("zone", "hour").agg(F.first("prediction").alias("prediction"), F.first("baseline").alias("baseline"), F.count("*").alias("_k"))
    one = one.withColumn("prediction", F.when(F.col("_k") > 1, F.raise_error(F.lit("a forecast repeats")).cast("double")).otherwise(F.col("prediction"))).drop("_k")
    out = grid.join(one, ["zone", "hour"], "left")
    if forecast_from is None:
        return out
    lacking = F.col("eligible") & (F.col("hour") >= ntz(forecast_from)) & F.col("prediction").isNull()
    return out.withColumn("prediction", F.when(lacking, F.raise_error(F.lit("an eligible hour has no forecast")).cast("double")).otherwise(F.col("prediction")))


def forecasts(table: DataFrame, zone, start: str, end: str) -> DataFrame:
    """Forecasts of a zone from one midnight to another; there may be none."""
    return table.where((F.col("zone") == zone) & inside(F.col("hour"), start, end))


def daily(periods: DataFrame, start: str, end: str, zones: int) -> DataFrame:
    """Daily sums of the days from start to end, both included: all zones on all days, or an error."""
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    rows = periods.where((F.col("kind") == "D") & F.col("period").between(start.replace("-", ""), end.replace("-", "")))
    return require_rows(rows, days * zones)


def monthly(periods: DataFrame, months: int, zones: int) -> DataFrame:
    return require_rows(periods.where("kind = 'M'"), months * zones)


def headline(days: DataFrame) -> DataFrame:
    """Total, mean a day and the zone with most of daily sums."""
    n = F.count_distinct("period")
    by_zone = days.groupBy("zone").agg(F.sum("recorded").alias("r"))
    top = by_zone.agg(F.max_by("zone", F.struct(F.coalesce("r", F.lit(-1)), -F.col("zone"))).alias("top_zone"))
    return days.agg(F.sum("recorded").alias("total"), F.round(F.sum("recorded") / n, 6).alias("mean_a_day"), F.sum("missing").alias("missing")).crossJoin(top)  # a row each


def compare_zones(grid: DataFrame, zones: list, start: str, end: str) -> DataFrame:
    """Histories of several zones under each other, each with its name."""
    return grid.where(F.col("zone").isin(*zones) & inside(F.col("hour"), start, end)).withColumn("label", F.col("zone").cast("string"))


def zone_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("zone").agg(F.sum("recorded").alias("recorded"), F.count_if("q_source_missing").alias("missing"), F.count_if("q_masked_day").alias("masked"))


def evaluated(rows: DataFrame) -> DataFrame:
    return rows.where("eligible and target is not null and prediction is not null")


def top_zones(grid: DataFrame, n: int = 10) -> DataFrame:
    return grid.groupBy("zone").agg(F.sum("recorded").alias("recorded")).orderBy(F.desc_nulls_last("recorded"), "zone").limit(n)


def by_day(grid: DataFrame) -> DataFrame:
    return grid.groupBy(F.date_format("hour", "yyyy-MM-dd").alias("day")).agg(F.sum("recorded").alias("recorded"))


def by_month(grid: DataFrame) -> DataFrame:
    """Here hours without a source count as 0."""
    return grid.groupBy(F.date_format("hour", "yyyy-MM").alias("month")).agg(F.coalesce(F.sum("recorded"), F.lit(0)).alias("recorded"))


def heatmap(grid: DataFrame, value: str = "target") -> DataFrame:
    """Mean by weekday (7 rows) and clock hour (24 columns); nothing stays null."""
    days = grid.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    cells = grid.select(monday_weekday(F.col("hour")).alias("weekday"), F.hour("hour").alias("clock"), value).groupBy("weekday").pivot("clock", list(range(24))).avg(value)
    return days.join(cells, "weekday", "left")


def long_form(rows: DataFrame, series: tuple[str, ...] = ("target", "prediction", "baseline")) -> DataFrame:
    doubled = rows.select("zone", "hour", *[F.col(c).cast("double").alias(c) for c in series])
    return doubled.unpivot(["zone", "hour"], list(series), "series", "value")


def tail_before(grid: DataFrame, zone, hour: str, n: int = 24) -> DataFrame:
    return grid.where((F.col("zone") == zone) & (F.col("hour") < ntz(hour))).orderBy(F.desc("hour")).limit(n)


def with_names(rows: DataFrame, lookup: DataFrame, key: str, name: str) -> DataFrame:
    """Many to one: a repeated key in the lookup is an error."""
    one = lookup.groupBy(key).agg(F.first(name).alias(name), F.count("*").alias("_k"))
    one = one.withColumn(name, F.when(F.col("_k") > 1, F.raise_error(F.lit("a key repeats in the lookup"))).otherwise(F.col(name))).drop("_k")
    return rows.join(one, rows["zone"] == one[key], "left")

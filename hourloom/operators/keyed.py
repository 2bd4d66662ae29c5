"""A key-ordered table of sparse cells: encode, decode, scan, merge, fingerprint; and comparison of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells that say which table and whose wall clock.
VERSION, CLOCK = "grid_v1", "local"


def refuse(wrong: Column, why: str, value: Column) -> Column:
    """``value``, or an error where ``wrong`` is true or unknown."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit(why))).otherwise(value)


def zone_text(zone: Column) -> Column:
    """Three digits; an error beyond them, as a cut zone would be another's key."""
    number = zone.cast("long")
    return refuse(~number.between(0, 999), "the zone does not fit three digits", F.lpad(number.cast("string"), 3, "0"))


def key_of(zone: Column, hour: Column) -> Column:
    off = F.date_trunc("hour", hour).cast("timestamp_ntz") != hour
    return F.concat_ws("#", zone_text(zone), refuse(off, "not on the hour", F.date_format(hour, "yyyyMMddHH")))


def bit(c: Column) -> Column:
    return F.when(c, "1").otherwise("0")


def encode(grid: DataFrame, lowest: int = 0, highest: int = 999) -> DataFrame:
    """key and cells (map); a null count is no cell. A zone outside its range, an hour that is not whole, a null flag, a negative count and rows that break the grid's identities are errors."""
    flags = ("q_source_missing", "q_masked_day", "q_zero", "eligible")
    null_flag = F.lit(False)
    for f in flags:
        null_flag = null_flag | F.col(f).isNull()
    wrong = (
        null_flag | ~F.col("zone").cast("long").between(lowest, highest) | ~F.col("recorded").isNull().eqNullSafe(F.col("q_source_missing"))
        | ~F.col("eligible").eqNullSafe(~F.col("q_source_missing") & ~F.col("q_masked_day")) | ~F.col("target").eqNullSafe(F.when(F.col("eligible"), F.col("recorded")))
        | ~F.col("q_zero").eqNullSafe(F.coalesce(F.col("recorded") == 0, F.lit(False))) | F.coalesce(F.col("recorded") < 0, F.lit(False)) | F.coalesce(F.col("target") < 0, F.lit(False))
    )
    cells = F.create_map(
        F.lit("d:recorded"), F.col("recorded").cast("string"), F.lit("d:target"), F.col("target").cast("string"), F.lit("m:clock"), F.lit(CLOCK), F.lit("m:version"), F.lit(VERSION),
        F.lit("q:eligible"), bit(F.col("eligible")), F.lit("q:masked"), bit(F.col("q_masked_day")), F.lit("q:missing"), bit(F.col("q_source_missing")), F.lit("q:zero"), bit(F.col("q_zero")),
    )
    key = refuse(wrong, "the row breaks a rule of the grid", key_of(F.col("zone"), F.col("hour")))
    return grid.select(key.alias("key"), F.map_filter(cells, lambda _, v: v.isNotNull()).alias("cells"))


def encode_forecasts(rows: DataFrame, version: str, built: str) -> DataFrame:
    """key and cells of zone (string or number), hour, origin, prediction, baseline, method, features_complete, model_version; no actual value is among the cells."""
    wrong = (F.col("hour") - F.expr("INTERVAL 1 HOUR") != F.col("origin")) | (F.col("model_version") != version) | F.isnan("prediction") | F.isnan("baseline") | F.col("method").isNull() | F.col("features_complete").isNull()
    cells = F.create_map(
        F.lit("m:built"), F.lit(built), F.lit("m:horizon"), F.lit("1"), F.lit("m:method"), F.col("method"), F.lit("m:mode"), F.lit("replay"), F.lit("m:origin"), F.date_format("origin", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("m:version"), F.col("model_version"), F.lit("p:baseline"), F.col("baseline").cast("string"), F.lit("p:value"), F.col("prediction").cast("string"), F.lit("q:complete"), bit(F.col("features_complete")),
    )
    zone = F.col("zone") if dict(rows.dtypes)["zone"] == "string" else zone_text(F.col("zone"))
    key = F.concat_ws("#", zone, F.date_format("hour", "yyyyMMddHH"), F.lit(version), F.lit("1"))
    return rows.select(refuse(wrong, "the origin, version or a value of the forecast is wrong", key).alias("key"), cells.alias("cells"))


#: Cells that every stored forecast has, and no other.
FORECAST_CELLS = ("m:built", "m:horizon", "m:method", "m:mode", "m:origin", "m:version", "p:baseline", "p:value", "q:complete")


def require_cells(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``table``, failing where a row's cells are not exactly ``names``."""
    wrong = F.array_sort(F.map_keys("cells")) != F.array(*map(F.lit, sorted(names)))
    return table.select(refuse(wrong, "the cells of a row are not those of its table", F.col("key")).alias("key"), "cells")


def decode_forecasts(table: DataFrame) -> DataFrame:
    part = F.split("key", "#")

    def cell(name: str) -> Column:
        return F.element_at("cells", F.lit(name))

    return table.select(
        part[0].alias("zone"), F.to_timestamp_ntz(part[1], F.lit("yyyyMMddHH")).alias("hour"), cell("p:value").cast("double").alias("prediction"), cell("p:baseline").cast("double").alias("baseline"),
        cell("m:method").alias("method"), (cell("q:complete") == "1").alias("features_complete"), cell("m:version").alias("model_version"), F.to_timestamp_ntz(cell("m:origin"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("origin"),
    )


SUMMARY = "hours long, masked long, missing long, period string, recorded long, zone long"


def encode_summaries(summaries: DataFrame) -> DataFrame:
    """key and cells of period sums; the record is compact JSON with its names in order."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    wrong = F.lit(False)
    for c in ("hours", "masked", "missing", "period", "zone"):
        wrong = wrong | F.col(c).isNull()
    record = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    key = refuse(wrong | ~F.col("kind").isin("D", "M"), "a summary lacks a value", F.concat_ws("#", "kind", "period", zone_text(F.col("zone"))))
    return summaries.select(key.alias("key"), F.create_map(F.lit("d:summary"), record, F.lit("m:version"), F.lit("summary_v1")).alias("cells"))


def decode_summaries(table: DataFrame) -> DataFrame:
    record = F.from_json(F.element_at("cells", F.lit("d:summary")), SUMMARY)
    return table.select(F.split("key", "#")[0].alias("kind"), record.alias("r")).select("kind", "r.*")


def decode(table: DataFrame) -> DataFrame:
    def cell(name: str) -> Column:
        return F.try_element_at("cells", F.lit(name))

    part = F.split("key", "#")
    return table.select(part[0].cast("long").alias("zone"), F.to_timestamp_ntz(part[1], F.lit("yyyyMMddHH")).alias("hour"), cell("d:recorded").cast("long").alias("recorded"), cell("d:target").cast("long").alias("target"), (cell("q:missing") == "1").alias("q_source_missing"), (cell("q:masked") == "1").alias("q_masked_day"), (cell("q:zero") == "1").alias("q_zero"), (cell("q:eligible") == "1").alias("eligible"))


def cells_text(cells: Column) -> Column:
    """Cells in the order of their names, as text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(cells)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def scan(table: DataFrame, start: str, stop: str, limit: int) -> DataFrame:
    """Rows of start <= key < stop in order; more than ``limit`` is an error, not a cut."""
    rows = table.where((F.col("key") >= start) & (F.col("key") < stop)).orderBy("key").limit(limit + 1)
    at = F.row_number().over(Window.orderBy("key"))  # limit + 1 rows at most
    return rows.withColumn("_r", at).withColumn("key", F.when(F.col("_r") > limit, F.raise_error(F.lit("the scan is over its limit"))).otherwise(F.col("key"))).drop("_r")


def multi_get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of all keys; a key without a row is an error."""
    out = keys.select("key").join(table, "key", "left")
    return out.withColumn("cells", F.when(F.col("cells").isNull(), F.raise_error(F.lit("a key is missing")).cast("map<string,string>")).otherwise(F.col("cells")))


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``changes`` take the place of those with their key; a cell that a change lacks is gone. Twice is as once; a key twice in the changes is an error."""
    one = changes.groupBy("key").agg(F.any_value("cells").alias("cells"), F.count("*").alias("_k"))
    one = one.select(refuse(F.col("_k") > 1, "a key repeats in the changes", F.col("key")).alias("key"), "cells")
    return table.join(changes.select("key"), "key", "left_anti").unionByName(one)


def year_totals(table: DataFrame) -> DataFrame:
    """Rows, sums and flags of each year, decoded from the stored cells."""

    def cell(name: str) -> Column:
        return F.try_element_at("cells", F.lit(name))

    sums = [F.sum(F.coalesce(cell(c).cast("long"), F.lit(0))).alias(n) for c, n in (("d:recorded", "recorded"), ("d:target", "target"), ("q:missing", "missing"), ("q:masked", "masked"), ("q:zero", "zero"), ("q:eligible", "eligible"))]
    return table.groupBy(F.split("key", "#")[1].substr(1, 4).alias("year")).agg(F.count("*").alias("rows"), *sums)


def merged(tables: list[DataFrame]) -> DataFrame:
    """Sorted tables as one in key order; the sort is by ranges, so no task holds all."""
    return reduce(DataFrame.unionByName, tables).orderBy("key")


def fingerprint(table: DataFrame, by: Column | None = None) -> DataFrame:
    """rows and an order-free hash; lengths before values keep the bounds of cells apart."""
    entry = F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.length(e["value"]).cast("string"), F.lit(":"), e["value"]))
    row = F.sha2(F.concat(F.length("key").cast("string"), F.lit(":"), F.col("key"), F.array_join(entry, "")), 256)
    # two sums of 56 bits of each row's hash: unlike xor, equal rows do not cancel
    high, low = F.conv(F.substring(row, 1, 14), 16, 10).cast("decimal(38,0)"), F.conv(F.substring(row, 15, 14), 16, 10).cast("decimal(38,0)")
    grouped = table.groupBy(by.alias("part")) if by is not None else table.groupBy()
    return grouped.agg(F.count("*").alias("rows"), F.concat_ws("-", F.sum(high).cast("string"), F.sum(low).cast("string")).alias("fingerprint"))


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key that is on one side only or has a differing value, null equal to null."""
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.lit(True).alias("in_left"), *[F.col(c).alias(f"left_{c}") for c in values])
    b = right.select(*keys, F.lit(True).alias("in_right"), *[F.col(c).alias(f"right_{c}") for c in values])
    both = a.join(b, keys, "full")
    differs = reduce(lambda x, y: x | y, [~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in values], F.lit(False))
    return both.where(F.col("in_left").isNull() | F.col("in_right").isNull() | differs)

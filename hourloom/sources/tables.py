"""Reading tables, and the roles that the test tables play."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import floor_hour, ntz


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """``df`` (a file scan) with the place of every row: file and row (from 0). Neither depends on how the files are split."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def lossless(df: DataFrame, column: str, to: str) -> Column:
    """Cast that fails on a value that ``to`` cannot hold."""
    c = F.col(column)
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType) and to == "double":
        return F.when(c.cast("double").cast(kind) == c, c.cast("double")).when(c.isNotNull(), F.raise_error(F.lit(f"{column} does not fit {to}")).cast(to))
    return c.cast(to)


def normalise(df: DataFrame, schema: T.StructType, aliases: dict[str, str] | None = None, optional: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: aliases renamed, optional ones absent filled with null, all else an error."""
    have = {c.lower(): c for c in df.columns}
    for old, new in (aliases or {}).items():
        if old in df.columns and old != new:
            if new in df.columns:
                raise ValueError(f"both {old} and {new}")
            df, have = df.withColumnRenamed(old, new), have | {new.lower(): new}
    names, columns = {f.name for f in schema}, set(df.columns)
    if extra := columns - names:
        raise ValueError(f"unexpected columns: {sorted(extra)}")
    if missing := names - columns - set(optional):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.select([(lossless(df, f.name, f.dataType.simpleString()) if f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def open_all(frames: list[DataFrame], schema: T.StructType, **rules) -> DataFrame:
    """Files of different schemas as one table; each is normalised first."""
    return reduce(DataFrame.unionByName, [normalise(f, schema, **rules) for f in frames])


@dataclass(frozen=True)
class Plan:
    """What a grid covers: an interval, entities left out, days masked."""

    start: str
    end: str
    excluded: tuple = ()
    masked: tuple[str, ...] = ()


TRIPS = Plan("1996-01-01 00:00:00", "2000-01-01 00:00:00", (23, 24))
SPARSE = Plan("2024-01-02 00:00:00", "2024-01-29 00:00:00", (10, 11), ("2024-01-14",))
DENSE = Plan("2024-01-01 00:00:00", "2024-01-31 00:00:00", (), ("2024-01-03", "2024-01-29"))
#: Orders are all of midnight, so most hours have no source: missing, zero and masked hours stand side by side.
GAPPED = Plan("1997-03-01 00:00:00", "1997-04-01 00:00:00", (23, 24), ("1997-03-10",))


def trips(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """Line items as trips: pickup, dropoff, zone, distance, fare, total, passengers; with file and row of the line item if ``place``. Joins are left to the optimizer, which broadcasts a side only below its size limit."""
    line, order, supplier, customer = [read(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier", "customer")]
    line = placed(line) if place else line
    joined = line.join(order, line.l_orderkey == order.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(customer, order.o_custkey == customer.c_custkey)
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderdate").alias("pickup"), F.col("l_shipdate").alias("dropoff"), F.col("s_nationkey").cast("long").alias("zone"),
        F.col("l_discount").alias("distance"), F.col("c_acctbal").alias("fare"), (F.col("c_acctbal") - F.col("l_quantity")).alias("total"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_linenumber") - 1).cast("long").alias("passengers"),
        *(["file", "row"] if place else []),
    )


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(12)).cast("long").alias("zone"), F.col("ts").alias("pickup"), floor_hour(F.col("ts")).alias("hour"))


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.col("ts").alias("pickup"), floor_hour(F.col("ts")).alias("hour"), "value")


def gapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the nation of the customer."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("zone"), at.alias("pickup"), floor_hour(at).alias("hour"))


def hour_axis(spark: SparkSession, plan: Plan) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(ntz(plan.start), ntz(plan.end) - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))

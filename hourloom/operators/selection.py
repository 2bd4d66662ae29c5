"""Exact order statistics by distributed selection.

Values are counted where they are (so a value that a third of all rows have is one row), dealt by ranges of (subject, value) and stored in sorted files, one for each
range. Sums of the counts of whole files say which file holds a rank; only that file's rows are added up. No buffer grows with the distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Files that are named in a filter, so that others are not opened; with more, a join picks the rows.
FEW_FILES = 500


def counted(df: DataFrame, value: str, *subject: str) -> DataFrame:
    """subject columns, value (double) and copies; rows without a value are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*subject, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("copies"))


def stored_by_rank(counts: DataFrame) -> DataFrame:
    """file, subject, value and copies, in files of one range of (subject, value) each."""
    path, parts = shared_dir(counts.sparkSession, "ranks"), int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.select("subject", "value", "copies").repartitionByRange(parts, "subject", "value").sortWithinPartitions("subject", "value")
    rows.write.option("maxRecordsPerFile", 0).parquet(path)
    return counts.sparkSession.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))


def at_ranks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """subject, rank and value of the ranks ``wanted`` (subject, rank from 0) of rows of ``stored_by_rank``."""
    sums = rows.groupBy("file", "subject").agg(F.sum("copies").alias("n"), F.min("value").alias("low"))
    in_order = Window.partitionBy("subject").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    place = wanted.join(sums, "subject").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("file", "subject", (F.col("rank") - F.col("before")).alias("inner"), "rank")
    files = [r["file"] for r in place.select("file").distinct().limit(FEW_FILES + 1).collect()]
    near = rows.where(F.col("file").isin(files)) if len(files) <= FEW_FILES else rows
    near = near.join(place.select("file", "subject").distinct(), ["file", "subject"], "left_semi")
    through = F.sum("copies").over(Window.partitionBy("file", "subject").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))  # rows of one file
    near = near.withColumn("through", through)
    here = (F.col("inner") < F.col("through")) & (F.col("inner") >= F.col("through") - F.col("copies"))
    return near.join(place, ["file", "subject"]).where(here).select("subject", "rank", "value")


def quantiles(counts: DataFrame, probabilities: tuple[float, ...]) -> DataFrame:
    """subject, p and value (interpolated between the two ranks beside it) for every subject of ``counts`` (subject, value, copies) and probability."""
    rows = stored_by_rank(counts)
    sizes = rows.groupBy("subject").agg(F.sum("copies").alias("size"))
    asked = sizes.select("subject", "size", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")).withColumn("place", F.col("p") * (F.col("size") - 1))
    asked = asked.select("subject", "p", F.floor("place").cast("long").alias("lower"), F.ceil("place").cast("long").alias("upper"), "place")
    found = at_ranks(rows, asked.select("subject", F.explode(F.array("lower", "upper")).alias("rank")).distinct())
    low, high = [found.select("subject", F.col("rank").alias(r), F.col("value").alias(f"v_{r}")) for r in ("lower", "upper")]
    both = asked.join(low, ["subject", "lower"]).join(high, ["subject", "upper"])
    value = F.col("v_lower") + (F.col("v_upper") - F.col("v_lower")) * (F.col("place") - F.col("lower"))
    return both.select("subject", "p", F.round(value, 6).alias("value"))

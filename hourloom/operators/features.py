"""Strictly causal features: distances are by the clock, not by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds, monday_weekday

LAGS, MEANS = (1, 2, 24, 168), (24, 168)


def lag(k: int, value: str = "target", second: Column | None = None) -> Column:
    w = Window.partitionBy("zone").orderBy(epoch_seconds(F.col("hour")) if second is None else second).rangeBetween(-k * 3600, -k * 3600)
    return F.max(value).over(w).cast("double")


def rolling_mean(n: int, value: str = "target", second: Column | None = None) -> Column:
    """Only where all n hours have a value."""
    w = Window.partitionBy("zone").orderBy(epoch_seconds(F.col("hour")) if second is None else second).rangeBetween(-n * 3600, -3600)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def add_features(grid: DataFrame, second: Column | None = None) -> DataFrame:
    """One window operator and one sort serve all six expressions. ``second``: a stored column of epoch seconds that a table is sorted by, so that no sort is needed."""
    made = {f"lag_{k}": lag(k, second=second) for k in LAGS} | {f"mean_{n}": rolling_mean(n, second=second) for n in MEANS}
    out = grid.withColumns(made)
    complete = F.lit(True)
    for name in made:
        complete = complete & F.col(name).isNotNull()
    return out.withColumns({"hour_of_day": F.hour("hour"), "weekday": monday_weekday(F.col("hour")), "year": F.year("hour"), "features_complete": complete})


def coverage(features: DataFrame) -> DataFrame:
    ready = F.col("eligible") & F.col("features_complete")
    return features.groupBy("year").agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible_rows"), F.count_if(ready).alias("ready_rows"))

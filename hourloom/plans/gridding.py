"""Queries over grids and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import inside, stamp
from ..operators import features, grid
from ..sources.tables import DENSE, SPARSE, Plan, dense_events, sparse_events
from . import sql


def build(raw: DataFrame, plan: Plan) -> DataFrame:
    kept = raw.where(inside(F.col("pickup"), plan.start, plan.end))
    if plan.excluded:
        kept, zones = kept.where(~F.col("zone").isin(*plan.excluded)), raw.where(~F.col("zone").isin(*plan.excluded))
    else:
        zones = raw
    return grid.dense(grid.observed(kept), grid.coverage(raw, plan), zones.select("zone").distinct(), plan)


def sparse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(sparse_events(spark, sf_dir), SPARSE)


def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(dense_events(spark, sf_dir), DENSE)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_features(dense_grid(spark, sf_dir))


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Hours as text, means rounded, small integers widened."""
    kinds = dict(df.dtypes)

    def show(c: str):
        if kinds[c] == "timestamp_ntz":
            return stamp(F.col(c)).alias(c)
        return F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c)

    return df.select(*map(show, columns or df.columns))


GRID = ("zone", "hour", "recorded", "target", "q_source_missing", "q_masked_day", "q_zero", "eligible")
GRID_SQL = f"SELECT zone, {sql.stamp('hour')} AS hour, recorded, target, q_source_missing, q_masked_day, q_zero, eligible FROM grid"

QUERIES = {
    "hourly_observed": lambda s, d: shown(grid.observed(dense_events(s, d))),
    "hourly_coverage": lambda s, d: shown(grid.coverage(sparse_events(s, d), SPARSE)),
    "dense_grid": lambda s, d: shown(sparse_grid(s, d), *GRID),
    "grid_totals": lambda s, d: grid.totals(sparse_grid(s, d)),
    "grid_zone_coverage": lambda s, d: shown(grid.zone_coverage(dense_grid(s, d))),
    "missing_hours": lambda s, d: shown(grid.missing_hours(grid.coverage(sparse_events(s, d), SPARSE), SPARSE)),
    "lag_features": lambda s, d: shown(featured(s, d), "zone", "hour", "lag_1", "lag_2", "lag_24", "lag_168"),
    "rolling_means": lambda s, d: shown(featured(s, d), "zone", "hour", "mean_24", "mean_168"),
    "calendar_features": lambda s, d: shown(featured(s, d), "zone", "hour", "hour_of_day", "weekday", "year"),
    "feature_frame": lambda s, d: shown(featured(s, d)),
    "feature_coverage": lambda s, d: shown(features.coverage(featured(s, d))),
}
ORACLE_SQL = {
    "hourly_observed": f"SELECT event_type AS zone, {sql.stamp('''date_trunc('hour', ts)''')} AS hour, count(*) AS trips FROM events GROUP BY ALL",
    "hourly_coverage": f"WITH {sql.SPARSE} SELECT {sql.stamp('hour')} AS hour FROM covered",
    "dense_grid": f"WITH {sql.SPARSE} {GRID_SQL}",
    "grid_totals": f"WITH {sql.SPARSE} SELECT count(*) AS rows, count_if(q_source_missing)::BIGINT AS n_q_source_missing, count_if(q_masked_day)::BIGINT AS n_q_masked_day, count_if(q_zero)::BIGINT AS n_q_zero, count_if(eligible)::BIGINT AS n_eligible, sum(recorded)::BIGINT AS recorded, sum(target)::BIGINT AS target FROM grid",
    "grid_zone_coverage": f"WITH {sql.DENSE} SELECT zone, count(*) AS hours, {sql.stamp('min(hour)')} AS first_hour, {sql.stamp('max(hour)')} AS last_hour FROM grid GROUP BY zone",
    "missing_hours": f"WITH {sql.SPARSE} SELECT {sql.stamp('hour')} AS hour FROM axis WHERE hour NOT IN (SELECT hour FROM covered)",
    "lag_features": f"WITH {sql.DENSE} SELECT zone, {sql.stamp('hour')} AS hour, lag_1, lag_2, lag_24, lag_168 FROM feature",
    "rolling_means": f"WITH {sql.DENSE} SELECT zone, {sql.stamp('hour')} AS hour, round(mean_24, 6) AS mean_24, round(mean_168, 6) AS mean_168 FROM feature",
    "calendar_features": f"WITH {sql.DENSE} SELECT zone, {sql.stamp('hour')} AS hour, hour_of_day, weekday, year FROM feature",
    "feature_frame": f"WITH {sql.DENSE} SELECT * REPLACE ({sql.stamp('hour')} AS hour, round(mean_24, 6) AS mean_24, round(mean_168, 6) AS mean_168) FROM feature",
    "feature_coverage": f"WITH {sql.DENSE} SELECT year, count(*) AS rows, count_if(eligible)::BIGINT AS eligible_rows, count_if(eligible AND features_complete)::BIGINT AS ready_rows FROM feature GROUP BY year",
}

"""Serving queries, the keyed store and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import ntz, stamp
from ..operators import forecast as fc
from ..operators import keyed, serving
from ..sources.tables import read
from . import sql
from .forecasting import CUT, TEST, hybrid
from .gridding import GRID, GRID_SQL, dense_grid, shown, sparse_grid

RANGE = ("2024-01-10", "2024-01-14", "2024-01-02", "2024-01-28")  # asked for, held


def history(s: SparkSession, d: str) -> DataFrame:
    days = serving.check_range(*RANGE)
    return shown(serving.require_rows(serving.history(sparse_grid(s, d), 3, "2024-01-10 00:00:00", "2024-01-15 00:00:00"), 24 * days), *GRID)


def joined(s: SparkSession, d: str) -> DataFrame:
    zone = serving.history(dense_grid(s, d), "click", "2024-01-26 00:00:00", "2024-01-31 00:00:00")
    return serving.joined(zone.select("zone", "hour", "target", "eligible"), hybrid(s, d).select("zone", "hour", "prediction", "baseline"), CUT)


def table(s: SparkSession, d: str) -> DataFrame:
    return keyed.encode(sparse_grid(s, d))


def changed(s: SparkSession, d: str) -> DataFrame:
    """One day at which a zone's source is found to be missing."""
    day = sparse_grid(s, d).where((F.col("zone") == 2) & (F.to_date("hour") == F.to_date(F.lit("2024-01-05"))))
    none = F.lit(None).cast("long")
    return day.select("zone", "hour", none.alias("recorded"), none.alias("target"), F.lit(True).alias("q_source_missing"), "q_masked_day", F.lit(False).alias("q_zero"), F.lit(False).alias("eligible"))


def merged(s: SparkSession, d: str) -> DataFrame:
    changes = keyed.encode(changed(s, d))
    return keyed.upsert(keyed.upsert(table(s, d), changes), changes)


def text(df: DataFrame) -> DataFrame:
    return df.select("key", keyed.cells_text(F.col("cells")).alias("cells"))


def wanted(s: SparkSession) -> DataFrame:
    return s.range(10).select(keyed.key_of(F.col("id"), ntz("2024-01-07 12:00:00")).alias("key"))


def compared(s: SparkSession, d: str) -> DataFrame:
    """The grid against one with faults, over all its columns: keys on one side only, and the names of columns that differ."""
    grid = sparse_grid(s, d).select(*GRID)

    def fault(column: str, zone: int, hour: int, value) -> dict:
        return {column: F.when((F.col("zone") == zone) & (F.hour("hour") == hour), value).otherwise(F.col(column))}

    other = grid.where("zone <> 9").withColumns(
        fault("target", 1, 5, F.coalesce("target", F.lit(0)) + 1) | fault("recorded", 4, 7, F.lit(None).cast("long")) | fault("q_zero", 2, 6, ~F.col("q_zero"))
        | fault("q_source_missing", 2, 6, ~F.col("q_source_missing")) | fault("q_masked_day", 3, 8, F.lit(True)) | fault("eligible", 3, 8, F.lit(False))
    )
    differing = F.concat_ws(",", *[F.when(~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")), c) for c in GRID[2:]])
    both = keyed.differences(grid, other, ["zone", "hour"])
    sides = [F.coalesce(f"in_{x}", F.lit(False)).alias(f"in_{x}") for x in ("left", "right")]
    return shown(both.select("zone", "hour", *sides, F.when(F.col("in_left") & F.col("in_right"), differing).alias("differing"), "left_target", "right_target"))


def names(s: SparkSession, d: str) -> DataFrame:
    lookup = read(s, d, "nation").select("n_nationkey", "n_name")
    return serving.with_names(serving.top_zones(sparse_grid(s, d)), lookup, "n_nationkey", "n_name").select("zone", "recorded", "n_name")


def stored_forecasts(s: SparkSession, d: str) -> DataFrame:
    rows = hybrid(s, d).withColumn("origin", F.col("hour") - F.expr("INTERVAL 1 HOUR")).withColumn("model_version", F.lit("blend"))
    return keyed.encode_forecasts(rows, "blend", "2024-02-01T00:00:00Z")


def snapshot_names(s: SparkSession, d: str) -> DataFrame:
    """All zones at one hour with their names, most first."""
    lookup = read(s, d, "nation").select("n_nationkey", "n_name")
    at = serving.require_rows(serving.snapshot(sparse_grid(s, d), "2024-01-12 08:00:00"), 10)
    rows = serving.with_names(at, lookup, "n_nationkey", "n_name")
    return rows.select("zone", "n_name", "recorded", "q_masked_day", "q_source_missing").orderBy(F.desc_nulls_last("recorded"), "zone")


def ledger(s: SparkSession, d: str) -> DataFrame:
    """Forecasts of a zone's day beside what came; hours that cannot be judged stay without an actual value."""
    rows = serving.history(dense_grid(s, d), "click", "2024-01-28 00:00:00", "2024-01-30 00:00:00").select("zone", "hour", "target", "eligible", "q_masked_day", "q_source_missing")
    served = keyed.decode_forecasts(stored_forecasts(s, d)).where("zone = 'click'").drop("zone")
    return shown(rows.join(served, "hour", "left").select("hour", "origin", "prediction", "baseline", F.col("target").alias("actual"), "method", "model_version", "eligible", "q_masked_day", "q_source_missing"))


def day_metrics(s: SparkSession, d: str) -> DataFrame:
    """Errors of a zone's forecasts and of the baseline on the same rows."""
    rows = serving.evaluated(joined(s, d))
    parts = [fc.score(rows, prediction=c).withColumn("series", F.lit(c)) for c in ("prediction", "baseline")]
    return parts[0].unionByName(parts[1])


FORECAST_CELLS = {"m:horizon": "horizon", "m:method": "method", "m:mode": "mode", "m:origin": "origin", "m:version": "version", "q:complete": "complete"}
SUMMARY = "SELECT {k} AS kind, strftime(hour, '{f}') AS period, zone, sum(recorded)::BIGINT AS recorded, count(*) AS hours, count_if(q_source_missing)::BIGINT AS missing, count_if(q_masked_day)::BIGINT AS masked FROM grid GROUP BY ALL"
SUMMARIES = f"WITH {sql.SPARSE}, summary AS ({SUMMARY.format(k="'D'", f='%Y%m%d')} UNION ALL {SUMMARY.format(k="'M'", f='%Y%m')})"
BITS = {"q:eligible": "eligible", "q:masked": "q_masked_day", "q:missing": "q_source_missing", "q:zero": "q_zero"}
KEY = "lpad(zone::VARCHAR, 3, '0') || '#' || strftime(hour, '%Y%m%d%H')"
CELLS = "concat_ws(';', 'd:recorded=' || recorded, 'd:target=' || target, 'm:clock=local', 'm:version=grid_v1', " + ", ".join(f"'{k}=' || ({c})::INT" for k, c in BITS.items()) + ")"
KV = f"WITH {sql.SPARSE}, kv AS (SELECT {KEY} AS key, {CELLS} AS cells FROM grid)"
CHANGED = "CASE WHEN zone = 2 AND hour::DATE = DATE '2024-01-05' THEN concat_ws(';', 'm:clock=local', 'm:version=grid_v1', 'q:eligible=0', 'q:masked=' || q_masked_day::INT, 'q:missing=1', 'q:zero=0') ELSE " + CELLS + " END"
HYBRID = "hybrid AS (SELECT *, CASE WHEN features_complete THEN greatest(0.0, (lag_24 + mean_168) / 2) ELSE baseline END AS prediction FROM test)"
METHOD = "CASE WHEN features_complete THEN 'random_forest' ELSE 'fallback_' || method END"
JOINED = f"{TEST}, {HYBRID}, j AS (SELECT g.zone, g.hour, g.target, g.eligible, h.prediction, h.baseline FROM grid g LEFT JOIN hybrid h ON g.zone = h.zone AND g.hour = h.hour WHERE g.zone = 'click' AND g.hour >= TIMESTAMP '2024-01-26' AND g.hour < TIMESTAMP '2024-01-31')"
HEAT = ", ".join(f'round(avg(target) FILTER (hour(hour) = {h}), 6) AS "{h}"' for h in range(24))

QUERIES = {
    "period_summaries": lambda s, d: serving.summaries(sparse_grid(s, d)),
    "daily_summary": lambda s, d: serving.daily(serving.summaries(sparse_grid(s, d)), "2024-01-10", "2024-01-14", 10),
    "monthly_summary": lambda s, d: serving.monthly(serving.summaries(sparse_grid(s, d)), 1, 10),
    "zone_history": history,
    "snapshot": lambda s, d: shown(serving.require_rows(serving.snapshot(sparse_grid(s, d), "2024-01-12 08:00:00"), 10), *GRID),
    "joined_history_forecast": lambda s, d: shown(joined(s, d)),
    "evaluated_metrics": lambda s, d: fc.score(serving.evaluated(joined(s, d))),
    "top_zones": lambda s, d: serving.top_zones(sparse_grid(s, d), 5),
    "daily_trend": lambda s, d: serving.by_day(sparse_grid(s, d)),
    "monthly_trend": lambda s, d: serving.by_month(sparse_grid(s, d)),
    "weekday_hour_heatmap": lambda s, d: shown(serving.heatmap(sparse_grid(s, d))),
    "series_long": lambda s, d: shown(serving.long_form(hybrid(s, d))),
    "tail_before_target": lambda s, d: shown(serving.tail_before(dense_grid(s, d), "click", "2024-01-28 06:00:00"), *GRID),
    "zone_names_join": names,
    "forecast_encode": lambda s, d: shown(stored_forecasts(s, d).select("key", *[F.element_at("cells", F.lit(c)).alias(n) for c, n in FORECAST_CELLS.items()], F.map_keys("cells").alias("names")).withColumn("names", F.array_join("names", ","))),
    "forecast_decode": lambda s, d: shown(keyed.decode_forecasts(stored_forecasts(s, d))),
    "forecasts_range": lambda s, d: shown(serving.forecasts(keyed.decode_forecasts(stored_forecasts(s, d)), "click", "2024-01-28 00:00:00", "2024-01-29 00:00:00").select("zone", "hour", "prediction", "method")),
    "summary_encode": lambda s, d: text(keyed.encode_summaries(serving.summaries(sparse_grid(s, d)))),
    "summary_decode": lambda s, d: keyed.decode_summaries(keyed.encode_summaries(serving.summaries(sparse_grid(s, d)))),
    "served_zones": lambda s, d: read(s, d, "nation").where("n_nationkey <= 9").select(F.col("n_nationkey").cast("long").alias("zone"), F.col("n_name").alias("name")),
    "overview_headline": lambda s, d: serving.headline(serving.daily(serving.summaries(sparse_grid(s, d)), "2024-01-10", "2024-01-14", 10)),
    "map_snapshot": snapshot_names,
    "zone_compare": lambda s, d: shown(serving.compare_zones(sparse_grid(s, d), [3, 5], "2024-01-10 00:00:00", "2024-01-15 00:00:00").select("label", "hour", "recorded")),
    "zone_compare_totals": lambda s, d: serving.zone_totals(serving.compare_zones(sparse_grid(s, d), [3, 5], "2024-01-10 00:00:00", "2024-01-15 00:00:00")),
    "forecast_target_row": lambda s, d: shown(joined(s, d).where(F.col("hour") == ntz("2024-01-28 06:00:00"))),
    "forecast_ledger": ledger,
    "forecast_day_metrics": day_metrics,
    "kv_encode_hourly": lambda s, d: text(table(s, d)),
    "kv_decode_hourly": lambda s, d: shown(keyed.decode(table(s, d)), *GRID),
    "kv_range_scan": lambda s, d: text(keyed.scan(table(s, d), "004#2024010500", "004#2024010600", 24)),
    "kv_point_get": lambda s, d: text(table(s, d).where("key = '007#2024012023'")),
    "kv_multi_get": lambda s, d: text(keyed.multi_get(table(s, d), wanted(s))),
    "kv_upsert_merge": lambda s, d: text(merged(s, d)),
    "kv_fingerprint": lambda s, d: keyed.fingerprint(table(s, d), F.substring("key", 1, 3)),
    "full_outer_compare": compared,
}
ORACLE_SQL = {
    "period_summaries": f"{SUMMARIES} SELECT * FROM summary",
    "daily_summary": f"{SUMMARIES} SELECT * FROM summary WHERE kind = 'D' AND period BETWEEN '20240110' AND '20240114'",
    "monthly_summary": f"{SUMMARIES} SELECT * FROM summary WHERE kind = 'M'",
    "zone_history": f"WITH {sql.SPARSE} {GRID_SQL} WHERE zone = 3 AND grid.hour >= TIMESTAMP '2024-01-10' AND grid.hour < TIMESTAMP '2024-01-15'",
    "snapshot": f"WITH {sql.SPARSE} {GRID_SQL} WHERE grid.hour = TIMESTAMP '2024-01-12 08:00:00'",
    "joined_history_forecast": f"{JOINED} SELECT zone, {sql.stamp('hour')} AS hour, target, eligible, round(prediction, 6) AS prediction, round(baseline, 6) AS baseline FROM j",
    "evaluated_metrics": f"{JOINED}, e AS (SELECT * FROM j WHERE eligible AND target IS NOT NULL AND prediction IS NOT NULL) {sql.metrics('e', p='prediction')}",
    "top_zones": f"WITH {sql.SPARSE} SELECT zone, sum(recorded)::BIGINT AS recorded FROM grid GROUP BY zone ORDER BY 2 DESC NULLS LAST, zone LIMIT 5",
    "daily_trend": f"WITH {sql.SPARSE} SELECT strftime(hour, '%Y-%m-%d') AS day, sum(recorded)::BIGINT AS recorded FROM grid GROUP BY ALL",
    "monthly_trend": f"WITH {sql.SPARSE} SELECT strftime(hour, '%Y-%m') AS month, coalesce(sum(recorded), 0)::BIGINT AS recorded FROM grid GROUP BY ALL",
    "weekday_hour_heatmap": f"WITH {sql.SPARSE}, d AS (SELECT unnest(range(7))::BIGINT AS weekday), h AS (SELECT isodow(hour) - 1 AS weekday, {HEAT} FROM grid GROUP BY ALL) SELECT d.weekday, h.* EXCLUDE (weekday) FROM d LEFT JOIN h ON d.weekday = h.weekday",
    "series_long": f"{TEST}, {HYBRID} " + " UNION ALL ".join(f"SELECT zone, {sql.stamp('hour')} AS hour, '{c}' AS series, round({c}::DOUBLE, 6) AS value FROM hybrid" for c in ("target", "prediction", "baseline")),
    "tail_before_target": f"WITH {sql.DENSE} {GRID_SQL} WHERE zone = 'click' AND grid.hour < TIMESTAMP '2024-01-28 06:00:00' ORDER BY grid.hour DESC LIMIT 24",
    "zone_names_join": f"WITH {sql.SPARSE} SELECT zone, recorded, n_name FROM (SELECT zone, sum(recorded)::BIGINT AS recorded FROM grid GROUP BY zone ORDER BY 2 DESC NULLS LAST, zone LIMIT 10) LEFT JOIN nation ON zone = n_nationkey",
    "forecast_encode": f"{TEST}, {HYBRID} SELECT zone || '#' || strftime(hour, '%Y%m%d%H') || '#blend#1' AS key, '1' AS horizon, {METHOD} AS method, 'replay' AS mode, strftime(hour - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS origin, 'blend' AS version, features_complete::INT::VARCHAR AS complete, 'm:built,m:horizon,m:method,m:mode,m:origin,m:version,p:baseline,p:value,q:complete' AS names FROM hybrid",
    "forecast_decode": f"{TEST}, {HYBRID} SELECT zone, {sql.stamp('hour')} AS hour, round(prediction, 6) AS prediction, round(baseline, 6) AS baseline, {METHOD} AS method, features_complete, 'blend' AS model_version, {sql.stamp('hour - INTERVAL 1 HOUR')} AS origin FROM hybrid",
    "forecasts_range": f"{TEST}, {HYBRID} SELECT zone, {sql.stamp('hour')} AS hour, round(prediction, 6) AS prediction, {METHOD} AS method FROM hybrid WHERE zone = 'click' AND hybrid.hour >= TIMESTAMP '2024-01-28' AND hybrid.hour < TIMESTAMP '2024-01-29'",
    "summary_encode": f"{SUMMARIES} SELECT kind || '#' || period || '#' || lpad(zone::VARCHAR, 3, '0') AS key, 'd:summary={{\"hours\":' || hours || ',\"masked\":' || masked || ',\"missing\":' || missing || ',\"period\":\"' || period || '\",\"recorded\":' || coalesce(recorded::VARCHAR, 'null') || ',\"zone\":' || zone || '}};m:version=summary_v1' AS cells FROM summary",
    "summary_decode": f"{SUMMARIES} SELECT * FROM summary",
    "served_zones": "SELECT n_nationkey::BIGINT AS zone, n_name AS name FROM nation WHERE n_nationkey <= 9",
    "overview_headline": f"{SUMMARIES}, x AS (SELECT * FROM summary WHERE kind = 'D' AND period BETWEEN '20240110' AND '20240114') SELECT sum(recorded)::BIGINT AS total, round(sum(recorded) / count(DISTINCT period), 6) AS mean_a_day, sum(missing)::BIGINT AS missing, (SELECT zone FROM x GROUP BY zone ORDER BY sum(recorded) DESC NULLS LAST, zone LIMIT 1) AS top_zone FROM x",
    "map_snapshot": f"WITH {sql.SPARSE} SELECT zone, n_name, recorded, q_masked_day, q_source_missing FROM grid LEFT JOIN nation ON zone = n_nationkey WHERE hour = TIMESTAMP '2024-01-12 08:00:00'",
    "zone_compare": f"WITH {sql.SPARSE} SELECT zone::VARCHAR AS label, {sql.stamp('hour')} AS hour, recorded FROM grid WHERE zone IN (3, 5) AND grid.hour >= TIMESTAMP '2024-01-10' AND grid.hour < TIMESTAMP '2024-01-15'",
    "zone_compare_totals": f"WITH {sql.SPARSE} SELECT zone, sum(recorded)::BIGINT AS recorded, count_if(q_source_missing)::BIGINT AS missing, count_if(q_masked_day)::BIGINT AS masked FROM grid WHERE zone IN (3, 5) AND hour >= TIMESTAMP '2024-01-10' AND hour < TIMESTAMP '2024-01-15' GROUP BY zone",
    "forecast_target_row": f"{JOINED} SELECT zone, {sql.stamp('hour')} AS hour, target, eligible, round(prediction, 6) AS prediction, round(baseline, 6) AS baseline FROM j WHERE j.hour = TIMESTAMP '2024-01-28 06:00:00'",
    "forecast_ledger": f"{TEST}, {HYBRID} SELECT {sql.stamp('g.hour')} AS hour, {sql.stamp('h.hour - INTERVAL 1 HOUR')} AS origin, round(h.prediction, 6) AS prediction, round(h.baseline, 6) AS baseline, g.target AS actual, CASE WHEN h.features_complete THEN 'random_forest' ELSE 'fallback_' || h.method END AS method, CASE WHEN h.hour IS NOT NULL THEN 'blend' END AS model_version, g.eligible, g.q_masked_day, g.q_source_missing FROM grid g LEFT JOIN hybrid h ON g.zone = h.zone AND g.hour = h.hour WHERE g.zone = 'click' AND g.hour >= TIMESTAMP '2024-01-28' AND g.hour < TIMESTAMP '2024-01-30'",
    "forecast_day_metrics": f"{JOINED}, e AS (SELECT * FROM j WHERE eligible AND target IS NOT NULL AND prediction IS NOT NULL) " + " UNION ALL ".join(f"SELECT *, '{c}' AS series FROM ({sql.metrics('e', p=c)})" for c in ("prediction", "baseline")),
    "kv_encode_hourly": f"{KV} SELECT * FROM kv",
    "kv_decode_hourly": f"WITH {sql.SPARSE} {GRID_SQL}",
    "kv_range_scan": f"{KV} SELECT * FROM kv WHERE key >= '004#2024010500' AND key < '004#2024010600'",
    "kv_point_get": f"{KV} SELECT * FROM kv WHERE key = '007#2024012023'",
    "kv_multi_get": f"{KV} SELECT * FROM kv WHERE key LIKE '%#2024010712'",
    "kv_upsert_merge": f"WITH {sql.SPARSE} SELECT {KEY} AS key, {CHANGED} AS cells FROM grid",
    "kv_fingerprint": f"{KV}, c AS (SELECT key, list_sort(string_split(cells, ';')) AS cells FROM kv), r AS (SELECT substr(key, 1, 3) AS part, sha256(length(key) || ':' || key || array_to_string(list_transform(cells, lambda x: length(split_part(x, '=', 1)) || ':' || split_part(x, '=', 1) || length(split_part(x, '=', 2)) || ':' || split_part(x, '=', 2)), '')) AS h FROM c) SELECT part, count(*) AS rows, sum(('0x' || substr(h, 1, 14))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr(h, 15, 14))::BIGINT)::VARCHAR AS fingerprint FROM r GROUP BY part",
    "full_outer_compare": f"""WITH {sql.SPARSE}, g AS (SELECT *, hour(grid.hour) AS h FROM grid), o AS (SELECT *, CASE WHEN zone = 9 THEN NULL ELSE concat_ws(',', CASE WHEN zone = 4 AND h = 7 AND recorded IS NOT NULL THEN 'recorded' END, CASE WHEN zone = 1 AND h = 5 THEN 'target' END,
        CASE WHEN zone = 2 AND h = 6 THEN 'q_source_missing' END, CASE WHEN zone = 3 AND h = 8 AND NOT q_masked_day THEN 'q_masked_day' END, CASE WHEN zone = 2 AND h = 6 THEN 'q_zero' END, CASE WHEN zone = 3 AND h = 8 AND eligible THEN 'eligible' END) END AS differing FROM g)
        SELECT zone, {sql.stamp('hour')} AS hour, true AS in_left, zone <> 9 AS in_right, differing, target AS left_target, CASE WHEN zone = 9 THEN NULL WHEN zone = 1 AND h = 5 THEN coalesce(target, 0) + 1 ELSE target END AS right_target FROM o WHERE zone = 9 OR differing <> ''""",
}

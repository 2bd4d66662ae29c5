"""Queries that write and read back: manifests, sinks, the store's verification, acceptance."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import clock_change, inside, stamp
from ..operators import checks, clean, grid, keyed, serving
from ..operators import forecast as fc
from ..sources import bucketed, files
from ..sources.shared import shared_dir, written
from ..sources.tables import SPARSE, TRIPS, dense_events, read, sparse_events
from . import sql
from .cleaning import classed
from .forecasting import TEST, candidate_sql, hybrid
from .gridding import GRID, GRID_SQL, build, dense_grid, featured, shown, sparse_grid
from .serving import HYBRID, KV, SUMMARIES, table, text

HOURS = 27 * 24
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def zones(s: SparkSession, d: str) -> DataFrame:
    """Zones of the sparse grid: those that are not excluded."""
    return sparse_events(s, d).where(~F.col("zone").isin(*SPARSE.excluded)).select("zone").distinct()


def yearly_files(s: SparkSession, d: str) -> tuple[str, list[str]]:
    """Order lines in a folder for each year, older ones without the discount and under another name; their manifests. A write for each layout and one count for all."""
    home, manifests = shared_dir(s, "manifests"), []
    lines = read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_orderdate").cast("timestamp_ntz").alias("pickup"), "l_quantity", "l_discount")
    held = written(lines.withColumn("year", F.year("pickup")))
    layouts = {"old": held.where("year < 1996").drop("l_discount").withColumnRenamed("l_quantity", "quantity"), "new": held.where("year >= 1996")}
    for name, rows in layouts.items():
        files.write_new(rows, f"{home}/{name}", "year")
    for row in held.groupBy("year").agg(F.count("*").alias("n")).orderBy("year").collect():  # a row for each year
        name = "old" if row["year"] < 1996 else "new"
        schema = layouts[name].drop("year").schema.jsonValue()
        manifests.append(f"{home}/{row['year']}.json")
        files.write_manifest(s, manifests[-1], True, files=[{"period": str(row["year"]), "path": f"{home}/{name}/year={row['year']}", "rows": row["n"], "schema": schema}])
    return home, manifests


def manifest_trips(s: SparkSession, d: str) -> DataFrame:
    _, manifests = yearly_files(s, d)
    schema = T.StructType.fromDDL("l_orderkey long, l_linenumber int, pickup timestamp_ntz, l_quantity double, l_discount double")
    kinds = dict(read(s, d, "lineitem").dtypes)
    schema = T.StructType([T.StructField(f.name, f.dataType if f.name == "pickup" else T._parse_datatype_string(kinds[f.name])) for f in schema])
    rows = files.open_listed(s, files.listed(s, manifests), schema, aliases={"quantity": "l_quantity"}, optional=("l_discount",))
    return rows.groupBy(F.year("pickup").cast("long").alias("year")).agg(F.count("*").alias("n"), F.count("l_discount").alias("discounts"), F.round(F.sum("l_quantity"), 4).cast("double").alias("quantity"))


def manifest_extra(s: SparkSession, d: str) -> DataFrame:
    """Rows by year of the files of all manifests but the last and, beside them, the last year's file by its path; a period twice would be an error."""
    _, manifests = yearly_files(s, d)
    last = files.listed(s, manifests[-1:])
    schema = T.StructType.fromDDL("l_orderkey long, l_linenumber int, pickup timestamp_ntz")
    both = files.listed(s, manifests[:-1], {f["period"]: f["path"] for f in last})
    rows = [x.select(*schema.names) for x in (s.read.schema(layout).parquet(*paths) for layout, paths in files.by_layout(s, both))]
    return reduce(DataFrame.unionByName, rows).groupBy(F.date_format("pickup", "yyyy").alias("period")).agg(F.count("*").alias("n"))


def manifest_grid(s: SparkSession, d: str) -> DataFrame:
    home = shared_dir(s, "grid")
    rows = sparse_grid(s, d)
    files.write_sorted(rows, f"{home}/grid", "zone", ["zone", "hour"])
    back = s.read.parquet(f"{home}/grid")
    files.write_manifest(s, f"{home}/audit.json", True, files=[{"period": "2024-01", "path": f"{home}/grid", "rows": back.count()}])
    return grid.totals(files.open_listed(s, files.listed(s, [f"{home}/audit.json"]), rows.schema))


def csv_observed(s: SparkSession, d: str) -> DataFrame:
    path = shared_dir(s, "csv")
    counts = grid.observed(dense_events(s, d))
    files.write_csv(counts, path)
    back = s.read.schema("zone string, hour timestamp_ntz, trips long").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return shown(back)


def csv_lookup(s: SparkSession, d: str) -> DataFrame:
    """A lookup as spreadsheets write it, with a byte order mark."""
    path = f"{shared_dir(s, 'lookup')}/nation.csv"
    files.export_csv(read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), path)
    return files.lookup_csv(s, path, "id long, name string", "id")


def partitioned_features(s: SparkSession, d: str) -> DataFrame:
    """Features dealt by zone, sorted, in a folder for each day; two days are read back."""
    path = shared_dir(s, "features")
    files.write_sorted(featured(s, d).withColumn("day", F.date_format("hour", "yyyy-MM-dd")), path, "zone", ["zone", "hour"], "day")
    return shown(s.read.parquet(path).where(F.col("day").cast("string").isin("2024-01-10", "2024-01-20")).select("zone", "hour", "lag_1", "mean_24"))


def file_manifest(s: SparkSession, d: str) -> DataFrame:
    """Name, size, checksum and rows of the input files."""
    facts = files.file_facts(s, f"{d}/{{{','.join(t + '.parquet' for t in TABLES)}}}")
    counts = s.createDataFrame([(f"{t}.parquet", read(s, d, t).count()) for t in TABLES], "name string, rows long")  # a row for each table
    return facts.join(counts, "name")


def split_sink(s: SparkSession, d: str) -> DataFrame:
    path = shared_dir(s, "split")
    files.write_split(classed(s, d), path)
    return s.read.parquet(path).groupBy("disposition", "reason").agg(F.count("*").alias("n"))


def period_overwrite(s: SparkSession, d: str) -> DataFrame:
    """Daily sums by folders; one day is written anew, the others stay."""
    path = shared_dir(s, "periods")
    days = serving.summaries(sparse_grid(s, d)).where("kind = 'D'").select("zone", "recorded", F.concat(F.lit("d"), "period").alias("period"))
    files.replace_periods(days, path, "period")
    files.replace_periods(days.where("period = 'd20240105'").withColumn("recorded", F.lit(-1).cast("long")), path, "period")
    return s.read.parquet(path).groupBy("period").agg(F.count("*").alias("n"), F.sum("recorded").alias("recorded"))


def summary_snapshot(s: SparkSession, d: str) -> DataFrame:
    """Summaries sorted in small row groups for bounded reads."""
    path = shared_dir(s, "snapshot")
    files.write_sorted(serving.summaries(sparse_grid(s, d)), path, "kind", ["kind", "period", "zone"], row_group_bytes=1 << 20)
    return s.read.parquet(path).orderBy("kind", "period", "zone")


def audit_json(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s, 'audit')}/audit.json"
    counts = checks.conserved(clean.disposition_counts(classed(s, d)), "raw", ("outside_interval", "excluded_zone", "nonpositive_duration", "retained"))
    files.write_manifest(s, path, True, totals=counts.first().asDict())
    back = json.loads(files.read_text(s, path))["totals"]
    return s.createDataFrame([back], ", ".join(f"{k} long" for k in sorted(back)))


def monthly_parts(s: SparkSession, d: str) -> list[DataFrame]:
    whole = sparse_grid(s, d)
    return [keyed.encode(whole.where(inside(F.col("hour"), a, b))) for a, b in (("2024-01-02 00:00:00", "2024-01-10 00:00:00"), ("2024-01-10 00:00:00", "2024-01-20 00:00:00"), ("2024-01-20 00:00:00", "2024-01-29 00:00:00"))]


def store_matches_source(s: SparkSession, d: str) -> DataFrame:
    """Cells of the stored table against those of a merge of its sorted parts: rows of both, rows that differ."""
    path = shared_dir(s, "store")
    files.write_sorted(table(s, d), path, "key", ["key"])
    stored, source = text(s.read.parquet(path)), text(keyed.merged(monthly_parts(s, d)))
    return keyed.differences(stored, source, ["key"]).agg(F.count("*").alias("differing")).crossJoin(stored.agg(F.count("*").alias("rows")))


def backup_equal(s: SparkSession, d: str) -> DataFrame:
    """A table, its backup and what is restored from it have one fingerprint."""
    home = shared_dir(s, "backup")
    files.write_new(table(s, d), f"{home}/live")
    files.write_new(s.read.parquet(f"{home}/live"), f"{home}/backup")
    files.write_new(s.read.parquet(f"{home}/backup"), f"{home}/restored")
    prints = [keyed.fingerprint(s.read.parquet(f"{home}/{x}")).withColumn("x", F.lit(x)) for x in ("live", "backup", "restored")]
    both = prints[0].unionByName(prints[1]).unionByName(prints[2])
    return both.agg(F.max("rows").alias("rows"), F.count_distinct("fingerprint").alias("fingerprints"))


def readiness(s: SparkSession, d: str) -> DataFrame:
    whole = sparse_grid(s, d)
    path = shared_dir(s, "store")
    files.write_sorted(table(s, d), path, "key", ["key"])
    points = checks.edge_points(whole, (2024,), (1, 7), SPARSE.start, SPARSE.end)
    return checks.readiness(whole, s.read.parquet(path), points, "007#2024010200", "007#2024010300")


def resumed(s: SparkSession, d: str) -> DataFrame:
    """A step that runs once and is found done the second time."""
    folder, ran = shared_dir(s, "step"), []

    def run(path: str) -> None:
        ran.append(path)
        files.write_new(serving.by_day(sparse_grid(s, d)), path)

    reports = [checks.resume(s, folder, f"{d}/events.parquet", run) for _ in range(2)]
    rows = s.read.parquet(f"{folder}/data").count()
    return s.createDataFrame([(len(ran), reports[0] == reports[1], rows)], "runs long, same boolean, rows long")


def selection_lock(s: SparkSession, d: str) -> DataFrame:
    """The best candidate, locked with its context; a second lock of the same context gives the first one back."""
    from .forecasting import ranking, selection_context

    path, best = f"{shared_dir(s, 'lock')}/selection.json", ranking(s, d).where("place = 1").first().asDict()
    context = selection_context(s, d)
    locked = [checks.lock(s, path, context, x) for x in (best, {})]
    r = locked[1]["result"]
    return s.createDataFrame([(r["model"], r["history"], r["n"], locked[0] == locked[1])], "model string, history string, n long, same boolean")


def status(s: SparkSession, d: str) -> DataFrame:
    home = shared_dir(s, "serving")
    files.write_new(table(s, d), f"{home}/hourly")
    files.write_new(keyed.encode_summaries(serving.summaries(sparse_grid(s, d))), f"{home}/summary")
    files.write_manifest(s, f"{home}/accepted.json", True)
    return checks.tables_ready(s, home, ("hourly", "summary"))


def forecast_store(s: SparkSession, d: str) -> DataFrame:
    """Forecasts loaded into a stored table, twice (the second load changes nothing), checked for their cells and read back."""
    rows = forecast_table(s, d)
    stored = bucketed.store(rows, "key", ["key"], name="forecasts")
    again = bucketed.store(keyed.upsert(stored, rows), "key", ["key"], name="forecasts")
    back = keyed.decode_forecasts(keyed.require_cells(again, keyed.FORECAST_CELLS))
    return shown(back.select("zone", "hour", "origin", "prediction", "baseline", "method", "features_complete", "model_version"))


def preflight(s: SparkSession, d: str) -> DataFrame:
    types = {"zone": "bigint", "hour": "timestamp_ntz", "recorded": "bigint", "target": "bigint", "q_source_missing": "boolean", "q_masked_day": "boolean", "q_zero": "boolean", "eligible": "boolean"}
    return s.createDataFrame([(checks.preflight(sparse_grid(s, d), types),)], "rows long")


def forecast_table(s: SparkSession, d: str) -> DataFrame:
    rows = hybrid(s, d).withColumn("origin", F.col("hour") - F.expr("INTERVAL 1 HOUR")).withColumn("model_version", F.lit("blend"))
    return keyed.encode_forecasts(rows, "blend", "2024-02-01T00:00:00Z")


def acceptance(s: SparkSession, d: str) -> DataFrame:
    """For three zones on two days: served forecasts against their source, one to one: rows, rows that differ, error sums of both."""
    source = hybrid(s, d).where(inside(F.col("hour"), "2024-01-28 00:00:00", "2024-01-31 00:00:00"))
    served = keyed.decode_forecasts(forecast_table(s, d))
    a = source.select("zone", "hour", "target", F.col("prediction").alias("p1"), F.col("baseline").alias("b1"))
    both = checks.one_to_one(a, served.select("zone", "hour", F.col("prediction").alias("p2"), F.col("baseline").alias("b2")), ["zone", "hour"])
    differs = ~(F.col("p1").eqNullSafe(F.col("p2")) & F.col("b1").eqNullSafe(F.col("b2")))
    day = F.date_format("hour", "yyyy-MM-dd").alias("day")
    return both.groupBy("zone", day).agg(F.count("*").alias("n"), F.count_if(differs).alias("differing"), F.round(F.avg(F.abs(F.col("p2") - F.col("target"))), 6).alias("mae"))


def changes_of_clocks(s: SparkSession, d: str) -> DataFrame:
    years = s.range(2023, 2026).select(F.col("id").alias("year"))
    return years.select("year", F.date_format(clock_change(F.col("year"), True), "yyyy-MM-dd").alias("spring"), F.date_format(clock_change(F.col("year"), False), "yyyy-MM-dd").alias("autumn"))


def split_roles(s: SparkSession, d: str) -> DataFrame:
    """Rows of every role of every history and fold."""
    frame = featured(s, d)
    spans = [(h, role, fold, *fc.role_span(h, role, fold)) for h in fc.HISTORIES for role in fc.ROLES for fold in (range(len(fc.FOLDS)) if role in ("train", "validation") else (0,))]
    roles = s.createDataFrame(spans, "history string, role string, fold long, a string, b string")  # a row for each role
    rows = frame.where("eligible").select(stamp(F.col("hour")).alias("at"))
    return roles.join(rows, (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b")), "left").groupBy("history", "role", "fold").agg(F.count("at").alias("n"))


def deterministic_sample(s: SparkSession, d: str) -> DataFrame:
    return shown(hybrid(s, d).orderBy("zone", "hour").limit(100).select("zone", "hour", "target", "baseline"))


def observed_ranks(s: SparkSession, d: str) -> DataFrame:
    """Observed hours in the order of zone and hour; a zone's places are one window."""
    at = F.row_number().over(Window.partitionBy("zone").orderBy("hour"))
    return shown(grid.observed(sparse_events(s, d)).select("zone", "hour", "trips", at.cast("long").alias("place")))


ZERO = ("unknown_zone", "outside_interval", "off_the_hour", "wrong_mask", "wrong_eligible", "wrong_missing", "wrong_target_null", "wrong_target", "negative", "wrong_zero", "repeated", "zones_out_of_place", "absent_zones")
DISPOSITION = "CASE WHEN reason IS NULL THEN 'retained' WHEN reason LIKE 'pickup%' THEN 'outside_interval' WHEN reason LIKE 'excluded%' THEN 'excluded_zone' ELSE 'nonpositive_duration' END"
TOTALS = "SELECT count(*) AS rows, count_if(q_source_missing)::BIGINT AS n_q_source_missing, count_if(q_masked_day)::BIGINT AS n_q_masked_day, count_if(q_zero)::BIGINT AS n_q_zero, count_if(eligible)::BIGINT AS n_eligible, sum(recorded)::BIGINT AS recorded, sum(target)::BIGINT AS target FROM grid"
YEARLY = "SELECT year(o_orderdate) AS year, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

QUERIES = {
    "grid_acceptance": lambda s, d: checks.grid_acceptance(sparse_grid(s, d), SPARSE, zones(s, d), HOURS),
    "grid_sums_agree": lambda s, d: checks.sums_agree(build(sparse_events(s, d), SPARSE), sparse_events(s, d).where(inside(F.col("pickup"), SPARSE.start, SPARSE.end) & ~F.col("zone").isin(*SPARSE.excluded))),
    "row_conservation": lambda s, d: checks.conserved(clean.disposition_counts(classed(s, d)), "raw", ("outside_interval", "excluded_zone", "nonpositive_duration", "retained")),
    "clock_change_days": changes_of_clocks,
    "split_roles": split_roles,
    "deterministic_sample": deterministic_sample,
    "observed_places": observed_ranks,
    "manifest_trips": manifest_trips,
    "manifest_extra": manifest_extra,
    "manifest_grid": manifest_grid,
    "csv_observed": csv_observed,
    "csv_lookup": csv_lookup,
    "partitioned_features": partitioned_features,
    "file_manifest": file_manifest,
    "split_sink": split_sink,
    "period_overwrite": period_overwrite,
    "summary_snapshot": summary_snapshot,
    "audit_json": audit_json,
    "kv_full_scan": lambda s, d: text(table(s, d)).orderBy("key"),
    "kv_merge_sorted": lambda s, d: text(keyed.merged(monthly_parts(s, d))),
    "kv_year_totals": lambda s, d: keyed.year_totals(table(s, d)),
    "kv_store_matches_source": store_matches_source,
    "kv_backup_equal": backup_equal,
    "kv_readiness": readiness,
    "step_resumed": resumed,
    "selection_lock": selection_lock,
    "serving_status": status,
    "kv_forecast_store": forecast_store,
    "grid_preflight": preflight,
    "worker_smoke": lambda s, d: s.createDataFrame([(checks.worker_smoke(s),)], "total long"),
    "forecast_acceptance": acceptance,
    "edge_hours": lambda s, d: shown(checks.edge_points(dense_grid(s, d), (2024,), ("click", "view"), "2024-01-01 00:00:00", "2024-01-31 00:00:00"), *GRID),
}
ORACLE_SQL = {
    "grid_acceptance": "SELECT " + ", ".join(f"0::BIGINT AS {c}" for c in ZERO),
    "grid_sums_agree": f"WITH {sql.SPARSE} SELECT (SELECT coalesce(sum(recorded), 0)::BIGINT FROM grid) AS grid_sum, (SELECT count(*) FROM inside WHERE zone NOT IN (10, 11)) AS retained, true AS equal",
    "row_conservation": f"WITH {sql.TRIP} SELECT count(*) AS raw, count_if(reason LIKE 'pickup%')::BIGINT AS outside_interval, count_if(reason LIKE 'excluded%')::BIGINT AS excluded_zone, count_if(reason LIKE '%duration')::BIGINT AS nonpositive_duration, count_if(reason IS NULL)::BIGINT AS retained FROM classed",
    "clock_change_days": "SELECT * FROM (VALUES (2023::BIGINT, '2023-03-12', '2023-11-05'), (2024, '2024-03-10', '2024-11-03'), (2025, '2025-03-09', '2025-11-02')) t(year, spring, autumn)",
    "split_roles": f"""WITH {sql.DENSE}, roles AS (SELECT * FROM (VALUES {', '.join(f"('{h}', '{r}', {k}::BIGINT, TIMESTAMP '{a}', TIMESTAMP '{b}')" for h, start in (('A', '2024-01-08 00:00:00'), ('B', '2024-01-01 00:00:00')) for r, k, a, b in (
        *(('train', k, start, f'2024-01-{19 + 3 * k} 00:00:00') for k in range(3)), *(('validation', k, f'2024-01-{19 + 3 * k} 00:00:00', f'2024-01-{22 + 3 * k} 00:00:00') for k in range(3)), ('final_train', 0, start, '2024-01-28 00:00:00'), ('test', 0, '2024-01-28 00:00:00', '2024-01-31 00:00:00')))}) t(history, role, fold, a, b))
        SELECT history, role, fold, count(hour) AS n FROM roles LEFT JOIN feature ON eligible AND hour >= a AND hour < b GROUP BY ALL""",
    "deterministic_sample": f"WITH {sql.DENSE}, {sql.train('2024-01-01 00:00:00', '2024-01-28 00:00:00')} SELECT zone, {sql.stamp('hour')} AS hour, target, round(baseline, 6) AS baseline FROM based WHERE eligible AND based.hour >= TIMESTAMP '2024-01-28' AND based.hour < TIMESTAMP '2024-01-31' ORDER BY zone, based.hour LIMIT 100",
    "observed_places": f"WITH {sql.SPARSE}, o AS (SELECT zone, hour, count(*) AS trips FROM raw GROUP BY ALL) SELECT zone, {sql.stamp('hour')} AS hour, trips, row_number() OVER (PARTITION BY zone ORDER BY o.hour) AS place FROM o",
    "manifest_trips": f"WITH y AS ({YEARLY}) SELECT year, count(*) AS n, CASE WHEN year < 1996 THEN 0 ELSE count(l_discount) END AS discounts, round(sum(l_quantity), 4)::DOUBLE AS quantity FROM y GROUP BY year",
    "manifest_extra": f"WITH y AS ({YEARLY}) SELECT year::VARCHAR AS period, count(*) AS n FROM y GROUP BY year",
    "manifest_grid": f"WITH {sql.SPARSE} {TOTALS}",
    "csv_observed": f"SELECT event_type AS zone, {sql.stamp('''date_trunc('hour', ts)''')} AS hour, count(*) AS trips FROM events GROUP BY ALL",
    "csv_lookup": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation",
    "partitioned_features": f"WITH {sql.DENSE} SELECT zone, {sql.stamp('hour')} AS hour, lag_1, round(mean_24, 6) AS mean_24 FROM feature WHERE feature.hour::DATE IN (DATE '2024-01-10', DATE '2024-01-20')",
    "split_sink": f"WITH {sql.TRIP} SELECT {DISPOSITION} AS disposition, reason, count(*) AS n FROM classed GROUP BY ALL",
    "period_overwrite": f"{SUMMARIES} SELECT 'd' || period AS period, count(*) AS n, CASE WHEN period = '20240105' THEN -count(*) ELSE sum(recorded)::BIGINT END AS recorded FROM summary WHERE kind = 'D' GROUP BY summary.period",
    "summary_snapshot": f"{SUMMARIES} SELECT * FROM summary",
    "audit_json": f"WITH {sql.TRIP} SELECT count(*) AS raw, count_if(reason LIKE 'pickup%')::BIGINT AS outside_interval, count_if(reason LIKE 'excluded%')::BIGINT AS excluded_zone, count_if(reason LIKE '%duration')::BIGINT AS nonpositive_duration, count_if(reason IS NULL)::BIGINT AS retained FROM classed",
    "kv_full_scan": f"{KV} SELECT * FROM kv",
    "kv_merge_sorted": f"{KV} SELECT * FROM kv",
    "kv_year_totals": f"WITH {sql.SPARSE} SELECT strftime(hour, '%Y') AS year, count(*) AS rows, coalesce(sum(recorded), 0)::BIGINT AS recorded, coalesce(sum(target), 0)::BIGINT AS target, count_if(q_source_missing)::BIGINT AS missing, count_if(q_masked_day)::BIGINT AS masked, count_if(q_zero)::BIGINT AS zero, count_if(eligible)::BIGINT AS eligible FROM grid GROUP BY ALL",
    "kv_store_matches_source": f"{KV} SELECT 0::BIGINT AS differing, count(*) AS rows FROM kv",
    "kv_backup_equal": f"{KV} SELECT count(*) AS rows, 1::BIGINT AS fingerprints FROM kv",
    "kv_readiness": f"WITH {sql.SPARSE} SELECT 0::BIGINT AS point_mismatches, (SELECT count(*) FROM grid WHERE zone IN (1, 7) AND hour IN (TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28 23:00:00')) AS point_rows, 0::BIGINT AS range_mismatches, (SELECT count(*) FROM grid WHERE zone = 7 AND hour::DATE = DATE '2024-01-02') AS range_rows",
    "step_resumed": f"WITH {sql.SPARSE} SELECT 1::BIGINT AS runs, true AS same, count(DISTINCT hour::DATE) AS rows FROM grid",
    "serving_status": f"{SUMMARIES}, k AS (SELECT 'hourly' AS name, lpad(zone::VARCHAR, 3, '0') || '#' || strftime(hour, '%Y%m%d%H') AS key FROM grid UNION ALL SELECT 'summary', kind || '#' || period || '#' || lpad(zone::VARCHAR, 3, '0') FROM summary) SELECT name, true AS ready, count(*) AS rows, min(key) AS first_key, max(key) AS last_key FROM k GROUP BY name",
    "kv_forecast_store": f"{TEST}, {HYBRID} SELECT zone, {sql.stamp('hour')} AS hour, {sql.stamp("hour - INTERVAL 1 HOUR")} AS origin, round(prediction, 6) AS prediction, round(baseline, 6) AS baseline, CASE WHEN features_complete THEN 'random_forest' ELSE 'fallback_' || method END AS method, features_complete, 'blend' AS model_version FROM hybrid",
    "grid_preflight": f"WITH {sql.SPARSE} SELECT count(*) AS rows FROM grid",
    "worker_smoke": "SELECT sum(2 * i)::BIGINT AS total FROM range(1000) t(i)",
    "forecast_acceptance": f"{TEST}, {HYBRID} SELECT zone, strftime(hour, '%Y-%m-%d') AS day, count(*) AS n, 0::BIGINT AS differing, round(avg(abs(prediction - target)), 6) AS mae FROM hybrid GROUP BY ALL",
    "selection_lock": f"{candidate_sql()} SELECT model, history, n, true AS same FROM m ORDER BY mae, (model <> 'naive')::INT, (history <> 'A')::INT, depth LIMIT 1",
    "edge_hours": f"WITH {sql.DENSE} {GRID_SQL} WHERE zone IN ('click', 'view') AND grid.hour IN (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00')",
}

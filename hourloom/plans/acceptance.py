"""Queries over hours without a source, and checks that are shown faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds
from ..operators import checks, features, grid, keyed, serving
from ..operators import forecast as fc
from ..sources import files
from ..sources.shared import shared_dir, written
from ..sources.tables import GAPPED, SPARSE, gapped_events
from . import sql
from .gridding import GRID, GRID_SQL, build, shown, sparse_grid
from .lifecycle import HOURS, zones
from .serving import KV, SUMMARIES, table


HALF = "1997-03-15 00:00:00"


def gapped_grid(s: SparkSession, d: str) -> DataFrame:
    return build(gapped_events(s, d), GAPPED)


def state() -> Column:
    """What a cell is: missing, masked (with a source), zero or counted."""
    return F.when(F.col("q_source_missing"), "missing").when(F.col("q_masked_day"), "masked").when(F.col("q_zero"), "zero").otherwise("counted")


def transitions(s: SparkSession, d: str) -> DataFrame:
    """How often a zone goes from one state to another from a day's first hour to the hour after, and to the next day's first hour."""
    rows = gapped_grid(s, d).select("zone", "hour", state().alias("state"))
    in_order = Window.partitionBy("zone").orderBy(epoch_seconds(F.col("hour")))
    steps = rows.select("state", F.lead("state", 1).over(in_order).alias("hour_after"), F.lead("state", 24).over(in_order).alias("day_after"))
    return steps.groupBy("state", "hour_after", "day_after").agg(F.count("*").alias("n"))


def gapped_baseline(s: SparkSession, d: str) -> DataFrame:
    """Baselines of the second half of the month by method and demand: last week's hour is masked for one day, and one zone was not trained on, so all three levels are there."""
    frame = features.add_features(gapped_grid(s, d))
    train = fc.labelled(frame, GAPPED.start, HALF).where("zone <> 5")
    rows = fc.labelled(fc.baseline(frame, fc.zone_means(train), fc.global_mean(train)), HALF, GAPPED.end)
    return rows.groupBy("method", fc.demand_group(F.col("zone_mean")).alias("demand")).agg(F.count("*").alias("n"), F.round(F.sum("baseline"), 6).alias("baseline"), F.round(F.sum(F.abs(F.col("baseline") - F.col("target"))), 6).alias("error"))


def faulty_grid(s: SparkSession, d: str) -> DataFrame:
    """The grid with faults: a day of zone 3 is lost, one of zone 4 is there twice, zone 5 is not masked, zone 6 counts -1 at noon, zone 7 is missing at noon but has a count, and zone 99 is unknown."""
    rows = sparse_grid(s, d)
    day = lambda zone, text: (F.col("zone") == zone) & (F.date_format("hour", "yyyy-MM-dd") == text)
    noon = F.hour("hour") == 12
    wrong = rows.where(~day(3, "2024-01-05")).withColumns({
        "q_masked_day": F.when(F.col("zone") == 5, F.lit(False)).otherwise(F.col("q_masked_day")),
        "recorded": F.when((F.col("zone") == 6) & noon, F.lit(-1).cast("long")).otherwise(F.col("recorded")),
        "q_source_missing": F.when((F.col("zone") == 7) & noon, F.lit(True)).otherwise(F.col("q_source_missing")),
    })
    return wrong.unionByName(rows.where(day(4, "2024-01-06"))).unionByName(rows.where(day(2, "2024-01-07")).withColumn("zone", F.lit(99).cast("long")))


def served_summaries(s: SparkSession, d: str) -> DataFrame:
    """Daily and monthly sums as they come back from the stored table."""
    path = shared_dir(s, "summaries")
    files.write_new(keyed.encode_summaries(serving.summaries(sparse_grid(s, d))), path)
    return keyed.decode_summaries(s.read.parquet(path))


def reconciled(s: SparkSession, served: DataFrame, d: str) -> DataFrame:
    """Served sums against sums of the hourly table, made anew from its stored cells."""
    source = serving.summaries(keyed.decode(table(s, d)))
    return checks.reconciled(served, source.select("kind", "period", "zone", "recorded", "hours", "missing", "masked"), ["kind", "period", "zone"], "kind")


def reconciled_faults(s: SparkSession, d: str) -> DataFrame:
    """The same where the served table lacks zone 1 of a day, has one zone too many, and a wrong sum for zone 2 of all days."""
    served = served_summaries(s, d)
    wrong = served.where(~((F.col("zone") == 1) & (F.col("period") == "20240105"))).withColumn("recorded", F.when((F.col("zone") == 2) & (F.col("kind") == "D"), F.col("recorded") + 1).otherwise(F.col("recorded")))
    return reconciled(s, wrong.unionByName(served.where("zone = 3 and kind = 'M'").withColumn("zone", F.lit(77).cast("long"))), d)


def store_faults(s: SparkSession, d: str) -> DataFrame:
    """Readiness of a store that lost the cells of zone 7 at the first hour and has another value at the third."""
    whole = sparse_grid(s, d)
    stored = keyed.encode(whole.withColumn("recorded", F.when(F.hour("hour") == 2, F.col("recorded") + 1).otherwise(F.col("recorded"))).withColumn("target", F.when(F.col("target").isNotNull(), F.col("recorded"))).withColumn("q_zero", F.coalesce(F.col("recorded") == 0, F.lit(False))))
    stored = stored.where("key <> '007#2024010200'")
    points = checks.edge_points(whole, (2024,), (1, 7), SPARSE.start, SPARSE.end)
    return checks.readiness(whole, stored, points, "007#2024010200", "007#2024010300")


def resumed_after_changes(s: SparkSession, d: str) -> DataFrame:
    """Files of a step's outputs that are not as recorded, once one day of them was written anew and another was lost."""
    folder, inside_days = shared_dir(s, "changed"), serving.by_day(sparse_grid(s, d))
    days = inside_days.withColumn("part", F.col("day"))

    def run(path: str) -> None:
        files.replace_periods(days, path, "part")

    run(folder)
    before = written(digests(s, folder))
    files.replace_periods(days.where("part = '2024-01-05'").withColumn("recorded", F.col("recorded") + 1), folder, "part")
    after = digests(s, folder).where("part <> '2024-01-06'")
    return before.withColumnRenamed("digest", "was").join(after.withColumnRenamed("digest", "now"), "part", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("part", F.col("now").isNull().alias("gone"))


def digests(s: SparkSession, folder: str) -> DataFrame:
    rows = s.read.option("basePath", folder).parquet(folder).withColumn("part", F.col("part").cast("string"))
    return rows.groupBy("part").agg(F.sum(F.xxhash64("day", "recorded").cast("decimal(38,0)")).alias("digest"))


STATE = "CASE WHEN q_source_missing THEN 'missing' WHEN q_masked_day THEN 'masked' WHEN q_zero THEN 'zero' ELSE 'counted' END"
BAD_GRID = f"""WITH {sql.SPARSE}, bad AS (
  SELECT zone, hour, CASE WHEN zone = 6 AND hour(grid.hour) = 12 THEN -1 ELSE recorded END AS recorded, target, q_source_missing OR (zone = 7 AND hour(grid.hour) = 12) AS q_source_missing, q_masked_day AND zone <> 5 AS q_masked_day, q_zero, eligible
  FROM grid WHERE NOT (zone = 3 AND hour::DATE = DATE '2024-01-05')
  UNION ALL SELECT * FROM grid WHERE zone = 4 AND hour::DATE = DATE '2024-01-06'
  UNION ALL SELECT 99, hour, recorded, target, q_source_missing, q_masked_day, q_zero, eligible FROM grid WHERE zone = 2 AND hour::DATE = DATE '2024-01-07'),
z AS (SELECT zone, count(*) AS n, count(DISTINCT hour) AS d, min(hour) AS low, max(hour) AS high FROM bad GROUP BY zone)"""
RECONCILED = """SELECT kind, count(*) FILTER (there) AS served_rows, sum(served) FILTER (there)::BIGINT AS served_recorded, count(*) FILTER (here) AS source_rows, sum(recorded) FILTER (here)::BIGINT AS source_recorded,
  count(*) FILTER (there AND NOT here) AS only_served, count(*) FILTER (here AND NOT there) AS only_source, count(*) FILTER (here AND there AND served IS DISTINCT FROM recorded) AS differing FROM both_sides GROUP BY kind"""

QUERIES = {
    "gapped_grid": lambda s, d: shown(gapped_grid(s, d), *GRID),
    "gapped_totals": lambda s, d: grid.totals(gapped_grid(s, d)),
    "gapped_missing_hours": lambda s, d: shown(grid.missing_hours(grid.coverage(gapped_events(s, d), GAPPED), GAPPED)),
    "gapped_features": lambda s, d: shown(features.add_features(gapped_grid(s, d)).select("zone", "hour", "target", "lag_1", "lag_24", "lag_168", "mean_24", "features_complete")),
    "gapped_transitions": transitions,
    "gapped_baseline": gapped_baseline,
    "gapped_summaries": lambda s, d: serving.summaries(gapped_grid(s, d)),
    "grid_acceptance_faults": lambda s, d: checks.grid_acceptance(faulty_grid(s, d), SPARSE, zones(s, d), HOURS),
    "summary_reconciliation": lambda s, d: reconciled(s, served_summaries(s, d), d),
    "summary_reconciliation_faults": reconciled_faults,
    "kv_readiness_faults": store_faults,
    "period_changes": resumed_after_changes,
}
ORACLE_SQL = {
    "gapped_grid": f"WITH {sql.GAPPED} {GRID_SQL}",
    "gapped_totals": f"WITH {sql.GAPPED} SELECT count(*) AS rows, count_if(q_source_missing)::BIGINT AS n_q_source_missing, count_if(q_masked_day)::BIGINT AS n_q_masked_day, count_if(q_zero)::BIGINT AS n_q_zero, count_if(eligible)::BIGINT AS n_eligible, sum(recorded)::BIGINT AS recorded, sum(target)::BIGINT AS target FROM grid",
    "gapped_missing_hours": f"WITH {sql.GAPPED} SELECT DISTINCT {sql.stamp('hour')} AS hour FROM grid WHERE q_source_missing",
    "gapped_features": f"""WITH {sql.GAPPED}, lags AS (SELECT g.zone, g.hour, g.target, a.target::DOUBLE AS lag_1, b.target::DOUBLE AS lag_24, c.target::DOUBLE AS lag_168 FROM grid g LEFT JOIN grid a ON a.zone = g.zone AND a.hour = g.hour - INTERVAL 1 HOUR
        LEFT JOIN grid b ON b.zone = g.zone AND b.hour = g.hour - INTERVAL 24 HOUR LEFT JOIN grid c ON c.zone = g.zone AND c.hour = g.hour - INTERVAL 168 HOUR)
        SELECT zone, {sql.stamp('hour')} AS hour, target, lag_1, lag_24, lag_168, NULL::DOUBLE AS mean_24, false AS features_complete FROM lags""",
    "gapped_transitions": f"""WITH {sql.GAPPED}, t AS (SELECT zone, hour, {STATE} AS state FROM grid)
        SELECT t.state, a.state AS hour_after, b.state AS day_after, count(*) AS n FROM t LEFT JOIN t a ON a.zone = t.zone AND a.hour = t.hour + INTERVAL 1 HOUR LEFT JOIN t b ON b.zone = t.zone AND b.hour = t.hour + INTERVAL 1 DAY GROUP BY ALL""",
    "gapped_baseline": f"""WITH {sql.GAPPED}, train AS (SELECT * FROM grid WHERE eligible AND zone <> 5 AND hour < TIMESTAMP '{HALF}'), means AS (SELECT zone, avg(target) AS zone_mean FROM train GROUP BY zone), overall AS (SELECT avg(target) AS global_mean FROM train),
        based AS (SELECT g.target, zone_mean, w.target AS lag, greatest(0.0, coalesce(w.target, zone_mean, global_mean)) AS baseline FROM grid g LEFT JOIN grid w ON w.zone = g.zone AND w.hour = g.hour - INTERVAL 168 HOUR LEFT JOIN means m ON m.zone = g.zone, overall WHERE g.eligible AND g.hour >= TIMESTAMP '{HALF}')
        SELECT CASE WHEN lag IS NOT NULL THEN 'weekly' WHEN zone_mean IS NOT NULL THEN 'train_zone_mean' ELSE 'train_global_mean' END AS method, CASE WHEN zone_mean < 1 THEN 'lt_1' WHEN zone_mean < 10 THEN 'lt_10' ELSE '10_plus' END AS demand,
               count(*) AS n, round(sum(baseline), 6) AS baseline, round(sum(abs(baseline - target)), 6) AS error FROM based GROUP BY ALL""",
    "gapped_summaries": f"""WITH {sql.GAPPED}, x AS (SELECT 'D' AS kind, strftime(hour, '%Y%m%d') AS period, * FROM grid UNION ALL SELECT 'M', strftime(hour, '%Y%m'), * FROM grid)
        SELECT kind, period, zone, sum(recorded)::BIGINT AS recorded, count(*) AS hours, count_if(q_source_missing)::BIGINT AS missing, count_if(q_masked_day)::BIGINT AS masked FROM x GROUP BY ALL""",
    "grid_acceptance_faults": f"""{BAD_GRID} SELECT count(*) FILTER (zone NOT BETWEEN 0 AND 9) AS unknown_zone, 0::BIGINT AS outside_interval, 0::BIGINT AS off_the_hour, count(*) FILTER (q_masked_day <> (hour::DATE = DATE '2024-01-14')) AS wrong_mask,
        count(*) FILTER (eligible <> (NOT q_source_missing AND NOT q_masked_day)) AS wrong_eligible, count(*) FILTER ((recorded IS NULL) <> q_source_missing) AS wrong_missing, count(*) FILTER ((target IS NOT NULL) <> eligible) AS wrong_target_null,
        count(*) FILTER (target <> recorded) AS wrong_target, count(*) FILTER (recorded < 0) AS negative, count(*) FILTER (q_zero <> coalesce(recorded = 0, false)) AS wrong_zero,
        (SELECT sum(n - d)::BIGINT FROM z) AS repeated, (SELECT count(*) FROM z WHERE d <> {HOURS} OR low <> TIMESTAMP '2024-01-02' OR high <> TIMESTAMP '2024-01-28 23:00:00') AS zones_out_of_place, 0::BIGINT AS absent_zones FROM bad""",
    "summary_reconciliation": f"{SUMMARIES}, both_sides AS (SELECT kind, recorded, recorded AS served, true AS here, true AS there FROM summary) {RECONCILED}",
    "summary_reconciliation_faults": f"""{SUMMARIES}, served AS (SELECT kind, period, zone, CASE WHEN zone = 2 AND kind = 'D' THEN recorded + 1 ELSE recorded END AS served FROM summary WHERE NOT (zone = 1 AND period = '20240105') UNION ALL SELECT kind, period, 77, recorded FROM summary WHERE zone = 3 AND kind = 'M'),
        both_sides AS (SELECT coalesce(a.kind, b.kind) AS kind, a.recorded, b.served, a.kind IS NOT NULL AS here, b.kind IS NOT NULL AS there FROM summary a FULL JOIN served b ON a.kind = b.kind AND a.period = b.period AND a.zone = b.zone) {RECONCILED}""",
    "kv_readiness_faults": f"""WITH {sql.SPARSE}, p AS (SELECT * FROM grid WHERE zone IN (1, 7) AND hour IN (TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28 23:00:00')), r AS (SELECT * FROM grid WHERE zone = 7 AND hour::DATE = DATE '2024-01-02')
        SELECT count(*) FILTER (zone = 7 AND p.hour = TIMESTAMP '2024-01-02') AS point_mismatches, count(*) AS point_rows, (SELECT count(*) FROM r WHERE hour(r.hour) = 0 OR (hour(r.hour) = 2 AND recorded IS NOT NULL)) AS range_mismatches, (SELECT count(*) FROM r) AS range_rows FROM p""",
    "period_changes": f"WITH {sql.SPARSE}, days AS (SELECT hour::DATE AS day, sum(recorded) AS recorded FROM grid GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS part, day = DATE '2024-01-06' AS gone FROM days WHERE day = DATE '2024-01-06' OR (day = DATE '2024-01-05' AND recorded IS NOT NULL)",
}

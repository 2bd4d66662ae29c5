"""Queries over tables that are stored once and read as they lie: order, comparison, merge, digests, features without a shuffle, periods built one by one."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds, inside, ntz
from ..operators import features, grid, keyed, ordering
from ..operators import forecast as fc
from ..sources import bucketed, files
from ..sources.shared import shared_dir
from ..sources.tables import DENSE, Plan, dense_events
from . import sql
from .forecasting import CUT, END, ORACLE_SQL as FORECAST_SQL
from .gridding import ORACLE_SQL as GRID_SQL
from .gridding import dense_grid, shown, sparse_grid
from .serving import KV, table, text

#: Periods that are built one after another.
PERIODS = {"p1": ("2024-01-01 00:00:00", "2024-01-11 00:00:00"), "p2": ("2024-01-11 00:00:00", "2024-01-21 00:00:00"), "p3": ("2024-01-21 00:00:00", "2024-01-31 00:00:00")}
#: Hours before a period that its features look back to.
CARRY = 168


def zone_of_key() -> Column:
    return F.substring("key", 1, 3)


def by_key(rows: DataFrame) -> DataFrame:
    return bucketed.store(rows, "key", ["key"], name="cells")


def kv_parts(s: SparkSession, d: str) -> list[DataFrame]:
    """The keyed grid as three tables of their own, each stored in sorted buckets."""
    rows = table(s, d)
    return [by_key(rows.where(F.substring("key", 11, 2).between(a, b))) for a, b in (("01", "09"), ("10", "19"), ("20", "31"))]


def kv_faulty(s: SparkSession, d: str) -> DataFrame:
    """The keyed grid with three faults: zone 3 is lost, zone 5 has a wrong count at 7 o'clock, zone 99 is one too many."""
    rows = table(s, d)
    wrong = F.map_concat(F.map_filter("cells", lambda k, _: k != "d:recorded"), F.create_map(F.lit("d:recorded"), F.lit("-1")))
    rows = rows.where(zone_of_key() != "003").withColumn("cells", F.when((zone_of_key() == "005") & F.col("key").endswith("07"), wrong).otherwise(F.col("cells")))
    return rows.unionByName(table(s, d).where(zone_of_key() == "002").withColumn("key", F.concat(F.lit("099"), F.substring("key", 4, 100))))


def stored_in_order(s: SparkSession, d: str) -> DataFrame:
    """The keyed grid in sorted files, one after another in the order of keys."""
    path = shared_dir(s, "ordered")
    table(s, d).orderBy("key").write.parquet(path)
    return s.read.parquet(path)


def stored_out_of_order(s: SparkSession, d: str) -> DataFrame:
    """Three files: zones 0 to 3 in order; 4 to 6 the other way round; 2 to 9 in order, so it overlaps."""
    path, rows = shared_dir(s, "disorder"), table(s, d)
    for k, (a, b, up) in enumerate((("000", "003", True), ("004", "006", False), ("002", "009", True))):
        rows.where(zone_of_key().between(a, b)).coalesce(1).sortWithinPartitions("key" if up else F.desc("key")).write.parquet(f"{path}/{k}")
    return s.read.parquet(f"{path}/*")


def order_faults(s: SparkSession, d: str) -> DataFrame:
    return ordering.violations(stored_out_of_order(s, d)).select("place", "key", "previous", F.col("row").cast("long").alias("row"))


def store_differences(s: SparkSession, d: str) -> DataFrame:
    """Per zone: keys walked, keys that differ and the first of them, of the store against one with faults."""
    return ordering.first_differences(by_key(table(s, d)), by_key(kv_faulty(s, d)), zone_of_key())


def tree_faults(s: SparkSession, d: str) -> DataFrame:
    """The nodes of the digest tree above the faults."""
    return ordering.tree_differences(ordering.digest_tree(table(s, d)), ordering.digest_tree(kv_faulty(s, d)))


def stored_grid(s: SparkSession, d: str) -> DataFrame:
    """The dense grid in buckets of zones, sorted by the second that its hours begin at."""
    return bucketed.store(dense_grid(s, d).withColumn("second", epoch_seconds(F.col("hour"))), "zone", ["zone", "second"], name="grid")


def stored_features(s: SparkSession, d: str) -> DataFrame:
    """Features of the stored grid, stored in the same buckets; neither the window nor the second store has rows to deal or sort."""
    return bucketed.store(features.add_features(stored_grid(s, d), F.col("second")), "zone", ["zone", "second"], name="features")


def labels_between(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Labelled rows of an interval; the bounds on ``second`` reach the files' row groups."""
    return frame.where(F.col("second").between(epoch_seconds(ntz(start)), epoch_seconds(ntz(end)) - 1) & F.col("eligible"))


def stored_baseline(frame: DataFrame) -> DataFrame:
    train = labels_between(frame, fc.TEST.train_start, fc.TEST.start)
    return fc.baseline(labels_between(frame, CUT, END), fc.zone_means(train), fc.global_mean(train))


def gap(end: str, start: str) -> timedelta:
    """From the end of a period to the start of a later one; negative where the first is not over."""
    return datetime.fromisoformat(start) - datetime.fromisoformat(end)


def build_period(raw: DataFrame, zones: DataFrame, plan: Plan, period: str, home: str) -> None:
    """The grid of one period (``plan`` is its interval) takes the place of what was stored for it; other periods stay."""
    kept = raw.where(inside(F.col("pickup"), plan.start, plan.end))
    rows = grid.dense(grid.observed(kept), grid.coverage(raw, plan), zones, plan)
    files.replace_periods(rows.withColumns({"second": epoch_seconds(F.col("hour")), "period": F.lit(period)}), f"{home}/grid", "period")


def period_features(spark: SparkSession, periods: dict[str, tuple[str, str]], period: str, home: str) -> None:
    """Features of one period from its stored grid and the CARRY hours before it; only folders of periods that reach into these hours are read."""
    start, end = periods[period]
    since = epoch_seconds(ntz(start)) - CARRY * 3600
    near = [p for p, (_, e) in periods.items() if p <= period and gap(e, start) < timedelta(hours=CARRY)]
    held = spark.read.parquet(f"{home}/grid").where(F.col("period").isin(near) & (F.col("second") >= since) & (F.col("second") < epoch_seconds(ntz(end))))
    rows = features.add_features(held, F.col("second")).where(F.col("second") >= epoch_seconds(ntz(start)))
    files.replace_periods(rows, f"{home}/features", "period")


def refresh(raw: DataFrame, zones: DataFrame, whole: Plan, periods: dict[str, tuple[str, str]], period: str, home: str) -> list[str]:
    """Builds a period anew, and the features of those stored ones after it whose hours look back into it. The periods whose features were written."""
    spark = raw.sparkSession
    first = files.exists(spark, f"{home}/grid")
    stored = {r["period"] for r in spark.read.parquet(f"{home}/grid").select("period").distinct().collect()} if first else set()  # names of periods
    build_period(raw, zones, Plan(*periods[period], whole.excluded, whole.masked), period, home)
    after = [p for p in sorted(stored) if p > period and gap(periods[period][1], periods[p][0]) < timedelta(hours=CARRY)]
    for p in (period, *after):
        period_features(spark, periods, p, home)
    return [period, *after]


def incremental_features(s: SparkSession, d: str) -> DataFrame:
    """Features of three periods built one after another; the second first without its views, then anew as it should be."""
    home, raw = shared_dir(s, "periods"), dense_events(s, d)
    zones = raw.select("zone").distinct()
    for period, rows in (("p1", raw), ("p2", raw.where("zone <> 'view'")), ("p3", raw), ("p2", raw)):
        refresh(rows, zones, DENSE, PERIODS, period, home)
    return shown(s.read.parquet(f"{home}/features").drop("second", "period"))


def leaf_sql(prefix: str) -> str:
    """SQL of the digest tree; rows of ``prefix`` (key, t: the framed cells)."""
    node = "SELECT {level}::BIGINT AS level, substr(key, 1, {length}) AS node, sum(rows)::BIGINT AS rows, sha256(string_agg(digest, '' ORDER BY key)) AS digest FROM {below} GROUP BY substr(key, 1, {length})"
    return f"""{prefix}l AS (SELECT key, 1 AS rows, sha256(octet_length(encode(key)) || ':' || key || t) AS digest FROM framed),
    n0 AS ({node.format(level=0, length=10, below='l')}), n1 AS ({node.format(level=1, length=3, below='(SELECT node AS key, rows, digest FROM n0)')}), n2 AS ({node.format(level=2, length=0, below='(SELECT node AS key, rows, digest FROM n1)')}),
    tree AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2)"""


#: Cells of the keyed grid as framed text: each is name=value in the text of cells, which have neither '=' nor ';' within.
FRAMED = f"{KV}, framed AS (SELECT key, array_to_string(list_transform(string_split(cells, ';'), lambda x: octet_length(encode(split_part(x, '=', 1))) || ':' || split_part(x, '=', 1) || octet_length(encode(split_part(x, '=', 2))) || ':' || split_part(x, '=', 2)), '') AS t FROM kv), "
FAULTY = f"""{KV}, bad AS (
  SELECT key, CASE WHEN key LIKE '005%07' THEN regexp_replace(CASE WHEN cells LIKE '%d:recorded=%' THEN cells ELSE 'd:recorded=;' || cells END, 'd:recorded=[^;]*', 'd:recorded=-1') ELSE cells END AS cells FROM kv WHERE key NOT LIKE '003%'
  UNION ALL SELECT '099' || substr(key, 4), cells FROM kv WHERE key LIKE '002%')"""

QUERIES = {
    "kv_ordered_merge": lambda s, d: text(ordering.merged(kv_parts(s, d))),
    "kv_order_violations": lambda s, d: ordering.violations(stored_in_order(s, d)).agg(F.count("*").alias("violations")),
    "kv_order_faults": order_faults,
    "kv_first_differences": store_differences,
    "kv_digest_tree": lambda s, d: ordering.digest_tree(table(s, d)),
    "kv_digest_faults": tree_faults,
    "stored_features": lambda s, d: shown(stored_features(s, d).drop("second")),
    "stored_baseline_by_zone": lambda s, d: fc.score(stored_baseline(stored_features(s, d)), "zone", prediction="baseline"),
    "stored_label_scan": lambda s, d: shown(labels_between(stored_features(s, d), CUT, END).select("zone", "hour", "target", "lag_168")),
    "incremental_features": incremental_features,
}
ORACLE_SQL = {
    "kv_ordered_merge": f"{KV} SELECT * FROM kv",
    "kv_order_violations": f"{KV}, o AS (SELECT key, lag(key) OVER (ORDER BY key) AS previous FROM kv) SELECT count(*) FILTER (previous >= key) AS violations FROM o",
    "kv_order_faults": f"""{KV}, f AS (SELECT 0 AS file, key, row_number() OVER (ORDER BY key) - 1 AS row FROM kv WHERE substr(key, 1, 3) <= '003' UNION ALL SELECT 1, key, row_number() OVER (ORDER BY key DESC) - 1 FROM kv WHERE substr(key, 1, 3) BETWEEN '004' AND '006'
        UNION ALL SELECT 2, key, row_number() OVER (ORDER BY key) - 1 FROM kv WHERE substr(key, 1, 3) BETWEEN '002' AND '009'), o AS (SELECT *, lag(key) OVER (ORDER BY file, row) AS previous FROM f)
        SELECT CASE WHEN row = 0 THEN 'border' ELSE 'inside' END AS place, key, previous, row FROM o WHERE previous >= key""",
    "kv_first_differences": f"""{FAULTY}, w AS (SELECT coalesce(kv.key, bad.key) AS key, CASE WHEN kv.key IS NULL THEN 'left' WHEN bad.key IS NULL THEN 'right' WHEN kv.cells <> bad.cells THEN 'cells' END AS fault FROM kv FULL JOIN bad ON kv.key = bad.key)
        SELECT substr(key, 1, 3) AS span, count(*) AS walked, count(fault) AS differing, min(CASE WHEN fault IS NOT NULL THEN key END) AS first_key, arg_min(fault, key) FILTER (fault IS NOT NULL) AS first_fault FROM w GROUP BY ALL""",
    "kv_digest_tree": f"{leaf_sql(FRAMED)} SELECT * FROM tree",
    "kv_digest_faults": f"""{FAULTY}, w AS (SELECT coalesce(kv.key, bad.key) AS key FROM kv FULL JOIN bad ON kv.key = bad.key WHERE kv.cells IS DISTINCT FROM bad.cells)
        SELECT DISTINCT 0::BIGINT AS level, substr(key, 1, 10) AS node FROM w UNION ALL SELECT DISTINCT 1, substr(key, 1, 3) FROM w UNION ALL SELECT 2, '' FROM w GROUP BY 1""",
    "stored_features": GRID_SQL["feature_frame"],
    "stored_baseline_by_zone": FORECAST_SQL["metrics_by_zone"],
    "stored_label_scan": f"WITH {sql.DENSE} SELECT zone, {sql.stamp('hour')} AS hour, target, lag_168 FROM feature WHERE eligible AND feature.hour >= TIMESTAMP '{CUT}' AND feature.hour < TIMESTAMP '{END}'",
    "incremental_features": GRID_SQL["feature_frame"],
}

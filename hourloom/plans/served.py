"""A store that is loaded once for an input and read by many bounded queries.

The store of an input is found by what it was made from: the code, the plan and the rows of the events. The first query of a session loads it, checks it and locks its place; of several at once
one place is kept. Later queries read sorted files with small row groups, so a zone's hours or a period's sums come from a few of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time
from ..functions.time import epoch_seconds, ntz
from ..operators import checks, grid, keyed, serving
from ..sources import files
from ..sources.shared import shared_base, shared_dir
from ..sources.tables import DENSE, SPARSE, read
from .forecasting import CUT, hybrid
from .gridding import GRID, dense_grid, shown, sparse_grid
from .serving import ORACLE_SQL as SERVING_SQL
from .serving import RANGE

TABLES = ("hourly", "dense", "summaries", "forecasts")
ROW_GROUP = 1 << 20


def context(s: SparkSession, d: str) -> str:
    """What a store is made from. Stores are not shared between applications."""
    return checks.context_hash(code=checks.code_digest(grid, serving, keyed, time), plans=[str(SPARSE), str(DENSE)], inputs=checks.input_digest(read(s, d, "events")), application=s.sparkContext.applicationId)


def load(s: SparkSession, d: str) -> str:
    """The folder of a new store, once its sums agree with its hours."""
    home = shared_dir(s, "store")
    for name, rows in (("hourly", sparse_grid(s, d)), ("dense", dense_grid(s, d)), ("forecasts", hybrid(s, d).select("zone", "hour", "prediction", "baseline", "method"))):
        files.write_sorted(rows.withColumn("second", epoch_seconds(F.col("hour"))), f"{home}/{name}", "zone", ["zone", "second"], row_group_bytes=ROW_GROUP)
    hourly = s.read.parquet(f"{home}/hourly")
    files.write_sorted(serving.summaries(hourly), f"{home}/summaries", "period", ["kind", "period", "zone"], row_group_bytes=ROW_GROUP)
    keys = ["kind", "period", "zone"]
    wrong = checks.reconciled(s.read.parquet(f"{home}/summaries"), serving.summaries(hourly).select(*keys, "recorded", "hours", "missing", "masked"), keys, "kind").where("only_served + only_source + differing > 0")
    if not wrong.isEmpty():
        raise ValueError("sums of the new store do not agree with its hours")
    files.write_manifest(s, f"{home}/accepted.json", True, tables=TABLES)
    return home


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    home: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{name}")

    def hours(self, name: str, zone, start: str, end: str) -> DataFrame:
        """Hours of a zone from one midnight to another, by filters that reach the row groups."""
        return self.table(name).where((F.col("zone") == zone) & (F.col("second") >= epoch_seconds(ntz(start))) & (F.col("second") < epoch_seconds(ntz(end))))

    def history(self, zone, first: str, last: str) -> DataFrame:
        """Whole days of a zone; an error outside what is held, for more than 31 days and for hours that are not there."""
        days = serving.check_range(first, last, *RANGE[2:])
        until = F.date_format(F.date_add(F.to_date(F.lit(last)), 1), "yyyy-MM-dd")
        rows = self.table("hourly").where((F.col("zone") == zone) & (F.col("second") >= epoch_seconds(ntz(f"{first} 00:00:00"))) & (F.col("second") < epoch_seconds(F.to_timestamp_ntz(until, F.lit("yyyy-MM-dd")))))
        return serving.require_rows(rows, 24 * days)

    def snapshot(self, hour: str, zones: int) -> DataFrame:
        return serving.require_rows(self.table("hourly").where(F.col("second") == epoch_seconds(ntz(hour))), zones)

    def joined(self, zone, start: str, end: str, forecast_from: str) -> DataFrame:
        forecasts = self.hours("forecasts", zone, start, end).select("zone", "hour", "prediction", "baseline")
        return serving.joined(self.hours("dense", zone, start, end).select("zone", "hour", "target", "eligible"), forecasts, forecast_from)


def open_store(s: SparkSession, d: str) -> Store:
    made_from = context(s, d)
    pointer = f"{shared_base(s)}/store-of-{made_from}.json"
    if not files.exists(s, pointer):
        checks.lock(s, pointer, made_from, {"home": load(s, d)})
    home = checks.unlocked(s, pointer, made_from)["result"]["home"]
    if not all(files.exists(s, f"{home}/{x}") for x in (*TABLES, "accepted.json")):
        raise ValueError(f"the store at {home} is not whole")
    return Store(s, home)


QUERIES = {
    "store_history": lambda s, d: shown(open_store(s, d).history(3, *RANGE[:2]), *GRID),
    "store_snapshot": lambda s, d: shown(open_store(s, d).snapshot("2024-01-12 08:00:00", 10), *GRID),
    "store_daily": lambda s, d: serving.daily(open_store(s, d).table("summaries"), "2024-01-10", "2024-01-14", 10),
    "store_monthly": lambda s, d: serving.monthly(open_store(s, d).table("summaries"), 1, 10),
    "store_joined": lambda s, d: shown(open_store(s, d).joined("click", "2024-01-26 00:00:00", "2024-01-31 00:00:00", CUT)),
}
ORACLE_SQL = {
    "store_history": SERVING_SQL["zone_history"],
    "store_snapshot": SERVING_SQL["snapshot"],
    "store_daily": SERVING_SQL["daily_summary"],
    "store_monthly": SERVING_SQL["monthly_summary"],
    "store_joined": SERVING_SQL["joined_history_forecast"],
}

"""Checks of the life cycle: conservation, acceptance, resumption, locks, readiness."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import clock_change, inside, masked_day, ntz
from ..sources import files
from ..sources.tables import Plan
from . import keyed


def conserved(counts: DataFrame, whole: str, parts: tuple[str, ...]) -> DataFrame:
    """The one row of counts, or an error where the parts do not add up to the whole."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    lost = F.col(whole) != total
    return counts.withColumn(whole, F.when(lost, F.raise_error(F.lit("rows were lost or made")).cast("long")).otherwise(F.col(whole)))


def grid_acceptance(grid: DataFrame, plan: Plan, zones: DataFrame, hours: int) -> DataFrame:
    """Counts of rows that break a rule of the grid; all are 0 in a right one. ``hours``: of the plan's interval.

    Place: with one row for each hour of each zone, a row's place in the order of (zone, hour) is the zone's number times the
    hours, and the hours gone. Rows out of the interval, off the hour, repeated or absent break it and are counted apart.
    """
    known = grid.join(zones.select("zone", F.lit(True).alias("_known")), "zone", "left")
    eligible = ~F.col("q_source_missing") & ~F.col("q_masked_day")
    rules = {
        "unknown_zone": F.col("_known").isNull(), "outside_interval": ~inside(F.col("hour"), plan.start, plan.end), "off_the_hour": F.date_trunc("hour", "hour").cast("timestamp_ntz") != F.col("hour"),
        "wrong_mask": F.col("q_masked_day") != masked_day(F.col("hour"), plan.masked), "wrong_eligible": F.col("eligible") != eligible, "wrong_missing": F.col("recorded").isNull() != F.col("q_source_missing"),
        "wrong_target_null": F.col("target").isNotNull() != F.col("eligible"), "wrong_target": F.coalesce(F.col("target") != F.col("recorded"), F.lit(False)), "negative": F.coalesce(F.col("recorded") < 0, F.lit(False)),
        "wrong_zero": F.col("q_zero") != F.coalesce(F.col("recorded") == 0, F.lit(False)),
    }
    rows = known.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    gone = F.timestamp_diff("HOUR", ntz(plan.start), F.col("hour"))
    by_zone = grid.groupBy("zone").agg(F.count("*").alias("n"), F.count_distinct("hour").alias("d"), F.min(gone).alias("low"), F.max(gone).alias("high"))
    misplaced = by_zone.agg(F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("repeated"), F.count_if((F.col("d") != hours) | (F.col("low") != 0) | (F.col("high") != hours - 1)).alias("zones_out_of_place"))
    absent = zones.select("zone").distinct().join(grid.select("zone").distinct(), "zone", "left_anti").agg(F.count("*").alias("absent_zones"))
    return rows.crossJoin(misplaced).crossJoin(absent)  # a row each


def sums_agree(grid: DataFrame, retained: DataFrame) -> DataFrame:
    """Recorded counts of the grid against the retained records they come from, a row of both sums and whether they are equal."""
    a = grid.agg(F.coalesce(F.sum("recorded"), F.lit(0)).alias("grid_sum"))
    return a.crossJoin(retained.agg(F.count("*").alias("retained"))).withColumn("equal", F.col("grid_sum") == F.col("retained"))


def preflight(df: DataFrame, expected: dict[str, str], rows: int | None = None) -> int:
    """Rows of ``df``, or an error where its columns, their types or the number of its rows are not as expected."""
    have = dict(df.dtypes)
    if have != expected:
        raise ValueError(f"unexpected schema: {sorted(set(have.items()) ^ set(expected.items()))}")
    n = df.count()
    if rows is not None and n != rows:
        raise ValueError(f"{n} rows, not {rows}")
    return n


def context_hash(**facts) -> str:
    """Of code, settings and inputs: what a result was made with."""
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()


def code_digest(*modules) -> str:
    """sha256 of the source of modules."""
    return hashlib.sha256("\0".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def input_digest(df: DataFrame) -> str:
    """Of the rows of a table and the names of its columns, in any order of rows: their number and two sums of 64-bit hashes, added up where the rows are."""
    names = sorted(df.columns)
    sums = [F.sum(F.xxhash64(*names, F.lit(seed)).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    row = df.agg(F.concat_ws("-", F.count("*").cast("string"), *sums)).first()  # one row
    return f"{','.join(names)}:{row[0]}"


def lock(spark: SparkSession, path: str, context: str, result: dict) -> dict:
    """The result as first locked: of several writers at once the first one's, and the others get it. An error if it was locked with another context."""
    made = json.loads(files.manifest_text({"complete": True, "context": context, "result": result}))
    if files.create_new(spark, path, files.manifest_text(made)):
        return made
    return unlocked(spark, path, context)


def unlocked(spark: SparkSession, path: str, context: str) -> dict:
    """What is locked at ``path``; an error if it was locked with another context than this, or never."""
    if not files.exists(spark, path):
        raise ValueError(f"nothing is locked at {path}")
    prior = files.read_manifest(spark, path)
    if prior["context"] != context:
        raise ValueError("already locked with another context")
    return prior


def hashes(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["name"]: r["digest"] for r in files.file_facts(spark, path).collect()}  # a row for each file of a step


def file_changes(recorded: dict[str, dict[str, str]], present: dict[str, dict[str, str]]) -> list[tuple]:
    """(side, name, recorded, present) of all files that are not as they were recorded; None stands for no such file."""
    names = {(side, name) for state in (recorded, present) for side in state for name in state[side]}
    rows = [(side, name, recorded.get(side, {}).get(name), present.get(side, {}).get(name)) for side, name in sorted(names)]
    return [r for r in rows if r[2] != r[3]]


def resume(spark: SparkSession, folder: str, inputs: str, run: Callable[[str], None]) -> dict:
    """The record of a step that ``run(folder/data)`` takes once: files that it read and wrote, with their checksums.

    A later call takes no step if all of them are as recorded; otherwise one error names every file that differs. A folder without a record is of a step that did not end, and stays for its owner to look at.
    """
    record, data = f"{folder}/record.json", f"{folder}/data"

    def state() -> dict[str, dict[str, str]]:
        return {"inputs": hashes(spark, inputs), "outputs": hashes(spark, f"{data}/*.parquet")}

    if files.exists(spark, record):
        kept = files.read_manifest(spark, record)
        if changes := file_changes(kept["state"], state()):
            raise ValueError("not as the step left them: " + ", ".join(f"{side}/{name} ({'gone' if now is None else 'new' if was is None else 'changed'})" for side, name, was, now in changes))
        return kept
    if files.exists(spark, folder):
        raise ValueError(f"a step has begun in {folder} and has no record of an end")
    run(data)
    return files.write_manifest(spark, record, True, state=state())


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows that have exactly one partner; a key that repeats or is on one side only is an error."""

    def single(df: DataFrame, mark: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in values], F.count("*").alias(mark))

    both = single(left, "_l").join(single(right, "_r"), keys, "full")
    wrong = ~(F.col("_l").eqNullSafe(F.lit(1)) & F.col("_r").eqNullSafe(F.lit(1)))
    bad = F.raise_error(F.lit("a key has not exactly one row on either side")).cast("boolean")
    return both.where(F.when(wrong, bad).otherwise(F.lit(True))).drop("_l", "_r")


def reconciled(served: DataFrame, source: DataFrame, keys: list[str], by: str) -> DataFrame:
    """For each value of ``by`` (one of the keys): rows of both tables, of either alone, rows that are in both and differ, and both sums of recorded."""
    values = [c for c in source.columns if c not in keys]
    both = keyed.differences(source, served.select(*source.columns), keys)
    kind = both.groupBy(by).agg(F.count_if(F.col("in_left").isNull()).alias("only_served"), F.count_if(F.col("in_right").isNull()).alias("only_source"), F.count_if(F.col("in_left") & F.col("in_right")).alias("differing"))
    sums = [t.groupBy(by).agg(F.count("*").alias(f"{n}_rows"), F.sum(values[0]).alias(f"{n}_{values[0]}")) for t, n in ((served, "served"), (source, "source"))]
    return sums[0].join(sums[1], by, "full").join(kind, by, "left").na.fill(0, ["only_served", "only_source", "differing"])


def tables_ready(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """name, ready, rows, first and last key of stored tables under ``folder``; an error where one is absent or its load was not accepted."""
    missing = [n for n in names if not files.exists(spark, f"{folder}/{n}")]
    if missing:
        raise ValueError(f"missing tables: {missing}")
    if not files.exists(spark, f"{folder}/accepted.json"):
        raise ValueError("the tables were not accepted")
    accepted = files.read_manifest(spark, f"{folder}/accepted.json")["complete"]
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("name"), "key") for n in names])
    return rows.groupBy("name").agg(F.lit(accepted).alias("ready"), F.count("*").alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def edge_points(grid: DataFrame, years: tuple[int, ...], zones: tuple, start: str, end: str) -> DataFrame:
    """Rows at the ends of the interval and at the clock changes of ``years``, of some zones."""
    hours = [ntz(start), ntz(end) - F.expr("INTERVAL 1 HOUR")]
    hours += [clock_change(F.lit(y), spring) + F.expr(f"INTERVAL {2 if spring else 1} HOURS") for y in years for spring in (True, False)]
    return grid.where(F.col("zone").isin(*zones) & F.col("hour").isin(*hours))


def readiness(grid: DataFrame, table: DataFrame, points: DataFrame, low: str, high: str) -> DataFrame:
    """Point and range queries against the store: how many were asked, how many differ from the source."""

    def differing(source: DataFrame, stored: DataFrame, name: str) -> DataFrame:
        a, b = [x.select("key", keyed.cells_text(F.col("cells")).alias("cells")) for x in (keyed.encode(source), stored)]
        return keyed.differences(a, b, ["key"]).agg(F.count("*").alias(f"{name}_mismatches")).crossJoin(source.agg(F.count("*").alias(f"{name}_rows")))

    keys = keyed.encode(points).select("key")
    point = differing(points, table.join(keys, "key", "left_semi"), "point")
    span = (F.col("key") >= low) & (F.col("key") < high)
    inner = grid.where((keyed.key_of(F.col("zone"), F.col("hour")) >= low) & (keyed.key_of(F.col("zone"), F.col("hour")) < high))
    return point.crossJoin(differing(inner, table.where(span), "range"))


def worker_smoke(spark: SparkSession, n: int = 1_000) -> int:
    """Sum of 0..n-1 doubled by Python workers in Arrow batches: whether executors can run Python."""
    import pyarrow as pa

    def double(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([2 * x for x in batch.column(0).to_pylist()], pa.int64())], names=["id"])

    return spark.range(n).mapInArrow(double, "id long").agg(F.sum("id")).first()[0]



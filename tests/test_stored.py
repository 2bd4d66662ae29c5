"""Selection, file order and tables that are read as they are stored."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.operators import features, ordering, profile, selection
from hourloom.plans import stored
from hourloom.sources import bucketed
from hourloom.sources.tables import DENSE, placed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cells(spark, rows):
    return spark.createDataFrame([(k, {"v": str(v)} if v is not None else {}) for k, v in rows], "key string, cells map<string,string>")


@pytest.mark.parametrize("few", [500, 0])
def test_selection_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW_FILES", few)
    r = np.random.default_rng(1)
    groups = {"one": [4.5], "two": [1.0, -2.0], "same": [7.0] * 500, "hot": [0.0] * 700 + r.normal(size=300).tolist(), "wide": (r.integers(-(10**6), 10**6, 2000) / 8).tolist()}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "subject string, v double").repartition(5)
    p = (0.0, 0.01, 0.25, 0.5, 0.333, 0.99, 1.0)
    got = {(x.subject, x.p): x.value for x in selection.quantiles(selection.counted(df, "v", "subject"), p).collect()}
    assert got == {(g, q): pytest.approx(float(np.quantile(vs, q)), abs=1e-6) for g, vs in groups.items() for q in p}


def test_ranks_are_read_from_few_files(spark):
    rows = selection.stored_by_rank(selection.counted(spark.range(10_000).selectExpr("cast(id as double) v"), "v").select(F.lit("s").alias("subject"), "value", "copies"))
    found = selection.at_ranks(rows, spark.createDataFrame([("s", 17), ("s", 9_999)], "subject string, rank long"))
    assert sorted((x.rank, x.value) for x in found.collect()) == [(17, 17.0), (9_999, 9_999.0)]
    assert selection.quantiles(selection.counted(spark.createDataFrame([], "v double"), "v").select(F.lit("s").alias("subject"), "value", "copies"), (0.5,)).count() == 0


def ties(seed):
    r = random.Random(seed)
    return [r.choice([None, 1, 2, 3, 4, r.randrange(6)]) for _ in range(r.randrange(1, 40))]


@pytest.mark.parametrize("seed", range(6))
def test_longest_keeps_what_a_bounded_heap_keeps(spark, tmp_path, seed):
    values, heap = ties(seed), []
    for at, v in enumerate(values):
        if v is not None and (len(heap) < 5 or v > heap[0][0]):
            heapq.heappush(heap, (v, at))
            if len(heap) > 5:
                heapq.heappop(heap)
    spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.parquet(f"{tmp_path}/t")
    got = profile.longest(placed(spark.read.parquet(f"{tmp_path}/t")), "v").collect()
    assert [(x.v, x.row) for x in got] == sorted(heap, reverse=True)


def test_first_rows_are_those_of_the_files(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"g{i % 3}", 1000 * k - i) for i in range(50)], "g string, v int").coalesce(1).write.parquet(f"{tmp_path}/t/{k}")
    got = profile.samples(placed(spark.read.parquet(f"{tmp_path}/t/*")), "g").collect()
    assert {(x.g, x.r, x.row, x.v) for x in got} == {(f"g{g}", r + 1, g + 3 * r, -(g + 3 * r)) for g in range(3) for r in range(3)}


def test_order_is_checked_as_files_lie(spark, tmp_path):
    keys = [f"{i:05d}" for i in range(4000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name, part in (("a", keys[:2000]), ("b", keys[2000:])):
            cells(spark, [(k, k * 20) for k in part]).coalesce(1).write.option("parquet.block.size", 8192).parquet(f"{tmp_path}/good/{name}")
        good = spark.read.parquet(f"{tmp_path}/good/*")
        assert good.rdd.getNumPartitions() > 4 and ordering.violations(good).count() == 0
        assert ordering.runs(good).where("key is null").agg(F.sum("rows")).first()[0] == 4000
        swapped = [*keys[:700], keys[701], keys[700], *keys[702:2000], keys[1999]]
        cells(spark, [(k, k * 20) for k in swapped]).coalesce(1).write.option("parquet.block.size", 8192).parquet(f"{tmp_path}/bad/a")
        cells(spark, [(k, k) for k in keys[1500:]]).coalesce(1).write.parquet(f"{tmp_path}/bad/b")
        bad = ordering.violations(spark.read.parquet(f"{tmp_path}/bad/*")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(x.place, x.key, x.previous, x.row) for x in bad} == {("inside", keys[700], keys[701], 701), ("inside", keys[1999], keys[1999], 2000), ("border", keys[1500], keys[1999], 0)}


def test_merge_and_comparison_walk_sorted_buckets(spark):
    parts = [stored.by_key(cells(spark, [(f"{i:03d}", i) for i in range(k, 90, 3)])) for k in range(3)]
    out = ordering.merged(parts)
    assert plan(out).count("Exchange") == 1 and sorted(x.key for x in out.collect()) == [f"{i:03d}" for i in range(90)]
    two = ordering.merged(parts[:2])
    assert "Exchange" not in plan(two) and "Sort " not in plan(two) and sorted(x.key for x in two.collect()) == [f"{i:03d}" for i in range(90) if i % 3 < 2]
    ordered = two.select(F.spark_partition_id().alias("p"), "key").collect()
    assert [x.key for x in ordered] == [x.key for x in sorted(ordered)]  # each bucket in order
    for twice in ([parts[0], parts[0]], [*parts, parts[0]]):
        with pytest.raises(Exception, match="several tables"):
            ordering.merged(twice).collect()
    other = stored.by_key(cells(spark, [(f"{i:03d}", -1 if i == 60 else i) for i in range(0, 90, 3) if i != 33] + [("500", 1)]))
    found = ordering.first_differences(parts[0], other, F.substring("key", 1, 1))
    below = plan(found).split("SortMergeJoin", 1)[1]
    assert "Exchange" not in below and "Sort " not in below
    assert sorted(map(tuple, found.collect())) == [("0", 30, 2, "033", "right"), ("5", 1, 1, "500", "left")]
    assert ordering.first_differences(parts[0], parts[0]).first()[1:] == (30, 0, None, None)


def test_digest_tree(spark, monkeypatch):
    rows = [(f"{z:03d}#20240{m}{h:02d}00", z * m + h) for z in range(4) for m in range(1, 4) for h in range(20)]
    tree = ordering.digest_tree(cells(spark, rows))
    assert ordering.tree_differences(tree, ordering.digest_tree(cells(spark, rows[::-1]).repartition(7))).count() == 0
    other = dict(rows)
    a, b = rows[5][0], rows[30][0]
    other[a], other[b] = other[b], other[a]
    changed = ordering.tree_differences(tree, ordering.digest_tree(cells(spark, list(other.items()))))
    assert {tuple(x) for x in changed.collect()} == {(0, a[:10]), (0, b[:10]), (1, "000"), (2, "")}
    clash = [ordering.digest_tree(spark.createDataFrame([("k", m)], "key string, cells map<string,string>")) for m in ({"a": "b1:cd"}, {"a": "b", "c": "d"})]
    assert ordering.tree_differences(*clash).count() == 3
    monkeypatch.setattr(ordering, "MOST_CHILDREN", 10)
    with pytest.raises(Exception, match="too many children"):
        ordering.digest_tree(cells(spark, rows)).collect()
    with pytest.raises(ValueError, match="shorter"):
        ordering.digest_tree(cells(spark, rows), (3, 10))


def test_stored_features_neither_shuffle_nor_sort(spark):
    d = "/root/testdata/sf0.001"
    frame = features.add_features(stored.stored_grid(spark, d), F.col("second"))
    assert "Exchange" not in plan(frame) and "Sort " not in plan(frame) and "Window" in plan(frame)
    kept = stored.stored_features(spark, d)
    scored = stored.labels_between(kept, "2024-01-28 00:00:00", "2024-01-31 00:00:00").groupBy("zone").agg(F.count("*"))
    assert "Exchange" not in plan(scored)
    scan = next(x for x in scored._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(second" in scan and "LessThanOrEqual(second" in scan


def test_periods_are_built_one_by_one(spark, tmp_path):
    d, home = "/root/testdata/sf0.001", str(tmp_path)
    raw = stored.dense_events(spark, d)
    zones = raw.select("zone").distinct()
    small = {f"d{k:02d}": (f"2024-01-{k:02d} 00:00:00", f"2024-01-{k + 5:02d} 00:00:00") for k in (1, 6, 11, 16)}
    for p in small:
        assert stored.refresh(raw, zones, DENSE, small, p, home) == [p]
    assert stored.refresh(raw.where("zone <> 'view'"), zones, DENSE, small, "d06", home) == ["d06", "d11", "d16"]  # 168 hours: two periods of five days look back
    wrong = spark.read.parquet(f"{home}/features").where("zone = 'view'").agg(F.sum("lag_168")).first()[0]
    stored.refresh(raw, zones, DENSE, small, "d06", home)
    got = spark.read.parquet(f"{home}/features").drop("period", "second")
    whole = features.add_features(stored.dense_grid(spark, d)).where("hour < timestamp_ntz'2024-01-21'").select(*got.columns)
    assert got.exceptAll(whole).count() == 0 and got.count() == whole.count() and wrong != whole.where("zone = 'view'").agg(F.sum("lag_168")).first()[0]


def test_buckets_are_one_file_each(spark):
    t = bucketed.store(spark.range(1000).selectExpr("id % 7 as z", "id"), "z", ["z", "id"], buckets=3)
    assert len(t.inputFiles()) <= 3 and t.count() == 1000

"""Locks, records of steps, one-to-one joins, reconciliation and the final fit."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from hourloom.operators import checks
from hourloom.operators import forecast as fc
from hourloom.plans import acceptance, forecasting
from hourloom.sources import files

D = "/root/testdata/sf0.01"


def test_of_two_writers_at_once_one_locks(spark, tmp_path):
    got, at = [], threading.Barrier(6)

    def work(k):
        at.wait()
        got.append(checks.lock(spark, f"file://{tmp_path}/lock.json", "context", {"winner": k}))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 6 and len({json.dumps(x) for x in got}) == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["lock.json"]
    with pytest.raises(ValueError, match="another context"):
        checks.lock(spark, f"file://{tmp_path}/lock.json", "other", {})
    with pytest.raises(ValueError, match="nothing is locked"):
        checks.unlocked(spark, f"file://{tmp_path}/none.json", "context")
    assert not files.create_new(spark, f"file://{tmp_path}/lock.json", "x") and files.read_manifest(spark, f"file://{tmp_path}/lock.json") == got[0]


def test_context_follows_code_settings_and_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "a long, b string")
    same = checks.input_digest(rows)
    assert checks.input_digest(rows.repartition(3).select("b", "a")) == same
    for other in (rows.limit(2), rows.withColumn("a", F.col("a") + 1), rows.distinct(), rows.withColumnRenamed("b", "c")):
        assert checks.input_digest(other) != same
    assert checks.code_digest(fc) == checks.code_digest(fc) != checks.code_digest(checks)


def test_a_changed_input_is_refused_after_selection(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/selection.json"
    best = spark.createDataFrame([("random_forest", "A", 8, 10, 1.0), ("naive", "A", 0, 10, 2.0)], "model string, history string, depth int, n long, mae double")
    monkeypatch.setattr(forecasting, "rf_candidate_ranking", lambda s, d: best)
    locked = forecasting.select_and_lock(spark, D, path)
    assert locked["result"] == {"model": "random_forest", "history": "A", "depth": 8, "n": 10, "mae": 1.0}
    depths = []
    fit = fc.fit_forest
    monkeypatch.setattr(fc, "fit_forest", lambda train, depth=8: depths.append(depth) or fit(train, depth))
    rows = forecasting.final_rows(spark, D, path)
    assert depths == [8] and rows.where("hour < timestamp_ntz'2024-01-28'").count() == 0 and rows.where("method = 'random_forest'").count() > 0
    monkeypatch.setattr(fc, "FOREST", {**fc.FOREST, "seed": 7})
    with pytest.raises(ValueError, match="another context"):
        forecasting.final_rows(spark, D, path)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="another context"):
        forecasting.final_rows(spark, "/root/testdata/sf0.001", path)


def test_a_naive_winner_needs_no_fit(spark, tmp_path, monkeypatch):
    best = spark.createDataFrame([("naive", "B", 0, 10, 1.0), ("naive", "A", 0, 10, 1.0)], "model string, history string, depth int, n long, mae double")
    monkeypatch.setattr(forecasting, "rf_candidate_ranking", lambda s, d: best)
    monkeypatch.setattr(fc, "fit_forest", None)
    path = f"file://{tmp_path}/selection.json"
    assert forecasting.select_and_lock(spark, D, path)["result"]["history"] == "A"  # a tie: the shorter history
    assert forecasting.final_rows(spark, D, path).where("prediction <> baseline").count() == 0


def test_no_evaluation_reaches_the_test_days():
    for fold in fc.FOLDS:
        fc.before_holdout(fold.end)
    with pytest.raises(ValueError, match="test days"):
        fc.before_holdout("2024-01-28 00:00:01")


def test_tasks_side_by_side_keep_their_order_and_overlap(spark):
    both = threading.Barrier(2, timeout=60)

    def task(k):
        if k < 2:
            both.wait()  # only if two run at once
        return spark.range(k + 1).count()

    assert forecasting.side_by_side(spark, [lambda k=k: task(k) for k in range(5)], 2) == [1, 2, 3, 4, 5]
    with pytest.raises(ZeroDivisionError):
        forecasting.side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    b = spark.createDataFrame([(2, 5.0), (1, None)], "k long, w double")
    assert sorted(map(tuple, checks.one_to_one(a, b, ["k"]).collect())) == [(1, "x", None), (2, None, 5.0)]
    for left, right in ((a.where("k = 1"), b), (a, b.where("k = 1")), (a.unionByName(a), b), (a, b.unionByName(b.where("k = 2")))):
        with pytest.raises(Exception, match="exactly one row"):
            checks.one_to_one(left, right, ["k"]).collect()


def test_states_stand_side_by_side(spark):
    grid = acceptance.gapped_grid(spark, D).withColumn("state", acceptance.state())
    assert {r.state for r in grid.select("state").distinct().collect()} == {"missing", "masked", "zero", "counted"}
    for state, recorded, target in (("missing", True, True), ("masked", False, True), ("zero", False, False)):
        rows = grid.where(F.col("state") == state)
        assert rows.where(F.col("recorded").isNull() != F.lit(recorded)).count() == 0 and rows.where(F.col("target").isNull() != F.lit(target)).count() == 0
    assert grid.where("state = 'zero' and (recorded <> 0 or target <> 0 or not eligible)").count() == 0


def test_changes_of_files_are_all_named():
    was = {"inputs": {"a": "1", "b": "2"}, "outputs": {"c": "3"}}
    now = {"inputs": {"a": "1", "b": "9"}, "outputs": {"d": "4"}}
    assert checks.file_changes(was, now) == [("inputs", "b", "2", "9"), ("outputs", "c", "3", None), ("outputs", "d", None, "4")]
    assert checks.file_changes(was, was) == []


def test_digests_of_files_do_not_depend_on_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LEAF_LINES", 7)
    r, folder = random.Random(3), tmp_path / "f"
    folder.mkdir()
    held = {"text": b"one\ntwo\n\nthree", "binary": r.randbytes(60_000), "bom": b"\xef\xbb\xbfa\r\nb\n", "none": b"", "newline": b"\n", "long line": b"x" * 70_000 + b"\ny", "swapped": b"two\none\n\nthree"}
    for name, data in held.items():
        (folder / name).write_bytes(data)

    def plain(data):
        lines = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")  # Spark's reader leaves a byte order mark out; the size tells
        lines = lines if lines[-1] else lines[:-1]
        each = [hashlib.sha256(x).hexdigest() for x in lines]
        leaves = [hashlib.sha256("".join(each[i : i + 7]).encode()).hexdigest() for i in range(0, len(each), 7)]
        return len(data), len(lines), hashlib.sha256(f"{len(data)}:{''.join(leaves)}".encode()).hexdigest()

    found = []
    for size in ("1000", "100m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found.append({x["name"]: (x["bytes"], x["lines"], x["digest"]) for x in files.file_facts(spark, f"file://{folder}").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == {name: plain(data) for name, data in held.items() if data} and found[0]["text"] != found[0]["swapped"]

"""The store: loaded once for an input, read by filters, found again only for the same input."""

import threading

import pytest
from pyspark.sql import functions as F

from hourloom.plans import served
from hourloom.sources.tables import read

D = "/root/testdata/sf0.01"


def test_a_store_is_loaded_once_and_read_by_filters(spark, monkeypatch):
    loads, load = [], served.load
    monkeypatch.setattr(served, "load", lambda s, d: loads.append(d) or load(s, d))
    first, again = served.open_store(spark, D), served.open_store(spark, D)
    assert first == again and len(loads) <= 1
    rows = first.hours("hourly", 3, "2024-01-10 00:00:00", "2024-01-15 00:00:00")
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "EqualTo(zone,3)" in scan and "GreaterThanOrEqual(second" in scan and "LessThan(second" in scan and rows.count() == 120
    for bad in (("2023-12-31", "2024-01-03"), ("2024-01-05", "2024-01-04"), ("2024-01-20", "2024-01-30")):
        with pytest.raises(ValueError, match="range"):
            first.history(3, *bad)
    with pytest.raises(Exception, match="not complete"):
        first.history(77, "2024-01-10", "2024-01-11").collect()


def test_another_input_has_another_store(spark, tmp_path):
    for t in ("events",):
        read(spark, D, t).where("ts < timestamp_ntz'2024-01-20'").write.parquet(f"{tmp_path}/{t}.parquet")
    assert served.context(spark, str(tmp_path)) != served.context(spark, D)
    read(spark, D, "events").repartition(3).write.parquet(f"{tmp_path}/same/events.parquet")
    assert served.context(spark, f"{tmp_path}/same") == served.context(spark, D)  # the same rows


def test_several_at_once_share_one_store(spark, tmp_path, monkeypatch):
    made = []

    def load(s, d):
        home = f"file://{tmp_path}/home{len(made)}"
        made.append(home)
        for t in served.TABLES:
            s.range(1).write.parquet(f"{home}/{t}")
        served.files.write_manifest(s, f"{home}/accepted.json", True)
        return home

    monkeypatch.setattr(served, "load", load)
    monkeypatch.setattr(served, "context", lambda s, d: f"several-{tmp_path.name}")
    monkeypatch.setattr(served, "shared_base", lambda s: f"file://{tmp_path}")
    got, threads = [], []
    for _ in range(3):
        threads.append(threading.Thread(target=lambda: got.append(served.open_store(spark, D).home)))
        threads[-1].start()
    for t in threads:
        t.join()
    assert len(got) == 3 and len(set(got)) == 1 and got[0] in made
    (tmp_path / got[0].rsplit("/", 1)[1] / "accepted.json").unlink()
    with pytest.raises(ValueError, match="not whole"):
        served.open_store(spark, D)


def test_sums_that_do_not_agree_are_not_accepted(spark, monkeypatch):
    summaries, calls = served.serving.summaries, []
    monkeypatch.setattr(served.serving, "summaries", lambda rows: calls.append(1) or (summaries(rows).withColumn("recorded", F.col("recorded") + 1) if len(calls) == 1 else summaries(rows)))
    with pytest.raises(ValueError, match="do not agree"):
        served.load(spark, D)

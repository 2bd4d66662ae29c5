from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions.time import inside, us_clock_changes
from hourloom.operators import checks, clean, features, forecast, grid, keyed, profile, serving
from hourloom.sources import files, tables
from hourloom.sources.tables import Plan

JANUARY = Plan("2024-01-01 00:00:00", "2024-02-01 00:00:00", (264, 265))
TRIP = "pickup timestamp_ntz, dropoff timestamp_ntz, zone long, distance double, fare double, total double, passengers long"


def at(text):
    return datetime.fromisoformat(text)


def test_interval_is_half_open_and_zones_and_durations_follow(spark):
    one, two = at("2024-01-01 00:00"), at("2024-01-01 00:10")
    rows = [
        (at("2023-12-31 00:00"), at("2024-02-02"), 264, 1.0, 1.0, 1.0, 1), (at("2024-02-01 00:00"), at("2024-02-02"), 1, 1.0, 1.0, 1.0, 1), (at("2024-01-31 23:59"), at("2024-02-02"), 1, 1.0, 1.0, 1.0, 1),
        (one, two, 264, 1.0, 1.0, 1.0, 1), (one, one, 265, 1.0, 1.0, 1.0, 1), (two, one, 1, 1.0, 1.0, 1.0, 1), (one, one, 1, 1.0, 1.0, 1.0, 1), (one, two, 1, 1.0, -5.0, -7.0, None),
    ]
    df = clean.classify(clean.require_known(spark.createDataFrame(rows, TRIP)), JANUARY)
    assert [r.reason for r in df.collect()] == ["pickup_before_start", "pickup_at_or_after_end", None, "excluded_zone_264", "excluded_zone_265", "negative_duration", "zero_duration", None]
    n = clean.disposition_counts(df).first()
    assert n.raw == n.outside_interval + n.excluded_zone + n.nonpositive_duration + n.retained == 8


def test_unknown_conditions_stop(spark):
    df = spark.createDataFrame([(None, at("2024-01-01"), 1, 1.0, 1.0, 1.0, 1)], TRIP)
    with pytest.raises(Exception, match="null time or zone"):
        clean.require_known(df).collect()
    with pytest.raises(ValueError, match="starts?"):
        inside(F.lit(1), "2024-01-02", "2024-01-01")


def test_flags_and_sensitivity(spark):
    one = at("2024-01-01 00:00")
    rows = [(one, at("2024-01-01 00:10"), 1, 0.0, -5.0, -7.0, None), (one, at("2024-01-02 01:00"), 1, 300000.0, 10.0, 12.0, 0), (one, at("2024-01-02 02:00"), 1, None, None, None, 1), (one, at("2024-01-01 00:05"), 1, 1.0, 1.0, 1.0, 1)]
    df = clean.flags(spark.createDataFrame(rows, TRIP))
    a, b, c, _ = df.collect()
    assert (a.q_passenger_missing, a.q_duration_gt_24h, a.q_distance_zero, a.q_fare_negative) == (True, False, True, True)
    assert (b.q_duration_gt_24h, b.q_passenger_missing, b.q_passenger_zero) == (True, False, True)
    assert (c.q_distance_zero, c.q_fare_negative, c.q_total_negative) == (False, False, False)
    assert [tuple(r)[2:] for r in clean.sensitivity(df, F.col("pickup")).collect()] == [(4, 2, 2)]


def test_bands(spark):
    values = [None, -1, 0, 60_000_000, 60_000_001, 86_400_000_000, 86_400_000_001]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(profile.band(F.col("v")).alias("b"))
    assert [r.b for r in df.collect()] == ["missing_time", "negative", "zero", "(0,1] min", "(1,5] min", "(6,24] hours", ">24 hours"]


def test_zone_classes(spark):
    rows = [(None, None, False), (999, None, False), (264, "N/A", True), (265, "Outside", True), (1, "Newark", True)]
    df = spark.createDataFrame(rows, "zone long, name string, known boolean").select(profile.zone_class(F.col("name"), F.col("zone"), F.col("known")).alias("c"))
    assert [r.c for r in df.collect()] == ["missing_id", "not_in_lookup", "unknown_zone", "outside_unspecified", "named_zone"]


def test_grid_keeps_null_zero_and_masked_apart(spark):
    plan = Plan("2024-11-03 00:00:00", "2024-11-03 04:00:00", (), ())
    counts = spark.createDataFrame([(1, at("2024-11-03 00:00"), 3), (1, at("2024-11-03 03:00"), 8)], "zone long, hour timestamp_ntz, trips long")
    covered = spark.createDataFrame([(at(f"2024-11-03 0{h}:00"),) for h in (0, 1, 3)], "hour timestamp_ntz")
    zones = spark.createDataFrame([(1,)], "zone long")
    g = grid.dense(counts, covered, zones, plan)
    assert [(r.recorded, r.target, r.eligible, r.q_zero) for r in g.orderBy("hour").collect()] == [(3, 3, True, False), (0, 0, True, True), (None, None, False, False), (8, 8, True, False)]
    masked = grid.dense(counts, covered, zones, Plan(plan.start, plan.end, (), ("2024-11-03",)))
    assert [(r.recorded, r.target) for r in masked.orderBy("hour").collect()] == [(3, None), (0, None), (None, None), (8, None)]
    day = Plan(plan.start, plan.end, (), ("2024-11-03",))
    assert set(checks.grid_acceptance(masked, day, zones, 4).first()) == {0}


def test_grid_acceptance_names_what_is_wrong(spark):
    plan, h = Plan("2024-01-01 00:00:00", "2024-01-01 02:00:00"), [at("2024-01-01 00:00"), at("2024-01-01 01:00")]
    right = [(1, h[0], 0, 0, False, False, True, True), (1, h[1], None, None, True, False, False, False)]
    zones = spark.createDataFrame([(1,)], "zone long")

    def broken(*rows):
        found = checks.grid_acceptance(spark.createDataFrame(list(rows), GRID), plan, zones, 2).first().asDict()
        return {k for k, n in found.items() if n}

    assert broken(*right) == set()
    assert broken(right[0]) == {"zones_out_of_place"} and broken(*right, right[0]) == {"repeated"}
    assert broken() == {"absent_zones"}
    assert broken(right[0], (1, h[1], 4, 4, False, True, False, True)) == {"wrong_mask", "wrong_eligible"}
    assert broken(right[0], (1, h[1], 4, 3, False, False, True, True)) == {"wrong_target", "wrong_zero"}
    assert broken(*right, (2, at("2024-01-01 02:30"), -1, -1, False, False, False, True)) >= {"unknown_zone", "outside_interval", "off_the_hour", "negative"}


def test_row_conservation_and_sums(spark):
    with pytest.raises(Exception, match="lost or made"):
        checks.conserved(spark.createDataFrame([(5, 2, 2)], "raw long, a long, b long"), "raw", ("a", "b")).collect()
    assert checks.conserved(spark.createDataFrame([(5, 2, 3)], "raw long, a long, b long"), "raw", ("a", "b")).first().raw == 5


def test_issue_and_band_counters(spark):
    one, two = at("2024-01-01 00:00"), at("2024-01-01 00:10")
    rows = [(at("2023-12-31 00:00"), one, 1, 0.0, 0.0, -1.0, -2), (at("2024-02-01 00:00"), two, 1, -1.0, -5.0, 0.0, 0), (one, one, 1, None, None, None, None), (one, None, 1, 2.0, 3.0, 4.0, 1)]
    df = spark.createDataFrame(rows, TRIP)
    n = profile.issues(df, JANUARY).first().asDict()
    assert n == {
        "pickup_before_start": 1, "pickup_at_or_after_end": 1, "dropoff_before_pickup": 1, "dropoff_equal_pickup": 1, "distance_negative": 1, "distance_zero": 1, "passengers_negative": 1, "passengers_zero": 1,
        "fare_negative": 1, "fare_zero": 1, "total_negative": 1, "total_zero": 1,
    }
    bands = {r.band: r for r in profile.band_profile(df.withColumn("band", profile.band(clean.duration()))).collect()}
    assert set(bands) == set(profile.BANDS) and (bands["zero"].distance_missing, bands["zero"].passenger_missing, bands["negative"].total_zero, bands["missing_time"].n) == (1, 1, 1, 1)


def test_clock_changes():
    assert us_clock_changes(2024) == [date(2024, 3, 10), date(2024, 11, 3)]
    assert us_clock_changes(2025) == [date(2025, 3, 9), date(2025, 11, 2)]
    with pytest.raises(ValueError):
        us_clock_changes(2006)


def causal(spark, change=""):
    hours = "explode(sequence(TIMESTAMP_NTZ'2023-12-25 00:00:00', TIMESTAMP_NTZ'2023-12-25 00:00:00' + INTERVAL 219 HOURS, INTERVAL 1 HOUR))"
    df = spark.range(1, 3).selectExpr("id AS zone", f"{hours} AS hour")
    df = df.withColumn("i", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2023-12-25 00:00:00', hour)")).withColumn("target", F.expr("i + 1000 * zone").cast("long"))
    df = df.withColumn("target", F.expr(change)) if change and not change.startswith("drop") else df
    df = df.where("not (zone = 1 and i = 179)") if change == "drop" else df
    return features.add_features(df)


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ("", (1179.0, 1178.0, 1156.0, 1012.0, 1167.5, 1095.5, True)),
        ("CASE WHEN i >= 180 THEN -1 ELSE target END", (1179.0, 1178.0, 1156.0, 1012.0, 1167.5, 1095.5, True)),
        ("CASE WHEN zone = 1 AND i = 178 THEN NULL ELSE target END", (1179.0, None, 1156.0, 1012.0, None, None, False)),
        ("drop", (None, 1178.0, 1156.0, 1012.0, None, None, False)),
        ("CASE WHEN i = 179 THEN 0 ELSE target END", (0.0, 1178.0, 1156.0, 1012.0, None, None, True)),
    ],
)
def test_features_are_causal(spark, change, expected):
    r = causal(spark, change).where("zone = 1 and i = 180").first()
    got = (r.lag_1, r.lag_2, r.lag_24, r.lag_168, r.mean_24, r.mean_168, r.features_complete)
    if "= 179" in change:
        assert got[0] == 0.0 and got[6]
    else:
        assert got == expected
    assert causal(spark, change).where("zone = 2 and i = 0").first().lag_1 is None


def test_metrics_pool_and_guard(spark):
    sums = spark.createDataFrame([(1, 10.0, 100.0, 0.0), (9, 0.0, 0.0, 10.0)], "n long, absolute_error double, squared_error double, actual_sum double")
    m = forecast.pool(sums).first()
    assert (m.mae, m.wape, m.rmse) == (1.0, 1.0, round(10**0.5, 6))
    z = forecast.finish(spark.createDataFrame([(2, 3.0, 5.0, 0.0)], sums.schema)).first()
    assert (z.mae, z.wape) == (1.5, None)
    with pytest.raises(Exception, match="no rows"):
        forecast.finish(spark.createDataFrame([(0, 0.0, 0.0, 0.0)], sums.schema)).collect()
    with pytest.raises(Exception, match="finite"):
        forecast.score(spark.createDataFrame([(float("inf"), 1)], "prediction double, target long")).collect()


def test_ranking_prefers_the_simple_and_refuses_other_rows(spark):
    rows = [("rf", "B", 8, 10, 1.0), ("rf", "A", 12, 10, 1.0), ("naive", "B", 0, 10, 1.0), ("rf", "A", 8, 10, 1.0)]
    df = spark.createDataFrame(rows, "model string, history string, depth int, n long, mae double")
    assert [(r.model, r.history, r.depth) for r in forecast.rank_candidates(df).collect()] == [("naive", "B", 0), ("rf", "A", 8), ("rf", "A", 12), ("rf", "B", 8)]
    with pytest.raises(Exception, match="different rows"):
        forecast.rank_candidates(df.withColumn("n", F.when(F.col("depth") == 8, 9).otherwise(10).cast("long"))).collect()


GRID = "zone long, hour timestamp_ntz, recorded long, target long, q_source_missing boolean, q_masked_day boolean, q_zero boolean, eligible boolean"


def test_codec_merge_and_fingerprint(spark):
    h = at("2024-01-01 00:00")
    g = spark.createDataFrame([(1, h, 0, 0, False, False, True, True), (2, h, 5, None, False, True, False, False), (3, h, None, None, True, False, False, False)], GRID)
    table = keyed.encode(g).cache()
    cells = {r.key: r.cells for r in table.collect()}
    assert cells["001#2024010100"]["d:recorded"] == "0" and "d:target" not in cells["002#2024010100"] and "d:recorded" not in cells["003#2024010100"]
    assert sorted(map(tuple, keyed.decode(table).collect()), key=str) == sorted(map(tuple, g.collect()), key=str)
    with pytest.raises(Exception, match="breaks a rule"):
        keyed.encode(spark.createDataFrame([(1, h, 3, 4, False, False, False, True)], GRID)).collect()
    for bad in ((1, h, 3, 3, False, False, True, True), (1, h, 0, 0, False, False, False, True), (1, h, 3, 3, False, False, None, True), (1, h, -1, -1, False, False, False, True), (300, h, 3, 3, False, False, False, True)):
        with pytest.raises(Exception, match="breaks a rule"):
            keyed.encode(spark.createDataFrame([bad], GRID), 1, 263).collect()
    with pytest.raises(Exception, match="three digits"):
        spark.range(1000, 1001).select(keyed.zone_text(F.col("id"))).collect()
    with pytest.raises(Exception, match="repeats in the changes"):
        keyed.upsert(table, table.where("key like '001%'").unionByName(table)).collect()
    assert [tuple(r) for r in keyed.year_totals(table).collect()] == [("2024", 3, 5, 0, 1, 1, 1, 1)]
    gone = keyed.encode(spark.createDataFrame([(1, h, None, None, True, False, False, False)], GRID))
    once = keyed.upsert(table, gone)
    assert "d:recorded" not in {r.key: r.cells for r in once.collect()}["001#2024010100"]
    prints = [keyed.fingerprint(x).first().fingerprint for x in (once, keyed.upsert(once, gone), table, table.repartition(3))]
    assert prints[0] == prints[1] and prints[2] == prints[3] and prints[0] != prints[2]
    a, b, c = [spark.createDataFrame([("k", x)], "key string, cells map<string,string>") for x in ({"a": "bc"}, {"ab": "c"}, {})]
    assert len({keyed.fingerprint(x).first().fingerprint for x in (a, b, c)}) == 3
    with pytest.raises(Exception, match="over its limit"):
        keyed.scan(table, "001", "004", 2).collect()
    assert keyed.scan(table, "001", "003#", 2).count() == 2
    with pytest.raises(Exception, match="key is missing"):
        keyed.multi_get(table, spark.createDataFrame([("009",)], "key string")).collect()


def test_compare_finds_missing_extra_and_changed(spark):
    a = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "k long, v long")
    b = spark.createDataFrame([(1, 1), (2, None), (3, 4), (4, None)], "k long, v long")
    assert sorted(r.k for r in keyed.differences(a, b, ["k"]).collect()) == [3, 4]


def test_schema_rules(spark):
    schema = T.StructType.fromDDL("a long, fee double")
    out = tables.normalise(spark.createDataFrame([(1,)], "a long"), schema, optional=("fee",))
    assert out.first() == (1, None) and out.dtypes == [("a", "bigint"), ("fee", "double")]
    assert tables.normalise(spark.createDataFrame([(1, 2.0)], "a long, Fee2 double"), schema, aliases={"Fee2": "fee"}).first() == (1, 2.0)
    for bad in ("a long, fee double, x int", "fee double"):
        with pytest.raises(ValueError):
            tables.normalise(spark.createDataFrame([], bad), schema, optional=("fee",))
    with pytest.raises(Exception, match="does not fit"):
        tables.normalise(spark.createDataFrame([(1, 2**53 + 1)], "a long, fee long"), schema).collect()


def test_manifests_gate_what_is_read(spark, tmp_path):
    schema = T.StructType.fromDDL("a long, fee double")
    spark.createDataFrame([(1,), (2,)], "a long").write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([(3, 0.5)], "a long, fee double").write.parquet(f"{tmp_path}/new")

    def manifest(name, complete, *rows):
        files.write_manifest(spark, f"{tmp_path}/{name}.json", complete, files=[{"period": p, "path": f"{tmp_path}/{x}", "rows": n} for p, x, n in rows])
        return f"{tmp_path}/{name}.json"

    one, two = manifest("one", True, ("1", "old", 2)), manifest("two", True, ("2", "new", 1))
    rows = files.open_listed(spark, files.listed(spark, [one, two]), schema, optional=("fee",))
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, None), (2, None), (3, 0.5)]
    assert [f["period"] for f in files.listed(spark, [one], {"2": f"{tmp_path}/new"})] == ["1", "2"]
    for bad in ([one, one], [manifest("again", True, ("1", "new", 1)), one]):
        with pytest.raises(ValueError, match="twice"):
            files.listed(spark, bad)
    with pytest.raises(ValueError, match="twice"):
        files.listed(spark, [one], {"1": "x"})
    with pytest.raises(ValueError, match="not complete"):
        files.listed(spark, [manifest("half", False, ("1", "old", 2))])
    with pytest.raises(ValueError, match="2 rows, not 3"):
        files.open_listed(spark, files.listed(spark, [manifest("short", True, ("1", "old", 3))]), schema, optional=("fee",))


def test_sinks_do_not_overwrite_and_replace_periods(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v long, period string")
    files.write_new(df, f"{tmp_path}/new", "period")
    with pytest.raises(Exception, match="already exists"):
        files.write_new(df, f"{tmp_path}/new")
    files.replace_periods(df, f"{tmp_path}/p", "period")
    files.replace_periods(spark.createDataFrame([(9, "b")], "v long, period string"), f"{tmp_path}/p", "period")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1, 9]
    files.export_csv(spark.createDataFrame([(1, "é"), (2, None)], "id long, name string"), f"{tmp_path}/l.csv")
    assert open(f"{tmp_path}/l.csv", "rb").read()[:3] == b"\xef\xbb\xbf"
    assert sorted(map(tuple, files.lookup_csv(spark, f"{tmp_path}/l.csv", "id long, name string", "id").collect())) == [(1, "é"), (2, None)]
    with pytest.raises(ValueError, match="too long"):
        files.export_csv(spark.range(5), f"{tmp_path}/x.csv", 4)
    files.export_csv(spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string"), f"{tmp_path}/twice.csv")
    with pytest.raises(Exception, match="repeats in the lookup"):
        files.lookup_csv(spark, f"{tmp_path}/twice.csv", "id long, name string", "id").collect()


def test_file_facts_are_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc" * 1000)
    line = hashlib.sha256(b"abc" * 1000).hexdigest()
    digest = hashlib.sha256(b"3000:" + hashlib.sha256(line.encode()).hexdigest().encode()).hexdigest()
    assert [tuple(r) for r in files.file_facts(spark, f"{tmp_path}/f.bin").collect()] == [("f.bin", 3000, 1, digest)]


def test_steps_resume_only_what_is_unchanged(spark, tmp_path):
    (tmp_path / "in.txt").write_text("one")
    ran = []

    def run(path):
        ran.append(path)
        spark.range(3).write.parquet(path)

    def step():
        return checks.resume(spark, f"{tmp_path}/step", f"{tmp_path}/in.txt", run)

    assert step() == step() and len(ran) == 1
    (tmp_path / "in.txt").write_text("two")
    with pytest.raises(ValueError, match=r"inputs/in.txt \(changed\)$"):
        step()
    (tmp_path / "in.txt").write_text("one")
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/step/data")
    with pytest.raises(ValueError, match=r"outputs/.*\(gone\), outputs/.*\(new\)"):
        step()
    (tmp_path / "step" / "record.json").unlink()
    with pytest.raises(ValueError, match="no record of an end"):
        step()


def test_locks_and_preflight(spark, tmp_path):
    a, b = checks.context_hash(x=1, y=2), checks.context_hash(y=2, x=1)
    assert a == b != checks.context_hash(x=2, y=2)
    first = checks.lock(spark, f"{tmp_path}/l.json", a, {"winner": 1})
    assert checks.lock(spark, f"{tmp_path}/l.json", a, {"winner": 2}) == first
    with pytest.raises(ValueError, match="another context"):
        checks.lock(spark, f"{tmp_path}/l.json", "other", {})
    assert checks.preflight(spark.range(3), {"id": "bigint"}, 3) == 3
    with pytest.raises(ValueError, match="schema"):
        checks.preflight(spark.range(3), {"id": "int"})
    with pytest.raises(ValueError, match="3 rows"):
        checks.preflight(spark.range(3), {"id": "bigint"}, 4)
    with pytest.raises(ValueError, match="missing tables"):
        checks.tables_ready(spark, f"{tmp_path}", ("hourly",))


def test_edges_of_a_stored_hour(spark):
    """Zero, then missing, then zero, then masked: each state takes the place of the one before, cells and all."""
    h, states = at("2024-01-01 00:00"), [(0, 0, False, False, True, True), (None, None, True, False, False, False), (0, 0, False, False, True, True), (0, None, False, True, True, False)]
    table = keyed.encode(spark.createDataFrame([(1, h, *states[0])], GRID))
    for state in states[1:]:
        change = keyed.encode(spark.createDataFrame([(1, h, *state)], GRID))
        table = keyed.upsert(table, change)
        assert keyed.differences(*[x.select("key", keyed.cells_text(F.col("cells")).alias("c")) for x in (table, change)], ["key"]).count() == 0


def test_forecasts_and_summaries_are_stored_and_guarded(spark):
    h = at("2024-01-02 00:00")
    schema = "zone long, hour timestamp_ntz, origin timestamp_ntz, prediction double, baseline double, method string, features_complete boolean, model_version string"
    good = (7, h, at("2024-01-01 23:00"), 1.25, 2.0, "random_forest", True, "m")
    table = keyed.encode_forecasts(spark.createDataFrame([good], schema), "m", "now")
    r = keyed.decode_forecasts(table).first()
    assert (r.zone, r.hour, r.origin, r.prediction, r.baseline, r.method, r.features_complete) == ("007", h, good[2], 1.25, 2.0, "random_forest", True)
    assert table.first().key == "007#2024010200#m#1" and not any("actual" in k or "target" in k for k in table.first().cells)
    for bad in ((7, h, h, *good[3:]), (*good[:-1], "other"), (*good[:3], float("nan"), *good[4:])):
        with pytest.raises(Exception, match="of the forecast is wrong"):
            keyed.encode_forecasts(spark.createDataFrame([bad], schema), "m", "now").collect()
    s = spark.createDataFrame([("D", "20240101", 3, None, 24, 24, 0)], "kind string, period string, zone long, recorded long, hours long, missing long, masked long")
    stored = keyed.encode_summaries(s)
    assert stored.first().cells["d:summary"] == '{"hours":24,"masked":0,"missing":24,"period":"20240101","recorded":null,"zone":3}'
    assert keyed.decode_summaries(stored).first() == ("D", 24, 0, 24, "20240101", None, 3)


def test_joins_of_forecasts_and_complete_ranges(spark):
    h = at("2024-01-02 00:00")
    g = spark.createDataFrame([(1, h, True)], "zone long, hour timestamp_ntz, eligible boolean")
    none = spark.createDataFrame([], "zone long, hour timestamp_ntz, prediction double, baseline double")
    assert serving.joined(g, none).first().prediction is None and serving.joined(g, none, "2024-01-03 00:00:00").first().prediction is None
    with pytest.raises(Exception, match="has no forecast"):
        serving.joined(g, none, "2024-01-02 00:00:00").collect()
    twice = spark.createDataFrame([(1, h, 1.0, 1.0)] * 2, none.schema)
    with pytest.raises(Exception, match="forecast repeats"):
        serving.joined(g, twice).collect()
    days = spark.createDataFrame([("D", "20240101", 1, 5, 24, 0, 0), ("D", "20240102", 1, 7, 24, 0, 0)], "kind string, period string, zone long, recorded long, hours long, missing long, masked long")
    assert tuple(serving.headline(serving.daily(days, "2024-01-01", "2024-01-02", 1)).first()) == (12, 6.0, 0, 1)
    with pytest.raises(Exception, match="not complete"):
        serving.daily(days, "2024-01-01", "2024-01-03", 1).collect()
    with pytest.raises(Exception, match="not complete"):
        serving.monthly(days, 1, 1).collect() or serving.require_rows(days, 3).collect()


def test_roles_and_selection_guards(spark):
    assert forecast.role_span("A", "train", 1) == (forecast.HISTORIES["A"], forecast.FOLDS[1].start) and forecast.role_span("B", "final_train")[1] == forecast.TEST.start
    with pytest.raises(ValueError, match="unknown role"):
        forecast.role_span("A", "holdout")
    schema = "history string, depth int, fold string, n long, absolute_error double, squared_error double, actual_sum double, naive_n long, naive_absolute_error double, naive_squared_error double, naive_actual_sum double"
    rows = [("A", d, "f0", 10, 5.0 - d / 10, 9.0, 20.0, 10, 8.0, 16.0, 20.0) for d in (8, 12)]
    ranked = forecast.rank_candidates(forecast.pool(forecast.guarded(spark.createDataFrame(rows, schema)), "model", "history", "depth")).collect()
    assert [(r.model, r.depth) for r in ranked] == [("random_forest", 12), ("random_forest", 8), ("naive", 0)]
    for at_, value, why in ((3, 9, "different rows"), (8, 7.0, "baseline changed")):
        other = list(rows[1])
        other[at_] = value
        with pytest.raises(Exception, match=why):
            forecast.guarded(spark.createDataFrame([rows[0], tuple(other)], schema)).collect()


def test_range_guard():
    assert serving.check_range("2024-01-01", "2024-01-31", "2023-01-01", "2025-12-31") == 31
    for a, b in (("2024-01-01", "2024-02-01"), ("2024-01-02", "2024-01-01"), ("2022-12-31", "2023-01-01")):
        with pytest.raises(ValueError):
            serving.check_range(a, b, "2023-01-01", "2025-12-31")

"""Queries over splits, baseline, metrics and the forest."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, features, grid, keyed
from ..operators import forecast as fc
from ..sources import bucketed
from ..sources.shared import shared_dir, written
from ..sources.tables import read
from . import sql
from .gridding import featured, shown

T = TypeVar("T")
DEPTHS = (8, 12)
START, CUT, END = fc.TEST.train_start, fc.TEST.start, fc.TEST.end


def based(s: SparkSession, d: str, zones: str = "true") -> DataFrame:
    frame = featured(s, d)
    train = fc.training(frame, fc.TEST).where(zones)
    return fc.baseline(frame, fc.zone_means(train), fc.global_mean(train))


def test_rows(s: SparkSession, d: str) -> DataFrame:
    return fc.labelled(based(s, d), CUT, END)


def splits(s: SparkSession, d: str) -> DataFrame:
    frame = featured(s, d)

    def row(name: str, start: str, end: str, history: str) -> DataFrame:
        rows = fc.labelled(frame, start, end)
        return rows.agg(F.count("*").alias("n"), F.count_if("features_complete").alias("complete")).select(F.lit(name).alias("part"), F.lit(history).alias("history"), "n", "complete")

    out = [row(f.name, f.start, f.end, "-") for f in (*fc.FOLDS, fc.TEST)]
    out += [row(f"train_{f.name}", start, f.start, h) for f in fc.FOLDS for h, start in fc.HISTORIES.items()]
    return reduce(DataFrame.unionByName, out)


def fold_frame(s: SparkSession, frame: DataFrame) -> DataFrame:
    """Validation rows of every fold and history with their baseline; all from one frame, met by a table of folds (a row each)."""
    folds = s.createDataFrame([(f.name, h, start, f.start, f.end) for f in fc.FOLDS for h, start in fc.HISTORIES.items()], "fold string, history string, a string, b string, c string")
    folds = folds.select("fold", "history", *[F.col(x).cast("timestamp_ntz").alias(x) for x in "abc"])
    hours = frame.where("eligible")
    train = hours.join(folds, (F.col("hour") >= F.col("a")) & (F.col("hour") < F.col("b")))
    by_zone = train.groupBy("fold", "history", "zone").agg(F.avg("target").alias("zone_mean"))
    overall = train.groupBy("fold", "history").agg(F.avg("target").alias("global_mean"))
    rows = hours.join(folds, (F.col("hour") >= F.col("b")) & (F.col("hour") < F.col("c"))).drop(*"abc")
    rows = rows.join(by_zone, ["fold", "history", "zone"], "left").join(overall, ["fold", "history"], "left")
    return rows.withColumn("baseline", F.greatest(F.lit(0.0), F.coalesce("lag_168", "zone_mean", "global_mean")))


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Error sums of naive and two formulas by history and fold, in one pass."""
    rows = fold_frame(s, written(featured(s, d)))
    formulas = {"naive": (0, F.col("baseline")), "mean": (1, F.coalesce("mean_24", "baseline")), "blend": (2, (F.coalesce("mean_168", "baseline") + F.col("baseline")) / 2)}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("depth"), v.alias("prediction")) for m, (k, v) in formulas.items()]))
    return rows.select("fold", "history", "target", each.alias("x")).select("fold", "history", "target", "x.*").groupBy("model", "history", "depth", "fold").agg(*fc.error_sums())


def side_by_side(s: SparkSession, tasks: list[Callable[[], T]], most: int = 4) -> list[T]:
    """Results of ``tasks`` in order, ``most`` of them at a time, each in a pool of its own, so that the short stages of one fill the gaps of the others (with a fair scheduler, evenly)."""

    def run(k: int) -> T:
        s.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{k}")
        try:
            return tasks[k]()
        finally:
            s.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(inheritable_thread_target(s)(run), range(len(tasks))))


def rf_folds(s: SparkSession, d: str, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Error sums of naive and of the forest, fitted for every fold, history and depth (12 fits, side by side), by fold. No row of the test days is read."""
    frame = bucketed.store(featured(s, d).where(F.col("hour") < F.lit(CUT).cast("timestamp_ntz")), "zone", ["zone", "hour"], name="folds")

    def fits(fold: fc.Fold, history: str, start: str) -> DataFrame:
        fc.before_holdout(fold.end)
        train = fc.labelled(frame, start, fold.start)
        rows = written(fc.labelled(fc.baseline(frame, fc.zone_means(train), fc.global_mean(train)), fold.start, fold.end))
        fitted = fc.warmed(train, start).persist()  # a fit reads it once for each level of its trees
        both = [fc.forest_predictions(rows, fc.fit_forest(fitted, depth)).withColumn("depth", F.lit(depth)) for depth in depths]
        naive = [x.alias(f"naive_{n}") for x, n in zip(fc.error_sums("baseline"), ("n", "absolute_error", "squared_error", "actual_sum"), strict=True)]
        sums = reduce(DataFrame.unionByName, both).groupBy("depth").agg(*fc.error_sums(), *naive)
        out = written(sums.select(F.lit(history).alias("history"), "depth", F.lit(fold.name).alias("fold"), *[c for c in sums.columns if c != "depth"]))
        fitted.unpersist()
        return out

    tasks = [functools.partial(fits, fold, h, start) for fold in fc.FOLDS for h, start in fc.HISTORIES.items()]
    return reduce(DataFrame.unionByName, side_by_side(s, tasks))


def rf_candidate_ranking(s: SparkSession, d: str) -> DataFrame:
    """Naive and the forests by pooled error. Every candidate of a fold must have scored the same rows, and the baseline must not change with the depth of the forest beside it."""
    return fc.rank_candidates(fc.pool(fc.guarded(rf_folds(s, d)), "model", "history", "depth"))


def selection_context(s: SparkSession, d: str) -> str:
    """What a selection stands on: code, settings and the rows of the input."""
    settings = {"folds": [str(f) for f in fc.FOLDS], "histories": fc.HISTORIES, "depths": DEPTHS, "features": fc.FEATURES, "forest": fc.FOREST}
    return checks.context_hash(settings=settings, code=checks.code_digest(fc, features, grid), inputs=checks.input_digest(read(s, d, "events")))


def select_and_lock(s: SparkSession, d: str, path: str) -> dict:
    """The first of the ranked candidates, locked at ``path`` with its context; or what was locked there before with the same context."""
    best = written(rf_candidate_ranking(s, d)).orderBy("mae", (F.col("model") != "naive").cast("int"), (F.col("history") != "A").cast("int"), "depth").first()
    return checks.lock(s, path, selection_context(s, d), {k: best[k] for k in ("model", "history", "depth", "n", "mae")})


def final_rows(s: SparkSession, d: str, path: str) -> DataFrame:
    """Test rows with the predictions of the locked winner, fitted on all days before the test; an error if nothing is locked or the context has changed since."""
    winner = checks.unlocked(s, path, selection_context(s, d))["result"]
    start, end = fc.role_span(winner["history"], "final_train")
    frame = written(featured(s, d))
    train = fc.labelled(frame, start, end)
    rows = fc.labelled(fc.baseline(frame, fc.zone_means(train), fc.global_mean(train)), *fc.role_span(winner["history"], "test"))
    if winner["model"] == "naive":
        return rows.withColumn("prediction", F.col("baseline"))
    fitted = fc.warmed(train, start).persist()
    model = fc.fit_forest(fitted, winner["depth"])
    fitted.unpersist()
    return fc.forest_predictions(rows, model)


def rf_breakdowns(s: SparkSession, d: str) -> DataFrame:
    """The selected candidate, locked, fitted on all days before the test and scored on the test by zone, hour, month, demand and method, and the mean of the zones' errors."""
    path = f"{shared_dir(s, 'selected')}/selection.json"
    select_and_lock(s, d, path)
    both = written(final_rows(s, d, path))
    groups = {"zone": F.col("zone").cast("string"), "hour": F.col("hour_of_day").cast("string"), "month": F.date_format("hour", "yyyy-MM"), "demand": fc.demand_group(F.col("zone_mean")), "method": F.col("method"), "all": F.lit("all")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), c.alias("value")) for k, c in groups.items()]))
    out = fc.score(both.select("target", "prediction", each.alias("g")).select("target", "prediction", "g.*"), "part", "value")
    macro = out.where("part = 'zone'").agg(F.lit("macro").alias("part"), F.lit("zones").alias("value"), F.sum("n").alias("n"), F.round(F.avg("mae"), 6).alias("mae"), F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("double").alias("wape"))
    return out.unionByName(macro)


def model_bundle(s: SparkSession, d: str) -> DataFrame:
    """A fitted model saved with its zone means and facts, and loaded again: rows on which the loaded bundle differs, of a sorted sample of 100."""
    frame = featured(s, d)
    train = fc.training(frame, fc.TEST)
    means, overall = fc.zone_means(train), fc.global_mean(train)
    model = fc.fit_forest(fc.warmed(train, START))
    path = shared_dir(s, "bundle")
    fc.save_bundle(model, means, overall, {"depth": 8, "train_start": START, "train_end": CUT}, path)
    again, means2, overall2, facts = fc.load_bundle(s, path)
    sample = fc.labelled(frame, CUT, END).orderBy("zone", "hour").limit(100)
    a, b = [fc.forest_predictions(fc.baseline(sample, m, o), x).select("zone", "hour", "prediction", "baseline") for x, m, o in ((model, means, overall), (again, means2, overall2))]
    return keyed.differences(a, b, ["zone", "hour"]).agg(F.count("*").alias("differing")).withColumn("depth", F.lit(facts["depth"]).cast("long"))


def ranking(s: SparkSession, d: str) -> DataFrame:
    pooled = fc.pool(candidates(s, d), "model", "history", "depth")
    ranked = fc.rank_candidates(pooled)
    from pyspark.sql import Window

    at = F.row_number().over(Window.orderBy("mae", (F.col("model") != "naive").cast("int"), (F.col("history") != "A").cast("int"), "depth"))  # six candidates
    return ranked.withColumn("place", at.cast("long")).withColumn("depth", F.col("depth").cast("long"))


def hybrid(s: SparkSession, d: str) -> DataFrame:
    rows = test_rows(s, d)
    return fc.hybrid(rows, (F.col("lag_24") + F.col("mean_168")) / 2).select("zone", "hour", "target", "prediction", "baseline", "method", "features_complete")


def forest(s: SparkSession, d: str):
    frame = written(based(s, d))
    train = fc.warmed(fc.training(frame, fc.TEST), START).persist()  # a fit reads it once for each level of its trees
    model = fc.fit_forest(train)
    train.unpersist()
    return model, fc.labelled(frame, CUT, END)


def rf_predictions(s: SparkSession, d: str) -> DataFrame:
    model, rows = forest(s, d)
    return shown(fc.forest_predictions(rows, model).select("zone", "hour", "target", "prediction", "baseline", "method"))


def rf_metrics(s: SparkSession, d: str) -> DataFrame:
    model, rows = forest(s, d)
    both = written(fc.forest_predictions(rows, model).select("target", "prediction", "baseline"))
    return fc.score(both).withColumn("model", F.lit("random_forest")).unionByName(fc.score(both, prediction="baseline").withColumn("model", F.lit("naive")))


def rf_reload_equal(s: SparkSession, d: str) -> DataFrame:
    """Rows on which a saved and reloaded model differs from the fitted one: none."""
    model, rows = forest(s, d)
    path = shared_dir(s, "forest")
    model.write().save(path)
    again = PipelineModel.load(path)
    a, b = [fc.forest_predictions(rows, m).select("zone", "hour", "prediction") for m in (model, again)]
    return keyed.differences(a, b, ["zone", "hour"]).agg(F.count("*").alias("differing"))


def rf_importances(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(fc.importances(forest(s, d)[0]), "feature string, importance double")


BASED = f"WITH {sql.DENSE}, {sql.train(START, CUT)}"
TEST = f"{BASED}, test AS (SELECT * FROM based WHERE eligible AND hour >= TIMESTAMP '{CUT}' AND hour < TIMESTAMP '{END}')"
WITHOUT_CLICK = "zone <> 'click'"
GROUP = "CASE WHEN zone_mean < 1 THEN 'lt_1' WHEN zone_mean < 10 THEN 'lt_10' ELSE '10_plus' END"


def split_sql(name: str, start: str, end: str, history: str) -> str:
    return f"SELECT '{name}' AS part, '{history}' AS history, count(*) AS n, count_if(features_complete)::BIGINT AS complete FROM feature WHERE eligible AND hour >= TIMESTAMP '{start}' AND hour < TIMESTAMP '{end}'"


def candidate_sql() -> str:
    folds = [f"SELECT '{f.name}' AS fold, TIMESTAMP '{f.start}' AS a, TIMESTAMP '{f.end}' AS b, '{h}' AS history, TIMESTAMP '{start}' AS s" for f in fc.FOLDS for h, start in fc.HISTORIES.items()]
    return f"""WITH {sql.DENSE}, folds AS ({' UNION ALL '.join(folds)}),
    tr AS (SELECT fold, history, zone, target FROM folds JOIN feature ON eligible AND hour >= s AND hour < a), zm AS (SELECT fold, history, zone, avg(target) AS zone_mean FROM tr GROUP BY ALL), gm AS (SELECT fold, history, avg(target) AS global_mean FROM tr GROUP BY ALL),
    v AS (SELECT folds.fold, folds.history, f.*, greatest(0.0, coalesce(lag_168, zone_mean, global_mean)) AS baseline FROM folds JOIN feature f ON eligible AND hour >= a AND hour < b LEFT JOIN zm ON zm.fold = folds.fold AND zm.history = folds.history AND zm.zone = f.zone JOIN gm ON gm.fold = folds.fold AND gm.history = folds.history),
    p AS (SELECT 'naive' AS model, 0::BIGINT AS depth, history, target, baseline AS p FROM v UNION ALL SELECT 'mean', 1, history, target, coalesce(mean_24, baseline) FROM v UNION ALL SELECT 'blend', 2, history, target, (coalesce(mean_168, baseline) + baseline) / 2 FROM v),
    m AS ({sql.metrics('p', 'model, history, depth', 'p')})"""


QUERIES = {
    "label_split_counts": splits,
    "train_means": lambda s, d: shown(fc.zone_means(fc.training(featured(s, d), fc.TEST))),
    "baseline_predictions": lambda s, d: shown(test_rows(s, d), "zone", "hour", "target", "baseline", "method"),
    "baseline_methods": lambda s, d: test_rows(s, d).groupBy("method").agg(F.count("*").alias("n")),
    "baseline_global_fallback": lambda s, d: fc.labelled(based(s, d, "zone <> 'click'"), CUT, END).groupBy("zone", "method").agg(F.count("*").alias("n"), F.round(F.sum("baseline"), 6).alias("total")),
    "baseline_metrics": lambda s, d: fc.score(test_rows(s, d), prediction="baseline"),
    "metrics_by_zone": lambda s, d: fc.score(test_rows(s, d), "zone", prediction="baseline"),
    "metrics_by_hour": lambda s, d: fc.score(test_rows(s, d), F.col("hour_of_day").cast("long").alias("hour_of_day"), prediction="baseline"),
    "metrics_by_month": lambda s, d: fc.score(test_rows(s, d), F.date_format("hour", "yyyy-MM").alias("month"), prediction="baseline"),
    "metrics_by_day": lambda s, d: fc.score(test_rows(s, d), F.date_format("hour", "yyyy-MM-dd").alias("day"), prediction="baseline"),
    "metrics_by_demand_group": lambda s, d: fc.score(test_rows(s, d), fc.demand_group(F.col("zone_mean")).alias("demand"), prediction="baseline"),
    "macro_zone_mae": lambda s, d: fc.score(test_rows(s, d), "zone", prediction="baseline").agg(F.round(F.avg("mae"), 5).alias("macro_mae")),
    "pooled_metrics": lambda s, d: fc.pool(candidates(s, d), "model"),
    "candidate_ranking": ranking,
    "union_rf_fallback": lambda s, d: shown(hybrid(s, d)),
    "rf_predictions": rf_predictions,
    "rf_metrics": rf_metrics,
    "rf_reload_equal": rf_reload_equal,
    "rf_importances": rf_importances,
    "rf_candidate_ranking": rf_candidate_ranking,
    "rf_breakdowns": rf_breakdowns,
    "model_bundle": model_bundle,
}
ORACLE_SQL = {
    "label_split_counts": f"WITH {sql.DENSE} " + " UNION ALL ".join([split_sql(f.name, f.start, f.end, "-") for f in (*fc.FOLDS, fc.TEST)] + [split_sql(f"train_{f.name}", start, f.start, h) for f in fc.FOLDS for h, start in fc.HISTORIES.items()]),
    "train_means": f"{BASED} SELECT zone, round(zone_mean, 6) AS zone_mean FROM means",
    "baseline_predictions": f"{TEST} SELECT zone, {sql.stamp('hour')} AS hour, target, round(baseline, 6) AS baseline, method FROM test",
    "baseline_methods": f"{TEST} SELECT method, count(*) AS n FROM test GROUP BY method",
    "baseline_global_fallback": f"WITH {sql.DENSE}, {sql.train(START, CUT, WITHOUT_CLICK)} SELECT zone, method, count(*) AS n, round(sum(baseline), 6) AS total FROM based WHERE eligible AND hour >= TIMESTAMP '{CUT}' AND hour < TIMESTAMP '{END}' GROUP BY ALL",
    "baseline_metrics": f"{TEST} {sql.metrics('test')}",
    "metrics_by_zone": f"{TEST} {sql.metrics('test', 'zone')}",
    "metrics_by_hour": f"{TEST} {sql.metrics('test', 'hour_of_day')}",
    "metrics_by_month": f"{TEST}, t AS (SELECT *, strftime(hour, '%Y-%m') AS month FROM test) {sql.metrics('t', 'month')}",
    "metrics_by_day": f"{TEST}, t AS (SELECT *, strftime(hour, '%Y-%m-%d') AS day FROM test) {sql.metrics('t', 'day')}",
    "metrics_by_demand_group": f"{TEST}, t AS (SELECT *, {GROUP} AS demand FROM test) {sql.metrics('t', 'demand')}",
    "macro_zone_mae": f"{TEST}, m AS ({sql.metrics('test', 'zone')}) SELECT round(avg(mae), 5) AS macro_mae FROM m",
    "pooled_metrics": f"{candidate_sql()} {sql.metrics('p', 'model', 'p')}",
    "candidate_ranking": f"{candidate_sql()} SELECT *, row_number() OVER (ORDER BY mae, (model <> 'naive')::INT, (history <> 'A')::INT, depth) AS place FROM m",
    "union_rf_fallback": f"{TEST} SELECT zone, {sql.stamp('hour')} AS hour, target, round(CASE WHEN features_complete THEN greatest(0.0, (lag_24 + mean_168) / 2) ELSE baseline END, 6) AS prediction, round(baseline, 6) AS baseline, CASE WHEN features_complete THEN 'random_forest' ELSE 'fallback_' || method END AS method, features_complete FROM test",
}

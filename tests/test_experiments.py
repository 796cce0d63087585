"""Experiments see what was planted; chains run in order and know what is stale."""

import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import geo, panel, splits
from tidemark.operators.encoders import FeatureSpec
from tidemark.plans import chain, experiments, pipelines


@pytest.fixture(scope="module")
def features(spark):
    rng, rows = random.Random(3), []
    for i in range(2400):
        m, pc = rng.randrange(48), rng.choice(["2000", "2100", "2153", "2200"])
        area, level = rng.gauss(600, 60), {"2000": 0.0, "2100": 0.2, "2153": -0.1, "2200": 0.1}[pc]
        y = 5 + 0.4 * (area / 600) + level + 0.01 * m + rng.gauss(0, 0.03)
        rows.append((i, f"g{rng.randrange(1200)}", pc, splits._add(date(2015, 1, 1), m), 10**y, area, rng.gauss(0, 1)))
    clean = spark.createDataFrame(rows, "sale_id int, group_key string, post_code string, contract_date date, purchase_price double, area_sqm double, noise double")
    return pipelines.build_features(clean).persist()


@pytest.fixture(scope="module")
def folds(features):
    return splits.folds_of(features, min_train=24, horizon=6, step=6, holdout=6)


def test_presets(features):
    layers = experiments.layer_specs(features.columns)
    assert [n for n, _ in layers] == ["place", "calendar", "labels", "lagged_price", "unit_price", "dispersion", "liquidity"]
    assert all(set(a.numeric) <= set(b.numeric) for (_, a), (_, b) in zip(layers, layers[1:]))
    sets = experiments.feature_sets(features.columns)
    assert set(sets["full"].numeric) - set(sets["lean"].numeric) == {c for k in ("dispersion", "liquidity") for c in experiments.LAYERS[k].numeric}
    assert "year_num" not in sets["nocal"].numeric and "dist_cbd" not in sets["full"].numeric


def test_learning_curve(features, folds):
    train, valid = (d.persist() for d in splits.split(features, folds[0]))
    spec = FeatureSpec(numeric=("area_sqm", "year_num"))
    got = experiments.learning_curve(train, valid, spec, "ridge", (0.2, 0.8), least=100)
    a, b = got.points.collect()
    assert abs(a.train_rows / b.train_rows - 0.25) < 0.05 and a.train_end == b.train_end and a.train_start > b.train_start
    assert abs(a.gap - (a.valid_rmsle - a.train_rmsle)) < 1e-12 and a.tail_rmsle is None and got.verdict["verdict"] in ("helps", "flat", "hurts")
    early = experiments.learning_curve(train, valid, spec, "gbt", (0.5,), "earliest", 100, gbt={"rounds": 3, "depth": 3}).points.first()
    assert early.tail_rmsle is not None and early.train_start < a.train_start and early.train_end < a.train_end
    with pytest.raises(ValueError):
        experiments.learning_curve(train, valid, spec, mode="x")


def test_capacity(features, folds):
    train, valid = splits.split(features, folds[0])
    got = experiments.capacity_probe(train.where("sale_id % 8 = 0"), valid, FeatureSpec(numeric=("area_sqm", "noise")), share=1.0, rounds=6, depth=9).first()
    assert got.train_rmsle < 0.8 * got.valid_rmsle and got.tail_rmsle is None


def test_sets_against_each_other(features, folds):
    sets = {"lean": FeatureSpec(numeric=("area_sqm", "year_num")), "nocal": FeatureSpec(numeric=("area_sqm",))}
    got = experiments.compare_feature_sets(features, sets, folds[:1], "ridge", "lean", holdout_months=6)
    rows = {r.config: r for r in got.summary.collect()}
    assert rows["nocal"]["mean"] > rows["lean"]["mean"] and all(r.folds == 1 and r.holdout_rmsle for r in rows.values())
    assert rows["nocal"].holdout_rmsle > rows["lean"].holdout_rmsle
    control = got.control.first()
    assert control.config == "nocal" and control.wins == 0 and control.mean_difference > 0
    assert {r.config for r in got.differences.collect()} == {"nocal"}


def test_worth_of_layers(features, folds):
    layers = [("place", FeatureSpec(numeric=("area_sqm",))), ("lagged_price", FeatureSpec(numeric=("area_sqm", *experiments.LAGGED)))]
    spine = panel.complete_spine(panel.build_panel(features))
    forward = panel.forward_features(spine).persist()
    got = experiments.feature_value(features, layers, folds[:1], "ridge", forward=forward, draws=1, demeaned_folds=1)
    summary = {r.layer: r for r in got.summary.collect()}
    assert summary["lagged_price"].delta < 0 and summary["lagged_price"].folds_improved == 1
    placebos = {(r.placebo, r.draw): r.rmsle for r in got.placebos.collect()}
    assert set(placebos) == {("demeaned", 0), ("permuted", 0), ("forward", 0)} and placebos["permuted", 0] > summary["lagged_price"]["mean"]
    ahead = experiments.attach_forward(features, forward)
    assert ahead.count() == features.count() and "pc_median_price_3m__fwd" in ahead.columns


def test_event_studies_over_specifications(spark):
    rng, rows = random.Random(5), []
    for u in range(12):
        for m in range(60):
            for _ in range(3):
                y = 5 + 0.02 * u + 0.003 * m + 0.1 * (m >= 30) * (u < 4) + rng.gauss(0, 0.01)
                rows.append((f"20{u:02d}", splits._add(date(2014, 1, 1), m), 10**y, 500.0))
    sales = spark.createDataFrame(rows, "post_code string, contract_date date, purchase_price double, area_sqm double")
    lookup = spark.createDataFrame([(f"20{u:02d}", 0.4 * u + 0.1 if u < 4 else 3.0 + u, "x") for u in range(12)], "post_code string, dist_metro_new double, sa4 string")
    got = experiments.event_study_grid(sales, lookup, geo.EventSpec("2016-07-01", window=24), radii=(1.0,), draws=2, shift=12, least=2)
    table = {r.specification: r for r in got.robustness.collect()}
    assert set(table) == {"main", "outcome_median_price", "radius_1km"} and table["main"].treated_units == 4 and table["radius_1km"].treated_units == 3
    assert all(abs(r.post_mean - 0.1) < 0.03 for r in table.values())
    assert {r.specification for r in got.coefficients.select("specification").distinct().collect()} == set(table)
    assert {(r.placebo, r.draw) for r in got.placebos.collect()} == {("shifted", 0), ("random", 0), ("random", 1)}
    assert [r.most_km for r in got.dose.orderBy("most_km").collect()] == [5.0, 10.0]


def test_chain_and_staleness(spark, tmp_path):
    raw, clean, scores = (str(tmp_path / n) for n in ("raw", "clean", "scores"))
    spark.range(5).write.parquet(raw)
    copy = lambda a, b: lambda s: s.read.parquet(a).write.mode("overwrite").parquet(b)
    stages = [chain.Stage("clean", copy(raw, clean), (raw,), (clean,)), chain.Stage("scores", copy(clean, scores), (clean,), (scores, scores + "_more"))]
    status = lambda: {r.stage: r.status for r in chain.staleness(spark, stages).collect()}
    assert status() == {"clean": "missing", "scores": "missing"}
    assert [n for n, _ in chain.run_chain(spark, stages)] == ["clean", "scores"]
    assert status() == {"clean": "ok", "scores": "ok"}
    assert chain.staleness(spark, stages).where("stage = 'scores'").first().missing == [scores + "_more"]
    for where, _, names in os.walk(clean):
        for n in names:
            os.utime(os.path.join(where, n), (4e9, 4e9))
    assert status() == {"clean": "ok", "scores": "stale"}
    assert [n for n, _ in chain.run_chain(spark, stages, start="scores")] == ["scores"]
    with pytest.raises(ValueError):
        chain.run_chain(spark, stages, only=["x"])
    broken = [stages[0], chain.Stage("bad", lambda s: 1 / 0)]
    with pytest.raises(chain.StageFailed) as e:
        chain.run_chain(spark, broken)
    assert e.value.stage == "bad" and [n for n, _ in e.value.done] == ["clean"] and isinstance(e.value.__cause__, ZeroDivisionError)


def test_diagnostics_must_add_up(spark):
    predictions = spark.createDataFrame([("a", 0, 1), ("a", 0, 2)], "model string, fold int, sale_id int")
    by_fold, pooled = spark.createDataFrame([("a", 0, 2)], "model string, fold int, n int"), spark.createDataFrame([("a", 0.1)], "model string, rmsle double")
    grouped = lambda n: spark.createDataFrame([("year", n), ("band", 2)], "kind string, n int")
    failed = lambda **k: [r.name for r in pipelines.consistency(predictions, by_fold, pooled, **k).where("not passed").collect()]
    assert failed(grouped=grouped(2), recorded_rows=3, features=spark.range(3)) == []
    assert failed(grouped=grouped(5), recorded_rows=4, features=spark.range(3)) == ["grouped_counts_add_up", "recorded_rows"]

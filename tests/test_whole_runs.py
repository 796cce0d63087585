"""Whole runs and composite analyses: tables of one run agree, placebos keep what they must."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encoders, fences, hypotheses, panel, splits
from tidemark.plans import pipelines
from tidemark.sources.tables import MacroPanel


@pytest.fixture(scope="module")
def clean(spark):
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        m, pc = rng.randrange(48), rng.choice(["2000", "2100", "2153"])
        area = rng.gauss(600, 60)
        rows.append((i, f"g{rng.randrange(700)}", pc, splits._add(date(2015, 1, 1), m), 400_000 * (area / 600) ** 0.4 * (1.3 if pc == "2100" else 1) * (1 + 0.01 * m) * rng.lognormvariate(0, 0.1), area, rng.choice(["R1", "R2", "rare"][: 2 + (rng.random() < 0.02)]), rng.uniform(1, 40)))
    return spark.createDataFrame(rows, "sale_id int, group_key string, post_code string, contract_date date, purchase_price double, area_sqm double, zoning string, dist_cbd double").persist()


def test_features_and_cross_validation(spark, clean):
    macro = MacroPanel(spark.createDataFrame([(date(2014, 1, 1), 2.5), (date(2016, 5, 3), 1.75)], "effective_date date, cash_rate double"), spark.createDataFrame([(date(2014, 3 * q, 28), 100.0 + q, date(2014, 3 * q, 28)) for q in (1, 2, 3, 4)], "period_end date, cpi_index double, release_date date"))
    features = pipelines.build_features(clean, macro, min_count=100).persist()
    assert features.count() == clean.count() and {r.zoning for r in features.select("zoning").distinct().collect()} == {"R1", "R2", "OTHER"}
    assert {r.cash_rate for r in features.select("cash_rate").distinct().collect()} == {2.5, 1.75}
    spec = encoders.FeatureSpec(numeric=("log_area", "year_num"), high_card=("post_code",))
    folds = splits.folds_of(features, min_train=18, horizon=6, step=12, holdout=6)
    runs = pipelines.cross_validate(features, spec, folds, ["ridge", "naive", "global"])
    score = {r.model: r.rmsle for r in runs.pooled.collect()}
    assert score["ridge"] < score["naive_postcode"] < score["naive_global"]
    held = pipelines.evaluate_holdout(features, spec, ["ridge", "naive", "global"], months=6)
    assert pipelines.consistency(runs.predictions, runs.by_fold, runs.pooled, held.pooled).where("not passed").count() == 0
    broken = pipelines.consistency(runs.predictions.where("model <> 'ridge' or fold > 0"), runs.by_fold, runs.pooled)
    assert [r.name for r in broken.where("not passed").collect()] == ["fold_counts_add_up"]
    table = pipelines.fold_table(runs.by_fold, ["ridge", "naive_global"])
    assert table.columns == ["fold", "ridge", "naive_global"] and table.count() == len(folds)
    assert runs.predictions.where("naive_pred_log10 is null").count() == 0
    assert pipelines.diagnostics(runs.predictions, {"model": "model"}, 10).count() == 3


def test_area_and_price(spark, clean):
    got = hypotheses.area_price(clean, draws=40, least_year=50)
    assert abs(float(got.within.coef[0]) - 0.4) < 0.1 and not got.sign_flips
    rows = {r.statistic: r for r in got.headline.collect()}
    assert set(rows) == {"pearson", "spearman", "log_pearson"} and all(r.low <= r.estimate <= r.high for r in rows.values())
    assert got.by_year.count() == 4
    fits = hypotheses.robustness(clean, "dist_cbd")
    assert [len(f.names) for f in fits.values()] == [1, 2, 3]
    unit = hypotheses.unit_price(clean, "sale_id", draws=3)
    draws = {r.draw: r.correlation for r in unit.placebo.collect()}
    assert draws[0] > min(draws[d] for d in (1, 2, 3)) and unit.p_not_one < 0.05 and unit.bands.count() == 10


def test_time_reversal_keeps_each_key_s_values(spark, clean):
    features = panel.rolling_features(panel.complete_spine(panel.build_panel(clean)), windows=(3,))
    back = hypotheses.time_reversed(features)
    one = lambda df: sorted(str((r.post_code, r.pc_median_price_3m)) for r in df.collect())
    assert one(features) == one(back) and back.columns == features.columns
    assert features.exceptAll(back).count() > 0


def test_drop_outside(spark, clean):
    wild = clean.union(clean.limit(1).withColumn("area_sqm", F.lit(1e9)))
    bounds = fences.global_bounds(wild, ["area_sqm"])
    assert fences.drop_outside(wild, bounds, ["area_sqm"]).where("area_sqm > 1e6").count() == 0

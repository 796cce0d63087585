"""Operators that no registered query covers on its own."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning, describe, econometrics, geo, models, temporal


def test_transport_features(spark):
    rows = [("2000", "SYDNEY", "City", "NSW", "Delivery Area", -33.87, 151.21, 1), ("2000", "OTHER", "City", "NSW", "Delivery Area", -33.89, 151.19, 2), ("2153", "HILLS", "NW", "NSW", "Delivery Area", -33.73, 150.97, 3), ("2999", "ZERO", "X", "NSW", "Delivery Area", 0.0, 0.0, 4), ("3000", "MELB", "M", "VIC", "Delivery Area", -37.8, 144.9, 5), ("1001", "BOX", "City", "NSW", "Post Office Boxes", -33.8, 151.2, 6)]
    df = spark.createDataFrame(rows, "postcode string, locality string, sa4 string, state string, type string, lat double, lon double, file_order int")
    out = {r.postcode: r for r in geo.transport_features(df, {"dist_cbd": [(-33.88, 151.20)], "dist_train": [(-33.73, 150.97), (-33.88, 151.20)]}).collect()}
    assert set(out) == {"2000", "2153"} and out["2000"].locality == "SYDNEY"
    assert out["2000"].dist_cbd == 0.0 and out["2153"].dist_train == 0.0 and out["2153"].dist_cbd == round(out["2153"].dist_cbd, 2) > 20
    with pytest.raises(ValueError):
        geo.transport_features(df, {"dist_none": []})
    assert geo.development_label_meta({"v1": ("2001-01-01", "2010-12-31")}) == {"development_type_v1": "2010-12-31"}


def test_centroids_and_definitions(spark):
    points = spark.createDataFrame([("a", 1.0, 2.0, "x", 2), ("a", 3.0, 4.0, "y", 1), ("b", None, 1.0, "z", 1)], "k string, lat double, lon double, name string, o int")
    assert [tuple(r) for r in geo.centroids(points, "k", label="name", order="o").collect()] == [("a", 2.0, 3.0, "y")]
    a = spark.createDataFrame([("1", 1), ("2", 0), ("3", None)], "post_code string, treated int")
    b = spark.createDataFrame([("1", 1), ("2", 1), ("3", None)], "post_code string, treated int")
    assert {r.post_code: r.agree for r in geo.compare_definitions(a, b).collect()} == {"1": True, "2": False, "3": True}


def test_contract_failures_are_named(spark):
    df = spark.createDataFrame([("g", date(2015, 1, 1), 500_000.0, 600.0, -1.0, "E"), (None, None, 1.0, 0.0, 1.0, None)], "group_key string, contract_date date, purchase_price double, area_sqm double, dist_cbd double, label string")
    results = cleaning.contract(df, cleaning.clean_checks(df, distances=("dist_cbd", "absent"), label="label", label_from="2015-06-30"))
    failed = {r.name for r in results.where("not passed").collect()}
    assert failed == {"group_key_present", "date_parsed", "area_positive", "plausible", "dist_cbd_not_negative", "label_legal"}
    with pytest.raises(ValueError, match="label_legal"):
        cleaning.assert_all(results)
    with pytest.raises(ValueError):
        cleaning.check_features(["area_sqm", "unit_price"])


def frame(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(i, float(a := rng.uniform(0, 10)), float(b := rng.uniform(0, 10)), float((a > 5) * 2 + 0.1 * b + rng.gauss(0, 0.1)), date(2015, 1, 1) + timedelta(days=i // 4)) for i in range(600)], "id int, a double, b double, y double, day date")


def test_tree_learners_beat_the_mean(spark):
    df = frame(spark).persist()
    spread = df.agg(F.stddev("y")).first()[0]
    rmse = lambda out: out.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    fit, weights = models.random_forest(df, ["a", "b"], "y", trees=5, depth=4, share=1.0)
    assert rmse(fit(df)) < 0.5 * spread and models.importance(weights)[0][0] == "a"
    fit, _ = models.gradient_boosting(df, ["a", "b"], "y", "day", "id", rounds=5, depth=3, rate=0.5)
    assert rmse(fit(df)) < 0.5 * spread
    sizes = models.curve_sizes(df, "day", "id", (0.25, 1.0))
    assert sizes[1.0].count() == 600 and 60 < sizes[0.25].count() < 240
    late = models.curve_sizes(df, "day", "id", (0.25, 1.0), fixed_span=False)[0.25]
    assert late.count() <= 160 and late.agg(F.min("day")).first()[0] > date(2015, 3, 1)
    centred = models.demean_within(df.withColumn("g", F.col("id") % 3), "y", "g")
    assert abs(centred.where("g = 1").agg(F.avg("y")).first()[0]) < 1e-9


def test_dose_and_stack(spark):
    rng = random.Random(6)
    rows = [(f"u{u}", date(2010 + m // 12, m % 12 + 1, 1), int(u < 4), m - 18, 0.3 * u + 0.01 * m + 0.2 * (m >= 18) * (u < 4) + rng.gauss(0, 0.02)) for u in range(10) for m in range(36)]
    df = spark.createDataFrame(rows, "post_code string, month date, treated int, event_time int, y double")
    far = spark.createDataFrame([(f"u{u}", 1.0 if u < 4 else 8.0) for u in range(10)], "post_code string, distance double")
    assert float(econometrics.dose_response(df, "y", far).coef[0]) < -0.05
    own = econometrics.event_study(df, "y", window=12, least=2)
    both = econometrics.stacked({"a": own, "b": own}, spark)
    assert both.count() == 2 * (len(own.times) + 1) and {r.specification for r in both.collect()} == {"a", "b"}
    left = econometrics.partial_out(df, ["y"], "post_code", "month")
    assert abs(left.agg(F.avg("y")).first()[0]) < 1e-9


def test_descriptions(spark):
    df = frame(spark)
    assert describe.histogram(df, "a", 10).agg(F.sum("n")).first()[0] == 600
    assert describe.histogram(df.withColumn("a", F.lit(1.0)), "a").collect()[0].n == 600
    assert describe.binned_trend(df, "a", "y", 5).count() == 5
    assert describe.summary(df, "a").first()["count"] == 600 and describe.below(df, "a", [5.0]).first().n < 600
    assert describe.pivot_index(df.withColumn("arm", F.when(F.col("id") % 2 == 0, "x").otherwise("y2")), F.year("day"), "arm", ["x", "y2"], "a", 1900).where("index_x is not null").count() == 0


def test_series_joined_by_month_agrees_with_a_walk(spark):
    for step in (1, 9, 45, 400):
        series = [(date(2020, 1, 1) + timedelta(days=step * i), float(i)) for i in range(12)]
        left = [(i, date(2019, 12, 25) + timedelta(days=7 * i)) for i in range(300)] + [(900, None)]
        got = temporal.asof_series(spark.createDataFrame(left, "i int, d date"), spark.createDataFrame(series, "at date, v double"), "d", "at", ["v"])
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        want = {i: max(((t, v) for t, v in series if d is not None and t <= d), default=(None, None))[1] for i, d in left}
        assert sorted((r.i, str(r.v)) for r in got.collect()) == sorted((i, str(v)) for i, v in want.items())
    none = temporal.asof_series(spark.createDataFrame(left, "i int, d date"), spark.createDataFrame([], "at date, v double"), "d", "at", ["v"])
    assert none.count() == 301 and none.where("v is not null").count() == 0


def test_stop_tail_splits_a_heavy_last_date(spark):
    from tidemark.operators import models

    df = spark.range(4000).select("id", F.when(F.col("id") < 200, F.lit("2020-01-01")).otherwise("2020-02-01").cast("date").alias("day"))
    assert df.where(models.early_stop_tail(df, "day")).count() == 0
    assert 300 < df.where(models.early_stop_tail(df, "day", 0.1, "id")).count() < 500

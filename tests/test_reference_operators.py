"""Invariants of the temporal operators: nothing is known before its time, groups stay apart, plain recomputation agrees."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import cleaning, econometrics, encoders, fences, geo, keys, metrics, models, panel, splits, temporal
from tidemark.sources import tables

DAY = date(2015, 1, 1)


def sales(spark, seed=1, inflate=None):
    rng = random.Random(seed)
    rows = []
    for pc in ("2000", "2100"):
        for m in range(24):
            first = date(2015 + m // 12, m % 12 + 1, 1)
            if (m * 7 + len(rows)) % 11 == 3:
                continue
            for k in range(5):
                price = 500_000 + 60_000 * (first.year - 2015) + (120_000 if pc == "2100" else 0) + rng.gauss(0, 8000)
                if inflate and inflate[0](first):
                    price *= inflate[1]
                rows.append((f"{pc}-{len(rows)}", pc, first + timedelta(days=rng.randint(0, 26)), price, rng.gauss(650, 40)))
    return spark.createDataFrame(rows, "group_key string, post_code string, contract_date date, purchase_price double, area_sqm double")


def features(df, **how):
    return panel.rolling_features(panel.complete_spine(panel.build_panel(df)), **how)


def rows_by(df, cols):
    return {(r.post_code, r.month): tuple(r[c] for c in cols) for r in df.collect()}


def test_future_prices_change_no_earlier_feature(spark):
    cols = [c for c in features(sales(spark)).columns if c.startswith("pc_")]
    plain = rows_by(features(sales(spark)), cols)
    cut = date(2016, 1, 1)
    grown = rows_by(features(sales(spark, inflate=(lambda d: d >= cut, 10))), cols)
    assert all(grown[k] == v for k, v in plain.items() if k[1] <= cut)
    own = date(2015, 9, 1)
    spiked = rows_by(features(sales(spark, inflate=(lambda d: d == own, 50))), cols)
    assert all(spiked[k] == v for k, v in plain.items() if k[1] <= own) and spiked != plain


def test_first_month_knows_nothing(spark):
    got = features(sales(spark)).where(F.col("month") == DAY).collect()
    for r in got:
        assert all(r[c] is None for c in r.asDict() if c.startswith("pc_") and c != "pc_months_observed") and r.pc_months_observed == 0


def test_attached_names_show_what_is_contemporaneous(spark):
    out = panel.attach_panel(sales(spark), features(sales(spark)))
    assert "median_price" not in out.columns and "contemporaneous_median_price" in out.columns and "pc_median_price_3m" in out.columns
    assert out.count() == sales(spark).count()


def test_non_strict_windows_need_half(spark):
    got = rows_by(features(sales(spark), strict=False), ["pc_n_sales_6m"])
    strict = rows_by(features(sales(spark)), ["pc_n_sales_6m"])
    assert sum(v[0] is not None for v in got.values()) > sum(v[0] is not None for v in strict.values())


def test_balanced_panel(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1, 3, 5.0, -1), ("a", date(2020, 4, 1), 1, 1, 6.0, 2), ("b", date(2020, 2, 1), 0, 2, 7.0, 0)], "post_code string, month date, treated int, n_sales long, median_price double, event_time int")
    plain = panel.balance_panel(df)
    assert plain.count() == 8 and plain.where("n_sales = 0 and event_time is null").count() == 5
    assert panel.balance_panel(df, event="2020-02-01").where("event_time is null").count() == 0


# as-of

CASH = [(date(2018, 1, 1), 1.5), (date(2018, 9, 1), 1.0), (date(2019, 6, 4), 0.75), (date(2020, 3, 19), 0.25)]


def cpi(spark):
    ends = [date(y, m, d) for y in (2017, 2018, 2019, 2020) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    return spark.createDataFrame([(e, float(x), e + timedelta(days=28)) for e, x in zip(ends, np.linspace(90, 110, 16))], "period_end date, cpi_index double, release_date date")


def test_macro_values(spark):
    days = [date(2018, 1, 1), date(2018, 6, 30), date(2018, 9, 1), date(2019, 6, 3), date(2019, 6, 4), date(2021, 1, 1), date(2017, 1, 1), None, date(2019, 1, 10), date(2019, 1, 31)]
    left = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, contract_date date")
    got = {r.i: r for r in temporal.attach_macro(left, spark.createDataFrame(CASH, "effective_date date, cash_rate double"), cpi(spark)).collect()}
    assert [got[i].cash_rate for i in range(8)] == [1.5, 1.5, 1.0, 1.0, 0.75, 0.25, None, None]
    assert got[8].period_end == date(2018, 9, 30) and got[9].period_end == date(2018, 12, 31) and got[6].cpi_index is None
    assert cleaning.contract(temporal.attach_macro(left.where("i < 6"), spark.createDataFrame(CASH, "effective_date date, cash_rate double"), cpi(spark)), temporal.macro_checks()).where("not passed").count() == 0
    bad = spark.createDataFrame([(date(2019, 1, 5), date(2019, 2, 28), date(2018, 12, 31), 1.0)], "contract_date date, release_date date, period_end date, cash_rate double")
    with pytest.raises(ValueError, match="released_by_contract"):
        cleaning.assert_all(cleaning.contract(bad, temporal.macro_checks()))


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_bucketed_against_brute_force(spark, seed):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.05 else DAY + timedelta(days=rng.randint(0, 400))
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(i, key(), day()) for i in range(200)]
    right = [(key(), day(), rng.randint(0, 9), i) for i in range(120)]
    got = temporal.asof_bucketed(spark.createDataFrame(left, "i int, k string, d date"), spark.createDataFrame(right, "k string, at date, tie int, v int"), "d", "at", ["k"], ["v"], ["tie", "v"]).collect()
    want = {}
    for i, k, d in left:
        fit = [(at, tie, v) for rk, at, tie, v in right if rk == k and k is not None and d is not None and at is not None and at <= d]
        want[i] = max(fit)[2] if fit else None
    assert {r.i: r.v for r in got} == want and len(got) == len(left)


def test_label_is_legal_and_null_overwrites(spark):
    df = spark.createDataFrame([(date(2010, 12, 31), "G", "E"), (date(2011, 1, 1), "G", "E"), (date(2015, 1, 1), "G", None), (None, "G", "E")], "d date, a string, b string")
    assert [r[0] for r in df.select(temporal.legal_label(F.col("d"), [("2010-12-31", F.col("a")), ("2014-12-31", F.col("b"))])).collect()] == [None, "G", None, None]


# scalars and keys


def test_scalars(spark):
    df = spark.createDataFrame([(" 850.0",), ("2000",), ("12345",), ("2112.5",), ("x",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(s.postcode_key(F.col("c"))).collect()] == ["0850", "2000", "12345", None, None, None, None]
    dates = spark.createDataFrame([("2015-06-01",), ("20150601.0",), (" 1/6/2015",), ("01-06-2015",), ("1 Jun 2015",), ("soon",), (None,)], "c string")
    assert [r[0] for r in dates.select(s.contract_date(F.col("c"))).collect()] == [date(2015, 6, 1)] * 5 + [None] * 2
    numbers = spark.createDataFrame([("1.5",), (" 2",), ("NaN",), ("x",), (None,)], "c string")
    assert [r[0] for r in numbers.select(s.number(F.col("c"))).collect()] == [1.5, 2.0, None, None, None]
    houses = spark.createDataFrame([("12 SMITH ST",), ("UNIT 5/12 SMITH ST",), ("5/12 SMITH ST",), ("LOT 3 SMITH RD",), ("910 B/6 NANCARROW AVE",), (" SMITH ST",), ("WOODBURY PARK DR",), ("",), (None,)], "c string")
    assert [r[0] for r in houses.select(s.has_house_number(F.col("c"))).collect()] == [True] * 5 + [False] * 4
    one = spark.createDataFrame([(1.0, 0.0, 0.125, "17.00 to 17.50", "a | b||c ")], "a double, z double, h double, t string, l string")
    got = one.select(s.safe_ratio(F.col("a"), F.col("z")), s.safe_log10(F.col("z")), s.half_even(F.col("h"), 2), s.last_number(F.col("t")), s.split_list(F.col("l"))).first()
    assert tuple(got) == (None, None, 0.12, 17.5, ["a", "b", "c"])


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 3000), st.integers(1, 20))
def test_rank_bin_rule_matches_quantile_edges(n, q):
    for r in range(1, n + 1, max(1, n // 50)):
        got = max(0, ((r - 1) * q + n - 2) // (n - 1) - 1)
        want = next(b for b in range(q) if (r - 1) * q <= (b + 1) * (n - 1))
        assert got == want


def test_ranked_bins_and_ranks(spark):
    rng = random.Random(4)
    values = [rng.choice([1.0, 2.0, 2.0, 5.5, None, rng.random() * 9]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    order = sorted((v, i) for i, v in enumerate(values) if v is not None)
    n = len(order)
    assert {r.i: r.bin for r in metrics.ranked_bins(df, "v", "i", 7).collect()} == {i: max(0, (r * 7 + n - 2) // (n - 1) - 1) for r, (_, i) in enumerate(order)}
    mean = {}
    for r, (v, _) in enumerate(order):
        mean.setdefault(v, []).append(r + 1)
    for r in metrics.with_rank(df, "v", None).collect():
        assert r["rank"] == sum(mean[r.v]) / len(mean[r.v]) and r.n_ranked == n


SALE = "property_id string, contract_date date, purchase_price double, area double, settlement_date date, address string, post_code string"


def test_identity_dedup(spark):
    base = ("1001", date(2015, 6, 1), 500000.0, 600.0, date(2015, 7, 1), "12 SMITH ST", "2000")
    vary = lambda **c: tuple(c.get(k, v) for k, v in zip([x.split()[0] for x in SALE.split(", ")], base))
    cases = [([base, vary(settlement_date=date(2015, 8, 1))], 1), ([base, vary(purchase_price=1.0)], 2), ([base, vary(area=1.0)], 2), ([base] * 4 + [vary(area=2.0)] * 2, 2), ([vary(property_id=None)] * 2, 1)]
    for rows, n in cases:
        df = spark.createDataFrame(rows, SALE)
        assert keys.keep_first(df, cleaning.IDENTITY, ["settlement_date"]).count() == n
        assert keys.dedup_counts(df, cleaning.IDENTITY).first().rows_removed == len(rows) - n
    first = keys.keep_first(spark.createDataFrame(cases[0][0], SALE), cleaning.IDENTITY, ["settlement_date"]).first()
    assert first.settlement_date == date(2015, 7, 1)


def test_group_keys(spark):
    rows = [("9001", "SMITH ST", "2000"), ("9002", "SMITH ST", "2000"), (" ", "SMITH ST", "2000"), ("9003", "1 smith st", "2000"), (None, None, None)]
    df = spark.createDataFrame(rows, "property_id string, address string, post_code string")
    assert [(r.group_key, r.group_key_source) for r in keys.add_group_key(df).collect()] == [("9001", "property_id"), ("9002", "property_id"), ("SMITH ST|2000", "address"), ("1 SMITH ST|2000", "address"), ("<missing>|<missing>", "address")]
    assert {r.group_key_source for r in keys.add_group_key(df.drop("property_id")).collect()} == {"address"}


def test_uniqueness_guard(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="not unique"):
        keys.many_to_one(left, right, ["k"])


def test_build_clean(spark):
    raw = {"property_id": "1", "address": "12 SMITH ST", "post_code": "2000.0", "property_type": "House", "primary_purpose": "residence", "area": "600", "area_type": "M", "contract_date": "20150601", "settlement_date": "x", "purchase_price": "500000"}
    rows = [raw, raw, raw | {"purchase_price": "900"}, raw | {"area_type": "H", "area": "0.06", "property_id": "2"}, raw | {"post_code": "9999"}, raw | {"contract_date": "never"}, raw | {"primary_purpose": "shop"}, raw | {"area_type": "?", "property_id": "3"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} string" for k in raw))
    lookup = spark.createDataFrame([("2000", 5.0)], "post_code string, dist_cbd double")
    out, report = cleaning.build_clean(df, lookup)
    assert sorted(r.property_id for r in out.collect()) == ["1", "2"] and {r.area_sqm for r in out.collect()} == {600.0}
    assert report.first().asDict() == {"rows_in": 8, "after_window": 7, "after_required": 6, "after_purpose": 5, "after_kind": 5}


# fences


def test_fences(spark):
    rng = random.Random(2)
    rows = [(date(y, 6, 15), rng.gauss(m, 20_000), rng.gauss(600, 40)) for y, m in ((2014, 500_000), (2015, 510_000), (2019, 520_000)) for _ in range(400)] + [(date(2015, 6, 15), 500_000.0, 1.53e9), (date(2015, 6, 15), 8.75e8, 600.0), (date(2015, 6, 15), None, 600.0)]
    df = spark.createDataFrame(rows, "contract_date date, purchase_price double, area_sqm double")
    train, cols, year = df.where("contract_date < '2016-01-01'"), ["purchase_price", "area_sqm"], F.year("contract_date")
    fitted = fences.fit_bounds(train, cols, year)
    assert {r.grp for r in fitted.collect()} == {"2014", "2015", "__all__"}
    marked = fences.mark_quality(df, fitted, fences.global_bounds(train, cols), cols, year)
    share = {r.y: r.k for r in marked.groupBy(year.alias("y")).agg(F.avg(F.col("iqr_keep").cast("int")).alias("k")).collect()}
    assert share[2019] > 0.5 and share[2014] > 0.9 and share[2015] > 0.9
    assert marked.where("(area_sqm > 1e9 or purchase_price > 1e8 or purchase_price is null) and iqr_corruption_ok").count() == 0
    assert fences.flag_outliers(df, fitted, cols, year).where("iqr_keep is null").count() == 0
    assert fences.flag_outliers(df, fitted, cols, year, True).where("iqr_keep is null").count() == 401
    for mode in fences.MODES:
        out, report = fences.fence(df, cols, year, F.col("contract_date") < "2016-01-01", mode)
        r = report.first()
        assert out.count() == r.rows_out and r.rows_in == r.rows_out + r.dropped
    with pytest.raises(ValueError):
        fences.fence(df, cols, year, F.lit(True), "other")
    capped = {r.column: r.hi for r in fences.global_bounds(train, cols, caps={"area_sqm": 500.0}).collect()}
    assert abs(capped["area_sqm"] - math.log10(500)) < 1e-12


# splits


def test_fold_table():
    folds = splits.rolling_origin(date(2001, 1, 1), date(2023, 12, 1))
    assert len(folds) == 8
    assert (folds[0].train_start, folds[0].train_end, folds[0].valid_start, folds[0].valid_end) == (date(2001, 1, 1), date(2007, 12, 1), date(2008, 2, 1), date(2009, 1, 1))
    assert (folds[7].train_end, folds[7].valid_start, folds[7].valid_end) == (date(2021, 12, 1), date(2022, 2, 1), date(2022, 12, 1))
    with pytest.raises(ValueError):
        splits.rolling_origin(date(2001, 1, 1), date(2023, 12, 1), mode="x")
    with pytest.raises(ValueError):
        splits.rolling_origin(date(2001, 1, 1), date(2023, 12, 1), mode="sliding")
    with pytest.raises(ValueError):
        splits.holdout_window(date(2020, 1, 1), date(2020, 6, 1), 6)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.integers(1, 60), st.integers(1, 24), st.integers(1, 24), st.integers(0, 6), st.integers(0, 12), st.sampled_from(["expanding", "sliding"]), st.integers(1, 80))
def test_folds_move_forward(months, min_train, horizon, step, embargo, holdout, mode, window):
    last = splits._add(date(2000, 1, 1), months - 1)
    folds = splits.rolling_origin(date(2000, 1, 1), last, min_train, horizon, step, embargo, holdout, mode, window)
    for f in folds:
        assert splits._months(f.train_end, f.valid_start) - 1 == embargo + 1 and f.valid_start <= f.valid_end <= splits._add(last, -holdout)
        if mode == "sliding":
            assert splits._months(f.train_start, f.train_end) == min(window, splits._months(date(2000, 1, 1), f.train_end))
    assert all(a.valid_start < b.valid_start for a, b in zip(folds, folds[1:]))


def test_purge_and_gates(spark):
    rng = random.Random(6)
    rows = [(f"g{i}" if i % 9 else None, splits._add(date(2018, 1, 1), rng.randrange(36)), rng.random() < 0.9, rng.random() < 0.8) for i in range(40) for _ in range(2)]
    df = spark.createDataFrame(rows, "group_key string, contract_date date, ok boolean, keep boolean")
    folds = splits.folds_of(df, min_train=12, horizon=6, step=6, holdout=0)
    assert len(folds) >= 3
    for f in folds:
        train, valid = splits.split(df, f, corruption="ok", quality="keep")
        splits.assert_no_leakage(train, valid, f.embargo)
        assert train.where("not ok or not keep").count() == 0 and valid.where("not ok").count() == 0
        with pytest.raises(ValueError):
            splits.assert_no_leakage(train.union(valid.where("group_key is not null")), valid, f.embargo)
    summary = {r.fold: r for r in splits.summarize(df, splits.folds_frame(spark, folds)).collect()}
    for f in folds:
        train, valid = splits.split(df, f)
        assert (summary[f.fold].train_rows_purged, summary[f.fold].valid_rows) == (train.count(), valid.count())


# encoders and models


def frame(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.1 else rng.gauss(600, 50), None, rng.choice(["2000", "2153", None]), rng.choice(["Established", "Greenfield"]), rng.gauss(5.8, 0.1), date(2015, 1, 1) + timedelta(days=i)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, area_sqm double, empty double, post_code string, development string, log_price double, contract_date date")


def test_encoder(spark):
    spec = encoders.FeatureSpec(numeric=("area_sqm", "empty"), low_card=("development",), high_card=("post_code",), binned=("area_sqm",))
    df = frame(spark)
    e = encoders.Encoder(spec).fit(df)
    assert e.degenerate == ["empty"] and e.medians["empty"] == 0.0
    out = e.transform(df)
    for r in out.select(*e.names).collect():
        assert all(v is not None and math.isfinite(v) for v in r)
    stats = out.agg(F.avg("area_sqm"), F.stddev_pop("area_sqm")).first()
    assert abs(stats[0]) < 1e-9 and abs(stats[1] - 1) < 1e-9
    unseen = e.transform(spark.createDataFrame([(1, 1e9, None, "9999", "New", 1.0, DAY)], df.schema), standardize=False).first()
    assert unseen["development__freq"] == 0.0 and abs(unseen["post_code__te"] - e.mean) < 1e-12 and unseen["area_sqm__bin"] == -1
    with pytest.raises(ValueError):
        encoders.FeatureSpec(numeric=("a",), low_card=("a",))
    with pytest.raises(ValueError):
        encoders.FeatureSpec(numeric=("purchase_price",))
    layers = encoders.with_layers([("L0", encoders.FeatureSpec(numeric=("a",))), ("L1", encoders.FeatureSpec(low_card=("b",)))])
    assert layers[1][1].numeric == ("a",) and layers[1][1].low_card == ("b",)


def test_out_of_fold_target_ignores_own_part(spark):
    df = frame(spark).where("post_code is not null")
    got = {r.id: r["post_code__te"] for r in encoders.out_of_fold_target(df, "post_code", "log_price", "id").collect()}
    part = {r.id: r.p for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("p")).collect()}
    rows = [(r.id, r.post_code, r.log_price) for r in df.collect()]
    for i, pc, _ in rows[:20]:
        rest = [(k, y) for j, k, y in rows if part[j] != part[i]]
        mean = sum(y for _, y in rest) / len(rest)
        own = [y for k, y in rest if k == pc]
        assert abs(got[i] - (sum(own) + 20 * mean) / (len(own) + 20)) < 1e-9


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3)) + 4
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.standard_normal(200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    m = models.ridge(df, ["a", "b", "c"], "y", alpha=2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coef, want, atol=1e-9) and abs(m.intercept - (y.mean() - x.mean(0) @ want)) < 1e-9
    assert models.select_models(["xgb", "ridge", "gbt"]) == ["gbt", "ridge"]
    with pytest.raises(ValueError):
        models.select_models(["svm"])
    assert models.curve_verdict([(100, 0.40), (1000, 0.35)])["verdict"] == "helps"


def test_permutation_keeps_the_multiset(spark):
    df = frame(spark)
    out = models.permute_within(df, "area_sqm", "id")
    a = sorted((r.area_sqm is not None, r.area_sqm or 0) for r in df.collect())
    assert sorted((r.area_sqm is not None, r.area_sqm or 0) for r in out.collect()) == a
    per = models.permute_within(df, "area_sqm", "id", ["post_code"])
    one = lambda d, pc: sorted((r.area_sqm is not None, r.area_sqm or 0) for r in d.where(F.col("post_code").eqNullSafe(pc)).collect())
    assert all(one(per, pc) == one(df, pc) for pc in ("2000", "2153", None))
    tail = df.where(models.early_stop_tail(df, "contract_date")).count()
    assert tail <= 0.1 * df.count()


def test_metrics_on_known_numbers(spark):
    df = spark.createDataFrame([(5.0, 5.1), (5.5, 5.4), (6.0, 6.0)], "y_true_log10 double, y_pred_log10 double")
    r = metrics.report(df).first()
    d = np.array([0.1, -0.1, 0.0])
    assert abs(r.rmsle - math.sqrt((d * d).mean()) * math.log(10)) < 1e-12 and r.n == 3
    assert metrics.report(df.where("y_true_log10 = 5.0")).first().r2 is None


# econometrics


def made_panel(spark, seed=5, effect=0.3, treated_share=3):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(20):
        for m in range(50):
            t = m - 25
            if rng.random() < 0.15:
                continue
            treated = int(u % treated_share == 0)
            rows.append((f"u{u:02d}", splits._add(date(2010, 1, 1), m), treated, t, float(0.1 * u + 0.02 * m + effect * treated * (t >= 0) + rng.standard_normal() * 0.05), float(rng.standard_normal() + u), float(u)))
    return spark.createDataFrame(rows, "post_code string, month date, treated int, event_time int, y double, x double, km double")


def dense(df, y, x, unit, time):
    p = df.toPandas()
    cols = [p[c].to_numpy(float) for c in x] + [(p[unit] == u).to_numpy(float) for u in sorted(p[unit].unique())] + ([(p[time] == t).to_numpy(float) for t in sorted(p[time].unique())] if time else [])
    beta = np.linalg.lstsq(np.column_stack(cols), p[y].to_numpy(float), rcond=None)[0]
    return beta[: len(x)]


def test_fixed_effects_match_dense_least_squares(spark):
    df = made_panel(spark).withColumn("post", (F.col("event_time") >= 0).cast("double") * F.col("treated"))
    for time in ("month", None):
        fit = econometrics.fe_regression(df, "y", ["x", "post"], "post_code", time, "post_code")
        assert np.allclose(fit.coef, dense(df, "y", ["x", "post"], "post_code", time), atol=1e-9)
    p = df.toPandas()
    fit = econometrics.fe_regression(df, "y", ["x"], "post_code", None, "post_code", interactions=[("x", "km")])
    g = p.groupby("post_code")
    z = p.assign(z=p.x * p.km)
    xs = np.column_stack([z[c] - z.groupby("post_code")[c].transform("mean") for c in ("x", "z")])
    yd = (p.y - g.y.transform("mean")).to_numpy()
    inv = np.linalg.inv(xs.T @ xs)
    e = yd - xs @ (inv @ xs.T @ yd)
    meat = sum(np.outer(v, v) for v in (xs[p.post_code == u].T @ e[p.post_code == u] for u in p.post_code.unique()))
    n, k, c = len(p), 2, p.post_code.nunique()
    assert np.allclose(fit.cov, inv @ meat @ inv * c / (c - 1) * (n - 1) / (n - k), rtol=1e-6)
    dropped = econometrics.fe_regression(df, "y", ["x", "km"], "post_code", "month", "post_code")
    assert dropped.dropped == ["km"]


def test_products_of_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((70, 12))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(12)))
    n, p = econometrics.products(df, df.columns)
    assert n == 70 and np.allclose(p, x.T @ x)


def test_event_study_finds_the_effect(spark):
    df = made_panel(spark)
    got = econometrics.event_study(df, "y")
    assert abs(got.post_mean() - 0.3) < 0.05 and got.reference == -1 and -1 not in got.times
    assert min(got.times) >= -22 and max(got.times) <= 22 and 0 <= got.pretrend_p <= 1
    none = econometrics.placebo_shifted(df, "y", -12, window=12, least=2)
    assert abs(none.post_mean()) < 0.1
    with pytest.raises(ValueError):
        econometrics.event_study(df.where("event_time <> -1"), "y")
    draws = econometrics.placebo_random(df, "y", 2, 1)
    assert all(abs(d.post_mean()) < 0.3 for d in draws)


def test_event_study_matches_dense_least_squares(spark):
    df = made_panel(spark, seed=9).where("event_time between -24 and 24")
    df = df.union(df.where("x > 10"))  # several rows a cell
    got = econometrics.event_study(df, "y")
    bucket = F.greatest(F.lit(-22), F.least(F.lit(22), F.col("event_time")))
    names = [f"d{i}" for i in range(len(got.times))]
    wide = df.select("*", *[((bucket == t) & (F.col("treated") == 1)).cast("double").alias(c) for c, t in zip(names, got.times)])
    assert np.allclose(got.fit.coef, dense(wide, "y", names, "post_code", "month"), atol=1e-8)
    same = econometrics.ols(econometrics.demean(wide, ["y", *names], "post_code", "month"), "y", names, "post_code")
    assert np.allclose(got.fit.cov, same.cov, atol=1e-10) and (got.fit.n, got.fit.clusters) == (same.n, same.clusters)


def test_p_values():
    assert abs(econometrics.normal_p(1.959963985) - 0.05) < 1e-9
    assert abs(econometrics.chi2_sf(3.841458821, 1) - 0.05) < 1e-9 and abs(econometrics.chi2_sf(18.307038, 10) - 0.05) < 1e-7 and abs(econometrics.chi2_sf(2.0, 2) - math.exp(-1)) < 1e-12


def test_cluster_sums_equal_resampled_rows(spark):
    df = made_panel(spark).select("post_code", "x", "y")
    p = df.toPandas()
    m = {r.post_code: r for r in econometrics.cluster_moments(df, "x", "y", "post_code").collect()}
    rng = np.random.default_rng(8)
    pick = rng.choice(sorted(m), len(m))
    rows = np.concatenate([p[p.post_code == u][["x", "y"]].to_numpy() for u in pick])
    sums = [sum(m[u][c] for u in pick) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    assert abs(float(econometrics.correlation(*sums)) - np.corrcoef(rows.T)[0, 1]) < 1e-9
    a, b = (econometrics.bootstrap_ci(df, "x", "y", "post_code", draws=200).first() for _ in range(2))
    assert a == b and a.low <= a.estimate <= a.high and a.clusters == len(m)
    per = {r.g: r for r in econometrics.bootstrap_ci(df.withColumn("g", F.col("post_code") > "p3").union(df.withColumn("g", F.lit(None).cast("boolean"))), "x", "y", "post_code", draws=50, by=["g"]).collect()}
    alone = econometrics.bootstrap_ci(df, "x", "y", "post_code", draws=50).first()
    assert abs(per[None].low - alone.low) < 1e-9 and per[None].clusters == sum(r.clusters for g, r in per.items() if g is not None)
    none = econometrics.bootstrap_ci(df.limit(0), "x", "y", "post_code", draws=5).first()
    assert (none.estimate, none.draws, none.clusters) == (None, 0, 0)


def test_prices_dealt_anew(spark):
    rng = random.Random(4)
    rows = [(i, a := rng.gauss(2.7, 0.2), 5 + 0.4 * a + rng.gauss(0, 0.1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a double, p double")
    a, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for block in (50_000, 300):  # one block, and ten
        got = {r.draw: r.correlation for r in econometrics.ratio_placebo(df, "a", "p", "id", 100, block=block).collect()}
        assert sorted(got) == list(range(101)) and abs(got[0] - np.corrcoef(a, p - a)[0, 1]) < 1e-9
        rng2 = np.random.default_rng(1)
        want = [np.corrcoef(a, rng2.permutation(p) - a)[0, 1] for _ in range(400)]
        drawn = [got[d] for d in range(1, 101)]
        assert abs(np.mean(drawn) - np.mean(want)) < 4 * np.std(want) / 10 and 0.7 < np.std(drawn) / np.std(want) < 1.4
    assert all(sorted(econometrics._places(n, d)) == list(range(n)) for n in (0, 1, 7, 1000) for d in (1, 2))
    assert [r.correlation for r in econometrics.ratio_placebo(df.limit(0), "a", "p", "id", 2).collect()] == [None]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert econometrics.pearson(df, "x", "y").first().r is None


# distance, sources


def test_distance_and_assignment(spark):
    df = spark.createDataFrame([("a", -33.8688, 151.2093), ("b", None, 1.0)], "k string, lat double, lon double")
    got = {r.k: r.d for r in geo.nearest_km(df, [(-33.8688, 151.2093), (-37.8136, 144.9631)], out="d").collect()}
    assert got["a"] == 0.0 and got["b"] is None
    far = geo.nearest_km(df.where("k = 'a'"), [(-37.8136, 144.9631)], out="d").first().d
    assert 710 < far < 716
    spec = geo.EventSpec("2019-05-26", regions=("N",))
    lookup = spark.createDataFrame([("1", 1.0, "N"), ("2", 2.5, "N"), ("3", 5.0, "N"), ("4", 5.0, "S")], "post_code string, dist_metro_new double, sa4 string")
    arms = {r.post_code: (r.treated, r.distance_source) for r in geo.assign_treatment(lookup, spec, spark.createDataFrame([("2", 1.5)], "post_code string, dist_p25 double")).collect()}
    assert arms == {"1": (1, "centroid"), "2": (1, "geocoded"), "3": (0, "centroid"), "4": (None, "centroid")}


def test_sources(spark, tmp_path):
    (tmp_path / "cash.csv").write_text("effective_date,cash_rate\n1990-01-23,17.00 to 17.50\n1990-04-04,15.00\n1990-04-04,15.00\n,3\n")
    assert [(r.effective_date, r.cash_rate) for r in tables.cash_rate(spark, str(tmp_path / "cash.csv")).collect()] == [(date(1990, 1, 23), 17.5), (date(1990, 4, 4), 15.0)]
    (tmp_path / "bad.csv").write_text("effective_date,cash_rate\n1990-04-04,15.00\n1990-04-04,16.00\n")
    with pytest.raises(ValueError, match="conflicting"):
        tables.cash_rate(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "cpi.csv").write_text("period_end,cpi_index\n2017-03-31,90\n2017-03-31,90\n")
    assert [(r.cpi_index, r.release_date) for r in tables.price_index(spark, str(tmp_path / "cpi.csv")).collect()] == [(90.0, date(2017, 4, 28))]
    (tmp_path / "stations.csv").write_text("Train_Station,LAT,LONG\n A ,-33.8,151.2\nB,x,151\n")
    assert [r.station for r in tables.station_entrances(spark, str(tmp_path / "stations.csv")).collect()] == ["A"]
    with pytest.raises(ValueError):
        tables.station_entrances(spark, str(tmp_path / "stations.csv"), ["B"])
    (tmp_path / "events.csv").write_text("event_id,event_date,stations,opened_stations\ne1,2019-05-26,A | B,B\n")
    ev = tables.events(spark, str(tmp_path / "events.csv"))
    assert tables.event(ev, "e1").stations == ["A", "B"] and tables.event(ev, "e1").event_month == date(2019, 5, 1)
    with pytest.raises(KeyError):
        tables.event(ev, "e2")
    (tmp_path / "pub.csv").write_text("\n".join(["note"] * 10 + ["Mar-2017,90.1", "", "Jun-2017,91.0"]))
    assert [r.cells for r in tables.preamble_table(spark, str(tmp_path / "pub.csv")).orderBy("line").collect()] == [["Mar-2017", "90.1"], ["Jun-2017", "91.0"]]
    df = sales(spark)
    tables.to_parquet(df, str(tmp_path / "p"))
    assert tables.clean(spark, str(tmp_path / "p")).count() == df.count()
    assert "| 2000 |" in tables.md_table(df.orderBy("post_code").select("post_code", "purchase_price"), 1)
    assert tables.capped_sample(df, "group_key", 10).count() == 10
    every = tables.systematic_sample(df, "contract_date", "group_key", 5).count()
    assert df.count() / 5 <= every <= df.count() / 5 + 24

"""Experiments over a feature frame: preset feature sets, learning curves, capacity, sets against each other, the worth of
layers with their placebos, and event studies over specifications.

Each fit is a distributed job; what comes to the driver is a score. Encoders see training rows only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_log10
from ..operators import econometrics, encoders, geo, metrics, models, panel, splits
from ..operators.encoders import FeatureSpec
from .pipelines import learners

_W = panel.WINDOWS
LAGGED = tuple(f"pc_median_price_{w}m" for w in _W)
#: What each layer of columns adds to those before it; macro series come last, against all else.
LAYERS: dict[str, FeatureSpec] = {
    "place": FeatureSpec(numeric=("area_sqm", "log_area", "dist_cbd", "log_dist_cbd", "log_area_x_dist"), binned=("area_sqm",)),
    "calendar": FeatureSpec(numeric=("year_num", "month_sin", "month_cos")),
    "labels": FeatureSpec(low_card=("label", "zoning"), high_card=("post_code", "council", "locality")),
    "lagged_price": FeatureSpec(numeric=LAGGED),
    "unit_price": FeatureSpec(numeric=tuple(f"pc_unit_price_{w}m" for w in _W)),
    "dispersion": FeatureSpec(numeric=tuple(f"pc_spread_{w}m" for w in _W[-1:])),
    "liquidity": FeatureSpec(numeric=(*(f"pc_n_sales_{w}m" for w in _W), *(f"pc_n_months_observed_{w}m" for w in _W), "pc_months_since_sale", "pc_months_observed")),
    "macro": FeatureSpec(numeric=("cash_rate_asof", "cpi_yoy_asof")),
}


def without(spec: FeatureSpec, columns) -> FeatureSpec:
    keep = lambda names: tuple(c for c in names if c not in columns)
    return replace(spec, numeric=keep(spec.numeric), low_card=keep(spec.low_card), high_card=keep(spec.high_card), binned=keep(spec.binned))


def layer_specs(columns: list[str], layers: dict[str, FeatureSpec] | None = None) -> list[tuple[str, FeatureSpec]]:
    """Cumulative specs of the layers, of the columns that are there; a layer without any adds nothing and is left out."""
    layers, out = layers or LAYERS, []
    for name, s in layers.items():
        own = without(s, {c for c in (*s.numeric, *s.low_card, *s.high_card, *s.binned) if c not in columns})
        if own.numeric or own.low_card or own.high_card or own.binned:
            out.append((name, own))
    return encoders.with_layers(out)


def feature_sets(columns: list[str]) -> dict[str, FeatureSpec]:
    """``full``; ``lean``, without dispersion, liquidity and macro; and ``nocal``, lean without the calendar: the positive
    control, which must be worse if the comparison can tell anything."""
    full = layer_specs(columns)[-1][1]
    lean = without(full, {c for layer in ("dispersion", "liquidity", "macro") for c in LAYERS[layer].numeric})
    return {"full": full, "lean": lean, "nocal": without(lean, LAYERS["calendar"].numeric)}


def rmsles(df: DataFrame, side: str, target: str, p: str = "prediction") -> dict[str, float]:
    """Per side the root mean squared error of natural logs: one aggregate."""
    got = df.groupBy(side).agg(F.sqrt(F.avg((F.col(p) - F.col(target)) * (F.col(p) - F.col(target)))).alias("e")).collect()
    return {r[side]: float(r["e"]) * math.log(10.0) for r in got if r["e"] is not None}


def fit_and_score(train: DataFrame, sides: dict[str, DataFrame], spec: FeatureSpec, model: str, day: str = "contract_date", key: str = "sale_id", **sizes) -> dict[str, float | None]:
    """One fit on ``train``, and the error on each side, None where it has no rows. A fit passes over its rows several times,
    so they are kept, spilling to disk, unless they are already."""
    own = not train.is_cached
    train = train.persist() if own else train
    try:
        encoder = encoders.Encoder(spec).fit(train)
        predict = learners(spec.target, day, key, **sizes)[models.select_models([model])[0]](encoder.transform(train), encoder.names)
        every = None
        for name, df in sides.items():
            tagged = df.withColumn("_side", F.lit(name))
            every = tagged if every is None else every.unionByName(tagged)
        got = rmsles(predict(encoder.transform(every)), "_side", spec.target)
    finally:
        if own:
            train.unpersist()
    return {name: got.get(name) for name in sides}


def _sides(train: DataFrame, model: str, day: str, key: str, sizes: dict) -> dict[str, DataFrame]:
    """The rows that a learner fits, and those on which it stops early, if it does."""
    tail = sizes.get("gbt", {}).get("tail", 0.1)
    if models.select_models([model]) != ["gbt"] or not tail:
        return {"train": train}
    stop = F.coalesce(models.early_stop_tail(train, day, tail, key), F.lit(False))
    return {"train": train.where(~stop), "tail": train.where(stop)}


@dataclass
class Curve:
    points: DataFrame
    verdict: dict


_POINT = "share double, train_rows long, train_start date, train_end date, train_rmsle double, tail_rmsle double, valid_rmsle double, gap double, ratio double"


def learning_curve(train: DataFrame, valid: DataFrame, spec: FeatureSpec, model: str = "gbt", shares: tuple[float, ...] = (0.02, 0.05, 0.1, 0.25, 0.5, 1.0), mode: str = "latest", least: int = 1000, day: str = "contract_date", key: str = "sale_id", **sizes) -> Curve:
    """Fits on growing parts of the training rows, all scored on the same validation rows. ``latest`` parts all end with the
    training, so only their size changes; ``earliest`` parts all begin with it, so their distance from the validation
    changes as well. A part has ``least`` rows at least. The rows are parted by date, and within one date by a hash of
    the key. The verdict is the slope of the error on log10 of the rows."""
    if mode not in ("latest", "earliest"):
        raise ValueError(f"unknown mode {mode}")
    n, rows = train.count(), []
    if not n:
        raise ValueError("no training rows")
    for share in sorted(shares):
        at = min(1.0, max(share, least / n))
        if at >= 1:
            part = train
        else:
            late = F.coalesce(models.early_stop_tail(train, day, at if mode == "latest" else 1 - at, key), F.lit(False))
            part = train.where(late if mode == "latest" else ~late)
        part = part.persist()
        try:
            seen = part.agg(F.count("*"), F.min(day), F.max(day)).first()
            got = fit_and_score(part, {**_sides(part, model, day, key, sizes), "valid": valid}, spec, model, day, key, **sizes)
        finally:
            part.unpersist()
        a, b = got["train"], got["valid"]
        gap, ratio = (None, None) if a is None or b is None else (b - a, b / a if a else None)
        rows.append((float(share), *seen, a, got.get("tail"), b, gap, ratio))
    points = train.sparkSession.createDataFrame(rows, _POINT)
    return Curve(points, models.curve_verdict([(r[1], r[6]) for r in rows if r[6] is not None]))


def capacity_probe(train: DataFrame, valid: DataFrame, spec: FeatureSpec, share: float = 0.02, rounds: int = 2000, depth: int = 12, day: str = "contract_date", key: str = "sale_id") -> DataFrame:
    """Whether the learner can overfit at all: deep trees of single rows, without early stopping, on few of the latest rows."""
    return learning_curve(train, valid, spec, "gbt", (share,), day=day, key=key, gbt={"rounds": rounds, "depth": depth, "leaf": 1, "tail": None}).points


@dataclass
class Comparison:
    by_fold: DataFrame
    summary: DataFrame
    differences: DataFrame
    control: DataFrame


def compare_feature_sets(features: DataFrame, sets: dict[str, FeatureSpec], folds: list[splits.Fold], model: str = "gbt", base: str = "full", control: tuple[str, str] | None = ("nocal", "lean"), holdout_months: int = 12, day: str = "contract_date", group: str = "group_key", key: str = "sale_id", corruption: str | None = None, quality: str | None = None, **sizes) -> Comparison:
    """Every set on the same rows of every fold, and once on the holdout by a model of all rows before it. ``differences`` are
    of each set to the base over folds; ``settled`` says whether their mean exceeds their deviation. ``control`` is the
    same for a set known to be worse."""
    first, last = features.agg(F.min(day), F.max(day)).first()
    start, end = splits.holdout_window(first, last, holdout_months)
    rows, held = [], {}
    for fold in [*folds, splits.Fold(-1, first.replace(day=1), splits._add(start, -1), start, end, 0)]:
        train, valid = (d.persist() for d in splits.split(features, fold, day, group, corruption, quality))
        try:
            n, m = train.count(), valid.count()
            for name, spec in sets.items() if n and m else ():
                if fold.fold < 0:
                    held[name] = fit_and_score(train, {"valid": valid}, spec, model, day, key, **sizes)["valid"]
                else:
                    got = fit_and_score(train, {**_sides(train, model, day, key, sizes), "valid": valid}, spec, model, day, key, **sizes)
                    rows.append((name, fold.fold, len(spec.numeric), n, m, got.get("tail"), got["valid"]))
        finally:
            train.unpersist()
            valid.unpersist()
    spark = features.sparkSession
    by_fold = spark.createDataFrame(rows, "config string, fold int, numeric_features int, train_rows long, valid_rows long, tail_rmsle double, rmsle double")
    scored = spark.createDataFrame(list(held.items()), "config string, holdout_rmsle double")
    summary = by_fold.groupBy("config", "numeric_features").agg(F.avg("rmsle").alias("mean"), F.stddev("rmsle").alias("std"), F.avg("tail_rmsle").alias("tail_mean"), F.count("*").alias("folds")).join(scored, "config", "left").orderBy("mean", "config")
    settled = lambda d: d.withColumn("settled", F.abs("mean_difference") >= F.col("std_difference"))
    against = settled(metrics.paired_differences(by_fold.where(F.col("config").isin(*control)), control[1])) if control else None
    return Comparison(by_fold, summary, settled(metrics.paired_differences(by_fold, base)), against)


@dataclass
class FeatureValue:
    by_fold: DataFrame
    summary: DataFrame
    placebos: DataFrame


def attach_forward(features: DataFrame, forward: DataFrame, key: str = "post_code", day: str = "contract_date", suffix: str = "__fwd") -> DataFrame:
    """Every row with the medians of the months after its own, under the lagged columns' names and the suffix; rows stay."""
    named = [F.col(f"fw_median_price_{w}m").alias(f"pc_median_price_{w}m{suffix}") for w in _W if f"fw_median_price_{w}m" in forward.columns]
    ahead = forward.select(F.col(key).alias("_k"), F.col("month").alias("_m"), *named)
    return features.join(ahead, (F.col(key) == F.col("_k")) & (F.trunc(F.col(day), "MM") == F.col("_m")), "left").drop("_k", "_m")


def feature_value(features: DataFrame, layers: list[tuple[str, FeatureSpec]], folds: list[splits.Fold], model: str = "gbt", tested: str = "lagged_price", columns: tuple[str, ...] = LAGGED, forward: DataFrame | None = None, draws: int = 3, demeaned_folds: int = 2, place: str = "post_code", day: str = "contract_date", group: str = "group_key", key: str = "sale_id", corruption: str | None = None, quality: str | None = None, seed: int = 17, **sizes) -> FeatureValue:
    """What each layer adds, over the same rows of every fold, and placebos of the layer ``tested`` in its columns:
    ``demeaned`` of their place's training means (last folds: level or timing?), ``permuted`` over both sides of the last
    fold, missing values included, and ``forward`` months in place of those before. No placebo drops rows, as other rows
    would be easier or harder."""
    spec, rows, placebos = dict(layers)[tested], [], []
    used = [c for c in columns if c in features.columns]
    for i, fold in enumerate(folds):
        train, valid = (d.persist() for d in splits.split(features, fold, day, group, corruption, quality))
        run = lambda a, b, s: fit_and_score(a, {"valid": b}, s, model, day, key, **sizes)["valid"]
        try:
            if train.isEmpty() or valid.isEmpty():
                continue
            rows += [(name, at, fold.fold, run(train, valid, s)) for at, (name, s) in enumerate(layers)]
            if i >= len(folds) - demeaned_folds:
                means = train.groupBy(F.col(place).alias("_p")).agg(*[F.avg(c).alias(f"_mean_{c}") for c in used])
                free = lambda df, means=means: df.join(means, F.col(place).eqNullSafe(F.col("_p")), "left").withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in used}).drop("_p", *[f"_mean_{c}" for c in used])
                placebos.append(("demeaned", 0, fold.fold, run(free(train), free(valid), spec)))
            if i == len(folds) - 1:
                both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
                for d in range(draws):
                    dealt = both
                    for j, c in enumerate(used):
                        dealt = models.permute_within(dealt, c, key, seed=seed + 1009 * d + j)
                    placebos.append(("permuted", d, fold.fold, run(dealt.where("not _valid").drop("_valid"), dealt.where("_valid").drop("_valid"), spec)))
        finally:
            train.unpersist()
            valid.unpersist()
    if forward is not None and folds:
        ahead = attach_forward(features, forward, place, day)
        known = [c for c in used if f"{c}__fwd" in ahead.columns]
        ahead = ahead.withColumns({c: F.col(f"{c}__fwd") for c in known}).select(*features.columns)
        train, valid = splits.split(ahead, folds[-1], day, group, corruption, quality)
        placebos.append(("forward", 0, folds[-1].fold, run(train, valid, spec)))
    spark = features.sparkSession
    by_fold = spark.createDataFrame(rows, "layer string, layer_idx int, fold int, rmsle double")
    return FeatureValue(by_fold, metrics.ablation(by_fold), spark.createDataFrame(placebos, "placebo string, draw int, fold int, rmsle double"))


@dataclass
class EventGrid:
    robustness: DataFrame
    coefficients: DataFrame
    placebos: DataFrame
    dose: DataFrame


def event_study_grid(sales: DataFrame, lookup: DataFrame, spec: geo.EventSpec, geocoded: DataFrame | None = None, radii: tuple[float, ...] = (1.5, 3.0), outcomes: tuple[str, ...] = ("median_price",), outcome: str = "median_unit_price", shift: int = 36, draws: int = 20, dose_km: tuple[float, ...] = (5.0, 10.0), least: int = 5, seed: int = 17) -> EventGrid:
    """The main event study, variants by radius and by outcome, both placebos and dose responses, one table each. Outcomes
    are logs. A specification whose reference bucket is not observed in both arms has a row of nulls and no coefficients."""
    spark, fits, rows = sales.sparkSession, {}, []

    def balanced(s: geo.EventSpec) -> tuple[DataFrame, DataFrame]:
        arms = geo.assign_treatment(lookup, s, geocoded)
        grid = panel.balance_panel(geo.event_panel(sales, arms, s), event=s.event)
        return arms, grid.withColumns({c: safe_log10(F.col(c)) for c in {outcome, *outcomes}}).persist()

    def study(name: str, s: geo.EventSpec, y: str, arms: DataFrame, grid: DataFrame) -> None:
        treated = arms.where("treated = 1").count()
        try:
            got = econometrics.event_study(grid, y, window=s.window, reference=s.reference, least=least)
        except ValueError:
            rows.append((name, float(s.radius), y, treated, None, None, None))
            return
        fits[name] = got
        rows.append((name, float(s.radius), y, treated, got.post_mean(), got.pretrend_p, int(got.fit.n)))

    arms, grid = balanced(spec)
    study("main", spec, outcome, arms, grid)
    for y in outcomes:
        study(f"outcome_{y}", spec, y, arms, grid)
    for r in radii:
        own = replace(spec, radius=r)
        a, g = balanced(own)
        study(f"radius_{r:g}km", own, outcome, a, g)
        g.unpersist()
    shown = []
    for name, make in (("shifted", lambda: [econometrics.placebo_shifted(grid, outcome, shift, reference=spec.reference, least=least)]), ("random", lambda: econometrics.placebo_random(grid, outcome, draws, seed, window=spec.window, reference=spec.reference, least=least))):
        try:
            shown += [(name, d, e.post_mean(), e.pretrend_p, int(e.fit.n)) for d, e in enumerate(make())]
        except ValueError:
            shown.append((name, 0, None, None, None))
    dose = []
    for km in dose_km:
        fit = econometrics.dose_response(grid, outcome, arms.select("post_code", "distance"), most_km=km)
        dose.append((float(km), float(fit.coef[0]), float(fit.se[0]), int(fit.n), int(fit.clusters)))
    grid.unpersist()
    stacked = econometrics.stacked(fits, spark) if fits else spark.createDataFrame([], "event_time int, coef double, se double, ci_low double, ci_high double, specification string")
    return EventGrid(
        spark.createDataFrame(rows, "specification string, radius double, outcome string, treated_units long, post_mean double, pretrend_p double, n long"),
        stacked,
        spark.createDataFrame(shown, "placebo string, draw int, post_mean double, pretrend_p double, n long"),
        spark.createDataFrame(dose, "most_km double, coef double, se double, n long, units long"),
    )

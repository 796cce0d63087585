"""Whole runs: clean frame to features, features to cross-validated scores, and the consistency of their tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import calendar_features, safe_log10
from ..operators import encoders, metrics, models, panel, splits
from ..operators.keys import clean_category
from ..operators.temporal import attach_macro
from ..sources.tables import MacroPanel


def geometry_features(df: DataFrame, area: str = "area_sqm", distance: str = "dist_cbd") -> DataFrame:
    """Logs of area and distance, and their product; a missing distance column gives only the log of the area."""
    cols = {"log_area": safe_log10(F.col(area))}
    if distance in df.columns:
        cols |= {"log_dist_cbd": F.log1p(distance), "log_area_x_dist": safe_log10(F.col(area)) * F.log1p(distance)}
    return df.withColumns(cols)


def build_features(clean: DataFrame, macro: MacroPanel | None = None, required: tuple[str, ...] = ("purchase_price", "area_sqm", "contract_date", "post_code"), zoning: str | None = "zoning", min_count: int = 500) -> DataFrame:
    """Clean sales with macro series as of their day, calendar, geometry, the target, lagged panel features of their place
    and the same month's aggregates under ``contemporaneous_``."""
    df = attach_macro(clean, macro.cash, macro.cpi).withColumns({"cash_rate_asof": F.col("cash_rate"), "cpi_yoy_asof": F.col("cpi_yoy")}) if macro else clean
    df = geometry_features(df.withColumns(calendar_features(F.col("contract_date")))).withColumn("log_price", safe_log10(F.col("purchase_price")))
    df = panel.attach_panel(df, panel.rolling_features(panel.complete_spine(panel.build_panel(clean))))
    if zoning and zoning in df.columns:
        df = clean_category(df, zoning, min_count)
    return df.na.drop(subset=list(required))


#: Fits on encoded training rows and returns what adds ``prediction`` to rows.
Learner = Callable[[DataFrame, list[str]], Callable[[DataFrame], DataFrame]]


def learners(target: str = "log_price", day: str = "contract_date", key: str = "sale_id", **sizes) -> dict[str, Learner]:
    return {
        "ridge": lambda train, names: models.ridge(train, names, target).predict,
        "random_forest": lambda train, names: models.random_forest(train, names, target, **sizes.get("random_forest", {}))[0],
        "gbt": lambda train, names: models.gradient_boosting(train, names, target, day, key, **sizes.get("gbt", {}))[0],
    }


@dataclass
class Scores:
    by_fold: DataFrame
    pooled: DataFrame
    predictions: DataFrame


def cross_validate(features: DataFrame, spec: encoders.FeatureSpec, folds: list[splits.Fold], chosen: list[str], day: str = "contract_date", group: str = "group_key", price: str = "purchase_price", corruption: str | None = None, quality: str | None = None, most_train_rows: int | None = None, key: str = "sale_id", **sizes) -> Scores:
    """Every chosen model on every fold: encoders and medians are fitted on the fold's training rows only, which are gated
    and purged; ``most_train_rows`` keeps the latest. Naive predictions ride along as a column, so nothing is joined again."""
    every, out = learners(spec.target, day, key, **sizes), None
    for fold in folds:
        train, valid = splits.split(features, fold, day, group, corruption, quality)
        if most_train_rows:
            train = train.orderBy(F.desc(day), key).limit(most_train_rows)
        train = train.persist()
        try:
            median = models.train_median(train, price)
            valid = models.naive_postcode(valid, median)
            encoder = encoders.Encoder(spec).fit(train) if set(chosen) & set(every) else None
            for name in models.select_models(chosen):
                if name == "naive_postcode":
                    scored = valid.withColumn("prediction", F.col("naive_pred_log10"))
                elif name == "naive_global":
                    scored = valid.withColumn("prediction", F.log10(F.lit(max(median, 1.0))))
                else:
                    raw = valid.select(key, F.col("naive_pred_log10").alias("_naive"))
                    scored = every[name](encoder.transform(train), encoder.names)(encoder.transform(valid.drop("naive_pred_log10"))).join(raw, key).withColumnRenamed("_naive", "naive_pred_log10")
                own = scored.select(F.lit(name).alias("model"), F.lit(fold.fold).alias("fold"), key, day, F.col(spec.target).alias("y_true_log10"), F.col("prediction").alias("y_pred_log10"), "naive_pred_log10")
                out = own if out is None else out.unionByName(own)
        finally:
            train.unpersist()
    ape = F.abs(F.pow(F.lit(10.0), "y_pred_log10") - F.pow(F.lit(10.0), "y_true_log10")) / F.pow(F.lit(10.0), "y_true_log10")
    predictions = out.withColumn("abs_pct_error", ape)
    return Scores(metrics.grouped_report(predictions, ["model", "fold"], least=1), metrics.compare_models(predictions), predictions)


def evaluate_holdout(features: DataFrame, spec: encoders.FeatureSpec, chosen: list[str], months: int = 12, embargo: int = 0, day: str = "contract_date", **how) -> Scores:
    """One scoring of the last months by models of all before them; the published run has no embargo here, so it is a parameter."""
    first, last = features.agg(F.min(day), F.max(day)).first()
    start, end = splits.holdout_window(first, last, months)
    return cross_validate(features, spec, [splits.Fold(-1, first.replace(day=1), splits._add(start, -1 - embargo), start, end, embargo)], chosen, day, **how)


def diagnostics(predictions: DataFrame, groups: dict[str, str], least: int = 200) -> DataFrame:
    """Metrics over several groupings at once: kind, value, metrics. Rows are unpivoted by grouping, so it is one aggregate."""
    parts = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in groups.items()]))
    return metrics.grouped_report(predictions.withColumn("_g", parts).select("*", "_g.kind", "_g.value"), ["kind", "value"], least=least)


def fold_table(scores: DataFrame, names: list[str], metric: str = "rmsle") -> DataFrame:
    """Folds by models."""
    return scores.groupBy("fold").pivot("model", names).agg(F.first(metric))


def consistency(predictions: DataFrame, by_fold: DataFrame, pooled: DataFrame, holdout: DataFrame | None = None, grouped: DataFrame | None = None, recorded_rows: int | None = None, features: DataFrame | None = None) -> DataFrame:
    """(name, passed, violations) between tables of one run: grouped counts add up to the predictions, every model has the
    same folds, and pooled and holdout tables have the same models. ``grouped(kind, n)`` are diagnostics of the best
    model, each kind of which has each of its predictions once; ``recorded_rows`` are those that a run says it read."""
    spark = predictions.sparkSession
    n = {r["model"]: r["n"] for r in predictions.groupBy("model").agg(F.count("*").alias("n")).collect()}
    folds = {r["model"]: (r["n"], r["k"]) for r in by_fold.groupBy("model").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    names = {r["model"] for r in pooled.select("model").collect()}
    checks = [
        ("fold_counts_add_up", sum(folds.get(m, (0, 0))[0] != k for m, k in n.items())),
        ("equal_folds", len({k for _, k in folds.values()}) - 1 if folds else 0),
        ("pooled_models", len(names ^ set(n))),
    ]
    if holdout is not None:
        checks.append(("holdout_models", len(names ^ {r["model"] for r in holdout.select("model").distinct().collect()})))
    if grouped is not None:
        best = pooled.orderBy("rmsle", "model").first()
        kinds = grouped.groupBy("kind").agg(F.sum("n").alias("n")).collect()
        checks.append(("grouped_counts_add_up", sum(r["n"] != n.get(best["model"], 0) for r in kinds) if best else 0))
    if recorded_rows is not None and features is not None:
        checks.append(("recorded_rows", int(features.count() != recorded_rows)))
    return spark.createDataFrame([(k, v == 0, int(v)) for k, v in checks], "name string, passed boolean, violations long")

"""Composite analyses: correlation of area and price, its robustness, unit-price placebos."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_log10
from .describe import unit_price_index
from .econometrics import Fit, bootstrap_ci, fe_regression, normal_p, ratio_placebo
from .metrics import with_rank

#: Why area must not be adjusted for what a larger area itself changes.
BAD_CONTROL = "Controls that follow from the plot (development type, zoning after sale) absorb part of the effect they are meant to isolate."


def logs(df: DataFrame, price: str = "purchase_price", area: str = "area_sqm") -> DataFrame:
    return df.withColumns({"log_price": safe_log10(F.col(price)), "log_area": safe_log10(F.col(area))})


def spearman_bootstrap(df: DataFrame, x: str, y: str, cluster: str, draws: int = 300, seed: int = 17) -> DataFrame:
    """Interval of Spearman's correlation over resamples of whole clusters. Mean ranks are those in the full table; draws
    reweight them and do not rank anew, which would need the table once per draw. So this is an approximation."""
    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(cluster, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = with_rank(with_rank(fine, "_x", None, "rank_x", "n_x"), "_y", None, "rank_y", "n_y")
    return bootstrap_ci(ranked, "rank_x", "rank_y", cluster, draws, seed)


def yearly_intervals(df: DataFrame, x: str, y: str, cluster: str, least: int = 500, draws: int = 60, seed: int = 17) -> DataFrame:
    """Per ``year`` with at least ``least`` rows: n, and the correlation with its interval over resampled clusters."""
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("year").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(bootstrap_ci(df, x, y, cluster, draws, seed, by=["year"]), "year")


@dataclass
class AreaPrice:
    headline: DataFrame
    by_year: DataFrame
    within: Fit
    sign_flips: bool


def area_price(df: DataFrame, cluster: str = "post_code", day: str = "contract_date", draws: int = 300, least_year: int = 500, seed: int = 17) -> AreaPrice:
    """Raw, rank and log correlations of area and price with cluster intervals; the log correlation by year; the elasticity
    within places and years; and whether the two signs differ. Years are those with ``least_year`` rows; each has its own
    interval over a fifth of the draws, 50 at least. ``df`` has purchase_price and area_sqm."""
    both = logs(df).where("log_price is not null and log_area is not null").withColumn("year", F.year(day))
    parts = {"pearson": bootstrap_ci(both, "area_sqm", "purchase_price", cluster, draws, seed), "spearman": spearman_bootstrap(both, "area_sqm", "purchase_price", cluster, draws, seed), "log_pearson": bootstrap_ci(both, "log_area", "log_price", cluster, draws, seed)}
    headline = None
    for name, part in parts.items():
        part = part.withColumn("statistic", F.lit(name))
        headline = part if headline is None else headline.unionByName(part)
    yearly = yearly_intervals(both, "log_area", "log_price", cluster, least_year, max(50, draws // 5), seed)
    within = fe_regression(both, "log_price", ["log_area"], cluster, "year", cluster)
    raw = parts["log_pearson"].first()["estimate"]
    return AreaPrice(headline, yearly, within, raw is not None and float(within.coef[0]) * raw < 0)


def robustness(df: DataFrame, distance: str, cluster: str = "post_code", day: str = "contract_date") -> dict[str, Fit]:
    """The elasticity with a control for distance and with its interaction. The interaction is centred at means taken before
    incomplete rows go, so the main effect stays the one at the average distance."""
    both = logs(df).withColumn("year", F.year(day)).withColumn("log_distance", F.log1p(distance))
    mean = both.agg(F.avg("log_area").alias("a"), F.avg("log_distance").alias("d"))
    centred = both.crossJoin(F.broadcast(mean)).withColumns({"area_c": F.col("log_area") - F.col("a"), "distance_c": F.col("log_distance") - F.col("d")}).drop("a", "d")
    run = lambda x, inter=(): fe_regression(centred, "log_price", x, "council" if "council" in df.columns else cluster, "year", cluster, list(inter))
    return {"R0": run(["area_c"]), "R1": run(["area_c", "distance_c"]), "R2": run(["area_c", "distance_c"], [("area_c", "distance_c")])}


@dataclass
class UnitPrice:
    placebo: DataFrame
    elasticity: float
    p_not_one: float
    bands: DataFrame


def unit_price(df: DataFrame, key: str, cluster: str = "post_code", day: str = "contract_date", draws: int = 200) -> UnitPrice:
    """The correlation of area with unit price against prices dealt at random, the elasticity against 1, and unit prices by
    decile of area."""
    both = logs(df).where("log_price is not null and log_area is not null")
    fit = fe_regression(both.withColumn("year", F.year(day)), "log_price", ["log_area"], cluster, "year", cluster)
    b, se = float(fit.coef[0]), float(fit.se[0])
    return UnitPrice(ratio_placebo(both, "log_area", "log_price", key, draws), b, normal_p((b - 1) / se) if se > 0 else float("nan"), unit_price_index(df, "purchase_price", "area_sqm", key))


def time_reversed(panel_features: DataFrame, key: str = "post_code") -> DataFrame:
    """A placebo: each key's lagged features in reversed order of its months. One window per key, of its months."""
    cols = [c for c in panel_features.columns if c.startswith("pc_")]
    ahead = panel_features.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("month")))
    back = panel_features.select(F.col(key).alias("_k"), F.row_number().over(Window.partitionBy(key).orderBy(F.desc("month"))).alias("_b"), *[F.col(c).alias(f"_v_{c}") for c in cols])
    joined = ahead.join(back, (F.col(key) == F.col("_k")) & (F.col("_r") == F.col("_b")))
    return joined.select(*[F.col(f"_v_{c}").alias(c) if c in cols else F.col(c) for c in panel_features.columns])

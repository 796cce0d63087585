"""Descriptive tables: index series, bands, histograms, pivots, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from .metrics import ranked_bins
from .quantiles import aggregate, medians


def unit_price_index(df: DataFrame, price: str, area: str, key: str, bins: int = 10) -> DataFrame:
    """Medians by rank decile of area, and the unit price as an index of the first band."""
    banded = ranked_bins(df.where((F.col(price) > 0) & (F.col(area) > 0)), area, key, bins, "band")
    per = medians(banded, ["band"], [F.count("*").alias("n")], {"median_area": F.col(area), "median_price": F.col(price), "median_unit_price": safe_ratio(F.col(price), F.col(area))})
    first = F.first("median_unit_price").over(Window.partitionBy(F.lit(0)).orderBy("band"))
    return per.withColumn("unit_price_index", F.col("median_unit_price") / first * 100)


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 20, least: int = 30) -> DataFrame:
    """Medians of y in bins between distinct quantiles of x, right-closed, bins of fewer rows left out."""
    from .encoders import bin_edges, bin_of

    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = bin_edges(fine, [x], bins)[x]
    binned = fine.select(bin_of(F.col(x), edges).alias("bin"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    return medians(binned, ["bin"], [F.count("*").alias("n")], {"median_x": F.col("_x"), "median_y": F.col("_y")}).where(F.col("n") >= least)


def summary(df: DataFrame, column: str, at: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """One row: count, mean, std, min, quantiles, max."""
    c = F.col(column)
    one = aggregate(df, [], [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")], {"q": c}, list(at))
    return one.select("count", "mean", "std", "min", *[F.col("q")[i].alias(f"p{round(a * 100):02d}") for i, a in enumerate(at)], "max")


def boxplot(df: DataFrame, column: str, by: str, k: float = 1.5) -> DataFrame:
    """Quartiles, and whiskers at the last values within k interquartile ranges of them."""
    q = aggregate(df.where(F.col(column).isNotNull()), [by], [], {"q": F.col(column)}, [0.25, 0.5, 0.75])
    q = q.select(F.col(by).alias("_by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    lo, hi = F.col("q1") - (F.col("q3") - F.col("q1")) * k, F.col("q3") + (F.col("q3") - F.col("q1")) * k
    rows = df.where(F.col(column).isNotNull()).join(q, F.col(by).eqNullSafe(F.col("_by")))
    inside = F.col(column).between(lo, hi)
    return rows.groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"), F.count_if(~inside).alias("outliers"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Counts in equal-width bins from min to max, the last closed; empty bins are left out."""
    c = F.col(column).cast("double")
    ends = df.where(c.isNotNull()).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    rows = df.where(c.isNotNull()).crossJoin(F.broadcast(ends))
    width = (F.col("_hi") - F.col("_lo")) / bins
    i = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((c - F.col("_lo")) / F.nullif(width, F.lit(0.0))).cast("int"))).otherwise(F.lit(0))
    return rows.groupBy(i.alias("bin"), (F.col("_lo") + i * width).alias("left")).agg(F.count("*").alias("n"))


def grid_counts(df: DataFrame, x: Column, y: Column, dx: float, dy: float) -> DataFrame:
    """Two-dimensional histogram on a fixed grid."""
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(F.floor(x / dx).alias("ix"), F.floor(y / dy).alias("iy")).agg(F.count("*").alias("n"))


def yearly(df: DataFrame, day: str, price: str) -> DataFrame:
    dated = df.where(F.col(price).isNotNull()).select(F.year(day).alias("year"), F.col(price).alias("_p"))
    return medians(dated, ["year"], [F.count("*").alias("n"), F.min("_p").alias("min_price"), F.max("_p").alias("max_price")], {"median_price": F.col("_p")})


def pivot_index(df: DataFrame, year: Column, arm: str, arms: list, price: str, base_year: int) -> DataFrame:
    """Median price by year and arm, each arm as an index of the base year, and the gap of the last arm to the first.
    Arms are given, so the pivot needs no scan for them; null where the base year is missing."""
    long = medians(df.select(year.alias("year"), F.col(arm).alias("_arm"), F.col(price).alias("_p")), ["year", "_arm"], [F.count("*").alias("_n")], {"_m": F.col("_p")})
    wide = long.groupBy("year").pivot("_arm", arms).agg(F.max("_m"))
    names = [str(a) for a in arms]
    base = wide.where(F.col("year") == base_year).select(*[F.col(n).alias(f"_b{i}") for i, n in enumerate(names)])
    out = wide.join(F.broadcast(base), how="left", on=F.lit(True))
    out = out.select("year", *[F.col(n).alias(f"median_{n}") for n in names], *[(F.col(n) / F.nullif(F.col(f"_b{i}"), F.lit(0.0)) * 100).alias(f"index_{n}") for i, n in enumerate(names)])
    return out.withColumn("gap", F.col(f"index_{names[-1]}") - F.col(f"index_{names[0]}"))


def below(df: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """One row per threshold: rows below it; one pass."""
    one = df.agg(*[F.count_if(F.col(column) < t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")

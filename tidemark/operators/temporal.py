"""Joins along time: as-of with availability lag, and lookups that become legal on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_floor


def legal_label(day: Column, versions: list[tuple[str, Column]]) -> Column:
    """The newest version's label among those whose last illegal date lies before ``day``; it stands even if it is null."""
    out = None
    for last_illegal, label in sorted(versions, key=lambda v: v[0], reverse=True):
        after = day > F.lit(last_illegal).cast("date")
        out = F.when(after, label) if out is None else out.when(after, label)
    return out


def yoy(df: DataFrame, value: str, order: str, lag: int = 4, by: list[str] | None = None, out: str = "yoy") -> DataFrame:
    """Percent change to the row ``lag`` rows before, in order."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    before = F.lag(value, lag).over(w)
    return df.withColumn(out, (F.col(value) / F.nullif(before, F.lit(0.0)) - 1) * 100)


def asof_bucketed(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], values: list[str], tie: list[str] | None = None, bucket=month_floor) -> DataFrame:
    """``left`` with the ``values`` of the last right row of the same ``by`` whose time is not after the left row's; of
    equal times the greatest ``tie``; null before the first and for null times or keys.

    Rows are dealt by (by, time bucket), so a key that most rows share is many tasks. Each bucket's last right row is
    carried forward over the key's buckets - one row each - and fills what has no earlier right row in its own bucket.
    """
    tie = tie or []
    pack = F.struct(F.col(right_time).alias("_t"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    r = right.where(known & F.col(right_time).isNotNull()).select(*by, bucket(F.col(right_time)).alias("_b"), pack.alias("_p"))
    l = left.withColumn("_b", bucket(F.col(left_time)))  # noqa: E741
    per = r.groupBy(*by, "_b").agg(F.max("_p").alias("_last"))
    heads = l.where(known & F.col("_b").isNotNull()).select(*by, "_b").distinct().join(per, [*by, "_b"], "full")
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*by, "_b", F.last("_last", True).over(w).alias("_carry"))
    cols = left.columns
    both = r.select(*by, "_b", F.col("_p._t").alias("_time"), F.lit(0).alias("_side"), "_p", F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("_row")).unionByName(
        l.select(*by, "_b", F.col(left_time).cast(right.schema[right_time].dataType).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p"), F.struct(*cols).alias("_row"))
    )
    inner = Window.partitionBy(*by, "_b").orderBy("_time", "_side", "_p").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_own", F.last("_p", True).over(inner)).where("_side = 1").join(carried, [*by, "_b"], "left")
    got = F.coalesce(F.when(F.col("_time").isNotNull() & known, F.col("_own")), F.col("_carry"))
    return met.select("_row.*", *[got[f"_v{i}"].alias(c) for i, c in enumerate(values)])


def intervals(series: DataFrame, time: str, values: list[str]) -> DataFrame:
    """A series as validity intervals [valid_from, valid_to); of rows with one time the greatest values stand."""
    one = series.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("valid_from")).agg(F.max(F.struct(*values)).alias("v"))
    return one.select("valid_from", F.lead("valid_from").over(Window.partitionBy(F.lit(0)).orderBy("valid_from")).alias("valid_to"), "v.*")


def asof_series(left: DataFrame, series: DataFrame, left_time: str, time: str, values: list[str]) -> DataFrame:
    """As-of join with a series that has no key: an equi-join on the month, in which each of the series' intervals stands
    once for every month that it touches; the days are compared only within a month. Times after the series' last month
    meet in that month, where its last interval is open."""
    spans = intervals(series, time, values)
    month = lambda c: F.trunc(c, "month")
    end = series.agg(F.max(time)).first()[0]
    touched = F.sequence(month(F.col("valid_from")), month(F.coalesce("valid_to", "valid_from")), F.expr("interval 1 month"))
    spans = spans.withColumn("_month", F.explode(touched))
    own = left.withColumn("_own", F.least(month(F.col(left_time)), month(F.lit(end))))
    on = (F.col("_own") == F.col("_month")) & (F.col(left_time) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(left_time) < F.col("valid_to")))
    return own.join(spans, on, "left").drop("valid_from", "valid_to", "_month", "_own")


def attach_macro(left: DataFrame, cash: DataFrame, cpi: DataFrame, day: str = "contract_date") -> DataFrame:
    """The cash rate in force and the price index published by each day: cash_rate; cpi_index, cpi_yoy, period_end,
    release_date. An index is known from its release, not from the end of its period."""
    rated = asof_series(left, cash, day, "effective_date", ["cash_rate"])
    index = yoy(cpi, "cpi_index", "release_date", out="cpi_yoy").withColumn("_release", F.col("release_date"))
    return asof_series(rated, index, day, "_release", ["cpi_index", "cpi_yoy", "period_end", "release_date"])


def macro_checks(day: str = "contract_date") -> dict[str, Column]:
    """Contracts of an as-of frame: nothing is used before it is known."""
    return {
        "released_by_contract": F.count_if(F.col("release_date") > F.col(day)),
        "period_over_by_contract": F.count_if(F.col("period_end") > F.col(day)),
        "cash_rate_known": F.count_if(F.col("cash_rate").isNull()),
    }


def macro_coverage(df: DataFrame, day: str = "contract_date") -> DataFrame:
    """Per year: rows, mean rate, and the lag in days between release and use."""
    lag = F.datediff(F.col(day), F.col("release_date"))
    return df.groupBy(F.year(day).alias("year")).agg(F.count("*").alias("n"), F.avg("cash_rate").alias("mean_cash_rate"), F.percentile("cpi_yoy", F.lit(0.5)).alias("median_cpi_yoy"), F.min(lag).alias("min_lag"), F.percentile(lag, F.lit(0.5)).alias("median_lag"), F.max(lag).alias("max_lag"))


def annual_day_weighted(series: DataFrame, time: str, value: str, last_day: str) -> DataFrame:
    """Mean of a step series over the calendar days of each year. It knows the whole year, so it is for description only."""
    spans = intervals(series, time, [value]).withColumn("valid_to", F.coalesce("valid_to", F.date_add(F.lit(last_day).cast("date"), 1)))
    days = spans.where("valid_to > valid_from").select(value, F.explode(F.sequence("valid_from", F.date_sub("valid_to", 1))).alias("day"))
    return days.groupBy(F.year("day").alias("year")).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("days"))

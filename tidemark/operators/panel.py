"""Monthly panels: aggregation, complete spines, strictly lagged rolling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import linear_quantiles, median, month_floor, months_between_floor, safe_ratio

#: Months of the rolling windows.
WINDOWS = (3, 6, 12)


def build_panel(sales: DataFrame, key: str = "post_code", day: str = "contract_date", price: str = "purchase_price", area: str = "area_sqm") -> DataFrame:
    """One row per (key, month) with sales; null keys and prices take no part."""
    q = linear_quantiles(F.col(price), [0.25, 0.5, 0.75])
    unit = safe_ratio(F.col(price), F.col(area))
    made = sales.where(F.col(key).isNotNull() & F.col(price).isNotNull() & F.col(day).isNotNull()).groupBy(key, month_floor(F.col(day)).alias("month"))
    made = made.agg(F.count("*").alias("n_sales"), q.alias("q"), F.avg(price).alias("mean_price"), median(unit).alias("median_unit_price"), median(F.col(area)).alias("median_area"))
    return made.select(key, "month", "n_sales", F.col("q")[1].alias("median_price"), "mean_price", F.col("q")[0].alias("p25_price"), F.col("q")[2].alias("p75_price"), "median_unit_price", "median_area")


def complete_spine(panel: DataFrame, key: str = "post_code", start: str | None = None, end: str | None = None) -> DataFrame:
    """Every key in every month from the first to the last of all; what was not observed has n_sales 0 and nulls.

    The months come from one aggregated row, so the product is keys times months, without a join of rows.
    """
    bounds = panel.agg(F.coalesce(F.lit(start).cast("date"), F.min("month")).alias("a"), F.coalesce(F.lit(end).cast("date"), F.max("month")).alias("b"))
    spine = panel.select(key).distinct().crossJoin(F.broadcast(bounds)).where("a is not null").select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    full = spine.join(panel, [key, "month"], "left")
    return full.withColumn("observed", F.col("n_sales").isNotNull()).withColumn("n_sales", F.coalesce("n_sales", F.lit(0).cast("long")))


def rolling_features(spine: DataFrame, key: str = "post_code", windows: tuple[int, ...] = WINDOWS, strict: bool = True, lagged_recency: bool = True) -> DataFrame:
    """Statistics of the months before each month only. A window is null until it has as many non-null months as it is long
    (``strict``) or half as many. All windows share one partitioning and one order, so there is one shuffle and one sort.

    ``lagged_recency=False`` lets pc_months_since_sale see its own month.
    """
    w = Window.partitionBy(key).orderBy("month")
    cols = {}
    for n in windows:
        span, least = w.rowsBetween(-n, -1), n if strict else max(1, n // 2)
        full = lambda c, value, span=span, least=least: F.when(F.count(c).over(span) >= least, value)
        med = lambda c, span=span: F.percentile(c, F.lit(0.5)).over(span)
        cols[f"pc_median_price_{n}m"] = full("median_price", med("median_price"))
        cols[f"pc_n_sales_{n}m"] = full("n_sales", F.sum("n_sales").over(span))
        cols[f"pc_unit_price_{n}m"] = full("median_unit_price", med("median_unit_price"))
        cols[f"pc_spread_{n}m"] = safe_ratio(full("p75_price", med("p75_price")), full("p25_price", med("p25_price")))
        cols[f"pc_n_months_observed_{n}m"] = F.sum(F.col("observed").cast("int")).over(span)
    upto = w.rowsBetween(Window.unboundedPreceding, -1 if lagged_recency else 0)
    cols["pc_months_since_sale"] = F.datediff("month", F.last(F.when(F.col("observed"), F.col("month")), True).over(upto)) / F.lit(30.44)
    cols["pc_months_observed"] = F.row_number().over(w) - 1
    return spine.withColumns(cols)


def forward_features(spine: DataFrame, key: str = "post_code", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Medians of the months after each month: a placebo that leaks on purpose."""
    w = Window.partitionBy(key).orderBy("month")
    return spine.select(key, "month", *[F.when(F.count("median_price").over(w.rowsBetween(1, n)) == n, F.percentile("median_price", F.lit(0.5)).over(w.rowsBetween(1, n))).alias(f"fw_median_price_{n}m") for n in windows])


def attach_panel(sales: DataFrame, features: DataFrame, key: str = "post_code", day: str = "contract_date") -> DataFrame:
    """Each sale with its key's features of its month. Lagged columns (pc_*) keep their names; aggregates of the same month
    come only under ``contemporaneous_``."""
    named = features.select(F.col(key).alias("_k"), F.col("month").alias("_m"), *[F.col(c).alias(c if c.startswith("pc_") else f"contemporaneous_{c}") for c in features.columns if c not in (key, "month")])
    return sales.join(named, (F.col(key) == F.col("_k")) & (month_floor(F.col(day)) == F.col("_m")), "left").drop("_k", "_m")


def balance_panel(panel: DataFrame, unit: str = "post_code", event: str | None = None) -> DataFrame:
    """The full unit x month grid of an event panel: treated is the unit's, counts are 0 and outcomes null where unobserved.
    With ``event`` (a date) event_time is recomputed on the grid; without, it stays null there."""
    bounds = panel.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = panel.groupBy(unit).agg(F.max("treated").alias("treated")).crossJoin(F.broadcast(bounds)).select(unit, "treated", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    full = grid.join(panel.drop("treated"), [unit, "month"], "left").withColumn("n_sales", F.coalesce("n_sales", F.lit(0).cast("long")))
    return full.withColumn("event_time", months_between_floor(F.col("month"), F.lit(event).cast("date"))) if event else full


def month_index(df: DataFrame, day: str = "month") -> DataFrame:
    """1-based month index: whole years from the first year, plus the month less the least calendar month of all."""
    first = df.agg(F.min(F.year(day)).alias("_y"), F.min(F.month(day)).alias("_m"))
    return df.crossJoin(F.broadcast(first)).withColumn("month_index", (F.year(day) - F.col("_y")) * 12 + F.month(day) - F.col("_m") + 1).drop("_y", "_m")

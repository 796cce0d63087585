"""Exact quantiles and ranges of a column by counting, so that no task holds all distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges per factor e that values are counted by: they are 0.1 % wide, and a double can be in 3 million.
PER_E = 1024


def magnitude(x: Column, per_e: int = PER_E) -> Column:
    """The range of a double: sign and rounded-down logarithm, rising with the value. Zero, the infinities and NaN, which
    sorts last, have ranges of their own."""
    inf, far = float("inf"), 1000 * per_e
    up = F.floor(F.ln(F.abs(x)) * per_e).cast("int") + far
    out = F.when(F.isnan(x), F.lit(4 * far)).when(x == 0, F.lit(0)).when(x == inf, F.lit(3 * far)).when(x == -inf, F.lit(-3 * far))
    return out.when(x > 0, up).otherwise(-up)


def _holding(counts: DataFrame, of: list[str], order: str) -> DataFrame:
    """The counted ranges that hold one of ``_ranks``, with ``_before``, the rows before them."""
    upto = F.sum("_n").over(Window.partitionBy(*of).orderBy(order)) + F.col("_before")
    counted = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    return counted.where(F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_upto"))))


def exact_quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], at: list[float]) -> DataFrame:
    """Per group (struct ``_g`` of ``by``) an array of exact quantiles of each column, linearly interpolated; null values are
    left out, and a column or group without values has null or no row.

    Rows are counted by ranges of magnitude, and values are counted only in the ranges that hold a wanted rank. Two scans
    of the columns, both with partial counts before their shuffles; what is broadcast has at most two rows a group,
    column and quantile. The distinct values of such a range are sorted in one task, which may spill; they are few unless most
    values lie within 0.1 % of each other.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), c.cast("double").alias("_x")) for i, c in enumerate(columns.values())])
    rows = df.select(F.struct(F.lit(0).alias("_"), *by).alias("_g"), F.explode(cells).alias("_e"))
    rows = rows.select("_g", "_e._c", "_e._x").where("_x is not null").withColumn("_part", magnitude(F.col("_x")))
    key, position = ["_g", "_c"], lambda q: (F.col("_total") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(*[f(position(q)) for q in at for f in (F.floor, F.ceil)]))
    counts = rows.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    counts = counts.select("*", F.sum("_n").over(Window.partitionBy(*key)).alias("_total"), F.lit(0).cast("long").alias("_before"))
    wide = _holding(counts.withColumn("_ranks", ranks), key, "_part").drop("_n", "_upto")
    values = rows.join(F.broadcast(wide), [*key, "_part"]).groupBy(*key, "_part", "_x")
    values = values.agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in ("_before", "_total", "_ranks")])
    found = _holding(values, [*key, "_part"], "_x")

    def order_statistic(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_before")) & (rank < F.col("_upto")), F.col("_x")))

    ends = [F.struct(order_statistic(F.floor(position(q))).alias("a"), order_statistic(F.ceil(position(q))).alias("b")).alias(f"_q{i}") for i, q in enumerate(at)]
    each = found.groupBy(*key).agg(F.any_value("_total").alias("_total"), *ends)

    def between(q: float, i: int) -> Column:
        a, b, part = F.col(f"_q{i}.a"), F.col(f"_q{i}.b"), position(q) - F.floor(position(q))
        return F.when(a == b, a).otherwise((1 - part) * a + part * b)

    each = each.select(*key, F.array(*[between(q, i) for i, q in enumerate(at)]).alias("_q"))
    return each.groupBy("_g").agg(*[F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(c) for i, c in enumerate(columns)])


def aggregate(df: DataFrame, by: list[str], aggregates: list[Column], columns: dict[str, Column], at: list[float]) -> DataFrame:
    """``df.groupBy(by).agg(...)`` with exact quantiles of ``columns`` beside the aggregates, an array each. For groups that
    may be large and are not many; small groups do better with ``percentile``."""
    made = df.groupBy(*by).agg(*[*aggregates, F.count("*").alias("_rows")])
    found = exact_quantiles(df, by, columns, at)
    joined = made.withColumn("_g", F.struct(F.lit(0).alias("_"), *by)).join(F.broadcast(found), "_g", "left")
    return joined.select(*[c for c in made.columns if c != "_rows"], *columns)


def medians(df: DataFrame, by: list[str], aggregates: list[Column], columns: dict[str, Column]) -> DataFrame:
    """``aggregate`` with the median of each column as a number."""
    out = aggregate(df, by, aggregates, columns, [0.5])
    return out.withColumns({c: F.col(c)[0] for c in columns})

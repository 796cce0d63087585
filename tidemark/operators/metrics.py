"""Error metrics in log space, per group, and what model comparisons derive from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rank_bin
from .quantiles import magnitude, medians


def metric_columns(y: Column, p: Column) -> dict[str, Column]:
    """Of log10 truths and predictions. R2 is null where the truth does not vary."""
    d, a, b = p - y, F.pow(F.lit(10.0), y), F.pow(F.lit(10.0), p)
    ape = F.abs(b - a) / a
    rmse = F.sqrt(F.avg(d * d))
    total = F.var_pop(y) * F.count(y)
    return {
        "n": F.count("*"),
        "rmsle": rmse * math.log(10.0),
        "rmse_log10": rmse,
        "mae_log10": F.avg(F.abs(d)),
        "r2": F.when(total > 0, 1 - F.sum(d * d) / F.when(total > 0, total)),
        "mae": F.avg(F.abs(b - a)),
        "rmse": F.sqrt(F.avg((b - a) * (b - a))),
        "mape": F.avg(ape) * 100,
    }


def report(df: DataFrame, y: str = "y_true_log10", p: str = "y_pred_log10") -> DataFrame:
    """One row of all metrics, ``mdape`` (the median error in percent) among them."""
    return grouped_report(df, [], y, p, 0)


def grouped_report(df: DataFrame, by: list[str], y: str = "y_true_log10", p: str = "y_pred_log10", least: int = 50) -> DataFrame:
    """``report`` per group, of groups with at least so many rows. Predictions are dear, so they are made once: the groups,
    truths and predictions are shuffled, and all passes over them read that one exchange."""
    fine = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*by, y, p).hint("rebalance")
    a, b = F.pow(F.lit(10.0), y), F.pow(F.lit(10.0), p)
    out = medians(fine, by, [c.alias(k) for k, c in metric_columns(F.col(y), F.col(p)).items()], {"mdape": F.abs(b - a) / a})
    return out.withColumn("mdape", F.col("mdape") * 100).where(F.col("n") >= least)


def compare_models(df: DataFrame, model: str = "model", y: str = "y_true_log10", p: str = "y_pred_log10") -> DataFrame:
    return grouped_report(df, [model], y, p, 1).orderBy("rmsle", model)


def fold_stability(scores: DataFrame, model: str = "model", metric: str = "rmsle") -> DataFrame:
    return scores.groupBy(model).agg(F.avg(metric).alias("mean"), F.stddev(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.count("*").alias("folds"))


def with_rank(df: DataFrame, value: str, tie: str | None, out: str = "rank", n: str = "n_ranked") -> DataFrame:
    """``df`` without null values, with the global 1-based rank of ``value`` (ties in the order of ``tie``; without it, the
    mean rank of equal values) and the number of ranked rows.

    No task sees all rows: they are dealt by some 1024 ranges of values, ranked within a range, and the
    counts of the ranges before are added. Equal values are in one range; their group is not gathered for mean
    ranks, which come from counts per value.
    """
    rows = df.where(F.col(value).isNotNull())
    if tie is None:
        counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
        dealt, weight, order = _dealt(counts, "_v", F.col("_c")), F.col("_c"), ["_v"]
    else:
        dealt, weight, order = _dealt(rows, value, F.lit(1)), F.lit(1), [value, tie]
    per = dealt.groupBy("_part").agg(F.sum(weight).alias("_n"))
    every = Window.partitionBy(F.lit(0))
    before = per.select("_part", (F.sum("_n").over(every.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias(n))
    w = Window.partitionBy("_part").orderBy(*order)
    joined = dealt.join(F.broadcast(before), "_part")
    if tie is None:
        mean = F.sum("_c").over(w) - F.col("_c") + F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)
        return rows.join(joined.withColumn(out, mean).select("_v", out, n), F.col(value) == F.col("_v")).drop("_v")
    return joined.withColumn(out, F.row_number().over(w) + F.col("_before")).drop("_part", "_before")


#: Ranges that ranking deals rows to, beside one more for every factor of 1.06 that the values span.
RANGES = 1024


def _dealt(rows: DataFrame, value: str, weight: Column) -> DataFrame:
    """``rows`` with ``_part``, a range that rises with the value: ranges of magnitude, each cut into equal widths
    by its share of the rows. What is broadcast has a row a magnitude, of which there are at most 48,000."""
    placed = rows.withColumn("_x", F.col(value).cast("double")).withColumn("_m", magnitude(F.col("_x"), 16))
    per = placed.groupBy("_m").agg(F.sum(weight).alias("_s"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    per = per.withColumn("_s", F.ceil(F.col("_s") * RANGES / F.sum("_s").over(Window.partitionBy(F.lit(0)))))
    at = F.floor((F.col("_x") - F.col("_low")) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")) * F.col("_s"))
    cut = F.when(F.col("_high") > F.col("_low"), F.least(at, F.col("_s") - 1)).otherwise(F.lit(0)).cast("int")
    return placed.join(F.broadcast(per), "_m").withColumn("_part", F.struct("_m", cut.alias("_i"))).drop("_x", "_m", "_s", "_low", "_high")


def ranked_bins(df: DataFrame, value: str, tie: str, bins: int, out: str = "bin") -> DataFrame:
    """Equal-frequency bins of the rank of ``value`` (ties in the order of ``tie``), null values left out."""
    return with_rank(df, value, tie, "_r", "_all").withColumn(out, rank_bin(F.col("_r"), F.col("_all"), bins)).drop("_r", "_all")


def worst_share(df: DataFrame, error: str, tie: str, share: float = 0.01) -> DataFrame:
    """One row: rows, worst rows (ceil of the share), and their share of the squared error."""
    ranked = with_rank(df.where(F.col(error).isNotNull()).select(tie, (-F.col(error) * F.col(error)).alias("_e2")), "_e2", tie, "_r", "_all")
    worst = F.ceil(F.col("_all") * share)
    return ranked.agg(F.count("*").alias("rows"), F.count_if(F.col("_r") <= worst).alias("worst_rows"), (F.sum(F.when(F.col("_r") <= worst, F.col("_e2"))) / F.nullif(F.sum("_e2"), F.lit(0.0))).alias("share_of_squared_error"))


def price_band_errors(df: DataFrame, price: str, ape: str, naive: str, tie: str, bins: int = 5) -> DataFrame:
    banded = ranked_bins(df, price, tie, bins, "band")
    out = medians(banded, ["band"], [F.count("*").alias("n"), (F.avg(ape) * 100).alias("mape")], {"mdape": F.col(ape), "naive_mdape": F.col(naive)})
    return out.select("band", "n", (F.col("mdape") * 100).alias("mdape"), "mape", (F.col("naive_mdape") * 100).alias("naive_mdape"))


def win_counts(scores: DataFrame, metric: str = "rmsle") -> DataFrame:
    """Per model the folds it leads, and how often the lead passes to another from fold to fold."""
    lead = scores.groupBy("fold").agg(F.min_by("model", F.struct(metric, "model")).alias("leader"))
    flips = lead.withColumn("flip", (F.col("leader") != F.lag("leader").over(Window.partitionBy(F.lit(0)).orderBy("fold"))).cast("int")).agg(F.coalesce(F.sum("flip"), F.lit(0)).alias("leader_flips"))
    return lead.groupBy(F.col("leader").alias("model")).agg(F.count("*").alias("wins")).crossJoin(F.broadcast(flips))


def ablation(scores: DataFrame, layer: str = "layer", order: str = "layer_idx", metric: str = "rmsle") -> DataFrame:
    """Per layer, in declared order: mean, std, change to the layer before and folds improved."""
    per = Window.partitionBy("fold").orderBy(order)
    stepped = scores.withColumn("_d", F.col(metric) - F.lag(metric).over(per))
    out = stepped.groupBy(layer, order).agg(F.avg(metric).alias("mean"), F.stddev(metric).alias("std"), F.coalesce(F.sum((F.col("_d") < 0).cast("int")), F.lit(0)).alias("folds_improved"))
    return out.withColumn("delta", F.col("mean") - F.lag("mean").over(Window.partitionBy(F.lit(0)).orderBy(order)))


def paired_differences(scores: DataFrame, base: str, metric: str = "rmsle", config: str = "config") -> DataFrame:
    """Each config against the base over the same folds: mean difference, its std, folds won."""
    b = scores.where(F.col(config) == base).select("fold", F.col(metric).alias("_b"))
    d = scores.where(F.col(config) != base).join(b, "fold").withColumn("d", F.col(metric) - F.col("_b"))
    return d.groupBy(config).agg(F.avg("d").alias("mean_difference"), F.stddev("d").alias("std_difference"), F.count_if(F.col("d") < 0).alias("wins"), F.count("*").alias("folds"))

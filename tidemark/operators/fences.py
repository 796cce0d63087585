"""Log-IQR fences by group with a global fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_log10
from .quantiles import aggregate

ALL = "__all__"
MODES = ("per_year_full_sample", "per_year_train_only", "global_train_only", "off")


def _judged(df: DataFrame, columns: list[str]) -> DataFrame:
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    return df.where(fine)


def fit_bounds(df: DataFrame, columns: list[str], group: Column, k: float = 1.5, overall: bool = True) -> DataFrame:
    """Tidy fences (grp, column, lo, hi, n) of log10 values, per group and over all rows, each row counted once for its group
    and once for all."""
    logs = {c: safe_log10(F.col(c)) for c in columns}
    rows = _judged(df, columns).select(group.cast("string").alias("_own"), *[v.alias(c) for c, v in logs.items()])
    if overall:
        rows = rows.withColumn("grp", F.explode(F.array(F.col("_own"), F.lit(ALL)))).drop("_own")
    else:
        rows = rows.withColumnRenamed("_own", "grp")
    fitted = aggregate(rows, ["grp"], [F.count("*").alias("n")], {c: F.col(c) for c in columns}, [0.25, 0.75])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in columns]))
    tidy = fitted.select("grp", "n", parts.alias("x")).select("grp", "n", "x.column", F.col("x.q")[0].alias("q1"), F.col("x.q")[1].alias("q3"))
    step = (F.col("q3") - F.col("q1")) * k
    return tidy.select("grp", "column", (F.col("q1") - step).alias("lo"), (F.col("q3") + step).alias("hi"), "n")


def global_bounds(df: DataFrame, columns: list[str], k: float = 1.5, caps: dict[str, float] | None = None) -> DataFrame:
    """One fence per column over all rows; a cap is an upper limit in values."""
    out = fit_bounds(df, columns, F.lit(ALL), k, overall=False)
    for c, cap in (caps or {}).items():
        out = out.withColumn("hi", F.when(F.col("column") == c, F.least("hi", F.log10(F.lit(float(cap))))).otherwise(F.col("hi")))
    return out


def with_values(bounds: DataFrame) -> DataFrame:
    return bounds.withColumns({"lo_value": F.pow(F.lit(10.0), "lo"), "hi_value": F.pow(F.lit(10.0), "hi")})


def _wide(bounds: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row per group: key and lo_c, hi_c."""
    pick = lambda c, x: F.max(F.when(F.col("column") == c, F.col(x)))
    return bounds.groupBy(F.col("grp").alias(key)).agg(*[pick(c, x).alias(f"_{key}_{x}_{c}") for c in columns for x in ("lo", "hi")])


def inside(columns: list[str], key: str) -> Column:
    """Within all fences; null where the value or the fence is."""
    out = F.lit(True)
    for c in columns:
        out = out & safe_log10(F.col(c)).between(F.col(f"_{key}_lo_{c}"), F.col(f"_{key}_hi_{c}"))
    return out


def flag_outliers(df: DataFrame, bounds: DataFrame, columns: list[str], group: Column, unjudged_is_null: bool = False) -> DataFrame:
    """iqr_keep: within the own group's fences. What cannot be judged is False, or null if asked."""
    own = _wide(bounds.where(F.col("grp") != ALL), columns, "own")
    joined = df.withColumn("_g", group.cast("string")).join(own, F.col("_g") == F.col("own"), "left")
    keep = inside(columns, "own")
    out = joined.withColumn("iqr_keep", keep if unjudged_is_null else F.coalesce(keep, F.lit(False)))
    return out.select(*[c for c in df.columns if c != "iqr_keep"], "iqr_keep")


def mark_quality(df: DataFrame, quality: DataFrame, corruption: DataFrame, columns: list[str], group: Column) -> DataFrame:
    """iqr_corruption_ok: within the global fences. iqr_keep: that, and within the own group's fences - those over all rows
    for a group without. Fences are a row per group; the global ones are a single row."""
    own, rest, glob = _wide(quality.where(F.col("grp") != ALL), columns, "own"), _wide(quality.where(F.col("grp") == ALL), columns, "all"), _wide(corruption, columns, "glob")
    joined = df.withColumn("_g", group.cast("string")).join(own, F.col("_g") == F.col("own"), "left").crossJoin(F.broadcast(rest.limit(1))).crossJoin(F.broadcast(glob.limit(1)))
    ok = F.coalesce(inside(columns, "glob"), F.lit(False))
    fenced = F.when(F.col("own").isNotNull(), inside(columns, "own")).otherwise(inside(columns, "all"))
    return joined.withColumn("iqr_corruption_ok", ok).withColumn("iqr_keep", F.col("iqr_corruption_ok") & F.coalesce(fenced, F.lit(False))).select(*[c for c in df.columns if c not in ("iqr_corruption_ok", "iqr_keep")], "iqr_corruption_ok", "iqr_keep")


def apply_filter(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that pass the corruption fence, one-row report); quality failures stay, flagged."""
    report = marked.agg(F.count("*").alias("rows_in"), F.count_if(~F.col("iqr_corruption_ok")).alias("dropped"), F.count_if(F.col("iqr_corruption_ok")).alias("rows_out"), F.count_if(F.col("iqr_corruption_ok") & ~F.col("iqr_keep")).alias("flagged"))
    return marked.where("iqr_corruption_ok"), report


def fence(df: DataFrame, columns: list[str], group: Column, in_train: Column, mode: str = MODES[0], k: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Marks and filters by mode; the corruption fence is always fitted on the training span."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "off":
        out = df.withColumns({"iqr_corruption_ok": F.lit(True), "iqr_keep": F.lit(True)})
        return apply_filter(out)
    train = df.where(in_train)
    whole = mode == "global_train_only"
    fitted = fit_bounds(df if mode == "per_year_full_sample" else train, columns, F.lit(ALL) if whole else group, k, overall=not whole)
    return apply_filter(mark_quality(df, fitted, global_bounds(train, columns, k), columns, group))


def diagnostic(marked: DataFrame, bounds: DataFrame, columns: list[str], group: Column) -> DataFrame:
    """Per group: rows, kept, flagged, dropped, share flagged, and upper fences in values; all counts come from one frame."""
    counts = marked.groupBy(group.cast("string").alias("grp")).agg(F.count("*").alias("rows"), F.count_if(F.col("iqr_keep")).alias("kept"), F.count_if(F.col("iqr_corruption_ok") & ~F.col("iqr_keep")).alias("flagged"), F.count_if(~F.col("iqr_corruption_ok")).alias("dropped"))
    upper = bounds.groupBy("grp").agg(*[F.max(F.when(F.col("column") == c, F.pow(F.lit(10.0), "hi"))).alias(f"upper_{c}") for c in columns])
    return counts.join(upper, "grp", "left").withColumn("share_flagged", F.col("flagged") / F.col("rows"))


def drop_outside(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """Rows within the global fences of all columns; others, and what cannot be judged, go."""
    glob = _wide(bounds.where(F.col("grp") == ALL), columns, "glob")
    return df.crossJoin(F.broadcast(glob.limit(1))).where(inside(columns, "glob")).select(*df.columns)

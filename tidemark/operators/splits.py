"""Rolling-origin splits with embargo, holdout and group purge."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_floor, months_between_floor


@dataclass(frozen=True)
class Fold:
    """First months of the first and last month of each side, inclusive."""

    fold: int
    train_start: date
    train_end: date
    valid_start: date
    valid_end: date
    embargo: int


def _add(d: date, n: int) -> date:
    k = d.year * 12 + d.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def _months(a: date, b: date) -> int:
    return (b.year - a.year) * 12 + b.month - a.month + 1


def holdout_window(first: date, last: date, months: int = 12) -> tuple[date, date]:
    """The last months; ValueError if nothing is left before them."""
    if months >= _months(first, last):
        raise ValueError("the holdout covers all months")
    return _add(last.replace(day=1), 1 - months), last.replace(day=1)


def rolling_origin(first: date, last: date, min_train: int = 84, horizon: int = 12, step: int = 24, embargo: int = 1, holdout: int = 12, mode: str = "expanding", window: int | None = None) -> list[Fold]:
    """Folds over the calendar months from first to last. Validation starts ``embargo`` whole months after the training's
    last month, lasts ``horizon`` months and never reaches the holdout; sliding training keeps the last ``window`` months,
    or all where there are fewer."""
    if mode not in ("expanding", "sliding"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "sliding" and not window:
        raise ValueError("sliding folds need a window")
    first, last = first.replace(day=1), last.replace(day=1)
    ceiling = _months(first, last) - 1 - holdout
    out, end = [], min_train - 1
    while end + embargo + 1 <= ceiling:
        start = end + embargo + 1
        out.append(Fold(len(out), _add(first, max(0, end - window + 1) if mode == "sliding" else 0), _add(first, end), _add(first, start), _add(first, min(start + horizon - 1, ceiling)), embargo))
        if min(start + horizon - 1, ceiling) == ceiling:
            break
        end += step
    return out


def folds_of(df: DataFrame, day: str = "contract_date", **how) -> list[Fold]:
    a, b = df.agg(F.min(day), F.max(day)).first()
    if a is None:
        raise ValueError("no dates to split")
    return rolling_origin(a, b, **how)


def folds_frame(spark, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.fold, f.train_start, f.train_end, f.valid_start, f.valid_end, f.embargo) for f in folds], "fold int, train_start date, train_end date, valid_start date, valid_end date, embargo int")


def tagged(df: DataFrame, folds: DataFrame, day: str = "contract_date") -> DataFrame:
    """Each row once for each fold and side it is in: fold, side. Folds are a few rows, broadcast."""
    m = month_floor(F.col(day))
    train, valid = m.between(F.col("train_start"), F.col("train_end")), m.between(F.col("valid_start"), F.col("valid_end"))
    joined = df.join(F.broadcast(folds), train | valid)
    return joined.withColumn("side", F.when(valid, "valid").otherwise("train")).drop("train_start", "train_end", "valid_start", "valid_end", "embargo")


def purge(tags: DataFrame, group: str = "group_key") -> DataFrame:
    """Training rows whose group occurs in the fold's validation go; null groups are no group. One anti-join on distinct groups."""
    seen = tags.where((F.col("side") == "valid") & F.col(group).isNotNull()).select(F.col("fold").alias("_f"), F.col(group).alias("_g"), F.lit("train").alias("_s")).distinct()
    return tags.join(seen, (F.col("fold") == F.col("_f")) & (F.col(group) == F.col("_g")) & (F.col("side") == F.col("_s")), "left_anti")


def split(df: DataFrame, fold: Fold, day: str = "contract_date", group: str = "group_key", corruption: str | None = None, quality: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, valid) of one fold: the corruption gate holds on both sides, the quality gate in training only, then purge."""
    m = month_floor(F.col(day))
    fine = df.where(F.col(corruption)) if corruption else df
    valid = fine.where(m.between(F.lit(fold.valid_start), F.lit(fold.valid_end)))
    train = fine.where(m.between(F.lit(fold.train_start), F.lit(fold.train_end)))
    train = train.where(F.col(quality)) if quality else train
    seen = valid.where(F.col(group).isNotNull()).select(F.col(group).alias("_g")).distinct()
    return train.join(seen, F.col(group) == F.col("_g"), "left_anti"), valid


def holdout_split(df: DataFrame, first: date, last: date, months: int = 12, embargo: int = 0, day: str = "contract_date", group: str = "group_key", corruption: str | None = None, quality: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): training is all before the last months, less the embargo (0 as published), gated and purged as in folds."""
    start, end = holdout_window(first, last, months)
    return split(df, Fold(-1, first.replace(day=1), _add(start, -1 - embargo), start, end, embargo), day, group, corruption, quality)


def summarize(df: DataFrame, folds: DataFrame, day: str = "contract_date", group: str = "group_key") -> DataFrame:
    """Per fold: its months and the rows of each side before and after the purge."""
    tags = tagged(df.select(day, group), folds, day)
    n = tags.groupBy("fold").agg(F.count_if(F.col("side") == "train").alias("train_rows"), F.count_if(F.col("side") == "valid").alias("valid_rows"))
    kept = purge(tags, group).where("side = 'train'").groupBy("fold").agg(F.count("*").alias("train_rows_purged"))
    return folds.join(n, "fold", "left").join(kept, "fold", "left").na.fill(0, ["train_rows", "valid_rows", "train_rows_purged"])


def assert_no_leakage(train: DataFrame, valid: DataFrame, embargo: int, day: str = "contract_date", group: str = "group_key") -> None:
    """ValueError if a side is empty, the gap between the sides is not over the embargo, or a group is on both sides."""
    last, first = train.agg(F.max(day)).first()[0], valid.agg(F.min(day)).first()[0]
    if last is None or first is None:
        raise ValueError("a side is empty")
    if (first.year - last.year) * 12 + first.month - last.month <= embargo:
        raise ValueError("validation begins within the embargo")
    if train.join(valid.select(group).distinct(), group, "left_semi").limit(1).count():
        raise ValueError("a group is on both sides")


__all__ = ["Fold", "rolling_origin", "holdout_window", "folds_of", "folds_frame", "tagged", "purge", "split", "holdout_split", "summarize", "assert_no_leakage", "months_between_floor"]

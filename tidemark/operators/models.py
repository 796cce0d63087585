"""Baselines and learners over encoded features, learning curves, and comparisons."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import medians

ALIASES = {"naive": "naive_postcode", "pc": "naive_postcode", "global": "naive_global", "rf": "random_forest", "gbt": "gbt", "xgb": "gbt", "xgboost": "gbt", "linear": "ridge"}
MODELS = ("naive_postcode", "naive_global", "ridge", "random_forest", "gbt")


def select_models(names: list[str]) -> list[str]:
    """Canonical names, each once; ValueError for an unknown one."""
    out = []
    for n in names:
        n = ALIASES.get(n, n)
        if n not in MODELS:
            raise ValueError(f"unknown model {n}")
        if n not in out:
            out.append(n)
    return out


def naive_postcode(df: DataFrame, train_median: float, out: str = "naive_pred_log10", windows: tuple[int, ...] = (12, 6, 3)) -> DataFrame:
    """log10 of the key's median of the longest window that is known, else of the training median; never below log10(1)."""
    return df.withColumn(out, F.log10(F.greatest(F.coalesce(*[F.col(f"pc_median_price_{w}m") for w in windows], F.lit(float(train_median))), F.lit(1.0))))


def train_median(train: DataFrame, price: str = "purchase_price") -> float:
    got = medians(train, [], [], {"m": F.col(price)}).first()["m"]
    if got is None:
        raise ValueError("no training prices")
    return float(got)


@dataclass
class Ridge:
    names: list[str]
    coef: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        p = F.lit(float(self.intercept))
        for c, b in zip(self.names, self.coef, strict=True):
            p = p + F.col(c) * F.lit(float(b))
        return df.withColumn(out, p)


def ridge(train: DataFrame, names: list[str], target: str, alpha: float = 1.0) -> Ridge:
    """Minimises squared error + alpha * |coef|^2, the intercept unpenalised: one aggregate makes the products, the driver
    solves a system as wide as the features."""
    every = [*names, target]
    fine = train.na.drop(subset=every)
    shift = fine.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(every)]).first()
    if not shift["n"]:
        raise ValueError("no training rows")
    mean = np.array([shift[f"m{i}"] for i in range(len(every))], float)
    col = [F.col(c) - F.lit(float(m)) for c, m in zip(every, mean, strict=True)]
    pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    got = fine.agg(*[F.sum(col[i] * col[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(every), len(every)))
    for i, j in pairs:
        g[i, j] = g[j, i] = got[f"p{i}_{j}"]
    k = len(names)
    coef = np.linalg.solve(g[:k, :k] + alpha * np.eye(k), g[:k, k])
    return Ridge(list(names), coef, float(mean[k] - mean[:k] @ coef))


def _vectors(df: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="_features").transform(df)


def random_forest(train: DataFrame, names: list[str], target: str, trees: int = 200, depth: int = 20, leaf: int = 20, share: float = 0.4, seed: int = 17):
    """A function from rows to rows with a prediction. Spark's forest splits on histogram bins, so its values differ from
    exact-split forests."""
    from pyspark.ml.regression import RandomForestRegressor

    model = RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=str(share), seed=seed).fit(_vectors(train, names))
    return lambda df: model.transform(_vectors(df, names)).drop("_features"), dict(zip(names, model.featureImportances.toArray().tolist(), strict=True))


def gradient_boosting(train: DataFrame, names: list[str], target: str, day: str, key: str, rounds: int = 600, rate: float = 0.05, depth: int = 8, tail: float | None = 0.1, leaf: int = 1, seed: int = 17):
    """Boosted trees, stopped early on the last tenth of the training rows in the order of date and key; never, without a tail."""
    from pyspark.ml.regression import GBTRegressor

    learner = GBTRegressor(featuresCol="_features", labelCol=target, maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    if tail:
        train = train.withColumn("_stop", F.coalesce(early_stop_tail(train, day, tail, key), F.lit(False)))
        learner.setValidationIndicatorCol("_stop")
    model = learner.fit(_vectors(train, names))
    return lambda df: model.transform(_vectors(df, names)).drop("_features"), dict(zip(names, model.featureImportances.toArray().tolist(), strict=True))


def early_stop_tail(train: DataFrame, day: str, tail: float = 0.1, key: str | None = None):
    """True for the last ``tail`` of the rows by date: those after the date at which ``1 - tail`` is reached, by counts per
    date, and of that date's own rows, with a ``key``, the share that is still missing, by a hash of the key."""
    from pyspark.sql import Window

    per = train.groupBy(day).agg(F.count("*").alias("n"))
    run = per.select(day, F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(day)).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    beyond = F.col("upto") - F.col("all") * (1 - tail)
    last = per.join(run, day).where(beyond >= 0).agg(F.min_by(F.struct(day, (beyond / F.col("n")).alias("share")), day)).first()[0]
    if last is None:
        return F.lit(False)
    after = F.col(day) > F.lit(last[day])
    if key is None:
        return after
    return after | ((F.col(day) == F.lit(last[day])) & (F.xxhash64(F.lit(5), key) >= min(2**63 - 1, int(2**63 - min(1.0, last["share"]) * 2**64))))


def importance(weights: dict[str, float], top: int = 40) -> list[tuple[str, float]]:
    return sorted(weights.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:top]


def curve_sizes(train: DataFrame, day: str, key: str, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0), fixed_span: bool = True) -> dict[float, DataFrame]:
    """Training subsets of a learning curve: nested hashed shares over the whole span, or the latest dates holding the share."""
    if fixed_span:
        u = F.pmod(F.xxhash64(F.lit(7), F.col(key).cast("string")), F.lit(1_000_000))
        return {s: train.where(u < int(s * 1_000_000)) for s in shares}
    return {s: train.where(early_stop_tail(train, day, s, key)) if s < 1 else train for s in shares}


def curve_verdict(points: list[tuple[int, float]], flat: float = 0.002) -> dict:
    """Slope of the validation error on log10 of the rows, and whether more rows still help."""
    x, y = np.log10([n for n, _ in points]), np.array([e for _, e in points])
    dx = x - x.mean()
    slope = float(dx @ (y - y.mean()) / (dx @ dx)) if len(points) > 1 and (dx @ dx) > 0 else math.nan
    return {"slope_per_decade": slope, "verdict": "unknown" if math.isnan(slope) else "helps" if slope < -flat else "hurts" if slope > flat else "flat"}


def permute_within(df: DataFrame, column: str, key: str, within: list[str] | None = None, seed: int = 17) -> DataFrame:
    """A placebo: ``column`` dealt anew among the rows (of each group of ``within``), missing values included. The n-th row
    in one hashed order gets the value of the n-th in another; without groups, rows are dealt by hash to groups of
    about 50,000, so no task sees them all."""
    from pyspark.sql import Window

    h = lambda s: F.xxhash64(F.lit(seed), F.lit(s), F.col(key).cast("string"))
    groups = within or ["_part"]
    base = df if within else df.withColumn("_part", F.pmod(h("part"), F.lit(max(1, df.count() // 50_000))))
    a = base.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(h("a"), key)))
    b = base.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(column).alias("_value"), F.row_number().over(Window.partitionBy(*groups).orderBy(h("b"), key)).alias("_r"))
    on = F.col("_n") == F.col("_r")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return a.join(b, on).withColumn(column, F.col("_value")).select(*df.columns)


def demean_within(df: DataFrame, column: str, group: str) -> DataFrame:
    means = df.groupBy(group).agg(F.avg(column).alias("_m"))
    return df.join(means, group, "left").withColumn(column, F.col(column) - F.col("_m")).drop("_m")

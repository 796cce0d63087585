"""Two-way fixed effects, cluster-robust covariance, event studies, bootstraps and placebos.

Regressions never bring rows to the driver: each is solved from sums of products over rows, made by one aggregate, and
from cell sums per (unit, time).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_quantiles


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else float("nan")


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-squared, by the series or the continued fraction of the incomplete gamma function."""
    if k <= 0 or not math.isfinite(x):
        return float("nan")
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def demean(df: DataFrame, columns: list[str], unit: str, time: str | None = None, most_times: int = 4_000) -> DataFrame:
    """``df`` with ``columns`` freed of unit and time effects (null rows must be gone before).

    The normal equations collapse to the times: with cell counts n(unit, time), the time effects solve a system as wide as
    there are times, built from one aggregate over units; unit effects follow. One pass over cells replaces alternating
    projections over rows. Only times x times numbers come to the driver - times are calendar periods, and more than
    ``most_times`` is refused.
    """
    if time is None:
        means = df.groupBy(unit).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
        return df.join(means, unit).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
    cells = df.groupBy(unit, time).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns])
    times = [r[0] for r in df.select(time).distinct().orderBy(time).limit(most_times + 1).collect()]
    if len(times) > most_times:
        raise ValueError("too many times for the driver")
    at = {t: i for i, t in enumerate(times)}
    per_unit = cells.groupBy(unit).agg(F.sum("n").alias("in_unit"), *[F.sum(f"s_{c}").alias(f"all_{c}") for c in columns])
    joined = cells.join(per_unit, unit)
    rhs = joined.groupBy(time).agg(F.sum("n").alias("n"), *[(F.sum(f"s_{c}") - F.sum(F.col("n") * F.col(f"all_{c}") / F.col("in_unit"))).alias(c) for c in columns]).collect()
    pairs = cells.select(unit, F.col(time).alias("t1"), F.col("n").alias("n1")).join(joined.select(unit, F.col(time).alias("t2"), F.col("n").alias("n2"), "in_unit"), unit).groupBy("t1", "t2").agg(F.sum(F.col("n1") * F.col("n2") / F.col("in_unit")).alias("x")).collect()
    a, b = np.zeros((len(times), len(times))), np.zeros((len(times), len(columns)))
    for r in rhs:
        a[at[r[time]], at[r[time]]] += r["n"]
        b[at[r[time]]] = [r[c] for c in columns]
    for r in pairs:
        a[at[r["t1"]], at[r["t2"]]] -= r["x"]
    effect = np.linalg.pinv(a, rcond=1e-12) @ b if times else b
    spark = df.sparkSession
    table = spark.createDataFrame([(t, *map(float, effect[i])) for i, t in enumerate(times)], df.select(F.col(time), *[F.lit(0.0).alias(f"_t_{c}") for c in columns]).schema)
    shifted = cells.join(F.broadcast(table), time).groupBy(unit).agg(*[(F.sum(F.col(f"s_{c}") - F.col("n") * F.col(f"_t_{c}")) / F.sum("n")).alias(f"_u_{c}") for c in columns])
    out = df.join(F.broadcast(table), time).join(shifted, unit)
    return out.withColumns({c: F.col(c) - F.col(f"_t_{c}") - F.col(f"_u_{c}") for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "tu"])


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    clusters: int
    rank: int
    dropped: list[str] = field(default_factory=list)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def frame(self, spark) -> DataFrame:
        se = self.se
        rows = [(k, float(b), float(s), float(b - 1.96 * s), float(b + 1.96 * s), normal_p(b / s) if s > 0 else None, self.n, self.clusters) for k, b, s in zip(self.names, self.coef, se, strict=True)]
        return spark.createDataFrame(rows, "term string, coef double, se double, ci_low double, ci_high double, p_value double, n long, clusters long")


#: Beyond so many products, they are made by matrix products per partition and not by one aggregate expression each.
MOST_EXPRESSIONS = 60


def products(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """(rows, sums of the products of all pairs of columns). Partitions send one matrix each, which are added before the driver."""
    k = len(columns)
    if not k:
        return df.count(), np.zeros((0, 0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    out = np.zeros((k, k))
    if len(pairs) <= MOST_EXPRESSIONS:
        got = df.agg(F.count("*").alias("rows"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            out[i, j] = out[j, i] = got[f"p{i}_{j}"] or 0.0
        return got["rows"], out

    def part(batches):
        n, total = 0, np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n, total = n + len(x), total + x.T @ x
        yield pa.record_batch([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["rows", "p"])

    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(part, "rows long, p array<double>")
    for r in parts.select("rows", F.posexplode("p").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("rows").alias("rows")).collect():
        out[divmod(r["at"], k)] = r["x"]
        n = r["rows"]
    return n, out


def ols(df: DataFrame, y: str, x: list[str], cluster: str) -> Fit:
    """Least squares of centred columns without intercept, CR1 covariance: pinv(X'X) * sum of cluster scores' products *
    pinv(X'X) * G/(G-1) * (n-1)/(n-k). Products of columns are one aggregate; cluster scores - one row a cluster, whose
    products are summed where they are - another."""
    n, every = products(df, [*x, y])
    gram = every[:-1, :-1]
    inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    coef = inverse @ every[:-1, -1]
    e = F.col(y)
    for c, b in zip(x, coef, strict=True):
        e = e - F.col(c) * F.lit(float(b))
    scores = df.withColumn("_e", e).groupBy(cluster).agg(*[F.sum(F.col(c) * F.col("_e")).alias(f"s{i}") for i, c in enumerate(x)])
    g, meat = products(scores, [f"s{i}" for i in range(len(x))])
    k = len(x)
    scale = (g / (g - 1) if g > 1 else float("nan")) * ((n - 1) / (n - k) if n > k else float("nan"))
    return Fit(list(x), coef, inverse @ meat @ inverse * scale, n, g, int(np.linalg.matrix_rank(gram, tol=1e-10 * max(1.0, np.abs(gram).max(initial=0)))))


def fe_regression(df: DataFrame, y: str, x: list[str], unit: str, time: str | None, cluster: str, interactions: list[tuple[str, str]] = (), least_variance: float = 1e-12) -> Fit:
    """Regression with unit (and time) effects absorbed. Products of interacting columns are made before; columns without
    variance left after absorption are dropped and named."""
    for a, b in interactions:
        df = df.withColumn(f"{a}:{b}", F.col(a) * F.col(b))
    terms = [*x, *[f"{a}:{b}" for a, b in interactions]]
    # several passes over a few columns: they are kept, spilling to disk, so that what they come from runs once
    whole = df.select(*dict.fromkeys([y, *terms, unit, cluster, *([time] if time else [])])).na.drop().persist()
    try:
        flat = demean(whole, [y, *terms], unit, time)
        var = flat.agg(*[F.avg(F.col(c) * F.col(c)).alias(f"v{i}") for i, c in enumerate(terms)]).first()
        kept = [c for i, c in enumerate(terms) if (var[f"v{i}"] or 0.0) > least_variance]
        fit = ols(flat, y, kept, cluster)
    finally:
        whole.unpersist()
    fit.dropped = [c for c in terms if c not in kept]
    return fit


def partial_out(df: DataFrame, columns: list[str], unit: str, time: str | None = None) -> DataFrame:
    return demean(df.na.drop(subset=columns), columns, unit, time)


@dataclass
class EventStudy:
    fit: Fit
    times: list[int]
    reference: int
    pretrend_p: float

    def post_mean(self) -> float:
        own = [b for t, b in zip(self.times, self.fit.coef, strict=True) if t >= 0]
        return float(np.mean(own)) if own else float("nan")

    def frame(self, spark) -> DataFrame:
        rows = [(int(t), float(b), float(s), float(b - 1.96 * s), float(b + 1.96 * s)) for t, b, s in zip(self.times, self.fit.coef, self.fit.se, strict=True)]
        return spark.createDataFrame([*rows, (self.reference, 0.0, 0.0, 0.0, 0.0)], "event_time int, coef double, se double, ci_low double, ci_high double")


def event_study(panel: DataFrame, y: str, unit: str = "post_code", month: str = "month", window: int = 24, reference: int = -1, least: int = 5) -> EventStudy:
    """Effects of treatment by time to the event, with unit and month effects. Edge buckets take the two months beyond them;
    buckets with fewer than ``least`` rows in either arm go. ValueError if no row is left or the reference bucket is gone,
    as the others then mean nothing."""
    rows = panel.where(F.col(y).isNotNull() & F.col("event_time").isNotNull()).withColumn("bucket", F.greatest(F.lit(-window + 2), F.least(F.lit(window - 2), F.col("event_time"))))
    rows = rows.select(unit, month, y, "treated", "bucket").persist()
    try:
        return _event_study(rows, y, unit, month, reference, least)
    finally:
        rows.unpersist()


def _event_study(rows: DataFrame, y: str, unit: str, month: str, reference: int, least: int) -> EventStudy:
    arms = rows.groupBy("bucket").agg(F.count_if(F.col("treated") == 1).alias("a"), F.count_if(F.col("treated") == 0).alias("b")).where((F.col("a") >= least) & (F.col("b") >= least))
    buckets = sorted(r["bucket"] for r in arms.select("bucket").collect())
    if reference not in buckets:
        raise ValueError("the reference bucket is not observed in both arms")
    times = [t for t in buckets if t != reference]
    coded = F.when(F.col("treated") == 1, F.array_position(F.array(*[F.lit(t) for t in times]), F.col("bucket")).cast("int") - 1).otherwise(F.lit(-1)) if times else F.lit(-1)
    cells = rows.where(F.col("bucket").isin(buckets)).groupBy(unit, month, coded.alias("j")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    fit = _one_hot_fit(cells, unit, month, [f"event_time {t}" for t in times])
    pre = [i for i, t in enumerate(times) if t < reference]
    b, v = fit.coef[pre], fit.cov[np.ix_(pre, pre)]
    return EventStudy(fit, times, reference, chi2_sf(float(b @ np.linalg.pinv(v) @ b), len(pre)) if pre else float("nan"))


def _summed(units: DataFrame, part: Callable, size: int) -> np.ndarray:
    """The sum of a vector of ``size`` numbers that ``part`` makes of each partition's units, added before the driver."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                part(total, cells)
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["p"])

    out = np.zeros(size)
    for r in units.mapInArrow(run, "p array<double>").select(F.posexplode("p").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def _one_hot_fit(cells: DataFrame, unit: str, month: str, names: list[str], most_times: int = 2_000) -> Fit:
    """Least squares on one-hot columns with unit and month effects, clustered by unit, from cells(unit, month, j, n, s): j is
    the column that is 1 in the cell (-1: none), n its rows and s their sum of y.

    A unit's cells - at most a few a month - are one row. The first pass adds up, over units, the products of month
    dummies, columns and y within units; the driver frees them of months. The second adds up the products of the units'
    scores. Both send matrices as wide as months and columns, whatever the rows.
    """
    months = [r[0] for r in cells.select(month).distinct().orderBy(month).limit(most_times + 1).collect()]
    if len(months) > most_times:
        raise ValueError("too many months for the driver")
    at, k, width = {m: i for i, m in enumerate(months)}, len(names), len(months) + len(names) + 1
    t = len(months)
    units = cells.groupBy(unit).agg(F.collect_list(F.struct(month, "j", "n", "s")).alias("cells")).select("cells")

    def design(own):
        x = np.zeros((len(own), width))
        for i, c in enumerate(own):
            x[i, at[c[month]]] = 1
            if c["j"] is not None and c["j"] >= 0:
                x[i, t + c["j"]] = 1
            x[i, -1] = c["s"] / c["n"]
        return x, np.array([c["n"] for c in own], float)

    def gram(total, own):
        x, n = design(own)
        x = x - (n @ x) / n.sum()
        total[:-2] += (x.T @ (x * n[:, None])).ravel()
        total[-2:] += n.sum(), 1

    got = _summed(units, gram, width * width + 2)
    g, rows, clusters = got[:-2].reshape(width, width), int(got[-2]), int(got[-1])
    effects = np.linalg.pinv(g[:t, :t], rcond=1e-12, hermitian=True) @ g[:t, t:]
    free = g[t:, t:] - g[t:, :t] @ effects
    inverse = np.linalg.pinv(free[:k, :k], rcond=1e-10, hermitian=True)
    coef = inverse @ free[:k, k]

    def scores(total, own):
        x, n = design(own)
        r = x[:, t:] - x[:, :t] @ effects
        r -= (n @ r) / n.sum()
        score = r[:, :k].T @ (n * (r[:, k] - r[:, :k] @ coef))
        total += np.outer(score, score).ravel()

    meat = _summed(units, scores, k * k).reshape(k, k) if k else np.zeros((0, 0))
    scale = (clusters / (clusters - 1) if clusters > 1 else float("nan")) * ((rows - 1) / (rows - k) if rows > k else float("nan"))
    return Fit(names, coef, inverse @ meat @ inverse * scale, rows, clusters, int(np.linalg.matrix_rank(free[:k, :k], tol=1e-10 * max(1.0, np.abs(free[:k, :k]).max(initial=0)))) if k else 0)


def placebo_shifted(panel: DataFrame, y: str, shift: int, window: int = 12, **how) -> EventStudy:
    """The event moved by ``shift`` months, over months before the true event only."""
    moved = panel.where("event_time < 0").withColumn("event_time", F.col("event_time") - shift).where(F.col("event_time").between(-window, window))
    return event_study(moved, y, window=window, **how)


def placebo_random(panel: DataFrame, y: str, draws: int, seed: int, unit: str = "post_code", **how) -> list[EventStudy]:
    """Arms dealt at random, as many units as in truth: in each draw those first by a seeded hash, found and joined as a table."""
    units, treated = panel.select(unit).distinct(), panel.where("treated = 1").select(unit).distinct().count()
    out = []
    for i in range(draws):
        arm = units.orderBy(F.xxhash64(F.lit(seed), F.lit(i), unit), unit).limit(treated).withColumn("_in", F.lit(1))
        out.append(event_study(panel.drop("treated").join(arm, unit, "left").withColumn("treated", F.coalesce("_in", F.lit(0))).drop("_in"), y, unit, **how))
    return out


def dose_response(panel: DataFrame, y: str, distance: DataFrame, unit: str = "post_code", month: str = "month", most_km: float = 10.0) -> Fit:
    """post * log1p(km) with unit and month effects, for units within ``most_km``."""
    near = panel.join(distance.where(F.col("distance") <= most_km), unit).withColumn("dose", (F.col("event_time") >= 0).cast("double") * F.log1p("distance"))
    return fe_regression(near, y, ["dose"], unit, month, unit)


def stacked(fits: dict[str, EventStudy], spark) -> DataFrame:
    out = None
    for name, f in fits.items():
        own = f.frame(spark).withColumn("specification", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def cluster_moments(df: DataFrame, x: str, y: str, cluster: str, by: list[str] | None = None) -> DataFrame:
    """Per cluster the sums that any resampling of whole clusters needs for Pearson's correlation."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*(by or []), cluster).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy"))


def correlation(n, sx, sy, sxx, syy, sxy):
    """From sums; null (nan) where a side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    with np.errstate(all="ignore"):
        return np.where((vx > 0) & (vy > 0), (n * sxy - sx * sy) / np.sqrt(np.maximum(vx * vy, 1e-300)), np.nan)


def drawn(text: Column, below: Column | int) -> Column:
    """A whole number under ``below`` from the md5 of a text: other engines have it too, so SQL can repeat a draw."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % below


def bootstrap_ci(df: DataFrame, x: str, y: str, cluster: str, draws: int = 300, seed: int = 17, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Interval of Pearson's correlation over ``draws`` resamples of as many whole clusters as there are, with replacement:
    estimate, low, high, std, draws, clusters; one row, or one for each group of ``by``. Each cluster stands for a slot of
    each draw, and a hash of (seed, draw, slot) names the cluster that fills it; weighted sums of clusters equal those of
    resampled rows. So all draws of all groups are one aggregate, and reruns agree. Clusters are numbered in one task
    a group, a row each. A draw in which a side is constant does not count; estimates are null without rows."""
    from pyspark.sql import Window

    keys = by or []
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    m = cluster_moments(df, x, y, cluster, by).withColumns({"_i": F.row_number().over(own.orderBy(F.col(cluster).cast("string"))) - 1, "_c": F.count("*").over(own)})
    slots = m.select(*keys, F.col("_i").alias("_slot"), "_c", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")) if draws else m.select(*keys, F.col("_i").alias("_slot"), "_c", F.lit(1).alias("draw")).limit(0)
    picks = slots.groupBy(*keys, "draw", drawn(F.concat_ws(":", F.lit(seed), "draw", "_slot"), F.col("_c")).alias("_i")).agg(F.count("*").alias("w"))
    on = F.col("p._i") == F.col("m._i")
    for k in keys:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}"))
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    named = [F.col(f"m.{k}").alias(k) for k in keys]
    resampled = picks.alias("p").join(m.alias("m"), on).select(*named, "draw", "w", *sums)
    each = m.select(*keys, F.lit(0).alias("draw"), F.lit(1).cast("long").alias("w"), *sums).union(resampled).groupBy(*keys, "draw").agg(*[F.sum(F.col(c) * F.col("w")).cast("double").alias(c) for c in sums], F.count("*").alias("_c"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    each = each.select(*keys, "draw", "_c", r.alias("r"), F.when(F.col("draw") > 0, r).alias("d"))
    tail = (1 - level) / 2
    out = each.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col("r"))).alias("estimate"), linear_quantiles(F.col("d"), [tail, 1 - tail]).alias("q"), F.stddev_pop("d").alias("std"), F.count("d").cast("int").alias("draws"), F.coalesce(F.max(F.when(F.col("draw") == 0, F.col("_c"))), F.lit(0)).cast("long").alias("clusters"))
    return out.select(*keys, "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "std", "draws", "clusters")


def _places(n: int, draw: int) -> np.ndarray:
    """A permutation of n places for a draw: places in the order of a mixed number of place and draw, modulo a prime, in
    whole numbers under 2**62, so SQL can repeat it."""
    prime = 2**31 - 1
    h = (np.arange(1, n + 1, dtype=np.int64) * 48271 + draw * 69621) % prime
    h = ((h ^ (h >> 13)) * 1103515245) % prime
    h = ((h ^ (h >> 16)) * 1566083941) % prime
    return np.argsort(h, kind="stable")


def ratio_placebo(df: DataFrame, log_area: str, log_price: str, key: str, draws: int = 200, seed: int = 17, block: int = 50_000) -> DataFrame:
    """Correlation of log area with log unit price, true (draw 0) and with prices dealt anew: draw, correlation (null where
    it has none). Rows are dealt by a hash of their ``key``, which tells them apart, to random blocks of about ``block``
    rows, once for all draws; within its block each price moves in every draw. Random blocks leave the mean and, but for
    one part in ``block``, the variance of the placebo as under one permutation of all rows. Area and price keep their
    spread, so a draw needs only the sum of products: blocks send one number a draw."""
    rows = df.where(F.col(log_area).isNotNull() & F.col(log_price).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(log_area).cast("double").alias("a"), F.col(log_price).cast("double").alias("p"))
    t = rows.agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("p").alias("p"), F.var_pop("a").alias("va"), F.var_pop("p").alias("vp"), F.covar_pop("a", "p").alias("c")).first()
    n, mean_a, mean_p = t["n"], t["a"] or 0.0, t["p"] or 0.0
    parts = max(1, n // block)

    def moved(whole: pd.DataFrame) -> pd.DataFrame:
        whole = whole.sort_values(["o", "k", "a", "p"], kind="stable")
        a, p = whole["a"].to_numpy() - mean_a, whole["p"].to_numpy() - mean_p
        return pd.DataFrame({"draw": np.arange(1, draws + 1, dtype=np.int32), "s": [float(a @ p[_places(len(a), d)]) for d in range(1, draws + 1)]})

    dealt = rows.withColumns({"b": drawn(F.concat_ws(":", F.lit(seed), "k"), parts), "o": drawn(F.concat_ws(":", F.lit(seed), F.lit("o"), "k"), 1 << 48)})
    sums = dealt.groupBy("b").applyInPandas(moved, "draw int, s double").groupBy("draw").agg((F.sum("s") / max(n, 1)).alias("c"))
    every = df.sparkSession.createDataFrame([(0, t["c"])], "draw int, c double").union(sums)
    va, vp = F.lit(t["va"]).cast("double"), F.lit(t["vp"]).cast("double")
    spread = va * (vp + va - 2 * F.col("c"))
    return every.select("draw", F.when(spread > 0, (F.col("c") - va) / F.sqrt(spread)).alias("correlation"))


def within_slope(df: DataFrame, y: str, x: str, unit: str) -> DataFrame:
    """Slope of y on x within units, in SQL terms: regr_slope of deviations from unit means."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = whole.groupBy(unit).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    dx, dy = F.col(x) - F.col("_x"), F.col(y) - F.col("_y")
    return whole.join(means, unit).agg((F.sum(dx * dy) / F.nullif(F.sum(dx * dx), F.lit(0.0))).alias("slope"), F.count("*").alias("n"))


def _correlations(x: Column, y: Column) -> Column:
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """Pearson's correlation, null where a side is constant; per group if asked."""
    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = fine.groupBy(*(by or [])).agg(F.count("*").alias("n"), _correlations(F.col(x), F.col(y)).alias("r"))
    return out.where(F.col("n") >= least)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of mean ranks."""
    from .metrics import with_rank

    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = with_rank(with_rank(fine, "_x", None, "rx", "nx"), "_y", None, "ry", "ny")
    return pearson(ranked, "rx", "ry")

"""Encoders fitted on a fold's training rows: imputation, frequencies, smoothed targets, quantile bins, standardisation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import check_features
from .keys import MISSING
from .quantiles import aggregate, medians


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of columns. A column has one role; none may tell the target."""

    numeric: tuple[str, ...] = ()
    low_card: tuple[str, ...] = ()
    high_card: tuple[str, ...] = ()
    binned: tuple[str, ...] = ()
    target: str = "log_price"
    smoothing: float = 20.0
    bins: int = 10

    def __post_init__(self):
        roles = [*self.numeric, *self.low_card, *self.high_card]
        if len(set(roles)) != len(roles):
            raise ValueError("a column has several roles")
        check_features([*roles, *self.binned])


def with_layers(layers: list[tuple[str, FeatureSpec]]) -> list[tuple[str, FeatureSpec]]:
    """Cumulative specs: each layer adds its columns to those before."""
    out, add = [], lambda a, b: (*a, *(x for x in b if x not in a))
    now = FeatureSpec(target=layers[0][1].target)
    for name, s in layers:
        now = FeatureSpec(add(now.numeric, s.numeric), add(now.low_card, s.low_card), add(now.high_card, s.high_card), add(now.binned, s.binned), s.target, s.smoothing, s.bins)
        out.append((name, now))
    return out


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def frequency_table(train: DataFrame, column: str) -> DataFrame:
    """(key, freq): share of the training rows; null is a key of its own. The total is the sum of the counts, one row."""
    counts = train.groupBy(_key(column).alias("key")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("key", (F.col("n") / F.col("all")).alias("freq"))


def target_table(train: DataFrame, column: str, target: str, smoothing: float = 20.0) -> DataFrame:
    """(key, te): (sum of the target + global mean * s) / (n + s)."""
    sums = train.where(F.col(target).isNotNull()).groupBy(_key(column).alias("key")).agg(F.count("*").alias("n"), F.sum(target).alias("y"))
    mean = sums.agg((F.sum("y") / F.sum("n")).alias("mean"))
    return sums.crossJoin(F.broadcast(mean)).select("key", ((F.col("y") + F.col("mean") * smoothing) / (F.col("n") + smoothing)).alias("te"))


def out_of_fold_target(train: DataFrame, column: str, target: str, row_key: str, parts: int = 5, smoothing: float = 20.0) -> DataFrame:
    """``train`` with te fitted on the other parts of the rows, dealt by a hash of ``row_key``: sums less the part's own."""
    rows = train.withColumn("_p", F.pmod(F.xxhash64(row_key), F.lit(parts))).withColumn("_k", _key(column))
    sums = rows.where(F.col(target).isNotNull()).groupBy("_k", "_p").agg(F.count("*").alias("n"), F.sum(target).alias("y"))
    every = sums.groupBy("_k").agg(F.sum("n").alias("an"), F.sum("y").alias("ay"))
    part = sums.groupBy("_p").agg(F.sum("n").alias("pn"), F.sum("y").alias("py"))
    total = sums.agg(F.sum("n").alias("tn"), F.sum("y").alias("ty"))
    joined = rows.join(every, "_k", "left").join(sums, ["_k", "_p"], "left").join(part, "_p", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = (F.col("ty") - zero("py")) / F.nullif((F.col("tn") - zero("pn")).cast("double"), F.lit(0.0))
    te = (zero("ay") - zero("y") + mean * smoothing) / (zero("an") - zero("n") + smoothing)
    return joined.select(*train.columns, te.alias(f"{column}__te"))


def bin_edges(train: DataFrame, columns: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct quantile edges of each column; ``bins + 1`` numbers a column come to the driver."""
    got = aggregate(train, [], [], {c: F.col(c) for c in columns}, [i / bins for i in range(bins + 1)]).first() if columns else {}
    return {c: sorted(set(got[c] or [])) for c in columns}


def bin_of(c: Column, edges: list[float]) -> Column:
    """Right-closed bins, the first closed on both sides; -1 outside or null."""
    if len(edges) < 2:
        return F.lit(-1)
    out = F.when(c.isNull() | (c < edges[0]) | (c > edges[-1]), F.lit(-1))
    for i, edge in enumerate(edges[1:]):
        out = out.when(c <= edge, F.lit(i))
    return out.otherwise(F.lit(-1))


#: Fitted tables of up to so many keys are held as local rows; larger ones stay queries on the training rows.
LOCAL_KEYS = 20_000


def _fitted(table: DataFrame) -> DataFrame:
    rows = table.limit(LOCAL_KEYS + 1).collect()
    return table if len(rows) > LOCAL_KEYS else table.sparkSession.createDataFrame(rows, table.schema)


@dataclass
class Encoder:
    """Fits on training rows and transforms any rows of the same columns; the fitted numbers are one row per column or a
    table per key column, joined on."""

    spec: FeatureSpec
    medians: dict[str, float] = field(default_factory=dict)
    degenerate: list[str] = field(default_factory=list)
    edges: dict[str, list[float]] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    freq: dict[str, DataFrame] = field(default_factory=dict)
    te: dict[str, DataFrame] = field(default_factory=dict)
    mean: float | None = None

    @property
    def names(self) -> list[str]:
        s = self.spec
        return [x for c in s.numeric for x in (c, f"{c}__isna")] + [f"{c}__freq" for c in s.low_card] + [x for c in s.high_card for x in (f"{c}__freq", f"{c}__te")] + [f"{c}__bin" for c in s.binned]

    def fit(self, train: DataFrame) -> Encoder:
        s = self.spec
        if s.numeric:
            got = medians(train, [], [], {c: F.col(c) for c in s.numeric}).first()
            self.degenerate = [c for c in s.numeric if got[c] is None]
            self.medians = {c: 0.0 if got[c] is None else float(got[c]) for c in s.numeric}
        self.edges = bin_edges(train, list(s.binned), s.bins)
        self.freq = {c: _fitted(frequency_table(train, c)) for c in (*s.low_card, *s.high_card)}
        self.te = {c: _fitted(target_table(train, c, s.target, s.smoothing)) for c in s.high_card}
        self.mean = train.agg(F.avg(s.target)).first()[0] if s.high_card else None
        encoded = self._encoded(train)
        stats = encoded.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in self.names]).first()
        self.scale = {c: (float(stats[c]["m"] or 0.0), float(stats[c]["s"] or 0.0) or 1.0) for c in self.names}
        return self

    def _encoded(self, df: DataFrame) -> DataFrame:
        s, out = self.spec, df
        cols = {}
        for c in s.numeric:
            cols[f"{c}__isna"] = F.col(c).isNull().cast("double")
            cols[c] = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
        for c in s.binned:
            cols[f"{c}__bin"] = bin_of(F.col(c), self.edges[c]).cast("double")
        for c, table in self.freq.items():
            out = out.join(table.select(F.col("key").alias("_k"), F.col("freq").alias("_f")), _key(c) == F.col("_k"), "left").withColumn(f"{c}__freq", F.coalesce("_f", F.lit(0.0))).drop("_k", "_f")
        for c, table in self.te.items():
            out = out.join(table.select(F.col("key").alias("_k"), F.col("te").alias("_f")), _key(c) == F.col("_k"), "left").withColumn(f"{c}__te", F.coalesce("_f", F.lit(self.mean))).drop("_k", "_f")
        return out.withColumns(cols) if cols else out

    def transform(self, df: DataFrame, standardize: bool = True) -> DataFrame:
        out = self._encoded(df)
        return out.withColumns({c: (F.col(c) - self.scale[c][0]) / self.scale[c][1] for c in self.names}) if standardize else out

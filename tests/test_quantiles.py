"""Exact quantiles and ranks by counting, against Spark's own percentile and a plain sort."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.quantiles import aggregate, medians

AT = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def _rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    x = np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n))
    x[:6] = [np.inf, -np.inf, 0.0, -0.0, 5e-324, 1.7e308]
    groups = [None if i % 7 == 0 else i % 5 for i in range(n)]
    data = list(zip(range(n), groups, x.tolist(), (151.0 + rng.random(n) * 1e-3).tolist()))
    df = spark.createDataFrame(data, "id long, g int, x double, y double")
    return df.withColumn("z", F.when(F.coalesce(F.col("g"), F.lit(9)) != 3, F.col("x")))


def test_equal_to_percentile(spark):
    df = _rows(spark)
    for by in ([], ["g"]):
        got = aggregate(df, by, [F.count("*").alias("n")], {c: F.col(c) for c in "xyz"}, AT).collect()
        at = F.array(*[F.lit(q) for q in AT])
        want = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(c, at).alias(c) for c in "xyz"]).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_nothing_to_count(spark):
    none = _rows(spark).where("1 = 0")
    assert [tuple(r) for r in medians(none, [], [F.count("*").alias("n")], {"x": F.col("x")}).collect()] == [(0, None)]
    assert medians(none, ["g"], [F.count("*").alias("n")], {"x": F.col("x")}).collect() == []


def test_no_single_buffer_and_no_loop_over_rows(spark):
    plan = medians(_rows(spark), ["g"], [], {"x": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "NestedLoop" not in plan


def test_ranks(spark):
    df = _rows(spark)
    local = df.select("id", "x", "y").toPandas()
    for c in "xy":
        got = metrics.with_rank(df.select("id", c), c, "id").toPandas().set_index("id")["rank"]
        want = pd.Series(np.arange(1, len(local) + 1), index=local.assign(**{c: local[c] + 0.0}).sort_values([c, "id"], kind="stable")["id"])
        assert (got.sort_index() == want.sort_index()).all()
        mean = metrics.with_rank(df.select("id", c), c, None).toPandas().set_index("id")["rank"]
        assert np.allclose(mean.sort_index().to_numpy(), local.set_index("id")[c].rank().sort_index().to_numpy())

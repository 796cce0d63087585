"""Exact top-k against brute force; recall of the permutation index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, topk


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim)).astype(np.float32)


def brute_topk(rows, queries, k):
    out = []
    for q, v in queries:
        got = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 1000])
def test_topk_is_exact_over_blocks(spark, spread):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-spread, spread, 8)]) for i in range(700)] + [(i, [5.0] * 8) for i in range(700, 760)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = topk.top_k(df, F.col("id") % 50 == 0, 5, n_pivots=6, block_rows=100).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_topk_stops_early_where_bounds_allow():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (2000, 4)), rng.integers(400, 500, (10, 4))]).astype(float)
    find = topk.search_block(4, np.arange(len(x)), x, topk.chosen_pivots(x[::251], 4), 5)
    (ids, scores, _, rest), = list(find(np.array([2005]), x[2005:2006], np.array([-np.inf])))
    assert set(ids) < set(range(2000, 2010)) and list(scores) == sorted(scores, reverse=True) and rest == -np.inf
    assert find.evaluated < 100


def test_topk_evaluates_few_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centre = rng.integers(-90, 90, (40, 32))
    x = (centre[rng.integers(0, 40, 8000)] + rng.integers(-9, 9, (8000, 32))).astype(float)
    pivot = topk.chosen_pivots(x[::17], 256)
    assert len(pivot) == 28
    q = x[::400]
    least = np.sort(q @ x.T, axis=1)[:, -6]
    for known, share in ((np.full(len(q), -np.inf), 0.05), (least, 0.02)):
        find = topk.search_block(32, np.arange(len(x)), x, pivot, 5)
        got = list(find(np.arange(0, 8000, 400), q, known))
        for i, (ids, scores, *_) in enumerate(got):
            true = q[i] @ x.T
            true[400 * i] = -np.inf
            assert scores.tolist() == np.sort(true)[::-1][:5].astype(int).tolist()
        assert find.evaluated < share * len(q) * len(x)


def test_bounds_of_all_pivots_hold():
    rng = np.random.default_rng(4)
    for scale in (1.0, 1e-8, 1e8):
        x = rng.standard_normal((500, 16)) * scale
        x[100:] = x[rng.integers(0, 100, 400)] + rng.standard_normal((400, 16)) * scale * 1e-7
        for n in (0, 1, 5, 16):
            find = topk.search_block(16, np.arange(500), x, topk.chosen_pivots(x, n), 500, True)
            for i, (ids, _, key, rest) in enumerate(find(np.arange(9), x[:9], np.full(9, -np.inf))):
                missed = np.setdiff1d(np.arange(500), np.append(ids, i))
                assert (x[i] @ x[missed].T).max(initial=-np.inf) <= rest


def test_topk_odd_rows(spark):
    big = 3.0e38
    rows = [(0, [1.0, 2.0], "a"), (50, None, "a"), (100, [1.0, None], "a"), (150, [float("nan"), 1.0], None), (200, [float("inf"), 1.0], None), (1, [1.0, 2.0], None), (1, [1.0, 2.0], None), (None, [9.0, 9.0], None), (2, [1.0, 2.0, 3.0], None), (250, [big, big], None), (3, [], None), (300, [], None), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, block string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("id") % 50 == 0, 2).collect())
    assert got == [(0, 1, 250, 2**63 - 1), (0, 2, 1, 5), (250, 1, 0, 2**63 - 1), (250, 2, 1, 2**63 - 1), (300, 1, 3, 0)]
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0, 2).count() == 0


def test_a_query_id_asks_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [4.0, 0.0]), (9, [1.0, 0.0])] + [(20, [0.0, 9.0])] * 30
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("id") == 0, 3, block_rows=2).collect())
    assert got == [(0, 1, 8, 4), (0, 2, 7, 3), (0, 3, 7, 3)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("id") == 0, 3, block_rows=2).collect())
    assert got == [(0, 1, 9), (0, 2, 7), (0, 3, 7)]


def test_ann_recall_and_scores(spark):
    for n in (600, 5000):
        x = vectors(n, 32, n)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        got = ann.nearest(df, F.col("id") % 100 == 0, 10, block_rows=1500).collect()
        hit = total = 0
        y = x.astype(np.float64)
        for q in range(0, n, 100):
            d = np.sqrt(((y - y[q]) ** 2).sum(1))
            d[q] = np.inf
            true = set(np.argsort(d, kind="stable")[:10].tolist())
            own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 11))
            assert np.allclose([r.score for r in own], [d[r.vec_id] for r in own], rtol=1e-12)
            assert [r.score for r in own] == sorted(r.score for r in own)
            hit, total = hit + len(true & {r.vec_id for r in own}), total + 10
        assert hit / total >= 0.9


def test_ann_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "x"), (100, [0.0, 0.0], "x"), (1, None, "x"), (2, [None, 1.0], None), (3, [1.0, 0.0], None), (4, [1.0, 0.0], None), (4, [1.0, 0.0], None), (200, [float("inf"), 0.0], None), (None, [1.0, 1.0], None), (5, [], None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("id") % 100 == 0, 10).collect())
    assert got == [(0, 1, 3, 0.0), (0, 2, 4, 0.0), (0, 3, 4, 0.0)]
    assert ann.nearest(df.limit(0), F.col("id") % 100 == 0, 10).count() == 0

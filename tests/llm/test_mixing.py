"""Mixing: targets against plain resharing, taken words near targets, reruns agree."""

import math
import random
import re

import pytest

from tidemark.llm.mixing import mix, stage, tilts
from tidemark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        out.update({s: left * weight[s] / total for s in open_})
        over = [s for s in open_ if out[s] > 2 * sizes[s] * (1 + 1e-12)]
        if not over:
            return out
        for s in over:
            out[s] = 2 * sizes[s]
            full.add(s)
            left -= out[s]
        if len(full) == len(order):
            return out


def rows(seed, n, sources):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "\u00a0 x"]) if rng.random() < 0.03 else " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), "en", rng.choice(sources), 0) for i in range(n)]


@pytest.mark.parametrize("sources", [["a", "b", "B", "é", "\U0001f600", "\uffff", None], ["hot"] * 30 + ["x", "y", "z"], ["only"], [None]])
def test_targets_and_rounding(spark, sources):
    own = rows(len(sources), 900, sources)
    df = spark.createDataFrame(own, SCHEMA)
    got = mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df.repartition(7)).collect()))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in own}
    source = {i: s for i, _, _, s, _ in own}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(own)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 12), (s, taken[s], want[s])


def plain_rates(sizes, target, most):
    """Bisection on the tilt of r = min(most, exp(tilt size / mean))."""
    words = sum(sizes)
    if target >= words * most * (1 - 1e-9):
        return [most] * len(sizes)
    mean, lo, hi = words / len(sizes), -1e6, 1e6
    rates = lambda t: [min(most, math.exp(max(-700.0, min(700.0, t * s / mean)))) for s in sizes]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(r * s for r, s in zip(rates(mid), sizes)) > target else (mid, hi)
    return rates(lo)


@pytest.mark.parametrize("seed", [0])
def test_rates_meet_the_conditions_of_the_optimum(spark, seed):
    own = rows(seed, 700, ["a"] * 6 + ["b", "c", "d"] + [None] * 2)
    df = spark.createDataFrame(own + own[:40], SCHEMA)
    by = {}
    for r in mix(df).collect():
        by.setdefault(r.target, []).append(r)
    varied = 0
    for target, of in by.items():
        of = [r for r in of if r["size"]]
        want = plain_rates([r["size"] for r in of], target, 2)
        assert [r.rate for r in of] == pytest.approx(want, rel=1e-6)
        assert sum(r.rate * r["size"] for r in of) == pytest.approx(target, rel=1e-8)
        rates = {r["size"]: r.rate for r in of}
        varied += len(set(rates.values())) > 2
        # the optimum's own condition: the logarithm of a free rate grows in proportion to the size
        free = [math.log(r) / s for s, r in rates.items() if r < 2]
        assert not free or max(free) - min(free) < 1e-6 * max(1e-9, abs(max(free)))
    assert varied


def test_tilts_of_extreme_targets(spark):
    sizes = [1] * 50 + [7] * 20 + [20_000]
    docs = spark.createDataFrame([(s, n, 1) for s in "abcdef" for n in sizes], "source string, size long, n long")
    words = sum(sizes)
    asked = {"a": 1e-3 * words, "b": 0.999 * words, "c": float(words), "d": 1.999 * words, "e": 2.0 * words, "f": 0.0}
    with Scratch(spark) as scratch:
        got = {r.source: r for r in tilts(docs, spark.createDataFrame(list(asked.items()), "source string, target double"), 2, scratch).collect()}
    assert got["e"].tilt is None and got["f"].tilt is None
    for s in "abcd":
        assert sum(min(2.0, math.exp(min(9.0, got[s].tilt * n / got[s].mean))) * n for n in sizes) == pytest.approx(asked[s], rel=1e-8)


def test_many_equal_rows_share_their_copies(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 0)] * 500 + [(2, "a b", "en", "t", 0)] * 3 + [(1, "a b c", "en", "t", 0)], SCHEMA)
    got = mix(df).collect()
    assert len(got) == 504 and all(0 <= r.copies <= 2 for r in got)
    of = [r.copies for r in got if r.source_size == 1500]
    assert max(of) - min(of) <= 1
    assert stage(spark, df, "").groupBy("doc_id", "source").count().count() == 3


def test_stage_multiplies_documents(spark):
    own = rows(5, 200, ["a", "b", "c"])
    df = spark.createDataFrame(own, SCHEMA)
    out = stage(spark, df, "")
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n == {r.doc_id: r.copies for r in mix(df).collect() if r.copies}


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3)], SCHEMA + "").withColumnRenamed("lang", "key")
    got = mix(df).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 2), ("1", 2), ("None", 0)]
    assert sum(r.taken for r in got) == 6
    assert mix(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, "", "en", "s", 0), (2, None, "en", "t", 0)], SCHEMA)
    assert [(r.target, r.taken) for r in mix(none).collect()] == [(0.0, 0), (0.0, 0)]

"""N-gram Jaccard join against brute force over all pairs."""

import random
import re

import pytest

from tidemark.llm.jaccard import banding, near_duplicates, stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    """{row number: (class id, copies, links)}"""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links, copies = [0] * len(rows), [1] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
                if sets[i] == sets[j]:
                    copies[i] += 1
                    copies[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((rows[i][0], least[find(i)], copies[i], links[i]) for i in range(len(rows)))


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 300))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n, 3 * n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


def test_brute_force(spark):
    rows = made(1, 60) + [(900, "one two three"), (901, "One, two THREE!"), (902, ""), (903, "!!!"), (904, "x " * 3000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id, r.copies, r.links) for r in got.collect()) == brute(rows)


def test_large_group_in_several_blocks(spark, monkeypatch):
    import tidemark.llm.jaccard as m

    monkeypatch.setattr(m, "BLOCK", 16)
    rng = random.Random(3)
    base = ["w%d" % i for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "z%d" % rng.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id, r.copies, r.links) for r in got.collect()) == brute(rows)


def test_loosely_alike_texts_form_no_component(spark):
    """A chain in which each text shares some two fifths of its n-grams with the next: bands collide, signatures tell them apart."""
    import tidemark.llm.jaccard as m

    rng = random.Random(5)
    words = ["v%d" % i for i in range(60 * 200)]
    rows = [(i, " ".join(words[60 * i : 60 * i + 140])) for i in range(150)]
    shared = len(grams(rows[0][1]) & grams(rows[1][1])) / len(grams(rows[0][1]) | grams(rows[1][1]))
    assert 0.35 < shared < 0.45
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id and r.links == 0 for r in got)
    # without signatures about every fifth pair of neighbours would be joined
    sets = m.gram_sets([t for _, t in sorted(rows)], 5)
    mult, add = m.stream(2, 120) | m.np.uint64(1), m.stream(3, 120)
    sig = m.np.array([m.signature(g, mult, add) for g in sets]).reshape(150, 24, 5)
    assert sum((sig[i] == sig[i + 1]).all(axis=1).any() for i in range(149)) > 10
    assert (sig[1:] == sig[:-1]).sum(axis=(1, 2)).max() < m.least_agreeing(0.8, 120)


def test_long_texts_make_more_blocks(spark, monkeypatch):
    import tidemark.llm.jaccard as m

    monkeypatch.setattr(m, "GRAMS", 5000)
    rng = random.Random(6)
    base = ["w%d" % i for i in range(3000)]
    rows = []
    for i in range(12):
        w = list(base)
        for _ in range(rng.randint(0, 60)):
            w[rng.randrange(len(w))] = "z%d" % rng.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id, r.copies, r.links) for r in got.collect()) == brute(rows)


def test_signatures_keep_pairs_at_the_threshold():
    from math import comb

    from tidemark.llm.jaccard import MISSED, least_agreeing

    for t, n in ((0.8, 120), (0.5, 128), (1.0, 7)):
        k = least_agreeing(t, n)
        assert sum(comb(n, j) * t**j * (1 - t) ** (n - j) for j in range(k)) <= MISSED
    assert least_agreeing(0.8, 120) > 0.6 * 120


def test_odd_rows(spark):
    text = " ".join("w%d" % i for i in range(40))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, "en", "s", 3), (2, None, None, None, None), (3, "", "", "", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), str(r.class_id), r.copies, r.links) for r in near_duplicates(df).collect())
    assert got == sorted([("1", "None", 3, 2), ("1", "None", 3, 2), ("None", "None", 3, 2), ("2", "2", 1, 0), ("3", "3", 1, 0), ("None", "None", 1, 0)])
    stay = stage(spark, df.withColumn("node", df.doc_id).withColumn("extra", df.lang), "")
    assert stay.columns == df.columns + ["node", "extra"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in stay.collect()))) == sorted(map(str, [(None, text), (2, None), (3, ""), (None, None)]))
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("t,recall", [(0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)])
def test_banding_meets_recall(t, recall):
    bands, rows = banding(t, recall)
    assert 1 - (1 - t**rows) ** bands >= recall and bands * rows <= 128

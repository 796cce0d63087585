"""Held-out accuracy of the learned operators, exact rounds of their parts, odd rows."""

import random
import zlib

import numpy as np

from tidemark.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["schn", "ung", "ei", "ver", "ß"], "cc": ["é", "oi", "eau", "ch", "ç"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_kneser_ney_sums_to_one():
    texts = ["abab abba baab", "abba abba b"]
    codes, n = np.unique(langid.grams(texts)[1], return_counts=True)
    model = langid.Model(codes, n)
    every = np.arange(65536, dtype=np.uint64)
    for context in ("", "a", "ab", "abb", "zzz", " ab"):
        packed = 0
        for c in context[-3:]:
            packed = packed << 16 | (0 if c == " " else ord(c))
        total = np.exp(model.log_prob((np.uint64(packed << 16) | every))).sum()
        assert abs(total - 1) < 1e-6, context


def test_entropies_match_one_by_one():
    rng = random.Random(3)
    texts = [prose(rng, "aa", 50), "", "123", "Ünï CODE  漢字 😀", prose(rng, "bb", 5)] * 3
    models = {}
    for x in SYLLABLES:
        codes, n = np.unique(langid.grams([prose(rng, x, 500)])[1], return_counts=True)
        models[x] = langid.Model(codes, n)
    own = langid.Identifier(models)
    n, h = own.entropies(texts)
    again = own.entropies(texts)[1]  # now from the table
    for i, t in enumerate(texts):
        codes = langid.grams([t])[1]
        assert n[i] == len(codes)
        for j, m in enumerate(own.models):
            want = -m.log_prob(codes).mean() if len(codes) else 0.0
            assert abs(h[i, j] - want) < 1e-4 and abs(again[i, j] - want) < 1e-4


def test_language_id(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x = rng.choice(sorted(SYLLABLES))
        rows.append((i, prose(rng, x, rng.randint(5, 60)), x, "s", 0))
    rows += [(700, None, "aa", None, None), (701, "", None, None, None), (702, "12 !?", "bb", None, None), (None, prose(rng, "cc", 40), "cc", None, None), (5, rows[5][1], rows[5][2], None, None), (703, "zxq wvy " * 2000, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "source as score", "lang as lang_pred")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (700, 701, 702))
    assert by[703].rejected and by[703].lang_pred in SYLLABLES
    assert {r.doc_id: r.lang_pred for r in langid.identify(df, reject=True).collect()}[703] == "und"
    assert langid.identify(df.limit(0)).count() == 0
    nothing = langid.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_gradient_of_attention():
    rng = np.random.default_rng(1)
    model = quality.Attention(hidden=5, gate=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, first = rng.random((9, quality.FEATURES)), np.array([0, 2, 3, 9])
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        z = model.forward(x, first)[0]
        return float((np.log1p(np.exp(z)) - label * z).sum())

    z, state = model.forward(x, first)
    got = model.gradient(state, 1 / (1 + np.exp(-z)) - label)
    for k, v in model.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 5)]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-6 - got[k][at]) < 1e-4, (k, at)


def test_passages_cover_all_bytes():
    texts = ["", "a", "ab" * 700, "é" * 401]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    first, x = quality.passages(offsets, np.frombuffer(b"".join(raw), np.uint8))
    assert np.diff(first).tolist() == [max(1, -(-len(r) // quality.PASSAGE)) for r in raw]
    assert np.allclose((x[1:, : quality.CLASSES] ** 2).sum(axis=1), 1, atol=1e-5) and not x[0].any()


def junk(rng, t):
    return " ".join(w.upper() + "!!" if rng.random() < 0.8 else w for w in t.split())


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        t, good = prose(rng, "aa", rng.randint(20, 300)), rng.random() < 0.7
        rows.append((i, t if good else t[: len(t) // 2] + " " + junk(rng, t), "en", "s", 0))
        if i % 4:
            labels.append((i, int(good), 0))
    truth = {i: q for i, q, _ in labels}
    rows += [(None, "x", None, None, None), (2000, None, None, None, None), (2001, "", None, None, None), (7, rows[7][1], None, None, None), (2002, "word " * 60_000, None, None, None)]
    labels += [(None, 1, 0), (3, None, None), (4000, 1, 0), (2, 5, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "n_chars as quality", "lang as score")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, lab).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert quality.classify(docs.limit(0), lab).count() == 0
    assert {r.score for r in quality.classify(docs, lab.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs, lab.where("quality = 1")).collect()} == {1.0}


def test_sampled_passages_are_those_of_the_whole():
    raw = [t.encode() for t in ("", "abc def def " * 900, "é" * 401, "x")]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    first, x = quality.passages(offsets, data)
    counts, at, own = quality.sampled(offsets, data, 10**6)
    assert counts.tolist() == np.diff(first).tolist() and np.array_equal(quality.passages(at, own)[1], x)
    counts, at, own = quality.sampled(offsets, data, 5)
    assert counts.tolist() == [1, 5, 3, 1] and len(at) == 11
    whole, some = {r.tobytes() for r in x[first[1] : first[2]]}, quality.passages(at, own)[1][1:6]
    assert all(r.tobytes() in whole for r in some)


def test_level():
    assert quality.level([3, 1, 2], 6) == 3 and quality.level([10, 1, 10], 9) == 4 and quality.level([5, 5], 1) == 1 and quality.level([], 4) == 1
    rng = random.Random(1)
    for _ in range(50):
        sizes, budget = [rng.randint(1, 40) for _ in range(9)], rng.randint(9, 400)
        got = quality.level(sizes, budget)
        assert sum(min(s, got) for s in sizes) <= budget and (got >= max(sizes) or sum(min(s, got + 1) for s in sizes) > budget)


def test_quality_learns_from_long_documents(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(120):
        t, good = prose(rng, "aa", 5500), i % 2
        rows.append((i, t if good else t[: len(t) // 2] + " " + junk(rng, t[len(t) // 2 :]), "en", "s", 0))
        labels.append((i, good, 0))
    assert min(len(r[1].encode()) for r in rows) > 64 * quality.PASSAGE
    labels += [(1000 + i, 1, 0) for i in range(5000)]  # without a document: they take no place in the sample
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, lab).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.9
    assert isinstance(quality.learn(docs, lab, most_docs=40), quality.Attention)  # 20 documents of each label, none seen whole


def test_long_grams_are_grams():
    text = " -12 Ab, c  d😀漢字 éa!! zz  " * 7
    for t in (text, "", "12", "a"):
        for most in (1, 2, 5, 1000):
            got = np.concatenate([np.zeros(0, np.uint64), *langid.long_grams(t, most)])
            assert np.array_equal(got, langid.grams([t])[1])


def test_languages_rare_many_or_long(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng, "aa", 30), "aa", "s", 0) for i in range(40)]
    rows += [(100 + i, prose(rng, "bb", 30_000), "bb", "s", 0) for i in range(4)]  # all over 200,000 bytes
    assert all(len(r[1].encode()) > 200_000 for r in rows[40:])
    rows += [(1000 + i, "漢字" + chr(0x4E00 + i) * 20, f"x{i}", "s", 0) for i in range(450) if zlib.crc32(str(1000 + i).encode()) % 4 != 2]  # one each
    few = len({r[2] for r in rows})
    rows += [(3000 + i, prose(rng, "cc", 20), f"y{i}", "s", 0) for i in range(120) if zlib.crc32(str(3000 + i).encode()) % 4 != 2]
    assert few > 300 and len({r[2] for r in rows}) > 400
    model = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert set(model.langs) == {r[2] for r in rows}
    assert model.predict([prose(rng, "bb", 40), prose(rng, "aa", 40)])[0] == ["bb", "aa"]

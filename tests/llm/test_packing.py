"""Packing: ids equal the tokenizer's, places are gapless, bins are few."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm.packing import Places, WordIds, _tokenizer, pack, plan


def texts():
    rng = random.Random(1)
    words = ["the", "The", "naïve", "don't", "ÉTÉ,", "x%%%", "A###.", "ΑΣ", "漢字", "12a", "<|endoftext|>", "a\x1cb", "e\u0301a", "--", "öffnen.", "b]}", "", "\u00a0z", "it's", "😀"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))).replace("b]}", rng.choice(["b]}", "\n", "\t", "\r\n"])) for _ in range(200)]


def test_ids_equal_the_whole_tokenizer():
    for short in (True, False):
        ids, own = WordIds(_tokenizer(None)), texts()
        assert ids.short
        ids.short = short
        for t, got in zip(own, ids.encode(own), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [10, 60, 2048])
def test_plan_keeps_items_and_rivals_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        items = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, max(1, capacity // 4)) for _ in range(rng.randint(0, 300))]
        counts = {s: items.count(s) for s in set(items)}
        bins = plan(counts, capacity)
        seen = {}
        for content, n in bins:
            assert n > 0 and sum(content) <= capacity and sum(3 * s > capacity for s in content) <= 2
            for s in content:
                seen[s] = seen.get(s, 0) + n
        assert seen == counts
        free = []
        for s in sorted(items, reverse=True):
            fit = [i for i, gap in enumerate(free) if gap >= s]
            if fit:
                free[min(fit, key=lambda i: free[i])] -= s
            else:
                free.append(capacity - s)
        assert sum(n for _, n in bins) <= len(free) + 1
        places, used = Places(bins), {}
        for s in counts:
            for q, at in zip(*places.of(s, np.arange(counts[s])), strict=True):
                used.setdefault(int(q), []).append((int(at), s))
        for own in used.values():
            at = 0
            for a, s in sorted(own):
                assert a == at
                at += s


def test_pack_whole(spark):
    rng = random.Random(3)
    own = texts() + [" ".join(rng.choices(["alpha", "beta"], k=5000)), None, ""]
    rows = [(i, t, "x") for i, t in enumerate(own)] + [(0, own[0], "x"), (None, "null id", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack(df, _tokenizer(None), capacity=64).collect()
    tokenizer = WordIds(_tokenizer(None)).tokenizer
    want = []
    for d, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= 64
    assert len(sequences) <= -(-sum(w[3] for w in want) // 64) * 1.05 + 1
    assert pack(df.limit(0), _tokenizer(None)).count() == 0

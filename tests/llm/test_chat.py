"""Preference formatting against a plain rendering."""

import random

from tidemark.llm.chat import formatted, preference_pairs, swapped_replies

SCHEMA = "pair_id long, chosen boolean, conv_id long, turn long, role string, text string"


def safe(x):
    out = ""
    x = x or ""
    for i, c in enumerate(x):
        out += c
        if c == "<" and x[i + 1 : i + 2] in ("|", "\\"):
            out += "\\"
    return out


def plain(rows):
    sides = {}
    for p, c, v, *t in rows:
        if p is not None and c is not None:
            sides.setdefault(p, ([], []))[0 if c else 1].append(tuple(t))
    out = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    for p, both in sides.items():
        a, b = (sorted(x, key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or ""))) for x in both)
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        render = lambda ts: "".join(f"<|{safe(r)}|>\n{safe(x)}<|end|>\n" for _, r, x in ts)
        out[p] = (n, render(a[:n]), render(a[n:]) if a else None, render(b[n:]) if b else None, a[n:], b[n:])
    return out


def masked(turns):
    """Each part of a completion, and whether it is learned."""
    return [x for _, r, t in turns for x in ((f"<|{safe(r)}|>\n", False), (safe(t) + "<|end|>", r == "assistant"), ("\n", False))]


def test_against_plain(spark):
    rng = random.Random(1)
    rows = []
    for p in range(60):
        shared = [(t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "<|end|> a <\\| b", "", None, "ünï😀"])) for t in range(rng.randint(0, 4))]
        for chosen in (True, False):
            if rng.random() < 0.9:
                for t, r, x in shared + [(10 + k, rng.choice(["user", "assistant"]), f"{rng.random()}") for k in range(rng.randint(0, 3))]:
                    rows += [(p, chosen, 2 * p + (not chosen), t, r, x)] * rng.choice([1, 1, 1, 2])
    rows += [(None, True, 1, 1, "user", "x"), (70, None, 1, 1, "user", "x"), (71, True, 9, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", n string")
    got = {r.pair_id: r for r in preference_pairs(df).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for p, w in want.items():
        r = got[p]
        assert (r.common_turns, r.prompt, r.chosen, r.rejected) == w[:4]
        for body, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert (body is None) == (mask is None)
            if body is not None:
                assert sum(m.length for m in mask) == len(body)
                at = 0
                parts = []
                for m in mask:
                    parts.append((body[at : at + m.length], m.learned))
                    at += m.length
                assert parts == masked(w[4] if body is r.chosen else w[5])
    assert preference_pairs(df.limit(0)).count() == 0


def test_rendering_is_undone_uniquely():
    seen = {}
    rng = random.Random(2)
    for _ in range(20_000):
        x = "".join(rng.choices("<|\\a", k=rng.randint(0, 7)))
        assert seen.setdefault(safe(x), x) == x and "<|" not in safe(x)


def test_swapped_replies(spark):
    u, a, s = "user", "assistant", "system"
    big = 2**60 + 2
    rows = [(0, 0, s, "S"), (0, 1, u, "hi"), (0, 2, a, "one"), (0, 3, u, "more"), (0, 4, a, "two"), (0, 5, u, "bye")]
    rows += [(1, 0, u, "ask"), (1, 1, a, "other"), (2, 0, u, "alone"), (2, 1, a, None), (4, 0, u, "none"), (5, 0, a, "only"), (None, 0, a, "x")]
    rows += [(big, 0, u, "p"), (big, 1, a, "q"), (big + 1, 0, u, "r"), (big + 1, 1, a, "q"), (-1, 0, a, "m"), (-2, 0, u, "n"), (-2, 1, a, "m")]
    got = {r.pair_id: r for r in formatted(swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got.keys() == {0, 1, 2, 5, big, big + 1, -1, -2}
    r = got[0]
    assert (r.chosen_id, r.rejected_id, r.common_turns) == (0, 1, 4)
    assert r.prompt == "<|system|>\nS<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\none<|end|>\n<|user|>\nmore<|end|>\n"
    assert (r.chosen, r.rejected) == ("<|assistant|>\ntwo<|end|>\n", "<|assistant|>\nother<|end|>\n")
    assert [(m.length, m.learned) for m in r.rejected_mask] == [(14, False), (12, True), (1, False)]
    assert (got[1].common_turns, got[1].rejected) == (1, "<|assistant|>\ntwo<|end|>\n")
    for lone in (2, 5):
        assert got[lone].rejected is None and got[lone].rejected_id is None and got[lone].prompt == ""
    assert got[2].chosen == "<|user|>\nalone<|end|>\n<|assistant|>\n<|end|>\n"
    assert (got[big].rejected_id, got[big].common_turns, got[big].chosen, got[big].rejected) == (big + 1, 2, "", "")
    assert (got[-2].rejected_id, got[-2].common_turns, got[-1].common_turns) == (-1, 2, 1)

"""Substring dedup: planted passages go, other text stays, cuts are those of a plain loop."""

import random

import numpy as np

from tidemark.llm.substring_dedup import _GEAR, LEAST, MOST, cuts, substring_dedup


def plain_cuts(raw: bytes) -> list[int]:
    out, at, h = [], 0, 0
    for i, byte in enumerate(raw):
        h = ((h << 1) + int(_GEAR[byte])) & 0xFFFFFFFF
        # the operator's hash covers 8 bytes: of the bits looked at, earlier bytes have left
        ones = (h >> 4) & 15 == 15
        end = i + 1
        if (ones and end - at >= LEAST) or end - at == MOST or end == len(raw):
            out.append(end)
            at = end
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(n))


def test_cuts_match_a_plain_loop():
    rng = random.Random(5)
    for n in (0, 1, 5, 100, 3000):
        raw = words(rng, n).encode() if n else b""
        assert cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] == plain_cuts(raw)


def test_cuts_never_split_a_character():
    rng = random.Random(6)
    text = "".join(rng.choice("aéü漢😀 ") for _ in range(5000))
    raw = text.encode()
    ends = cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert ends[-1] == len(raw)
    at = 0
    for e in ends:
        raw[at:e].decode()
        at = e


def test_planted_passages_go_and_clean_text_stays(spark):
    rng = random.Random(7)
    passages = [words(rng, rng.randint(51, 60)) for _ in range(60)]
    rows, where = [], {}
    for i in range(300):
        body = [words(rng, rng.randint(40, 120)) for _ in range(2)]
        if i < 180:
            p = i % 60
            where.setdefault(p, []).append(i)
            rows.append((i, f"{body[0]} {passages[p]} {body[1]}"))
        else:
            rows.append((i, " ".join(body)))
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(180, 300):
        assert out[i].text == rows[i][1] and out[i].removed_chars == 0
    left = 0
    for p, docs in where.items():
        assert out[docs[0]].text == rows[docs[0]][1]
        for d in docs[1:]:
            left += passages[p] in out[d].text
            assert set(out[d].text.split()) <= set(rows[d][1].split())
    assert left == 0
    gone = sum(out[d].removed_chars for p, docs in where.items() for d in docs[1:])
    assert gone > 0.75 * sum(len(passages[p]) * (len(docs) - 1) for p, docs in where.items())


def test_odd_rows(spark):
    rng = random.Random(8)
    text = words(rng, 200)
    line = words(rng, 60)
    rows = [(5, text, "a"), (5, text, "b"), (7, text, "c"), (8, None, None), (9, "", None), (None, text, None), (None, None, None), (11, f"{line}\n{line}\n{line}", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").selectExpr("*", "digest as removed_chars", "digest as oid")
    out = substring_dedup(df).collect()
    assert len(out) == len(rows)
    by = lambda d: [r for r in out if r.doc_id == d]
    with_text = [r for r in out if r.text is not None and r.text == text]
    assert len(by(5)) == 2 and by(5)[0].text == by(5)[1].text and {r.digest for r in by(5)} == {"a", "b"}
    assert len(with_text) in (1, 2)  # rows of one doc_id, or the row without id, keep the text
    assert by(8)[0].text is None and by(9)[0].text == ""
    assert by(11)[0].removed_spans >= 1 and by(11)[0].text.startswith(line)
    assert substring_dedup(df.limit(0)).count() == 0


def plain_dedup(rows: list[tuple[int, str]], least: int) -> dict[int, str]:
    """Chunks as texts in dictionaries, over all documents in the order of their ids."""
    first, chunks = {}, {}
    for i, text in sorted(rows):
        raw, at, own = text.encode(), 0, []
        for end in plain_cuts(raw):
            own.append((at, end, raw[at:end]))
            first.setdefault(raw[at:end], i)
            at = end
        chunks[i] = own
    out = {}
    for i, text in rows:
        raw, seen, gone = text.encode(), set(), [False] * len(text.encode())
        for a, b, chunk in chunks[i]:
            if first[chunk] < i or chunk in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(chunk)
        kept, a = [], 0
        while a < len(raw):
            b = a
            while b < len(raw) and gone[b] == gone[a]:
                b += 1
            piece = raw[a:b].decode()
            if gone[a]:
                # words that the run cuts at either end stay
                head = 0 if a == 0 or raw[a - 1 : a].isspace() else next((k for k, c in enumerate(piece, 1) if c.isspace()), len(piece))
                tail = len(piece) if b == len(raw) or raw[b : b + 1].isspace() else next((k for k in range(len(piece), head, -1) if piece[k - 1].isspace()), head)
                middle = piece[head:tail]
                piece = piece if len(middle.split()) < least else piece[:head] + piece[tail:]
            kept.append(piece)
            a = b
        out[i] = "".join(kept)
    return out


def test_result_is_that_of_a_plain_walk(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        shared = [words(rng, rng.randint(5, 80)) for _ in range(12)]
        rows = []
        for i in range(60):
            parts = [rng.choice(shared) if rng.random() < 0.5 else words(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
            rows.append((i * 7, rng.choice([" ", "\n", ""]).join(parts)))
        rows += [(1000, rows[3][1]), (1001, rows[3][1][5:])]
        got = {r.doc_id: r.text for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
        assert got == plain_dedup(rows, 20)

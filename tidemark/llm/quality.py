"""Quality classifier: gated attention over the passages of a document, learned from document labels only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, mixed, slices, utf8

#: Bytes of a passage; a document is cut into as many nearly even passages as its length asks for.
PASSAGE = 400
#: Features of a passage: shares of 64 character classes, of class trigrams hashed to 192 buckets, and of words that equal
#: the word before, and how full the passage is.
CLASSES, BUCKETS = 64, 192
FEATURES = CLASSES + BUCKETS + 2


def _classes() -> np.ndarray:
    """Lower-case letters and ASCII punctuation stay apart; capitals, digits, controls and bytes beyond ASCII are a class each."""
    out = np.zeros(256, np.int64)
    out[97:123] = np.arange(1, 27)
    out[65:91] = 27
    out[48:58] = 28
    out[ord(" ")], out[ord("\n")] = 29, 30
    punctuation = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[punctuation] = np.arange(31, 31 + len(punctuation))
    out[128:] = 63
    return out


_CLASS = _classes()
_BUCKET = (mixed(np.arange(64**3, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64) + CLASSES


_POWERS = mixed(np.arange(256, dtype=np.uint64)) | np.uint64(1)


def _repeats(data: np.ndarray, where: np.ndarray, total: int) -> np.ndarray:
    """The share of each passage's words that equal the word before them in the passage."""
    space = (data == 32) | (data == 10)
    start = ~space
    start[1:] &= space[:-1] | (where[1:] != where[:-1])
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(total, np.float32)
    place = np.zeros(len(data), np.int64)
    place[at[0] :] = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    value = np.where(space, np.uint64(0), _POWERS[place & 255] * (data.astype(np.uint64) + np.uint64(1)))
    word, own = np.add.reduceat(value, at), where[at]
    same = np.zeros(len(at), bool)
    same[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    return (np.bincount(own[same], minlength=total) / np.maximum(1, np.bincount(own, minlength=total))).astype(np.float32)


def passages(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's passages begin, encodings of all passages): square roots of the shares of
    characters and trigrams, the share of repeated words, and the length against a full passage."""
    length = np.diff(offsets)
    per = np.maximum(1, -(-length // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], length)
    where = first[row] + at * per[row] // np.maximum(1, length[row])
    kind = _CLASS[data]
    out = np.bincount(where * FEATURES + kind, minlength=total * FEATURES).astype(np.float32).reshape(total, FEATURES)
    if len(data) > 2:
        same = where[2:] == where[:-2]
        tri = _BUCKET[(kind[:-2] << 12 | kind[1:-1] << 6 | kind[2:])[same]]
        out += np.bincount(where[2:][same] * FEATURES + tri, minlength=total * FEATURES).astype(np.float32).reshape(total, FEATURES)
    filled = out[:, :CLASSES].sum(axis=1, keepdims=True)
    out = np.sqrt(out / np.maximum(1, filled))
    if len(data):
        out[:, -2] = _repeats(data, where, total)
    out[:, -1:] = np.minimum(1, filled / PASSAGE)
    return first, out


class Attention:
    """h = tanh(E x + e); a passage weighs softmax(w . (tanh(V h) * sigmoid(U h))); the score is sigmoid(c . sum(weight h) + b)."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 9):
        rng = np.random.default_rng(seed)
        shape = {"E": (FEATURES, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "b": (1,)}
        self.p = {k: (rng.standard_normal(s) / np.sqrt(s[0]) if len(s) == 2 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Logits of the documents whose passages begin at ``first`` (its last element is the end)."""
        p, start = self.p, first[:-1]
        doc = np.repeat(np.arange(len(start)), np.diff(first))
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, start)[doc])
        a /= np.add.reduceat(a, start)[doc]
        z = np.add.reduceat(a[:, None] * h, start)
        return z @ p["c"] + p["b"][0], (x, start, doc, h, t, s, a, z)

    def gradient(self, state, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, start, doc, h, t, s, a, z = state
        g = {"c": z.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_z = (d_logit[:, None] * p["c"])[doc]
        d_a = (d_z * h).sum(axis=1)
        d_a = a * (d_a - np.add.reduceat(a * d_a, start)[doc])
        g["w"] = (t * s).T @ d_a
        d_t, d_s = d_a[:, None] * p["w"] * s * (1 - t * t), d_a[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ d_t, h.T @ d_s
        d_h = (a[:, None] * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        g["E"], g["e"] = x.T @ d_h, d_h.sum(axis=0)
        return g

    def fit(self, docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Attention:
        """Adam on the weighted log loss of the documents."""
        rng, step = np.random.default_rng(seed), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                first = np.concatenate([[0], np.cumsum([len(docs[k]) for k in own])])
                logit, state = self.forward(np.concatenate([docs[k] for k in own], dtype=np.float32), first)
                d = ((1 / (1 + np.exp(-logit)) - label[own]) * weight[own] / len(own)).astype(np.float32)
                step += 1
                for k, g in self.gradient(state, d).items():
                    g = g + decay * self.p[k] * (self.p[k].ndim == 2)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= rate * 0.85**epoch * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in slices(offsets, 1 << 20):
            first, x = passages(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
            out.append(1 / (1 + np.exp(-np.clip(self.forward(x, first)[0].astype(np.float64), -40, 40))))
        return np.concatenate(out)


def sampled(offsets: np.ndarray, data: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, offsets, bytes) of the texts' passages, each a text of its own with the encoding it has in the whole; of a
    text with more than ``most``, so many drawn over its whole length by a hash."""
    counts, begins, ends = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, length in zip(offsets[:-1].tolist(), np.diff(offsets).tolist(), strict=True):
        per = max(1, -(-length // PASSAGE))
        own = np.arange(per)
        if per > most:
            own = np.sort(np.argsort(mixed(mixed(own.astype(np.uint64)) ^ np.uint64(length)), kind="stable")[:most])
        counts.append(len(own))
        begins.append(start - -own * length // per)
        ends.append(start - -(own + 1) * length // per)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    out = np.concatenate([[0], np.cumsum(end - begin)])
    return np.array(counts, np.int64), out, data[np.repeat(begin - out[:-1], end - begin) + np.arange(out[-1])]


def level(sizes: list[int], budget: int) -> int:
    """The largest bound, at least 1, that keeps the sum of min(size, bound) within the budget."""
    left = budget
    for i, size in enumerate(ordered := sorted(sizes)):
        if size * (len(ordered) - i) > left:
            return max(1, left // (len(ordered) - i))
        left -= size
    return max(1, *sizes, 1)


def learn(docs: DataFrame, labels: DataFrame, most_docs: int = 4000, most_passages: int = 64, held_mod: int = 3, held: int = 1) -> Attention | float:
    """A model from at most ``most_docs`` labelled documents, or the share of label 1 where the labels have one value only
    (0.5 without labels).

    Documents whose crc32(doc_id as text) modulo ``held_mod`` is ``held`` are not learned from, nor are rows without
    doc_id or with another label than 0 or 1, nor labels without a document; a document with several labels has the larger.
    Half the sample comes from each label, chosen by a hash of doc_id and weighted back to the labels' shares. Documents
    of any length are learned from. The driver gets at most ``most_docs * most_passages`` passages: all of them where that
    holds the sample; else the longest documents alike give as many as it holds, drawn over their whole length by a hash.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", held_mod) != held)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs // 2)
        chosen = part if chosen is None else chosen.union(part)
    # at most most_docs rows of two numbers
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, quality int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    lengths = rows.groupBy("doc_id").agg(F.min_by(F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text")).alias("n")).collect()
    most = level([max(1, -(-r["n"] // PASSAGE)) for r in lengths], most_docs * most_passages)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(3))
            for i in range(batch.num_rows):
                _, at, own = sampled(offsets[i : i + 2], data, most)
                x = [passages(at[a : b + 1] - at[a], own[at[a] : at[b]])[1].astype(np.float16).tobytes() for a, b in slices(at, 1 << 20)]
                part = batch.slice(i, 1)
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array([b"".join(x)], pa.binary())], names=["doc_id", "quality", "hash", "x"])

    made = rows.select("doc_id", "quality", F.xxhash64("text").alias("hash"), "text").mapInArrow(encode, "doc_id long, quality int, hash long, x binary")
    got = sorted(made.groupBy("doc_id", "quality").agg(F.min_by("x", "hash").alias("x")).collect())
    label = np.array([r["quality"] for r in got], np.float32)
    have = {q: float((label == q).sum()) for q in (0, 1)}
    weight = np.array([counts[int(q)] / total * len(label) / have[int(q)] for q in label], np.float32)
    return Attention().fit([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in got], label, weight)


def scorer(spark, model: Attention | float):
    """A column function: text -> score from 0 to 1."""
    if not isinstance(model, Attention):
        return lambda text: F.lit(float(model))
    shared = spark.sparkContext.broadcast(model)

    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(*utf8(text)))

    made = F.arrow_udf(score, "double")
    return lambda text: made(F.coalesce(text, F.lit("")))


def held_out(doc_id: str, mod: int, held: int) -> Column:
    return F.coalesce(crc32_mod(doc_id, mod) == held, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score reads the whole text and nothing else. Null and empty texts have one empty passage and get its score.
    Repeated rows get equal scores; a null doc_id is not held out and not learned from. Other columns take no part.
    """
    score = scorer(docs.sparkSession, learn(docs, labels))
    scored = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    score = scorer(spark, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.select(F.struct(*docs.columns).alias("doc"), score(F.col("text")).alias("score")).where(F.col("score") >= 0.5).select("doc.*")

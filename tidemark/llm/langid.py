"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, mixed

ORDER = 4
UNKNOWN = "und"
#: Probability that any one unseen character shares.
_FLOOR = 1 / 65536
#: Slots of a worker's table of n-grams met before.
_SLOTS = 20

_char: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> 16-bit code of its lower case, 0 for what is no letter; code points over 16 bits are folded."""
    global _char
    if _char is None:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _char = ((table & 0xFFFF) ^ (table >> 16) * 40503 & 0xFFFF).astype(np.uint16)
        _char[(table != 0) & (_char == 0)] = 1
        _char[table == 0] = 0
    return _char


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, codes): the packed 4-gram that ends at each character of each text, with runs of non-letters as one space
    and three spaces before the text. ends[i] is where the codes of text i end."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(r) // 4 for r in raw])
    char = letters()[np.frombuffer(b"".join(raw), "<u4")].astype(np.uint64)
    start = np.ones(len(char), bool)
    start[1:] = row[1:] != row[:-1]
    before = np.zeros(len(char), bool)
    before[1:] = (char[:-1] == 0) & ~start[1:]
    keep = (char != 0) | ~(before | start)
    char, row = char[keep], row[keep]
    first = np.searchsorted(row, np.arange(len(texts)))
    code, place = char.copy(), np.arange(len(char)) - first[row] if len(char) else np.zeros(0, np.int64)
    for k in range(1, ORDER):
        prior = np.zeros(len(char), np.uint64)
        prior[k:] = char[:-k]
        prior[place < k] = 0
        code |= prior << np.uint64(16 * k)
    return np.searchsorted(row, np.arange(len(texts)), side="right"), code


def long_grams(text: str, most: int = 1_000_000) -> Iterator[np.ndarray]:
    """The codes that ``grams`` has for one text, made from ``most`` characters at a time."""
    last = np.zeros(ORDER - 1, np.uint64)
    for a in range(0, len(text), most):
        char = letters()[np.frombuffer(text[a : a + most].encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint64)
        char = np.append(last, char[(char != 0) | (np.append(last[-1], char[:-1]) != 0)])
        code = char[ORDER - 1 :].copy()
        for k in range(1, ORDER):
            code |= char[ORDER - 1 - k : len(char) - k] << np.uint64(16 * k)
        last = char[1 - ORDER :]
        yield code


class Model:
    """Kneser-Ney probabilities of one language, interpolated down to single characters, as sorted arrays of hashes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.orders = []
        level = [(codes, counts.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):  # lower orders count the different characters before
            level.append(tuple(x.astype(t) for x, t in zip(np.unique(level[-1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True), (np.uint64, np.float64), strict=True)))
        level.reverse()
        single, c = level[0]
        d = self._discount(c)
        prob = np.full(65536, d * len(c) / max(c.sum(), 1) * _FLOOR if len(c) else _FLOOR)
        if len(c):
            prob[single.astype(np.int64)] += np.maximum(c - d, 0) / c.sum()
        self.single = np.log(prob)
        for n in range(2, ORDER + 1):
            codes, c = level[n - 1]
            d = self._discount(c)
            context, at, kinds = np.unique(codes >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(at, c, len(context))
            weight = d * kinds / total if len(context) else np.zeros(0)
            lower = np.exp(self.log_prob(codes & np.uint64((1 << 16 * (n - 1)) - 1), n - 1))
            value = np.log(np.maximum(c - d, 0) / total[at] + weight[at] * lower) if len(codes) else np.zeros(0)
            self.orders.append((*self._sorted(codes, value), *self._sorted(context, np.log(weight))))

    @staticmethod
    def _discount(c: np.ndarray) -> float:
        one, two = float((c == 1).sum()), float((c == 2).sum())
        return min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashed = mixed(keys.astype(np.uint64))
        order = np.argsort(hashed)
        return hashed[order], values[order]

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(keys):
            return np.broadcast_to(other, wanted.shape).copy()
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def log_prob(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log P(last character | those before) of packed n-grams."""
        out = self.single[(codes & np.uint64(0xFFFF)).astype(np.int64)]
        for n in range(2, order + 1):
            own = codes & np.uint64((1 << 16 * n) - 1) if n < 4 else codes
            keys, values, contexts, weights = self.orders[n - 2]
            out = self._found(keys, values, mixed(own), self._found(contexts, weights, mixed(own >> np.uint64(16)), 0.0) + out)
        return out


class Identifier:
    """Models by language, and the calibration of scores and of rejection."""

    def __init__(self, models: dict[str, Model]):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.scale = 1.0
        self.limit = np.full(len(self.langs), np.inf)
        self.keys = self.rows = None

    def __getstate__(self):
        return self.__dict__ | {"keys": None, "rows": None}

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy of each language in nats a character) of texts."""
        ends, codes = grams(texts)
        if self.keys is None:
            # fewer slots for many languages: 64 MB of values
            self.slots = min(_SLOTS, max(8, 24 - (len(self.models) - 1).bit_length()))
            self.keys, self.rows = np.zeros(1 << self.slots, np.uint64), np.zeros((1 << self.slots, len(self.models)), np.float32)
            self.rows[0] = [m.log_prob(np.zeros(1, np.uint64))[0] for m in self.models]
        n = np.diff(ends, prepend=0)
        total = np.zeros((len(texts), len(self.models)))
        row, step = np.repeat(np.arange(len(texts)), n), max(1024, (1 << 24) // len(self.models))
        for a in range(0, len(codes), step):
            own = row[a : a + step]
            start = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[start]] += np.add.reduceat(self._values(codes[a : a + step]), start, axis=0, dtype=np.float64)
        return n, -total / np.maximum(n, 1)[:, None]

    def _values(self, codes: np.ndarray) -> np.ndarray:
        slot = (mixed(codes) >> np.uint64(64 - self.slots)).astype(np.int64)
        slot[codes == 0] = 0
        value = self.rows[slot]
        miss = np.flatnonzero(self.keys[slot] != codes)
        if len(miss):
            new, at = np.unique(codes[miss], return_inverse=True)
            got = np.stack([m.log_prob(new).astype(np.float32) for m in self.models], axis=1)
            value[miss] = got[at]
            put = slot[miss]
            use = put != 0
            self.keys[put[use]], self.rows[put[use]] = codes[miss][use], value[miss][use]
        return value

    def calibrate(self, texts: list[str], langs: list[str], tail: float = 0.001) -> None:
        """Fits the scale of softmax(-scale * sqrt(characters) * entropy) to texts kept out of the models, by golden
        section on their log loss, and sets each language's entropy that but a ``tail`` of its texts exceeds (with half
        a nat to spare) as the limit beyond which a text is rejected."""
        got = [self.entropies(texts[a:b]) for a, b in _parts(texts, 300_000)]
        if not got:
            return
        n, h = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        known = np.array([x in self.langs for x in langs]) & (n > 0)
        if not known.any():
            return
        n, h = n[known], h[known]
        truth = np.array([self.langs.index(x) for x, k in zip(langs, known, strict=True) if k])
        z = -np.sqrt(n)[:, None] * (h - h.min(axis=1, keepdims=True))

        def loss(log_scale: float) -> float:
            s = z * np.exp(log_scale)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean()) + 1e-3 * log_scale**2

        a, b, g = -4.0, 5.0, (5**0.5 - 1) / 2
        for _ in range(40):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        self.scale = float(np.exp((a + b) / 2))
        for i in range(len(self.langs)):
            own = h[(truth == i) & (n >= 20), i]
            if len(own):
                self.limit[i] = np.quantile(own, 1 - tail) + 0.5

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected); without a letter ``und``, 0 and True. The language has the least entropy, ties to the first by name."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        n, h = self.entropies(texts)
        best = h.argmin(axis=1)
        z = -self.scale * np.sqrt(n)[:, None] * (h - h.min(axis=1, keepdims=True))
        none = n == 0
        rejected = none | (h[np.arange(len(texts)), best] > self.limit[best])
        return [UNKNOWN if x else self.langs[i] for i, x in zip(best, none, strict=True)], np.where(none, 0.0, 1 / np.exp(z).sum(axis=1)), rejected


def _parts(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def learn(docs: DataFrame, per_language: int = 2000, held_mod: int = 4, held: int = 2, most_calibrating: int = 200_000) -> Identifier:
    """Models of all languages, each from at most ``per_language`` whole documents chosen by a hash of doc_id; a fifth of
    them serves calibration only, but never a language's first, so each language has a model. Of a calibration text over
    ``most_calibrating`` bytes a quarter as many characters serve, from a place drawn by a hash: these texts, and counts of
    4-grams, are what the driver gets, and grow with the number of languages. Learned from are rows with doc_id, lang and a
    letter in the text whose crc32(doc_id as text) modulo ``held_mod`` is not ``held``.
    """
    fit = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & (crc32_mod("doc_id", held_mod) != held)).select("doc_id", "lang", "text")
    chance = F.xxhash64(F.lit(17), "doc_id")
    # of each language about four times the rows wanted are ranked, however common it is
    share = F.lit(4.0 * per_language) / F.col("count")
    likely = fit.join(F.broadcast(fit.groupBy("lang").count()), "lang").where((share >= 1) | (chance < (share * 2.0**64 - 2.0**63).cast("long")))
    ranked = likely.select("lang", "doc_id").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(chance, "doc_id"))).where(F.col("k") <= per_language)
    limits = ranked.groupBy("lang").agg(F.min(chance).alias("first"), F.max(chance).alias("last")).collect()
    if not limits:
        return Identifier({})
    limits = docs.sparkSession.createDataFrame(limits, "lang string, first long, last long")
    chosen = fit.join(F.broadcast(limits), "lang").where(chance <= F.col("last")).withColumn("calibrates", (F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(5)) == 0) & (chance != F.col("first")))
    chosen = chosen.groupBy("lang", "doc_id", "calibrates").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lang = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist(), object)
            for a, b in _parts(texts):
                for x in sorted(set(lang[a:b])):
                    for part in long_grams(texts[a]) if b == a + 1 else [grams([t for t, k in zip(texts[a:b], lang[a:b], strict=True) if k == x])[1]]:
                        codes, n = np.unique(part, return_counts=True)
                        yield pa.record_batch([pa.array([x] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counts = chosen.where(~F.col("calibrates")).select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    named = counts.column(0).combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    lang, code, n = named.indices.to_numpy(), counts.column(1).to_numpy().view(np.uint64), counts.column(2).to_numpy()
    order = np.lexsort((code, lang))
    ends = np.searchsorted(lang[order], np.arange(len(names) + 1))
    models = {x: Model(code[own], n[own]) for i, x in enumerate(names) for own in [order[ends[i] : ends[i + 1]]]}
    out = Identifier(models)
    most = most_calibrating // 4
    place = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.greatest(F.lit(1), F.length("text") - most + 1)).cast("int") + 1
    text = F.when(F.octet_length("text") > most_calibrating, F.substring("text", place, F.lit(most))).otherwise(F.col("text")).alias("text")
    rest = chosen.where("calibrates").select("lang", text).orderBy("lang", "text").toArrow()
    texts, own = rest.column(1).to_pylist(), rest.column(0).to_pylist()
    out.calibrate(texts, own)
    return out


def identify(docs: DataFrame, reject: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Every character of the text is scored. Null texts and texts without letters are ``und`` with score 0. With
    ``reject``, so are texts whose entropy is beyond what the language's own texts have; without, the column rejected
    tells. Repeated rows have equal results; a null doc_id is neither held out nor learned from; other columns take no
    part. Without anything to learn from all texts are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def predict(text: pa.Array) -> pa.Array:
        texts = [t or "" for t in text.to_pylist()]
        got = [shared.value.predict(texts[a:b]) for a, b in _parts(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([x for g in got for x in g[0]], pa.string()), pa.array(np.concatenate([g[1] for g in got]) if got else [], pa.float64()), pa.array(np.concatenate([g[2] for g in got]) if got else [], pa.bool_())],
            names=["lang", "score", "rejected"],
        )

    made = docs.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.arrow_udf(predict, "lang string, score double, rejected boolean")("text").alias("out"))
    lang = F.when(F.col("out.rejected"), UNKNOWN).otherwise(F.col("out.lang")) if reject else F.col("out.lang")
    return made.select("doc_id", "held_out", lang.alias("lang_pred"), "out.score", "out.rejected")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Best-fit packing of documents into training sequences: large items matched in pairs, small ones fitted into the gaps."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, kept

#: Distinct words whose ids a worker keeps at hand.
REMEMBERED = 500_000
_loaded: dict[str, object] = {}


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others, in order, from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids by word; a word that is not there is learned."""

    def __init__(self, learned):
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learned(word)
        return ids


class WordIds:
    """Ids of texts, word by word: the tokenizer treats what white space separates independently, so ids of a distinct
    word are made once. Plain words - Latin letters, perhaps with ASCII marks behind - go straight to the
    tokenizer's model as the lower-cased unit that its normalizer and splitter would make of them; all others go through
    the whole tokenizer. Whether the shortcut holds for a vocabulary is tried at the start, and without it all do."""

    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=?@\[-`{}~]*)")
    TRIAL = ("The", "o", "Wherever", "onthshin", "\u00c9t\u00e9", "\u00fcberpf\u00fc\u00df", "a\u00f1o", "qzxj")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letter = _byte_letters()
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = _Known(self._learned)
        self.older: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in (".", ",", "%%%", "!!")} | {"": b""}
        self.short = all(self._unit(w.lower()) + self.marks[m] == self._whole(w + m) for w in self.TRIAL for m in self.marks)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letter.__getitem__, word.encode()))
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(word)])

    def _learned(self, word: str) -> bytes:
        old = self.older.get(word)
        if old is not None:
            return old
        if not self.short:
            return self._whole(word)
        if word.isascii() and word.isalpha():
            core, marks = word.lower(), ""
        elif plain := self.PLAIN.fullmatch(word):
            core, marks = plain[1].lower(), plain[2]
        else:
            return self._whole(word)
        unit = self.known.get(core)
        if unit is None:
            unit = self.older.get(core) or self._unit(core)
            if core != word:
                self.known[core] = unit
        if not marks:
            return unit
        behind = self.marks.get(marks) or self.known.get(marks)
        if behind is None:
            behind = self.known[marks] = self._whole(marks)
        return unit + behind

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for t in texts:
            if len(self.known) > REMEMBERED:  # words in use come back from the older generation
                self.older, self.known = self.known, _Known(self._learned)
            # these three are white space to the tokenizer; other white space stays within a word and is dropped by it
            yield b"".join(map(self.known.__getitem__, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, key, text) -> a row for each piece of at most ``capacity`` ids."""
        words = _loaded.get(path) or _loaded.setdefault(path, WordIds(path))
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, ids in enumerate(words.encode(texts)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "key", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, how many such bins)] from how many items there are of each length.

    Items over a third of the capacity go at most two to a bin: the largest takes the largest partner that still fits.
    Smaller ones, the largest first, go to the tightest gap. All steps move whole counts, so the work depends on the
    distinct lengths - at most ``capacity`` - and not on the items.
    """
    left = {s: n for s, n in counts.items() if n}
    if any(s > capacity for s in left):
        raise ValueError("an item exceeds the capacity")
    large = sorted(s for s in left if 3 * s > capacity)
    bins: dict[tuple[int, ...], int] = {}

    def put(content: tuple[int, ...], n: int) -> None:
        if n:
            bins[content] = bins.get(content, 0) + n

    while large:
        s = large[-1]
        n = left[s]
        i = bisect_left(large, capacity - s + 1) - 1
        if i < 0:
            put((s,), n)
            left[s] = 0
        elif large[i] == s:
            put((s, s), n // 2)
            left[s] = n % 2
            if left[s]:
                other = large[i - 1] if i else None
                put((s, other) if other else (s,), 1)
                if other:
                    left[other] -= 1
                left[s] = 0
        else:
            m = min(n, left[large[i]])
            put((s, large[i]), m)
            left[s] -= m
            left[large[i]] -= m
        large = [x for x in (large if not left[s] and i < 0 else large) if left[x]]

    gaps: dict[int, dict[tuple[int, ...], int]] = {}
    for content, n in bins.items():
        gaps.setdefault(capacity - sum(content), {})[content] = n
    order = sorted(gaps)

    def add(gap: int, content: tuple[int, ...], n: int) -> None:
        if gap not in gaps:
            gaps[gap] = {}
            order.insert(bisect_left(order, gap), gap)
        gaps[gap][content] = gaps[gap].get(content, 0) + n

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(order, s)
            if i == len(order):
                per = capacity // s
                full, rest = divmod(n, per)
                if full:
                    add(capacity - per * s, (s,) * per, full)
                if rest:
                    add(capacity - rest * s, (s,) * rest, 1)
                break
            gap = order[i]
            content, have = next(iter(gaps[gap].items()))
            per = gap // s
            use = min(have, n // per)
            if use:
                add(gap - per * s, content + (s,) * per, use)
                n -= use * per
            else:
                use = 1
                add(gap - n * s, content + (s,) * n, 1)
                n = 0
            gaps[gap][content] -= use
            if not gaps[gap][content]:
                del gaps[gap][content]
            if not gaps[gap]:
                del gaps[gap]
                order.remove(gap)
    return [(c, n) for gap in order for c, n in gaps[gap].items()]


class Places:
    """For each length the runs of item numbers that a plan puts at one place of consecutive bins."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for content, n in bins:
            offset = 0
            for s in content:
                runs.setdefault(s, []).append((used.get(s, 0), first, offset))
                used[s] = used.get(s, 0) + n
                offset += s
            first += n
        self.bins = first
        self.runs = {s: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for s, own in runs.items()}

    def of(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, first, offset = self.runs[length]
        i = np.searchsorted(begin, number, side="right") - 1
        return first[i] + number - begin[i], offset[i]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, salts: int = 16) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with id 0; only longer ones than ``capacity`` are cut. The driver gets how many pieces have
    each length (at most ``capacity`` numbers), plans bins from that, and broadcasts the plan, which is as small. Pieces
    of a length are numbered in groups dealt by hash (``salts`` times the shuffle partitions for each length, so a
    length that a third of all pieces have is many groups), behind the pieces of the groups before; the number gives the place.

    Null text is empty: one piece of one id. Repeated rows are packed each. Other columns take no part. An empty table
    gives no row. The numbering of bins depends only on the rows, except that pieces equal in id, text and place in their
    document may swap places.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    groups = salts * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
        made = rows.mapInArrow(_pieces(tokenizer, capacity), f"doc_id {id_type}, key long, piece int, start long, length long, ids_crc32 long")
        pieces = scratch.table(made.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)).cast("int")))
        sums = scratch.table(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
        counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))
        before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
        own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "key", "piece")) - 1
        numbered = pieces.withColumn("own", own).join(before, ["length", "salt"]).withColumn("number", F.col("own") + F.col("before"))

        @F.pandas_udf("sequence_id long, offset long")
        def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            size, at = length.to_numpy(), number.to_numpy()
            order = np.argsort(size, kind="stable")
            edges = np.flatnonzero(np.diff(size[order])) + 1
            for part in np.split(order, edges) if len(order) else []:
                sequence[part], offset[part] = places.value.of(int(size[part[0]]), at[part])
            return pd.DataFrame({"sequence_id": sequence, "offset": offset})

        placed = numbered.withColumn("at", place("length", "number"))
        return kept(placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"))


def _tokenizer(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_best_fit_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer(tokenizer))


def stage(spark, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    return pack(docs, _tokenizer(tokenizer))

"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept, slices, stream, utf8

#: A cut needs bits 4 to 7 of the hash to be ones: one byte in 16 on average. Bit 7 depends on the last 8 bytes alone, so
#: cuts agree again soon after two texts do.
_SHIFT, _ONES = np.uint32(4), np.uint32(15)
#: Bytes of a chunk. LEAST is over the hash's 8 bytes, so the text before a document never moves its cuts. Chunks of about
#: 32 bytes leave little of a passage of 50 words at its ends.
LEAST, MOST = 16, 192
#: A run of repeated chunks is removed if it holds at least so many words.
MIN_WORDS = 20

_GEAR = stream(1, 256).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + gear[byte] over the last 8 bytes, at every byte, by doubling; its low 8 bits are those of
    the endless hash."""
    h = _GEAR[data]
    for k in (1, 2, 4):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text of ``data`` (UTF-8, at ``offsets``) the ends of its chunks; no cut falls inside a character."""
    ends = np.flatnonzero((rolling(data) >> _SHIFT) & _ONES == _ONES) + 1
    inside = (data & 0xC0) == 0x80
    for _ in range(3):  # a cut before a continuation byte moves behind the character
        moved = ends[(ends < len(data))]
        ends[: len(moved)] += inside[moved]
    found, out = ends.tolist(), []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, at, i = [], start, 0
        i = bisect_left(found, start + LEAST)
        while at < end:
            i = bisect_left(found, at + LEAST, i)
            cut = found[i] if i < len(found) else end
            if cut > at + MOST:
                cut = at + MOST
                while cut < end and inside[cut]:
                    cut += 1
            at = min(cut, end)
            own.append(at)
        out.append(own)
    return out


def digests(data: bytes, start: int, ends: list[int]) -> list[int]:
    out = []
    for end in ends:
        out.append(xxhash.xxh3_64_intdigest(data[start:end]))
        start = end
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(oid, text) -> (digest, oid, again) for the distinct chunks of each text; again: it repeats within the text."""
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        oid = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, 1 << 20):
            base, part = offsets[a], data[offsets[a] : offsets[b]]
            raw, own = part.tobytes(), offsets[a : b + 1] - base
            ids, found, again = [], [], []
            for i, ends in enumerate(cuts(part, own)):
                once: dict[int, bool] = {}
                for d in digests(raw, int(own[i]), ends):
                    once[d] = d in once
                ids.append(np.full(len(once), oid[a + i], np.int64))
                found += once.keys()
                again += once.values()
            yield pa.record_batch([pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(again, pa.bool_())], names=["digest", "oid", "again"])


def cleaned(text: str, later: set[int], min_words: int) -> tuple[str, int, int]:
    """The text without its repeated runs, the characters and the runs removed. later: digests kept in an earlier document."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data, np.array([0, len(raw)]))[0] if raw else []
    seen: set[int] = set()
    runs: list[list[int]] = []
    start = 0
    for end, d in zip(ends, digests(raw, 0, ends), strict=True):
        if d in later or d in seen:
            if runs and runs[-1][1] == start:
                runs[-1][1] = end
            else:
                runs.append([start, end])
        seen.add(d)
        start = end
    out, at, removed, spans = [], 0, 0, 0
    space = b" \t\r\n\x0b\x0c"
    for a, b in runs:
        # only whole words go
        while 0 < a < b and raw[a - 1] not in space:
            a += 1
        while a < b < len(raw) and raw[b] not in space and raw[b - 1] not in space:
            b -= 1
        gone = raw[a:b].decode()
        if len(gone.split()) >= min_words:
            out.append(raw[at:a])
            at, removed, spans = b, removed + len(gone), spans + 1
    return b"".join([*out, raw[at:]]).decode(), removed, spans


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, plus removed_chars and removed_spans.

    A chunk belongs to the document with the smallest doc_id that holds it; in every later document, and where it
    repeats within one document, it is repeated. Runs of neighbouring repeated chunks that hold ``min_words`` whole
    words or more go. Inserted or deleted text moves only the cuts beside it, so shifted passages still meet.

    Null text stays null and empty text stays empty, with nothing removed. A null doc_id is replaced by a hash of the
    text for this order. Rows that share a doc_id count as one document: none takes a chunk from another, so repeated
    rows have equal results. Other columns are passed on; columns called removed_chars or removed_spans are replaced.
    """
    spark = docs.sparkSession
    oid = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    with Scratch(spark) as scratch:
        chunks = scratch.table(docs.where("length(text) > 0").select(oid.alias("oid"), "text").mapInArrow(_chunks, "digest long, oid long, again boolean"))
        heads = scratch.table(chunks.groupBy("digest").agg(F.min("oid").alias("first"), F.max("oid").alias("last")).where("last > first").select("digest", "first"))
        later = chunks.select("digest", "oid").join(heads, "digest").where("oid > first").select("oid", "digest")
        again = chunks.where("again").select("oid", F.lit(None).cast("long").alias("digest"))
        marked = kept(later.union(again).groupBy("oid").agg(F.collect_set("digest").alias("later")))

    @F.pandas_udf("text string, removed_chars int, removed_spans int")
    def clean(text: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(t, 0, 0) if d is None or t is None else cleaned(t, set((np.asarray(d).astype(np.int64)).view(np.uint64).tolist()), min_words) for t, d in zip(text, own, strict=True)], columns=["text", "removed_chars", "removed_spans"])

    names = [c for c in docs.columns if c not in ("removed_chars", "removed_spans")]
    keyed = docs.select(F.struct(*names).alias("doc"), oid.alias("oid")).join(marked, "oid", "left")
    return keyed.withColumn("out", clean(F.col("doc.text"), F.col("later"))).select(*[F.col("out.text").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in names], "out.removed_chars", "out.removed_spans")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs.select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; n_chars follows."""
    out = substring_dedup(docs)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])

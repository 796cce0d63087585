"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept, mixed, stream
from .components import components

WORD = re.compile(r"\w+")
#: Classes of a bucket or of a candidate component that a task holds on either side, and n-grams of those that it holds.
BLOCK, GRAMS = 512, 2_000_000
#: Probability that two texts exactly at the threshold are taken apart by their signatures.
MISSED = 1e-5


def banding(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have - so the fewest false candidates - while a pair exactly at the
    threshold still shares a band with probability ``recall`` or more, within ``most_hashes`` hashes."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def least_agreeing(threshold: float, hashes: int) -> int:
    """The most of ``hashes`` minima that a pair at the threshold agrees in with a probability of 1 - MISSED."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > MISSED:
            return k
    return hashes


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-grams of lower-cased words; shorter texts have one gram of all their words, and texts without words none."""
    words = [WORD.findall(t.lower()) for t in texts]
    flat = np.fromiter((xxhash.xxh64_intdigest(w) for own in words for w in own), np.uint64)
    mix = mixed(flat)
    whole = np.zeros(max(0, len(mix) - n + 1), np.uint64)
    for k in range(n):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + mix[k : k + len(whole)]
    whole = mixed(whole)
    out, at = [], 0
    for own in words:
        if len(own) >= n:
            out.append(np.unique(whole[at : at + len(own) - n + 1]))
        elif own:
            out.append(np.array([xxhash.xxh64_intdigest("\0".join(own), seed=len(own))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(own)
    return out


def signature(grams: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each of the hash functions (a x + b) >> 32."""
    low = np.full(len(mult), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(grams), 2048):
        h = grams[i : i + 2048, None] * mult[None]
        h += add
        low = np.minimum(low, (h >> np.uint64(32)).min(axis=0))
    return low


def _signed(bands: int, rows: int, n: int):
    mult, add = stream(2, bands * rows) | np.uint64(1), stream(3, bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, th, text) -> (doc_id, th, node, proof, size, low, bands); node and proof are digests of the gram set, null
        without grams, size is its number of grams and low the last byte of each minimum."""
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i in range(0, len(texts), 256):
                sets = gram_sets(texts[i : i + 256], n)
                sig = np.array([signature(g, mult, add) for g in sets]).reshape(len(sets), bands, rows)
                key = np.arange(bands, dtype=np.uint64)[None].repeat(len(sets), 0)
                for r in range(rows):
                    key = mixed(key * np.uint64(0x100000001B3) + sig[:, :, r])
                raw = [g.tobytes() for g in sets]
                some = [bool(r) for r in raw]
                node = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
                proof = np.array([xxhash.xxh64_intdigest(r, seed=7) for r in raw], np.uint64).view(np.int64)
                off = ~np.array(some)
                values = pa.array(key[~off].ravel().view(np.int64))
                ends = np.concatenate([[0], np.cumsum(np.where(off, 0, bands))]).astype(np.int32)
                part = batch.slice(i, len(sets))
                size, low = pa.array([len(g) for g in sets], pa.int64()), pa.array([r.tobytes() for r in sig.reshape(len(sets), -1).astype(np.uint8)], pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(node, mask=off), pa.array(proof, mask=off), size, low, pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "th", "node", "proof", "size", "low", "bands"])

    return run


def _similar(least: int):
    """(band, i, j, node, low), sorted by the first three -> (u, v): within each group a forest of the pairs whose signatures
    agree in ``least`` places or more."""

    def forest(nodes: list[int], low: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(nodes) < 2:
            return
        sig, left = np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1), np.arange(len(nodes))
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                at = front.pop()
                near = (sig[left] == sig[at]).sum(axis=1) >= least
                yield from ((nodes[at], nodes[k]) for k in left[near])
                front.extend(left[near])
                left = left[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, low, u, v = None, [], [], [], []
        for batch in batches:
            for *now, node, sig in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if now != key:
                    for a, b in forest(nodes, low):
                        u.append(a), v.append(b)
                    key, nodes, low = now, [], []
                nodes.append(node), low.append(sig)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u, v = [], []
        for a, b in forest(nodes, low):
            u.append(a), v.append(b)
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Matrix of whether the sets of a and b (None: a itself) have a Jaccard similarity of the threshold or more, counted exactly."""
    both = a + (b or [])
    size = np.array([len(g) for g in both], np.float64)
    values, ids, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), size.astype(np.int64))
    shared = count[ids] > 1
    row, col = row[shared], np.unique(ids[shared], return_inverse=True)[1]
    wide = int(col.max(initial=-1)) + 1
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n, m = len(a), len(a) if b is None else len(b)
    inter = np.zeros((n, m), np.float32)
    step = 4096
    for at in range(0, wide, step):
        lo, hi = np.searchsorted(col, [at, at + step])
        have = np.zeros((len(both), min(step, wide - at)), np.float32)
        have[row[lo:hi], col[lo:hi] - at] = 1
        inter += have[:n] @ (have[:n].T if b is None else have[n:].T)
    left, right = size[:n], size[:n] if b is None else size[n:]
    union = left[:, None] + right[None] - inter
    return inter >= threshold * union - 1e-9


def _verified(threshold: float, n: int):
    def groups(batches: Iterator[pa.RecordBatch]):
        """Streams (key, sides) of rows sorted by (comp, i, j, side); repeated rows of a class count once."""
        key, sides = None, ({}, {})
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(7)]
            for comp, i, j, side, node, copies, text in zip(*cols, strict=True):
                if key != (comp, i, j):
                    if key is not None:
                        yield key, sides
                    key, sides = (comp, i, j), ({}, {})
                sides[side].setdefault(node, (text, copies))
        if key is not None:
            yield key, sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, links = [], [], []
        for (_, i, j), (first, second) in groups(batches):
            ids = [*first], [*second]
            copies = [np.array([c for _, c in s.values()], np.int64) for s in (first, second)]
            sets = [gram_sets([t for t, _ in s.values()], n) for s in (first, second)]
            if i == j:
                near = linked(sets[0], None, threshold)
                np.fill_diagonal(near, False)
                tell = [(0, near @ copies[0])]
                names = ids[0]
            elif not (ids[0] and ids[1]):
                continue
            else:
                cross = linked(sets[0], sets[1], threshold)
                tell = [(0, cross @ copies[1]), (1, cross.T @ copies[0])]
                names = ids[0] + ids[1]
                near = np.zeros((len(names), len(names)), bool)
                near[: len(ids[0]), len(ids[0]) :] = cross
                near |= near.T
            for side, total in tell:
                for node, k in zip(ids[side], total.tolist(), strict=True):
                    if k:
                        u.append(node), v.append(None), links.append(k)
            # a spanning forest carries the component on
            todo = near.any(axis=1)
            while todo.any():
                root = int(todo.argmax())
                seen = front = np.zeros(len(names), bool)
                front[root] = True
                while front.any():
                    seen = seen | front
                    front = near[front].any(axis=0) & ~seen
                for k in np.flatnonzero(seen):
                    if k != root:
                        u.append(names[root]), v.append(names[int(k)]), links.append(None)
                todo &= ~seen
            if len(u) > 50_000:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], names=["u", "v", "links"])
                u, v, links = [], [], []
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], names=["u", "v", "links"])

    return run


def _dealt(rows: DataFrame, group: str, *columns: str, both: bool = False) -> DataFrame:
    """``rows(group, blocks, block, ...)`` dealt to (group, i, j), i <= j, for each pair of blocks of a group, so that any two
    rows of a group meet; rows of block i and of block j have side 0 and 1. Pairs of a block with itself are left out
    where there are others, unless ``both``."""
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    if not both:
        other = F.filter(other, lambda o: (o != F.col("block")) | (F.col("blocks") == 1))
    pairs = rows.withColumn("other", F.explode(other)).select(
        group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *([(F.col("block") > F.col("other")).cast("int").alias("side")] if both else []), *columns
    )
    return pairs.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", *(["side"] if both else []))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, most_hashes: int = 128) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row: doc_id, th, class_id, copies, links, first.

    Texts with equal n-gram sets are copies. Two texts are linked if their sets have a Jaccard similarity of
    ``threshold`` or more; classes are the connected components of links. class_id is the least doc_id of the class,
    copies the rows with the same set, links the other rows linked to this one (copies included), th a hash of the text
    and first whether the row's (doc_id, th) is the class's least.

    MinHash bands are chosen by :func:`banding`. Members of a bucket are candidates of each other if their signatures - all
    minima, of a byte each - agree about as far as the threshold asks (:func:`least_agreeing`), so texts that share a band
    by chance form no chains. Buckets are split into blocks of members and a task gets a pair of blocks; it tells a forest
    of the candidate pairs. In each component of these all pairs are compared on their full sets, in blocks of classes
    that are dealt out in pairs: block products count links without making rows for them. A block holds about ``BLOCK``
    classes or ``GRAMS`` n-grams, so long texts make more blocks. Copies are one class from the start, whatever their number.

    Texts without words (null, empty, punctuation) have no set: they link with nothing, and each is its own class with
    class_id = doc_id. A null doc_id counts as the least. Rows repeated with the same doc_id and text count as copies.
    Other columns take no part.
    """
    spark = docs.sparkSession
    bands, rows = banding(threshold, recall, most_hashes)
    mine = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        signed = scratch.table(mine.mapInArrow(_signed(bands, rows, n), f"doc_id {id_type}, th long, node long, proof long, size long, low binary, bands array<long>"))
        some = signed.where("node is not null")
        posted = some.select("node", F.explode("bands").alias("band"))
        heads = scratch.table(posted.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("band"))
        members = scratch.table(posted.join(heads, "band").select("band", "node").distinct())
        split = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        lows = some.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("low").alias("low"))
        placed = members.join(split, "band").join(lows, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        near = scratch.table(components(_dealt(placed, "band", "node", "low").mapInArrow(_similar(least_agreeing(threshold, bands * rows)), "u long, v long"), scratch))

        classes = scratch.table(some.groupBy("node", "proof").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min(F.struct("doc_id", "th")).alias("rep")))
        cand = classes.join(near, "node")
        sizes = cand.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / GRAMS)).cast("int").alias("blocks"))
        cand = scratch.table(cand.join(sizes, "component").select("component", "blocks", F.pmod(F.xxhash64("node", "proof"), F.col("blocks")).cast("int").alias("block"), "node", "copies", F.xxhash64("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th")))
        # candidates grow with the corpus, so their texts are found by a merge join at every size; it leaves rows dealt and
        # sorted by keys without nulls, so repeated rows go without another shuffle
        texts = mine.select(F.xxhash64("doc_id").alias("_id"), F.col("th").alias("_th"), "text").join(cand.hint("merge"), ["_id", "_th"]).dropDuplicates(["_id", "_th"])
        dealt = _dealt(texts, "component", "node", "copies", "text", both=True)
        found = scratch.table(dealt.mapInArrow(_verified(threshold, n), "u long, v long, links long"))

        links = found.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
        joined = components(found.where("v is not null").select("u", "v"), scratch)
        group = classes.join(joined, "node", "left").join(links, "node", "left").select("node", "proof", "copies", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
        group = scratch.table(group)
        named = group.join(group.groupBy("component").agg(F.min("rep").alias("least")), "component")
        named = scratch.table(named.select("node", "proof", "copies", "links", "least"))
        out = some.select("doc_id", "th", "node", "proof").join(named, ["node", "proof"]).select("doc_id", "th", F.col("least.doc_id").alias("class_id"), "copies", "links", (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))).alias("first"))
        none = signed.where("node is null").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("first"))
        return kept(out.union(none))


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copies", "links")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least doc_id. Of rows repeated with one doc_id and text, one stays."""
    marks = near_duplicates(docs).where("first").select(F.xxhash64("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    # keys without nulls: the join leaves rows dealt and sorted by them, so that repeated rows go without another shuffle
    return keyed.join(marks, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("doc.*")


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents
), places as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0
), grams as (
  select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as g from places
), sizes as (select doc_id, count(*) as n from grams group by doc_id),
met as (
  select a.doc_id as u, b.doc_id as v, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as (
  select u, v, (shared = a.n and shared = b.n) as same from met join sizes a on a.doc_id = u join sizes b on b.doc_id = v where shared >= 0.8 * (a.n + b.n - shared) - 1e-9
), reach(u, v) as (
  select u, v from links union select r.u, l.v from reach r join links l on l.u = r.v
), classes as (select u, least(u, min(v)) as class_id from reach group by u),
counts as (select u, count(*) as links, count(*) filter (same) as copies from links group by u)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(n.copies, 0) + 1 as copies, coalesce(n.links, 0) as links
from documents d left join classes c on c.u = d.doc_id left join counts n on n.u = d.doc_id
"""

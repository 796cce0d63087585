"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, dealt, past_blocks, pool, usable
from .common import Scratch, kept


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the farthest from those before: a crowd of near copies gives few pivots."""
    far, out = np.full(len(rows), np.inf), []
    for _ in range(min(n, len(rows))):
        out.append(int(far.argmax()))
        gap = rows - rows[out[-1]]
        far = np.minimum(far, np.einsum("ij,ij->i", gap, gap))
    return rows[out]


def orders(x: np.ndarray, pivot: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each row, nearest first."""
    far = np.einsum("ij,ij->i", pivot, pivot)[None] - 2 * x @ pivot.T
    near = np.argpartition(far, m - 1, axis=1)[:, :m] if m < len(pivot) else np.tile(np.arange(len(pivot)), (len(x), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def index_block(dim: int, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, m: int, share: float, least: int, k: int):
    """Inverted files of a block: for each pivot the rows that have it among their m nearest, with its place there.

    A query adds up |own place - row's place| over the lists of its own m pivots; a pivot missing from a row's order
    counts place m (footrule distance of truncated orders). The nearest share of the block is measured exactly.
    """
    m = min(m, len(pivot))
    order = orders(x, pivot, m) if len(x) else np.zeros((0, m), np.int64)
    flat = np.argsort(order.ravel(), kind="stable")
    starts = np.searchsorted(order.ravel()[flat], np.arange(len(pivot) + 1))
    rows, places = (flat // m).astype(np.int64), (flat % m).astype(np.float64)
    take = min(len(x), max(least, k + 1, math.ceil(share * len(x))))

    def find(query_ids: np.ndarray, q: np.ndarray, _):
        for qid, v, own in zip(query_ids, q, orders(q, pivot, m), strict=True):
            lists = [slice(starts[p], starts[p + 1]) for p in own]
            at = np.concatenate([rows[s] for s in lists])
            there = np.concatenate([places[s] for s in lists])
            place = np.repeat(np.arange(m, dtype=np.float64), [s.stop - s.start for s in lists])
            # an absent row pivot costs m - place; one that is there costs the difference of places instead. The row's own
            # pivots that the query lacks cost m - place each: all of them less those met.
            foot = np.bincount(at, np.abs(there - place) - (m - place) - (m - there), len(x))
            near = np.argpartition(foot, take - 1)[:take] if take < len(x) else np.arange(len(x))
            near = near[ids[near] != qid]
            gap = x[near] - v
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            top = np.lexsort((ids[near], d))[:k]
            yield ids[near[top]], d[top], d[top], -np.inf

    return find


def nearest(vectors: DataFrame, is_query: Column, k: int, n_pivots: int = 512, m: int = 128, sample: int = 4096, share: float = 0.05, least: int = 96, block_rows: int = 4096) -> DataFrame:
    """``vectors(id, vec)`` -> query_id, rank, vec_id, score: k near neighbours of each query by Euclidean distance.

    The pivots of a length are ``n_pivots`` of ``sample`` rows drawn by hash, chosen to lie far apart. Every row is
    indexed: its ``m`` nearest pivots, in order, are posted in the pivots' inverted files, which are kept by blocks of
    rows, each built once. A query reads the lists of its own m pivots in every block, adds up the footrule distance to
    all rows there, and measures ``share`` of them exactly (``least`` of a small block). The share is fixed, so recall
    does not fall as the table grows.

    Ties go to the smaller id; a row is no neighbour of a query with its id; fewer candidates give fewer rows. Repeated
    rows are a candidate each, but a query id asks once; of several vectors with it the least one asks. Vectors that are
    null, zero or hold null or non-finite components take no part, nor do rows without id. Vectors are compared with
    those of their own length. Other columns take no part.
    """
    fine = vectors.where(F.col("id").isNotNull() & usable(F.col("vec"), nonzero=True)).select("id", "vec")
    by_length = vectors.sparkSession.sparkContext.broadcast({d: spread(x, n_pivots) for d, x in pool(fine, sample).items()})
    with Scratch(vectors.sparkSession) as scratch:
        candidates, queries = dealt(fine, is_query, block_rows, k, scratch)
        everywhere = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("least", F.lit(0.0))
        found = past_blocks(candidates, everywhere, lambda dim, ids, x: index_block(dim, ids, x, by_length.value[dim], m, share, least, k), "double")
        return kept(best(found, k))


def op10_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return nearest(vectors, F.col("id") % 100 == 0, 10)

"""Exact top-k by inner product with pivot-table elimination."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, dealt, past_blocks, pool, usable
from .common import Scratch, kept

#: Candidates evaluated in the first wave; each later wave is WIDER times as wide.
FIRST, WIDER = 32, 2
#: Up to this magnitude of a score, float64 sums of integer products are exact.
_EXACT = 2.0**52


def chosen_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """At most n rows, each the farthest from the span of those before, so that no two say the same; at most seven eighths
    of the dimensions, since with all of them the table would be the vectors over again."""
    top = np.abs(rows).max(initial=0.0)
    if not top:
        return rows[:0]
    left, out = rows / top, []
    scale = np.einsum("ij,ij->i", left, left).max()
    for _ in range(min(n, math.ceil(rows.shape[1] * 7 / 8), len(rows))):
        far = np.einsum("ij,ij->i", left, left)
        i = int(far.argmax())
        if far[i] < 1e-6 * scale:
            break
        out.append(i)
        u = left[i] / np.sqrt(far[i])
        left = left - np.outer(left @ u, u)
    return rows[out]


def search_block(dim: int, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, k: int, first_wave: bool = False):
    """A pivot table of the block - the distance of each row to the origin and to every pivot - and a search that stops exactly.

    The distances of a row to all pivots fix its projection on their span and the length of what is left over. So of all
    pivots together the largest lower bound that the triangle inequality allows is d(q, x)^2 >= |q' - x'|^2 +
    (|q - q'| - |x - x'|)^2, where ' projects; it is never below max over pivots |d(q, p) - d(x, p)|. By q.x = (|q|^2 + |x|^2 -
    d^2) / 2 it bounds the product from above. Candidates are evaluated in waves of falling bound until none reaches the
    k-th best score, or ``least`` where that is higher. ``first_wave`` stops after one wave; ``rest`` is the largest bound
    of the candidates not evaluated. The function counts evaluations in its attribute ``evaluated``.
    """
    pivot_norm = np.einsum("ij,ij->i", pivot, pivot)
    scale = max(1.0, float(pivot_norm.max(initial=0.0)))
    inverse = np.linalg.inv(np.linalg.cholesky(pivot @ pivot.T / scale)) / np.sqrt(scale) if len(pivot) else np.zeros((0, 0))

    def table(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared norms, squared distances to all pivots) of rows."""
        norm = np.einsum("ij,ij->i", rows, rows)
        return norm, np.maximum(norm[:, None] + pivot_norm[None] - 2 * rows @ pivot.T, 0)

    def projected(norm: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates in the pivots' span, what is left over) from a row's distances alone."""
        at = (norm[:, None] + pivot_norm[None] - distance) / 2 @ inverse.T
        return at, np.sqrt(np.maximum(norm - np.einsum("ij,ij->i", at, at), 0))

    norm, distance = table(x)
    at, over = projected(norm, distance)
    peak = np.abs(x).max(initial=0.0)
    slack_x = 1e-6 * (norm + 1)

    def find(query_ids: np.ndarray, q: np.ndarray, least: np.ndarray):
        q_norm, q_distance = table(q)
        q_at, q_over = projected(q_norm, q_distance)
        exact = dim * max(peak, 1.0) * max(np.abs(q).max(initial=0.0), 1.0) < _EXACT
        # roundoff of the distances must never hide a candidate
        bound = q_at @ at.T + np.outer(q_over, over) + 1e-6 * q_norm[:, None] + slack_x[None]
        bound = np.where(np.isnan(bound), np.inf, bound)
        for i, qid in enumerate(query_ids):
            own = bound[i]
            live = np.flatnonzero((ids != qid) & (own >= least[i]))
            rows, scores = np.zeros(0, np.int64), (np.zeros(0) if exact else np.zeros(0, object))
            wave = max(FIRST, k)
            while len(live):
                if len(live) > wave:
                    cut = np.argpartition(-own[live], wave)
                    now, live = live[cut[:wave]], live[cut[wave:]]
                else:
                    now, live = live, live[:0]
                find.evaluated += len(now)
                got = x[now] @ q[i] if exact else np.array([sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for j in now], object)
                rows, scores = np.concatenate([rows, now]), np.concatenate([scores, got])
                if len(rows) > k:
                    top = np.lexsort((ids[rows], -scores))[:k] if exact else np.array(sorted(range(len(rows)), key=lambda j: (-scores[j], ids[rows[j]]))[:k])
                    rows, scores = rows[top], scores[top]
                if len(rows) == k:
                    live = live[own[live] >= float(min(scores))]
                if first_wave:
                    break
                wave *= WIDER
            order = sorted(range(len(rows)), key=lambda j: (-scores[j], ids[rows[j]]))
            top = [scores[j] for j in order]
            yield ids[rows[order]] if order else np.zeros(0, np.int64), np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in top], np.int64), np.array([-float(s) for s in top]), own[live].max(initial=-np.inf)

    find.evaluated = 0
    return find


def top_k(vectors: DataFrame, is_query: Column, k: int, n_pivots: int = 256, sample: int = 2048, block_rows: int = 8192) -> DataFrame:
    """``vectors(id, vec)`` of integer-valued doubles -> query_id, rank, vec_id, score: each query's k largest inner products, exactly.

    Two passes over blocks of candidates. In the first each query evaluates in every block the one wave of highest bounds;
    the k-th best score over all blocks is then known from below. The second pass goes only to blocks where a bound
    reaches that score, and evaluates there, in bound order, until none does. Pivots are at most ``n_pivots`` of
    ``sample`` rows of each length, drawn by hash.

    Ties go to the smaller id; a row is no candidate of a query with its id; fewer candidates give fewer rows. Repeated
    rows are a candidate each, but a query id asks once; of several vectors with it the least one asks. Null vectors and
    vectors with null or non-finite components take no part, nor do rows without id. Vectors are compared with those of
    their own length. A score outside 64 bits is given as the nearest 64-bit integer. Other columns take no part.
    """
    fine = vectors.where(F.col("id").isNotNull() & usable(F.col("vec"))).select("id", "vec")
    by_length = vectors.sparkSession.sparkContext.broadcast({d: chosen_pivots(x, n_pivots) for d, x in pool(fine, sample).items()})

    def search(first_wave: bool):
        return lambda dim, ids, x: search_block(dim, ids, x, by_length.value[dim], k, first_wave)

    with Scratch(vectors.sparkSession) as scratch:
        candidates, queries = dealt(fine, is_query, block_rows, k, scratch)
        everywhere = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("least", F.lit(float("-inf")))
        first = scratch.table(past_blocks(candidates, everywhere, search(True), "long"))
        reached = best(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("least"))
        still = first.groupBy("query_id", "dim", "block").agg(F.max("rest").alias("rest")).join(reached, "query_id").where("rest > double('-infinity') and rest >= least")
        still = scratch.table(still.select(F.col("query_id").alias("id"), "dim", "block", "least"))
        again = queries.select("id", "vec").join(still, "id")
        second = past_blocks(candidates, again, search(False), "long")
        done = first.join(still.select(F.col("id").alias("query_id"), "dim", "block"), ["query_id", "dim", "block"], "left_anti")
        return kept(best(done.select("query_id", "vec_id", "score", "key").union(second.select("query_id", "vec_id", "score", "key")), k))


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("raw"))
    fine = raw.where(usable(F.col("raw")))
    whole = fine.select("id", F.transform("raw", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vec"))
    return top_k(whole, F.col("id") % 50 == 0, 5)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id, min(e) as e from v where vec_id % 50 = 0 group by vec_id),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
      from q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

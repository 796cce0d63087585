"""Query vectors streamed past blocks of candidate vectors: the frame of both vector searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Queries that a task treats at once.
AT_ONCE = 256


def usable(vector: Column, nonzero: bool = False) -> Column:
    """True for a vector that is not null and holds only finite, non-null components (and, if asked, a non-zero one)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & (F.exists(vector, lambda x: x != 0) if nonzero else F.lit(True)), F.lit(False))


def pool(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By length, n different vectors drawn by a hash, so reruns agree; at most n rows of each length reach the driver."""
    hashed = vectors.select("vec", F.size("vec").alias("dim"), F.xxhash64("id", "vec").alias("h"))
    ranked = hashed.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy("h", "vec"))).where(F.col("k") <= n)
    out: dict[int, list] = {}
    for row in ranked.orderBy("dim", "k").toLocalIterator():
        out.setdefault(row["dim"], []).append(row["vec"])
    return {d: np.unique(np.array(v, np.float64).reshape(len(v), d), axis=0) for d, v in out.items()}


def dealt(vectors: DataFrame, is_query: Column, block_rows: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables of candidates(dim, block, id, vec, copies) and queries(dim, blocks, id, vec).

    Rows repeated with one id and vector are one candidate with copies, of which k can matter, so they fill no block.
    Candidates go to blocks of about ``block_rows`` by hash. A query id asks once: of several vectors with it the least.
    """
    once = vectors.groupBy("id", "vec").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"), F.max(is_query).alias("is_query"))
    once = scratch.table(once.withColumn("dim", F.size("vec")))
    sizes = once.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("blocks"))
    rows = once.join(sizes, "dim")
    candidates = scratch.table(rows.select("dim", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int").alias("block"), "id", "vec", "copies"))
    asking = once.where("is_query").groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    return candidates, scratch.table(asking.join(sizes, "dim").select("dim", "blocks", "id", "vec"))


def past_blocks(candidates: DataFrame, asking: DataFrame, search: Callable[[int, np.ndarray, np.ndarray], Callable], score_type: str) -> DataFrame:
    """(query_id, dim, block, vec_id, score, key, rest): what ``search`` finds for each row of ``asking(dim, block, id, vec,
    least)`` in its block of ``candidates(dim, block, id, vec, copies)``.

    In a task queries are sorted behind their block's candidates and treated as they stream by, so it holds one block and
    ``AT_ONCE`` queries. No row pair is ever made. ``search(dim, ids, matrix)`` prepares a block and returns a function of
    (query ids, query matrix, least) that yields (candidate ids, scores, sort keys, rest) for each query, in order.
    Vectors of unequal length are not compared.
    """
    own = candidates.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("dim", "block", F.lit(0).alias("side"), "id", "vec", F.lit(0.0).alias("least"))
    sent = own.union(asking.select("dim", "block", F.lit(1).alias("side"), "id", "vec", "least"))
    sent = sent.repartition("dim", "block").sortWithinPartitions("dim", "block", "side", "id")
    types = {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, find, held, wait, waiting = None, None, [], [], 0

        def answered() -> Iterator[pa.RecordBatch]:
            ids, vecs, least = (np.concatenate(x) for x in zip(*wait, strict=True))
            for i in range(0, len(ids), AT_ONCE):
                s = slice(i, i + AT_ONCE)
                got = list(find(ids[s], vecs[s], least[s]))
                n = [len(g[0]) for g in got]
                query, rest = np.repeat(ids[s], n), np.repeat(np.array([g[3] for g in got], np.float64), n)
                place = [np.full(len(query), v, np.int32) for v in at]
                vec_id, score, key = (np.concatenate([g[c] for g in got]) for c in range(3))
                yield pa.record_batch(
                    [pa.array(query, pa.int64()), *map(pa.array, place), pa.array(vec_id, pa.int64()), pa.array(score, types[score_type]), pa.array(key, pa.float64()), pa.array(rest)],
                    names=["query_id", "dim", "block", "vec_id", "score", "key", "rest"],
                )

        for batch in batches:
            dim, block, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            least, vec = batch.column(5).to_numpy(zero_copy_only=False), batch.column(4)
            values, ends = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
                if a == b:
                    continue
                if (dim[a], block[a]) != at:
                    if wait:
                        yield from answered()
                    at, find, held, wait, waiting = (dim[a], block[a]), None, [], [], 0
                part = values[ends[a] : ends[b]].reshape(b - a, dim[a]).astype(np.float64)
                if side[a] == 0:
                    held.append((ids[a:b], part))
                    continue
                if find is None:
                    find = search(int(dim[a]), *((np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros((0, dim[a])))))
                wait.append((ids[a:b], part, least[a:b]))
                waiting += b - a
                if waiting >= AT_ONCE:
                    yield from answered()
                    wait, waiting = [], 0
        if wait:
            yield from answered()

    return sent.mapInArrow(run, f"query_id long, dim int, block int, vec_id long, score {score_type}, key double, rest double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k least keys of each query over all its blocks, ties to the smaller id: query_id, rank, vec_id, score."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("key", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""What the operators share: scratch tables in the shared folder, Arrow text access, hashing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own serves a local
    master; a cluster must name one, since executors do not see the driver's folders."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Rows go to Python in batches of about ``size``: several workers of an executor hold a batch each, and the JVM a copy."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared folder. This checkpoint, and no other of the session, is registered with
    Spark's cleaner, which removes its files when nothing refers to them any longer."""
    shared_dir(df.sparkSession)
    conf, key = df.sparkSession.sparkContext._jsc.sc().conf(), "spark.cleaner.referenceTracking.cleanCheckpoints"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        with small_batches(df.sparkSession):
            return df.checkpoint()
    finally:
        conf.set(key, before)


class Scratch:
    """Written tables of one operator call, removed when the call ends. They cut lineage and survive lost executors.

    What the operator returns must not read them: it reads ``kept`` frames instead.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._drop(self.path)

    def _drop(self, path: str) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Removes a table that is no longer read."""
        self._drop(table._scratch_path)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return offsets, data


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes each; a longer row is a run of its own."""
    out, first = [], 0
    for i in range(len(offsets) - 1):
        if offsets[i + 1] - offsets[first] > most and i > first:
            out.append((first, i))
            first = i
    if first < len(offsets) - 1:
        out.append((first, len(offsets) - 1))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer with full avalanche (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mixed(mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)))

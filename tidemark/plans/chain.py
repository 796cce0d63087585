"""A chain of stages over written tables: run in order, from any stage on, and tell which tables are older than their inputs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """``run(spark)`` reads the paths ``inputs`` and writes the paths ``outputs``."""

    name: str
    run: Callable[[SparkSession], object]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


class StageFailed(RuntimeError):
    """Names the stage; what it raised is the cause. ``done`` are the stages before it with their seconds."""

    def __init__(self, stage: str, done: list[tuple[str, float]]):
        super().__init__(f"stage {stage} failed")
        self.stage, self.done = stage, done


def chosen(stages: list[Stage], only: list[str] | None = None, start: str | None = None) -> list[Stage]:
    """The stages in their order, from ``start`` on, of those named; ValueError for an unknown name or if none is left."""
    names = [s.name for s in stages]
    unknown = [n for n in [*(only or []), *([start] if start else [])] if n not in names]
    if unknown or len(set(names)) < len(names):
        raise ValueError(f"unknown or repeated stages: {unknown or names}")
    out = [s for s in stages[names.index(start) if start else 0 :] if not only or s.name in only]
    if not out:
        raise ValueError("no stage is left")
    return out


def run_chain(spark: SparkSession, stages: list[Stage], only: list[str] | None = None, start: str | None = None) -> list[tuple[str, float]]:
    """Runs the chosen stages one after another: (name, seconds). The first that raises ends the chain by ``StageFailed``."""
    done = []
    for s in chosen(stages, only, start):
        began = time.perf_counter()
        try:
            s.run(spark)
        except Exception as e:
            raise StageFailed(s.name, done) from e
        done.append((s.name, time.perf_counter() - began))
    return done


def written_at(spark: SparkSession, path: str) -> int | None:
    """When a file or table was last written, in milliseconds, on any file system that Spark reads; None if it is not there.
    A directory counts as written when the newest of its files was: one listing of metadata, no data is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    if fs.getFileStatus(where).isFile():
        return fs.getFileStatus(where).getModificationTime()
    files, last = fs.listFiles(where, True), None
    while files.hasNext():
        at = files.next().getModificationTime()
        last = at if last is None else max(last, at)
    return last


def staleness(spark: SparkSession, stages: list[Stage]) -> DataFrame:
    """(stage, status, missing, written, input_written), a row a stage: ``missing`` if none of its outputs is there, ``stale``
    if the newest of them is older than its newest input, else ``ok``; so a stage of unknown inputs is judged by existence
    alone. ``missing`` lists absent outputs."""
    rows = []
    for s in stages:
        out, given = ({p: written_at(spark, p) for p in paths} for paths in (s.outputs, s.inputs))
        made, read = ([t for t in d.values() if t is not None] for d in (out, given))
        status = "missing" if not made else "stale" if read and max(made) < max(read) else "ok"
        rows.append((s.name, status, [p for p, t in out.items() if t is None], max(made, default=None), max(read, default=None)))
    df = spark.createDataFrame(rows, "stage string, status string, missing array<string>, written long, input_written long")
    return df.selectExpr("stage", "status", "missing", "timestamp_millis(written) as written", "timestamp_millis(input_written) as input_written")

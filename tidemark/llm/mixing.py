"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, kept

#: What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that one rounding group holds on average.
GROUP = 1000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources(source, ...)`` with place (from 0) by code point, null last, without gathering the sources in one task:
    ranges are written once, and each row's place is its place in its range behind the rows of the ranges before."""
    parts = max(1, min(64, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = scratch.table(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window

    counts = scratch.table(dealt.groupBy("part").count())
    before = counts.alias("a").join(counts.alias("b"), F.col("a.part") > F.col("b.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").select(*sources.columns, (F.col("own") + F.col("before")).alias("place"))


def targets(sources: DataFrame, cycle: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """``sources(source, source_size)`` with target: weights repeat ``cycle`` in the order of sources; all targets add up
    to ``share`` of all sizes; one never exceeds ``most`` times its source's size, and what is cut off goes to the others
    by weight until none is above. At the end every target is min(most * size, level * weight) for one level, which rises
    as sources fill; each round is one aggregate over the sources."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    known = scratch.table(ranked(sources, scratch).withColumn("weight", weight))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    if share > most:
        raise ValueError("the share asked for exceeds what all sources can give")
    cap, level = F.col("source_size") * float(most), 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        filled, rest = known.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            break
        then = (share * total - (filled or 0)) / rest
        if then <= level * (1 + 1e-15):
            break
        level = then
    return known.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _summed(x: Column, scale: float = 2.0**50) -> Column:
    """The sum in fixed point, which does not depend on the order of rows as a floating one does: reruns agree to the last bit."""
    return F.sum((x * scale).cast("decimal(38,0)")).cast("double") / scale


def tilts(docs: DataFrame, wanted: DataFrame, most: float, scratch: Scratch, tolerance: float = 1e-9, most_rounds: int = 200) -> DataFrame:
    """(source, tilt, mean): entropy balancing of document rates.

    Of all rates 0 <= r <= ``most`` whose words meet each source's target, those nearest to 1 in relative entropy, the sum
    over documents of r log r - r + 1. They are r = min(most, exp(tilt * size / mean)), where mean is the source's mean size and
    the tilts minimise the convex dual

        sum over documents of f(tilt * size / mean) - sum over sources of tilt * target / mean,  f' = min(most, exp).

    So a source that is to grow repeats its long documents first, and one that is to shrink thins them first, each as
    little as its target allows. A Newton round is one distributed aggregate over documents - those of one source and size
    counted together - of the dual's gradient (words taken less target) and Hessian, which is diagonal as a document has
    one source. The step is taken between the logarithms of words taken and target, where the curve is flatter, and a
    bracket of each tilt, closed by the gradient's sign, holds it: a step that leaves it goes to its middle. Rounds end
    when each source's words are within ``tolerance`` of its target. A target of 0 (or no words) has tilt null, and so has
    one that asks for all there is; their rates are 0 and ``most``. ``docs(source, size, n)``, ``wanted(source, target)``.
    """
    grouped = scratch.table(docs.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")))
    sums = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("words"), F.sum("n").alias("rows"), F.min("size").alias("low"))
    known = wanted.withColumnRenamed("source", "_s").join(sums, F.col("_s").eqNullSafe(sums.source)).select("source", "target", "words", (F.col("words") / F.col("rows")).alias("mean"), F.col("low"))
    free = (F.col("target") > 0) & (F.col("target") < F.col("words") * most * (1 - tolerance))
    least = F.col("low") / F.col("mean")
    ratio = F.log(F.col("target") / F.col("words"))
    given = ["source", "target", "mean", "tilt", "lo", "hi"]
    state = scratch.table(known.where(free).select("source", "target", "mean", F.lit(0.0).alias("tilt"), (F.least(ratio, F.lit(0.0)) / least).alias("lo"), (F.lit(math.log(most)) / least).alias("hi")))
    met = []
    for _ in range(most_rounds):
        now = F.struct(*[F.col(f"now.{c}") for c in given]).alias("s")
        both = grouped.alias("g").join(state.alias("now"), F.col("g.source").eqNullSafe(F.col("now.source"))).select(now, "size", "n")
        x = F.col("size") / F.col("s.mean")
        rate = F.least(F.lit(float(most)), F.exp(F.col("s.tilt") * x))
        slope = F.when(rate < most, x * rate).otherwise(0.0)
        made = both.groupBy("s").agg(_summed(F.col("n") * F.col("size") * rate).alias("taken"), _summed(F.col("n") * F.col("size") * slope).alias("slope")).select("s.*", "taken", "slope")
        done = F.abs(F.col("taken") / F.col("target") - 1) <= tolerance
        over = F.col("taken") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - F.log(F.col("taken") / F.col("target")) * F.col("taken") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        then = F.when(done, F.col("tilt")).when(inside, newton).otherwise((lo + hi) / 2)
        seen = Observation()
        round_ = scratch.table(made.select("source", "target", "mean", then.alias("tilt"), lo.alias("lo"), hi.alias("hi"), done.alias("met")).observe(seen, F.count_if(~F.col("met")).alias("open")))
        met.append(round_.where("met").select("source", "tilt"))
        state = round_.where("not met").select(*given)
        if not seen.get.get("open"):
            break
    found = reduce(DataFrame.union, [*met, state.select("source", "tilt")])
    return known.withColumnRenamed("source", "_k").join(found.withColumnRenamed("source", "_s"), F.col("_k").eqNullSafe(F.col("_s")), "left").select(F.col("_k").alias("source"), "tilt", "mean")


def _rounded(most: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Largest documents first; what a rounding gains or loses is carried to the next, so that only the smallest are in error."""
        frame = frame.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
        carry, copies = 0.0, []
        for size, rate, n in zip(frame["size"].tolist(), frame["rate"].tolist(), frame["n"].tolist(), strict=True):
            want = n * size * rate + carry
            own = min(most * n, max(0, math.floor(want / size + 0.5))) if size else 0
            carry = want - own * size
            copies.append(own)
        return frame.assign(copies=copies)[["key", "doc_id", "size", "n", "source_size", "target", "rate", "copies"]]

    return run


def planned(docs: DataFrame, cycle: tuple[float, ...], share: float, most: int) -> DataFrame:
    """One row for all rows of one doc_id, text and source: key, doc_id, size, n (rows), source_size, target, rate, copies (of all n)."""
    if most < 1:
        raise ValueError("a document must be allowed at least once")
    with Scratch(docs.sparkSession) as scratch:
        sized = docs.select("doc_id", F.xxhash64("doc_id", "text", "source").alias("key"), "source", size_of(F.col("text")).alias("size"))
        sized = scratch.table(sized.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("n")))
        per = scratch.table(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.ceil(F.count("*") / GROUP).cast("int").alias("groups")))
        wanted = scratch.table(targets(per.select("source", "source_size"), cycle, share, most, scratch))
        tilted = tilts(sized, wanted, most, scratch).withColumnRenamed("source", "_s")
        known = per.join(wanted.select(F.col("source").alias("_w"), "target"), per.source.eqNullSafe(F.col("_w"))).join(tilted, per.source.eqNullSafe(F.col("_s")), "left")
        known = scratch.table(known.select(F.col("source").alias("_k"), "source_size", "groups", "target", "tilt", "mean"))
        rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("tilt").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
        rows = sized.join(known, sized.source.eqNullSafe(F.col("_k"))).withColumn("rate", rate).withColumn("group", F.pmod(F.col("key"), F.col("groups").cast("long")))
        id_type = docs.schema["doc_id"].dataType.simpleString()
        done = rows.select("source", "group", "key", "doc_id", "size", "n", "rate", "source_size", "target").groupBy("source", "group")
        return kept(done.applyInPandas(_rounded(most), f"key long, doc_id {id_type}, size long, n long, source_size long, target double, rate double, copies long"))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs(doc_id, text, source)`` -> one row per row: doc_id, key, size, source_size, target, rate, copies, taken.

    size counts words; targets are those of :func:`targets`, rates those of :func:`tilts`. Rates become whole copies,
    0 to ``most``, in groups of about ``GROUP`` documents of a source dealt by hash: within a group the largest documents
    are rounded first and each rounding's error is carried on, so a group ends within half a small document of its
    words. taken = copies * size. The result depends only on the rows, so reruns agree. Rows repeated with one doc_id,
    text and source are rounded together and share their copies evenly. key is a hash of these three.

    Null sources form one source, the last. Null texts have size 0 and are not taken; nor are texts without words.
    Other columns take no part.
    """
    each = planned(docs, cycle, share, most).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.expr("int((copies * i) div n - (copies * (i - 1)) div n)")
    return each.select("doc_id", "key", "size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it. Of rows repeated with one doc_id, text and source one stands for all."""
    total = planned(docs, (3, 1, 2), 1.5, 2).where("copies > 0").select(F.xxhash64("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("copies").cast("int").alias("_n"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id").alias("_id"), F.xxhash64("doc_id", "text", "source").alias("_key"))
    # keys without nulls: the join leaves rows dealt and sorted by them, so that repeated rows go without another shuffle
    once = keyed.join(total, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    return once.select("doc", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("doc.*")

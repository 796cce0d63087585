"""Keys: uniqueness of right sides, identity dedup, fallback group keys, rare categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, has_house_number

MISSING = "<missing>"
#: What makes two records the same sale.
IDENTITY = ("property_id", "contract_date", "purchase_price", "area")


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, or ValueError if a key repeats: a join on it would multiply rows. One aggregate; a limit ends it early."""
    again = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} is not unique: {again[0].asDict()}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that cannot multiply rows of ``left``; whether ``right`` is broadcast is left to its measured size."""
    return left.join(assert_unique(right, *on), on, how)


def keep_first(df: DataFrame, key: list[str] | tuple[str, ...], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order; nulls equal each other. An aggregate, not a window: each task keeps one
    row per key before the shuffle, so a key that most rows share does not meet in one task."""
    cols = df.columns
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*cols), rank).alias("row"))
    return picked.select("row.*")


def dedup_counts(df: DataFrame, key: list[str] | tuple[str, ...]) -> DataFrame:
    """One row: rows_in, rows_out, rows_removed of identity dedup."""
    return df.groupBy(*key).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows_in"), F.count("*").alias("rows_out"), (F.coalesce(F.sum("count"), F.lit(0)) - F.count("*")).alias("rows_removed"))


def add_group_key(df: DataFrame, address: str = "address", postcode: str = "post_code", property_id: str = "property_id") -> DataFrame:
    """``group_key`` and where it came from: ``ADDRESS|postcode`` where the address is numbered or no usable property id
    is there, else the property id. Never null or empty."""
    by_address = F.concat(F.coalesce(F.upper(blank_to_null(F.col(address))), F.lit(MISSING)), F.lit("|"), F.coalesce(F.col(postcode).cast("string"), F.lit(MISSING)))
    if property_id not in df.columns:
        return df.withColumns({"group_key": by_address, "group_key_source": F.lit("address")})
    own = blank_to_null(F.col(property_id).cast("string"))
    use_id = ~has_house_number(F.col(address)) & own.isNotNull()
    return df.withColumns({"group_key": F.when(use_id, own).otherwise(by_address), "group_key_source": F.when(use_id, "property_id").otherwise("address")})


def clean_category(df: DataFrame, column: str, min_count: int = 500, other: str = "OTHER") -> DataFrame:
    """Trimmed and upper-cased; values rarer than ``min_count`` become ``other``; null stays null. The counts come from an
    aggregate joined back, not from a window, so a common value is no single task."""
    code = F.upper(F.trim(F.col(column)))
    counts = df.groupBy(code.alias("_code")).agg(F.count("*").alias("_n"))
    joined = df.withColumn("_own", code).join(counts, F.col("_own").eqNullSafe(F.col("_code")), "left")
    return joined.withColumn(column, F.when(F.col("_own").isNotNull() & (F.col("_n") < min_count), other).otherwise(F.col("_own"))).drop("_own", "_code", "_n")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: column, missing, rows. One pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.column", "x.missing", "rows")

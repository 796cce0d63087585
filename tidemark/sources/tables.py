"""Reading: raw all-text CSV, lookups, reference series, events; writing: one call per sink."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import blank_to_null, last_number, number, postcode_key, split_list

RAW_COLUMNS = ("property_id", "address", "post_code", "property_type", "primary_purpose", "area", "area_type", "contract_date", "settlement_date", "purchase_price", "legal_description", "strata_lot_number", "council_name", "zoning", "nature_of_property", "district_code", "dealing_number")
#: Days from the end of a period to its publication.
RELEASE_LAG = 28


def raw_sales(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW_COLUMNS) -> DataFrame:
    """All columns as text, so that what fails to parse can be counted later; the schema is declared, never inferred."""
    return spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def count_rows(spark: SparkSession, path: str) -> int:
    return raw_sales(spark, path).count()


def clean(spark: SparkSession, path: str, floats: tuple[str, ...] = ("purchase_price", "area_sqm")) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumns({c: F.col(c).cast("double") for c in floats if c in df.columns})


def lookup_csv(spark: SparkSession, path: str, key: str = "postcode") -> DataFrame:
    """A lookup with a normalised key and blanks as null."""
    df = spark.read.csv(path, header=True)
    return df.select(*[(postcode_key(F.col(c)) if c == key else blank_to_null(F.col(c))).alias(c) for c in df.columns])


def cash_rate(spark: SparkSession, path: str) -> DataFrame:
    """(effective_date, cash_rate), one row a date; ValueError where a date has several rates. ``17.00 to 17.50`` gives its last number."""
    df = spark.read.csv(path, header=True).select(F.col("effective_date").try_cast("date").alias("effective_date"), last_number(F.col("cash_rate")).alias("cash_rate")).where("effective_date is not null and cash_rate is not null").distinct()
    again = df.groupBy("effective_date").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"conflicting rates on {again[0]['effective_date']}")
    return df.orderBy("effective_date")


def preamble_table(spark: SparkSession, path: str, skip: int = 10) -> DataFrame:
    """Text rows of a published table behind its preamble, as arrays of cells, with their place in the file. The file is
    one small publication, read as one row."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return lines.where((F.col("line") >= skip) & (F.trim("value") != "")).select("line", F.split("value", ",").alias("cells"))


def price_index(spark: SparkSession, path: str, lag_days: int = RELEASE_LAG) -> DataFrame:
    """(period_end, cpi_index, release_date): one row a period, known ``lag_days`` after its end."""
    df = spark.read.csv(path, header=True).select(F.col("period_end").try_cast("date").alias("period_end"), number(F.col("cpi_index")).alias("cpi_index")).where("period_end is not null and cpi_index is not null")
    one = df.groupBy("period_end").agg(F.max("cpi_index").alias("cpi_index"))
    return one.withColumn("release_date", F.date_add("period_end", lag_days)).orderBy("period_end")


@dataclass(frozen=True)
class MacroPanel:
    cash: DataFrame
    cpi: DataFrame

    def meta(self) -> dict:
        """Spans, for a sidecar. The index's base may change, so use its yearly change and not its level."""
        a = self.cash.agg(F.min("effective_date").alias("a"), F.max("effective_date").alias("b")).first()
        b = self.cpi.agg(F.min("period_end").alias("a"), F.max("period_end").alias("b")).first()
        return {"cash": [str(a["a"]), str(a["b"])], "cpi": [str(b["a"]), str(b["b"])], "lag_days": RELEASE_LAG}


def macro_panel(spark: SparkSession, cash_path: str, cpi_path: str) -> MacroPanel:
    return MacroPanel(cash_rate(spark, cash_path), price_index(spark, cpi_path))


def station_entrances(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(station, lat, lon) with known coordinates; ValueError if none is left."""
    df = spark.read.csv(path, header=True).select(F.trim("Train_Station").alias("station"), number(F.col("LAT")).alias("lat"), number(F.col("LONG")).alias("lon")).where("lat is not null and lon is not null")
    df = df.where(F.col("station").isin(names)) if names is not None else df
    if df.isEmpty():
        raise ValueError("no station entrance is left")
    return df


def events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.withColumns({"event_date": F.col("event_date").try_cast("date"), "stations": split_list(F.col("stations")), "opened_stations": split_list(F.col("opened_stations"))}).withColumn("event_month", F.trunc("event_date", "MM"))


def event(table: DataFrame, event_id: str):
    """The event's row; KeyError if it is not there."""
    got = table.where(F.col("event_id") == event_id).limit(1).collect()
    if not got:
        raise KeyError(event_id)
    return got[0]


def systematic_sample(df: DataFrame, day: str, key: str, step: int) -> DataFrame:
    """Every ``step``-th row in the order of day and ``key``, the first one included; rows without a day come last. Ranks are
    counted over ranges of days, so no task orders all."""
    from ..operators.metrics import with_rank

    placed = df.withColumn("_day", F.coalesce(F.unix_date(F.col(day).cast("date")), F.lit(10_000_000)))
    return with_rank(placed, "_day", key, "_r", "_all").where((F.col("_r") - 1) % step == 0).select(*df.columns)


def capped_sample(df: DataFrame, key: str, most: int, seed: int = 17) -> DataFrame:
    """``most`` rows by a seeded hash; the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(most)


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def to_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_json(value: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)


def from_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def md_table(df: DataFrame, n: int = 20, fmt: str = ".4g") -> str:
    """The first rows as Markdown."""
    rows = df.limit(n).collect()
    cell = lambda x: "" if x is None else format(x, fmt) if isinstance(x, float) else str(x)
    head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join('---' for _ in df.columns)}|"]
    return "\n".join(head + [f"| {' | '.join(cell(r[c]) for c in df.columns)} |" for r in rows])

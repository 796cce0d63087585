"""Staged cleaning with counts, the plausibility gate, and data contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import area_sqm, blank_to_null, contract_date, number, postcode_key, safe_ratio
from .keys import IDENTITY, add_group_key, keep_first, many_to_one


@dataclass(frozen=True)
class Bounds:
    """Limits that define results."""

    first_day: str = "2001-01-01"
    last_day: str = "2023-12-31"
    area: tuple[float, float] = (20.0, 10_000.0)
    price: tuple[float, float] = (10_000.0, 50_000_000.0)
    unit_price: tuple[float, float] = (10.0, 50_000.0)
    residential_area: tuple[float, float] = (100.0, 5_000.0)
    purpose: str = "RESIDENCE"
    kind: str = "house"


def staged_filter(df: DataFrame, stages: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every stage, one-row report). The report counts, in one pass, the rows in and those left after each
    stage in order; a null condition does not pass."""
    reached, counts = F.lit(True), [F.count("*").alias("rows_in")]
    for name, condition in stages.items():
        reached = reached & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(reached).alias(f"after_{name}"))
    return df.where(reached), df.agg(*counts)


def date_window(d: Column, first: str, last: str) -> Column:
    """Inclusive; a null date is outside."""
    return F.coalesce(d.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def valid_values(df: DataFrame, positive: list[str], not_negative: list[str]) -> Column:
    """Positive and finite where it must be; distances may be null but not negative. Columns that are absent are no condition."""
    fine = F.lit(True)
    for c in positive:
        if c in df.columns:
            fine = fine & F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    for c in not_negative:
        if c in df.columns:
            fine = fine & F.coalesce(F.col(c) >= 0, F.lit(True))
    return fine


def plausibility_rules(price: Column, area: Column, b: Bounds = Bounds()) -> dict[str, Column]:
    """Six overlapping violations; null never violates."""
    unit = safe_ratio(price, area)
    raw = {
        "area_low": area < b.area[0],
        "area_high": area > b.area[1],
        "price_low": price < b.price[0],
        "price_high": price > b.price[1],
        "unit_low": unit < b.unit_price[0],
        "unit_high": unit > b.unit_price[1],
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in raw.items()}


def plausibility_gate(df: DataFrame, price: str = "purchase_price", area: str = "area_sqm", b: Bounds = Bounds()) -> tuple[DataFrame, DataFrame]:
    """(rows without violation, one-row report of rows_in, each rule's count, dropped, rows_out); rules overlap."""
    rules = plausibility_rules(F.col(price), F.col(area), b)
    bad = F.lit(False)
    for rule in rules.values():
        bad = bad | rule
    report = df.agg(F.count("*").alias("rows_in"), *[F.count_if(v).alias(k) for k, v in rules.items()], F.count_if(bad).alias("dropped"), F.count_if(~bad).alias("rows_out"))
    return df.where(~bad), report


def residential(df: DataFrame, area: str = "area_sqm", b: Bounds = Bounds()) -> tuple[DataFrame, DataFrame]:
    inside = F.coalesce(F.col(area).between(*b.residential_area), F.lit(False))
    return df.where(inside), df.agg(F.count("*").alias("rows_in"), F.count_if(inside).alias("rows_out"), F.count_if(~inside).alias("dropped"))


# Columns that tell the target, are known only later, or name the row; no model may read them.
FORBIDDEN_FEATURES = (
    "purchase_price",
    "settlement_date",
    "download_date",
    "property_id",
    "legal_description",
    "address",
    "price_per_sqm",
    "cash_rate",
    "cpi",
    "development_type",
    "unit_price",
    "log_unit_price",
)


def contract(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, passed, violations): each check is an aggregate that counts violations; all are one pass over ``df``."""
    one = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), (F.col(name) == 0).alias("passed"), F.col(name).alias("violations")) for name in checks])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def assert_all(results: DataFrame) -> DataFrame:
    """``results``, or ValueError naming the checks that failed."""
    failed = [r["name"] for r in results.where(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"contracts failed: {', '.join(failed)}")
    return results


def clean_checks(df: DataFrame, b: Bounds = Bounds(), price: str = "purchase_price", area: str = "area_sqm", day: str = "contract_date", group: str = "group_key", distances: tuple[str, ...] = (), label: str | None = None, label_from: str = "2010-12-31") -> dict[str, Column]:
    """Contracts of a clean frame that one aggregate can judge."""
    rules = plausibility_rules(F.col(price), F.col(area), b)
    bad = F.lit(False)
    for rule in rules.values():
        bad = bad | rule
    checks = {
        "group_key_present": F.count_if(F.col(group).isNull() | (F.trim(F.col(group).cast("string")) == "")),
        "date_parsed": F.count_if(F.col(day).isNull()),
        "price_positive": F.count_if(F.coalesce(F.col(price) <= 0, F.lit(True))),
        "area_positive": F.count_if(F.col(area) <= 0),
        "plausible": F.count_if(bad),
    }
    for d in distances:
        if d in df.columns:
            checks[f"{d}_not_negative"] = F.count_if(F.col(d) < 0)
    if label:
        checks["label_legal"] = F.count_if(F.col(label).isNotNull() & (F.col(day) <= F.lit(label_from).cast("date")))
    return checks


def identity_contract(df: DataFrame, key: list[str] | tuple[str, ...] = IDENTITY) -> DataFrame:
    again = df.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
    return again.select(F.lit("identity_unique").alias("name"), (F.col("violations") == 0).alias("passed"), F.col("violations").cast("long").alias("violations"))


def areas_per_group_contract(df: DataFrame, group: str = "group_key", area: str = "area_sqm", most: int = 1000) -> DataFrame:
    """A group with very many areas is no dwelling."""
    wide = df.groupBy(group).agg(F.countDistinct(area).alias("n")).agg(F.count_if(F.col("n") > most).alias("violations"))
    return wide.select(F.lit("areas_per_group").alias("name"), (F.col("violations") == 0).alias("passed"), F.col("violations").cast("long").alias("violations"))


def check_features(columns: list[str]) -> None:
    """ValueError if a feature list holds a forbidden column."""
    bad = sorted(set(columns) & set(FORBIDDEN_FEATURES))
    if bad:
        raise ValueError(f"forbidden features: {bad}")


def coverage(df: DataFrame, postcode: str = "post_code", group: str = "group_key") -> DataFrame:
    """One row: rows, distinct postcodes and groups, rows whose group repeats. Groups are counted by aggregating twice."""
    per = df.groupBy(group).agg(F.count("*").alias("n"))
    left = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(group).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_on_repeated_groups"))
    return left.crossJoin(df.agg(F.countDistinct(postcode).alias("postcodes")))


def build_clean(raw: DataFrame, lookup: DataFrame, labels: DataFrame | None = None, b: Bounds = Bounds()) -> tuple[DataFrame, DataFrame]:
    """Raw all-text sales -> (clean frame, one-row report).

    Keys and numbers are parsed, lookup columns joined before any filter (an unmatched postcode then fails the required
    columns), labels attached as dates make them legal, then stages, identity dedup, units, values, plausibility and group
    keys. The order of equal identities is settlement_date, then all columns.
    """
    from .temporal import legal_label

    parsed = raw.withColumns(
        {
            "post_code": postcode_key(F.col("post_code")),
            "purchase_price": number(F.col("purchase_price")),
            "area": number(F.col("area")),
            "contract_date": contract_date(F.col("contract_date")),
            "address": blank_to_null(F.col("address")),
            "primary_purpose": F.upper(F.trim("primary_purpose")),
            "property_type": F.lower(F.trim("property_type")),
        }
    )
    joined = many_to_one(parsed, lookup, ["post_code"])
    if labels is not None:
        joined = many_to_one(joined, labels, ["post_code"])
        joined = joined.withColumn("development_type", legal_label(F.col("contract_date"), [("2014-12-31", F.col("development_type_v2014")), ("2010-12-31", F.col("development_type_v2010"))]))
    required = F.lit(True)
    for c in ("purchase_price", "area", "post_code", "dist_cbd"):
        if c in joined.columns:
            required = required & F.col(c).isNotNull()
    stages = {
        "window": date_window(F.col("contract_date"), b.first_day, b.last_day),
        "required": required,
        "purpose": F.col("primary_purpose") == b.purpose,
        "kind": F.col("property_type") == b.kind,
    }
    staged, report = staged_filter(joined, stages)
    order = ["settlement_date", *[c for c in staged.columns if c != "settlement_date"]] if "settlement_date" in staged.columns else staged.columns
    unique = keep_first(staged, IDENTITY, order)
    sized = unique.withColumn("area_sqm", area_sqm(F.col("area"), F.col("area_type")))
    valid = sized.where(valid_values(sized, ["purchase_price", "area_sqm"], [c for c in sized.columns if c.startswith("dist_")]))
    gated, _ = plausibility_gate(valid.withColumn("unit_price", safe_ratio(F.col("purchase_price"), F.col("area_sqm"))), b=b)
    return add_group_key(gated).drop("area", "area_type"), report

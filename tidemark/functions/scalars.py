"""Scalar expressions for dirty transaction data. All are built-in functions, null-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that may stand before the number of a numbered address.
UNIT_WORDS = ("UNIT", "U", "SHOP", "SUITE", "LOT", "FLAT", "LEVEL", "APT", "APARTMENT")
#: Square metres of an area unit.
AREA_UNITS = {"M": 1.0, "H": 10_000.0}
#: Date formats that are tried in this order; a text in none of them is null.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "d.M.yyyy")
#: Kilometres.
EARTH_RADIUS = 6371.0


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def postcode_key(c: Column) -> Column:
    """Trimmed, freed of a trailing ``.0``, zero-padded to four digits and never cut; null unless a whole number."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    number = text.try_cast("bigint").cast("string")
    return F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))


def contract_date(c: Column) -> Column:
    """A date from text in any of ``DATE_FORMATS``, day before month; a trailing ``.0`` is dropped; else null."""
    text = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])


def number(c: Column) -> Column:
    """A finite double from text, else null."""
    x = F.trim(c).try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def has_house_number(c: Column) -> Column:
    """Whether an address begins with a number, perhaps behind a unit word; null counts as no."""
    return F.coalesce(c.rlike(r"(?i)^\s*(?:(?:" + "|".join(UNIT_WORDS) + r")\s*)?\d"), F.lit(False))


def area_sqm(area: Column, unit: Column) -> Column:
    """Square metres; an unknown unit gives null."""
    code, factor = F.upper(F.trim(unit)), None
    for name, size in AREA_UNITS.items():
        factor = F.when(code == name, F.lit(size)) if factor is None else factor.when(code == name, F.lit(size))
    return area * factor


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def safe_log10(x: Column) -> Column:
    """log10 of what is positive, else null."""
    return F.log10(F.when(x > 0, x))


def month_floor(d: Column) -> Column:
    return F.trunc(d, "MM")


def months_between_floor(a: Column, b: Column) -> Column:
    """Whole calendar months from b to a, by year and month alone."""
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Spherical law of cosines; the cosine is clipped, so roundoff never leaves its domain; null for a null coordinate."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1))
    return F.when(cosine.isNotNull(), F.lit(EARTH_RADIUS) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def split_list(c: Column, mark: str = "|") -> Column:
    """Trimmed, non-empty parts of a delimited text."""
    return F.filter(F.transform(F.split(c, "\\" + mark), lambda x: F.trim(x)), lambda x: x != "")


def last_number(c: Column) -> Column:
    """The last number in a text like ``17.00 to 17.50``."""
    found = F.regexp_extract_all(c, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def calendar_features(d: Column) -> dict[str, Column]:
    """Year and month as texts, the month on a circle, and time in years."""
    angle = F.lit(6.283185307179586) * F.month(d) / 12
    return {
        "year": F.year(d).cast("string"),
        "month_num": F.month(d).cast("string"),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "year_num": F.year(d) + (F.month(d) - 1) / F.lit(12.0),
    }


def rank_bin(rank: Column, n: Column, bins: int) -> Column:
    """The bin, from 0, of 1-based ``rank`` of ``n`` in equal-frequency bins over [1, n] with right-closed edges. In whole
    numbers, so no roundoff moves an edge: the least b with rank - 1 <= (b + 1)(n - 1) / bins. One row is in bin 0."""
    r, m = (rank - 1).cast("long"), (n - 1).cast("long")
    return F.when(m > 0, F.greatest(F.lit(0).cast("long"), F.floor((r * bins + m - 1) / F.when(m > 0, m)) - 1)).otherwise(F.lit(0).cast("long")).cast("int")


def linear_quantiles(x: Column, at: list[float]) -> Column:
    """Exact quantiles with linear interpolation."""
    return F.percentile(x, F.array(*[F.lit(float(q)) for q in at]))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))

"""Distances to points, postcode lookups, treatment assignment and event panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import great_circle_km, half_even, linear_quantiles, median, month_floor, months_between_floor, postcode_key, safe_ratio
from .keys import assert_unique, many_to_one

#: Points of interest are a configuration table; more than this is refused, as they go to every task.
MOST_POINTS = 10_000


def nearest_km(df: DataFrame, points: list[tuple[float, float]], lat: str = "lat", lon: str = "lon", out: str = "nearest_km") -> DataFrame:
    """Great-circle distance to the nearest point; null coordinates give null. The points are an array literal that each row
    folds over, so no row is multiplied."""
    if len(points) > MOST_POINTS:
        raise ValueError("too many points for a literal; join them by cells instead")
    if not points:
        return df.withColumn(out, F.lit(None).cast("double"))
    table = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points])
    return df.withColumn(out, F.array_min(F.transform(table, lambda p: great_circle_km(F.col(lat), F.col(lon), p["lat"], p["lon"]))))


def centroids(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon", label: str | None = None, order: str | None = None) -> DataFrame:
    """Mean coordinates of each key, and the label that comes first in ``order``."""
    more = [F.min_by(label, order).alias(label)] if label and order else []
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(key).agg(F.avg(lat).alias(lat), F.avg(lon).alias(lon), *more)


def transport_features(postcodes: DataFrame, stations: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Postcode centroids in scope with distances to several sets of points, rounded half-even to two places; keys unique and
    distances known, or ValueError. ``postcodes(postcode, locality, sa4, state, type, lat, lon, file_order)``."""
    scope = postcodes.withColumn("postcode", postcode_key(F.col("postcode"))).where((F.col("state") == "NSW") & (F.col("type") == "Delivery Area") & (F.col("postcode").cast("int") >= 2000) & (F.col("lat") != 0) & (F.col("lon") != 0))
    out = scope.groupBy("postcode").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min_by("locality", "file_order").alias("locality"), F.min_by("sa4", "file_order").alias("sa4"))
    for name, points in stations.items():
        out = nearest_km(out, points, out=name).withColumn(name, half_even(F.col(name), 2))
    unknown = F.lit(False)
    for name in stations:
        unknown = unknown | F.col(name).isNull()
    if out.where(unknown).limit(1).count():
        raise ValueError("a distance is unknown")
    return assert_unique(out.drop("lat", "lon"), "postcode")


def development_labels(sales: DataFrame, windows: dict[str, tuple[str, str]], least: int = 50, share: float = 15.0) -> DataFrame:
    """Per postcode and version: sales and percent vacant land in the version's window, and the label: null under ``least``
    sales, Greenfield from ``share`` percent, else Established. One scan serves all windows.
    ``sales(post_code, contract_date, purpose)`` in scope."""
    agg = []
    for v, (a, b) in windows.items():
        within = F.col("contract_date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        agg += [F.count_if(within).alias(f"n_base_{v}"), F.count_if(within & (F.col("purpose") == "VACANT LAND")).alias(f"_v_{v}")]
    out = sales.where("post_code is not null").groupBy("post_code").agg(*agg)
    for v in windows:
        n = F.col(f"n_base_{v}")
        vacant = 100 * F.col(f"_v_{v}") / F.nullif(n.cast("double"), F.lit(0.0))
        out = out.withColumn(f"base_vac_{v}", vacant).withColumn(f"development_type_{v}", F.when(n >= least, F.when(vacant >= share, "Greenfield").otherwise("Established"))).drop(f"_v_{v}")
    return out


def development_label_meta(windows: dict[str, tuple[str, str]]) -> dict[str, str]:
    """Label column -> the last day on which it is not yet legal."""
    return {f"development_type_{v}": last for v, (_, last) in windows.items()}


def geo_distribution(df: DataFrame, key: str, distance: str, least: int = 3, radii: tuple[float, ...] = (1, 2, 3, 5)) -> DataFrame:
    """Per key with ``least`` known distances: n, quantiles, mean, range and shares within radii. dist_p25 is the distance
    within which a quarter of the points lie."""
    at = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    d = F.col(distance)
    made = df.where(d.isNotNull()).groupBy(key).agg(F.count("*").alias("n_points"), linear_quantiles(d, at).alias("q"), F.avg(d).alias("dist_mean"), (F.max(d) - F.min(d)).alias("dist_range"), *[F.avg((d <= r).cast("double")).alias(f"share_within_{r:g}km") for r in radii])
    return made.where(F.col("n_points") >= least).select("*", *[F.col("q")[i].alias(f"dist_p{round(q * 100):02d}") for i, q in enumerate(at)]).drop("q")


@dataclass(frozen=True)
class EventSpec:
    """Who is treated, who is a control, and the window around the event."""

    event: str
    radius: float = 2.0
    control_over: float = 3.0
    window: int = 24
    reference: int = -1
    regions: tuple[str, ...] | None = None


def assign_treatment(lookup: DataFrame, spec: EventSpec, geocoded: DataFrame | None = None, key: str = "post_code", centroid: str = "dist_metro_new", measured: str = "dist_p25", region: str = "sa4") -> DataFrame:
    """Each key with its distance, where the distance is from, and its arm: treated up to the radius, control beyond
    ``control_over`` in the regions, else null (in neither arm)."""
    df = many_to_one(lookup, geocoded.select(key, measured), [key]) if geocoded is not None else lookup.withColumn(measured, F.lit(None).cast("double"))
    d = F.coalesce(measured, centroid)
    fits = F.col(region).isin(*spec.regions) if spec.regions else F.lit(True)
    arm = F.when(d <= spec.radius, F.lit(1)).when((d > spec.control_over) & fits, F.lit(0))
    return df.select(*lookup.columns, d.alias("distance"), F.when(F.col(measured).isNotNull(), "geocoded").when(F.col(centroid).isNotNull(), "centroid").alias("distance_source"), arm.alias("treated"), (F.col(centroid) <= spec.radius).alias("treated_by_centroid"))


def treatment_summary(assigned: DataFrame, key: str = "post_code") -> DataFrame:
    return assigned.groupBy("treated").agg(F.countDistinct(key).alias("keys"), F.avg("distance").alias("mean_distance"), F.count_if(F.col("distance_source") == "geocoded").alias("geocoded"), F.count_if(F.col("treated_by_centroid") != (F.col("treated") == 1)).alias("disagree"))


def compare_definitions(a: DataFrame, b: DataFrame, key: str = "post_code") -> DataFrame:
    """Keys in both assignments and whether their arms agree."""
    return a.select(key, F.col("treated").alias("treated_a")).join(b.select(key, F.col("treated").alias("treated_b")), key).withColumn("agree", F.col("treated_a").eqNullSafe(F.col("treated_b")))


def event_panel(sales: DataFrame, assigned: DataFrame, spec: EventSpec, key: str = "post_code", day: str = "contract_date", price: str = "purchase_price", area: str = "area_sqm") -> DataFrame:
    """Months within the window around the event, of keys in an arm: n_sales, medians, treated and event_time."""
    arms = assert_unique(assigned.where("treated is not null").select(key, "treated"), key)
    t = months_between_floor(F.col(day), F.lit(spec.event).cast("date"))
    rows = sales.where(t.between(-spec.window, spec.window)).join(arms, key)
    made = rows.groupBy(key, month_floor(F.col(day)).alias("month"), "treated").agg(F.count("*").alias("n_sales"), median(F.col(price)).alias("median_price"), median(safe_ratio(F.col(price), F.col(area))).alias("median_unit_price"))
    return made.withColumn("event_time", months_between_floor(F.col("month"), F.lit(spec.event).cast("date")))

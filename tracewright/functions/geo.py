"""Distances on the sphere, to borders, and the evidence made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.fixed import BORDERS, CENTROIDS, DISTANCE_SCALE_KM, DISTANCE_WEIGHT, EARTH_RADIUS_KM, default_countries
from tracewright.functions.values import strip

POLYGON = "array<struct<lat:double,lon:double>>"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def segment_point(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """struct(d, lat, lon): the nearest point of the segment a-b in a plane at the point's latitude, and its distance."""
    ky = F.lit(math.pi * EARTH_RADIUS_KM / 180.0)
    kx = ky * F.cos(F.radians(lat))
    px, py, ax, ay = lon * kx, lat * ky, a["lon"] * kx, a["lat"] * ky
    dx, dy = b["lon"] * kx - ax, b["lat"] * ky - ay
    flat = (dx == 0) & (dy == 0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    near_lat = F.when(flat, a["lat"]).otherwise((ay + t * dy) / ky)
    near_lon = F.when(flat, a["lon"]).otherwise((ax + t * dx) / kx)
    return F.struct(haversine_km(lat, lon, near_lat, near_lon).alias("d"), near_lat.alias("lat"), near_lon.alias("lon"))


def border_point(lat: Column, lon: Column, polygon: Column) -> Column:
    """struct(d, lat, lon) of the border's nearest point; polygons of three and more vertices are closed. Inside too the
    distance is to the border. Null for fewer than two vertices."""
    n = F.size(polygon)
    ends = F.when(n > 2, F.concat(F.slice(polygon, 2, F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1))).otherwise(F.slice(polygon, 2, 1))
    starts = F.when(n > 2, polygon).otherwise(F.slice(polygon, 1, 1))
    segments = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.when(n >= 2, F.array_min(F.transform(segments, lambda s: segment_point(lat, lon, s["a"], s["b"]))))


def parse_polygon(text: Column) -> Column:
    """Vertices of a JSON list of pairs, or of objects with lat(itude) and lon(gitude) or lng; bad ones are left out.
    Null for fewer than two."""
    v = F.try_parse_json(text)
    items = F.try_variant_get(v, "$", "array<variant>")
    finite = lambda x: (~F.isnan(x)) & (F.abs(x) < float("inf"))

    def vertex(i: Column) -> Column:
        lat = F.coalesce(*(F.try_variant_get(i, p, "double") for p in ("$[0]", "$.latitude", "$.lat")))
        lon = F.coalesce(*(F.try_variant_get(i, p, "double") for p in ("$[1]", "$.longitude", "$.lon", "$.lng")))
        return F.when(finite(lat) & finite(lon), F.struct(lat.alias("lat"), lon.alias("lon")))

    out = F.filter(F.transform(items, vertex), lambda x: x.isNotNull())
    return F.when(F.size(out) >= 2, out)


def nations(spark: SparkSession, countries: list[str] | None = None) -> DataFrame:
    """A small table: nation (lower case), border, lat, lon. Countries without a known centre have (0, 0)."""
    names = [c.lower() for c in (countries if countries is not None else default_countries())]
    rows = []
    for n in sorted({*names, *BORDERS}):
        lat, lon = CENTROIDS.get(n, (0.0, 0.0)) if n in names else (None, None)
        rows.append((n, list(BORDERS[n]) if n in BORDERS else None, lat, lon))
    return spark.createDataFrame(rows, f"nation string, border {POLYGON}, lat double, lon double")


def with_distance(df: DataFrame, nation: str, lat: str, lon: str, polygon: str | None = None, at: tuple[str, str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """df with distance_km, distance_reference, reference_lat, reference_lon, distance_score and distance_adjustment.

    The row's own polygon goes first, then the nation's border, then the row's own point `at`, then the nation's centre;
    all are null without them or without a position. The nations table is of fixed size, so it is broadcast.
    """
    known = nations(df.sparkSession, countries).select(F.col("nation").alias("_geo_nation"), F.col("border").alias("_geo_border"), F.col("lat").alias("_geo_lat"), F.col("lon").alias("_geo_lon"))
    out = df.join(F.broadcast(known), F.lower(strip(F.coalesce(F.col(nation), F.lit("")))) == F.col("_geo_nation"), "left")
    border = F.coalesce(*([F.col(polygon)] if polygon else []), F.col("_geo_border"))
    point = border_point(F.col(lat), F.col(lon), border)
    own = F.when(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull(), F.struct(F.col(at[0]).alias("lat"), F.col(at[1]).alias("lon"))) if at else F.lit(None).cast("struct<lat:double,lon:double>")
    centre = F.coalesce(own, F.when(F.col("_geo_lat").isNotNull(), F.struct(F.col("_geo_lat").alias("lat"), F.col("_geo_lon").alias("lon"))))
    out = out.withColumn("_geo_point", point).withColumn("_geo_centre", centre)
    here = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    by_border = here & F.col("_geo_point").isNotNull()
    by_centre = here & F.col("_geo_centre").isNotNull()
    d = F.when(by_border, F.col("_geo_point.d")).when(by_centre, haversine_km(F.col(lat), F.col(lon), F.col("_geo_centre.lat"), F.col("_geo_centre.lon")))
    out = out.withColumn("distance_km", d)
    out = out.withColumn("distance_reference", F.when(by_border, "border").when(by_centre, "centroid"))
    out = out.withColumn("reference_lat", F.when(by_border, F.col("_geo_point.lat")).when(by_centre, F.col("_geo_centre.lat")))
    out = out.withColumn("reference_lon", F.when(by_border, F.col("_geo_point.lon")).when(by_centre, F.col("_geo_centre.lon")))
    out = out.withColumn("distance_score", F.exp(-F.col("distance_km") / DISTANCE_SCALE_KM))
    out = out.withColumn("distance_adjustment", F.lit(DISTANCE_WEIGHT) * F.col("distance_score"))
    return out.drop("_geo_nation", "_geo_border", "_geo_lat", "_geo_lon", "_geo_point", "_geo_centre")

"""ZIP-prefix centroids from raw geolocation points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions.geo import LAT_BOUNDS, LNG_BOUNDS, centroid_shift_m, in_box
from haulmark.operators.ordering import summarise
from haulmark.session import written

GEO_COLUMNS = ["zip_prefix", "lat", "lng", "city", "state"]


def exact_dedup(geo: DataFrame, cols=GEO_COLUMNS) -> DataFrame:
    """Distinct rows with the number of copies of each."""
    return geo.groupBy(*cols).agg(F.count("*").alias("copies"))


def box_filter(geo: DataFrame, lat_bounds=LAT_BOUNDS, lng_bounds=LNG_BOUNDS) -> tuple[DataFrame, DataFrame]:
    """Rows inside the country box, and the rejected rest."""
    inside = in_box("lat", "lng", lat_bounds, lng_bounds)
    return geo.filter(inside), geo.filter(~inside)


def zip_centroids(geo: DataFrame, stat: str = "mean", lat_bounds=LAT_BOUNDS, lng_bounds=LNG_BOUNDS) -> DataFrame:
    """One row per ZIP prefix.

    ``mean`` uses distinct points inside the country box and reports how far duplicates had
    moved the centre; ``median`` uses all raw points, as the price model does. Points are
    counted per distinct row first, so a prefix with very many copies stays cheap.
    """
    if stat == "median":
        centre = summarise(geo, ["zip_prefix"], {}, {"lat": ("lat", 0.5), "lng": ("lng", 0.5)})
        counted, _ = written(geo.groupBy(*GEO_COLUMNS).agg(F.count("*").alias("w")))
        return centre.join(_modes(counted), "zip_prefix")
    distinct, _ = written(exact_dedup(geo))
    points = distinct.withColumn("inside", in_box("lat", "lng", lat_bounds, lng_bounds))
    raw = F.sum("copies")
    clean = lambda c: F.avg(F.when(F.col("inside"), F.col(c)))
    out = points.groupBy("zip_prefix").agg(
        clean("lat").alias("lat"),
        clean("lng").alias("lng"),
        F.count(F.when(F.col("inside"), 1)).alias("n_points"),
        raw.alias("n_points_raw"),
        (F.sum(F.col("lat") * F.col("copies")) / raw).alias("lat_raw"),
        (F.sum(F.col("lng") * F.col("copies")) / raw).alias("lng_raw"),
        F.sum(F.when(~F.col("inside"), F.col("copies")).otherwise(0)).alias("points_out_of_bounds"),
    )
    out = out.filter("n_points > 0").join(
        _modes(points.filter("inside").withColumn("w", F.lit(1))), "zip_prefix"
    )
    return out.withColumns(
        {
            "duplicates_removed": F.col("n_points_raw") - F.col("n_points"),
            "centroid_shift_m": centroid_shift_m("lat", "lng", "lat_raw", "lng_raw"),
        }
    )


def _modes(points: DataFrame) -> DataFrame:
    """Most frequent city and state per prefix; ties go to the smallest value."""

    def mode(c):
        counted = points.filter(F.col(c).isNotNull()).groupBy("zip_prefix", c).agg(F.sum("w").alias("n"))
        return counted.groupBy("zip_prefix").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))

    keys = points.select("zip_prefix").distinct()
    return keys.join(mode("city"), "zip_prefix", "left").join(mode("state"), "zip_prefix", "left")


def city_centroids(centroids: DataFrame) -> DataFrame:
    """Median of the ZIP centroids of each city and state."""
    return summarise(centroids, ["city", "state"], {}, {"lat": ("lat", 0.5), "lng": ("lng", 0.5)})

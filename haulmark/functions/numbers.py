"""Binning, parsing and feature expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.base import col_of, flag

INF = math.inf

# Band edges and labels.
WEIGHT_BANDS_G = ([0, 300, 750, 2000, 5000, 15000, INF], ["<=300g", "301-750g", "751g-2kg", "2-5kg", "5-15kg", ">15kg"])
WEIGHT_BANDS_KG = ([0, 0.5, 1, 2, 5, 10, 30, 1e9], ["<0.5", "0.5-1", "1-2", "2-5", "5-10", "10-30", ">30"])
PRICE_BANDS_KG = ([0, 0.3, 0.5, 1, 2, 5, 10, 30, 1e9], ["<0.3", "0.3-0.5", "0.5-1", "1-2", "2-5", "5-10", "10-30", ">30"])
SELLER_TIERS = ([0, 10, 100, 1000, INF], ["1-10 pedidos", "11-100", "101-1000", ">1000"])
SELLER_SIZES = ([0, 10, 100, 1000, 1e9], ["1-10", "11-100", "101-1000", ">1000"])
CUBIC_DIVISOR = 6000.0


def round_scaled(value, places: int = 2) -> Column:
    """Rounds the value times a power of ten, as SQL's ``round`` on doubles does.

    ``F.round`` rounds the shortest decimal form instead: 1.255, stored a little below, would give 1.26.
    """
    return F.round(col_of(value) * float(10**places)) / float(10**places)


def cut(value, edges, labels) -> Column:
    """Right-closed bins: a value at or below the first edge, or above the last, gives null."""
    x, out = col_of(value), None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        test = F.lit(True) if low == -INF else x > F.lit(float(low))
        if high != INF:
            test = test & (x <= F.lit(float(high)))
        test = test & x.isNotNull()
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def cut_ordinal(value, edges) -> Column:
    """One-based position of the right-closed bin, for sorting."""
    return cut(value, edges, list(range(1, len(edges))))


def parse_bool(value) -> Column:
    """``true``, ``1`` and ``sim`` in any case; everything else, null included, is false."""
    return flag(F.lower(col_of(value).cast("string")).isin("true", "1", "sim"))


def parse_number_ptbr(value, thousands_dot: bool = True) -> Column:
    """Number as typed in a Brazilian sheet: currency and spaces dropped, comma as decimal.

    With ``thousands_dot`` a text such as ``8.000`` is eight thousand; without it, eight.
    """
    text = F.regexp_replace(col_of(value).cast("string"), "[^\\d,.\\-]", "")
    plain = F.when(text.contains(","), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    if thousands_dot:
        plain = plain.when(text.rlike("^-?\\d{1,3}(\\.\\d{3})+$"), F.replace(text, F.lit("."), F.lit("")))
    return plain.otherwise(text).try_cast("double")


# Accepted date layouts.
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]


def parse_date_multi(value, formats=DATE_FORMATS) -> Column:
    """First layout that reads the leading ten characters, else null."""
    text = F.substring(F.trim(col_of(value).cast("string")), 1, 10)
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def finite(value) -> Column:
    """Not-a-number and infinities become null."""
    x = col_of(value).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), None).otherwise(x)


def require(df: DataFrame, numeric: list[str], other: list[str] = ()) -> DataFrame:
    """Drop rows in which a required column is missing or not finite."""
    out = df.withColumns({c: finite(c) for c in numeric})
    return out.dropna(subset=[*numeric, *other])


def ratio(top, bottom) -> Column:
    """Null when the denominator is zero."""
    return col_of(top) / F.nullif(col_of(bottom).cast("double"), F.lit(0.0))


def cubage(df: DataFrame, divisor: float = CUBIC_DIVISOR) -> DataFrame:
    """Cubic weight, density, freight per kilogram and freight as a share of the value."""
    return (
        df.withColumn("weight_total_kg", F.col("weight_total_g") / 1000.0)
        .withColumn("cubic_weight_kg", F.col("volume_cm3") / F.lit(float(divisor)))
        .withColumn("density", ratio("weight_total_kg", "cubic_weight_kg"))
        .withColumn("freight_per_kg", ratio("freight_value", "weight_total_kg"))
        .withColumn("freight_pct_value", 100 * ratio("freight_value", "declared_value"))
    )


# Model feature lists.
PRICE_NUMERIC = ["distance_km", "weight_total_kg", "quantity_items", "declared_value", "month"]
PRICE_CATEGORICAL = ["origin_state", "dest_state", "route", "same_state", "geo_profile"]
PRICE_LOG = ["distance_km", "weight_total_kg", "quantity_items", "declared_value"]
SEGMENT_FEATURES = [
    "distance_km", "weight_total_kg", "cubic_weight_kg", "declared_value", "quantity_items", "log_density",
]
SEGMENT_LOG = ["distance_km", "weight_total_kg", "cubic_weight_kg", "declared_value", "quantity_items"]


def prepare_features(df: DataFrame) -> DataFrame:
    """Model inputs for pricing: numbers floored at zero, four of them logged, labels filled."""
    cols = {}
    for c in PRICE_NUMERIC:
        x = F.greatest(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))
        cols["x_" + c] = F.log1p(x) if c in PRICE_LOG else x
    for c in PRICE_CATEGORICAL:
        cols["x_" + c] = F.coalesce(F.col(c).cast("string"), F.lit("desconhecido"))
    return df.withColumns(cols)


def prepare_segment_features(df: DataFrame) -> DataFrame:
    """Model inputs for segmentation: five logs, the log density floored, missing as zero."""
    cols = {}
    for c in SEGMENT_LOG:
        cols["x_" + c] = F.coalesce(F.log1p(F.greatest(F.col(c).try_cast("double"), F.lit(0.0))), F.lit(0.0))
    cols["x_log_density"] = F.when(F.col("density").isNull(), 0.0).otherwise(
        F.log(F.greatest(F.col("density"), F.lit(1e-3)))
    )
    return df.withColumns(cols)


def valid_shipments(df: DataFrame, strict: bool = False) -> DataFrame:
    """Domain filter; ``strict`` is the rule set of the segmentation."""
    if not strict:
        return df.filter("freight_value >= 0 AND weight_total_kg > 0 AND quantity_items > 0")
    return df.filter(
        "freight_value > 0 AND weight_total_kg > 0 AND cubic_weight_kg > 0 AND declared_value > 0 "
        "AND quantity_items > 0 AND lead_days > 0"
    )

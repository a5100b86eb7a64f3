"""Distances and places on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.base import col_of, flag
from haulmark.functions.text import plain_text

# The two Earth radii in use, the metres per degree, the country box.
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_SHORT_KM = 6371.0
METRES_PER_DEGREE = 111_320
LAT_BOUNDS = (-34.0, 5.3)
LNG_BOUNDS = (-74.0, -34.8)

# State capitals in plain form.
CAPITALS = [
    "aracaju", "belem", "belo horizonte", "boa vista", "brasilia", "campo grande", "cuiaba",
    "curitiba", "florianopolis", "fortaleza", "goiania", "joao pessoa", "macapa", "maceio",
    "manaus", "natal", "palmas", "porto alegre", "porto velho", "recife", "rio branco",
    "rio de janeiro", "salvador", "sao luis", "sao paulo", "teresina", "vitoria",
]

# Macro-region of each state.
STATE_REGIONS = {
    "N": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "NE": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "CO": ["DF", "GO", "MT", "MS"],
    "SE": ["ES", "MG", "RJ", "SP"],
    "S": ["PR", "RS", "SC"],
}


def haversine_km(lat1, lng1, lat2, lng2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance; null when any coordinate is missing."""
    a1, a2 = F.radians(col_of(lat1)), F.radians(col_of(lat2))
    d_lng = F.radians(col_of(lng2)) - F.radians(col_of(lng1))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(d_lng / 2), 2)
    return F.when(h.isNotNull(), F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))))


def centroid_shift_m(lat, lng, raw_lat, raw_lng) -> Column:
    """How far the raw mean lies from the clean centroid, flat-Earth metres, one digit."""
    d_lng = (col_of(lng) - col_of(raw_lng)) * F.cos(F.radians(col_of(lat)))
    return F.round(F.hypot(col_of(lat) - col_of(raw_lat), d_lng) * METRES_PER_DEGREE, 1)


def city_kind(city, capitals=CAPITALS) -> Column:
    """``capital`` or ``interior``."""
    return F.when(plain_text(city).isin(*capitals), "capital").otherwise("interior")


def geo_profile(origin_city, dest_city, capitals=CAPITALS) -> Column:
    """``capital`` or ``interior`` for each end, joined by an underscore."""
    return F.concat_ws("_", city_kind(origin_city, capitals), city_kind(dest_city, capitals))


def region_of(state, regions: dict[str, list[str]] = STATE_REGIONS, unknown: str = "?") -> Column:
    """Macro-region of a state; unknown or missing states get the given label."""
    out = None
    for region, states in regions.items():
        test = col_of(state).isin(*states)
        out = F.when(test, region) if out is None else out.when(test, region)
    return out.otherwise(unknown)


def route_key(origin_state, dest_state) -> Column:
    """``A>B``; null when an end is unknown."""
    return F.concat(col_of(origin_state), F.lit(">"), col_of(dest_state))


def same_state(origin_state, dest_state) -> Column:
    return F.when(flag(col_of(origin_state) == col_of(dest_state)), "same_state").otherwise("interstate")


def in_box(lat, lng, lat_bounds=LAT_BOUNDS, lng_bounds=LNG_BOUNDS) -> Column:
    return flag(col_of(lat).between(*lat_bounds) & col_of(lng).between(*lng_bounds))

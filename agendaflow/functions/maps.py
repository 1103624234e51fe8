"""Look-ups and geometry for the map as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Colours of styles on the map of a city, and of all other cities (fixed values: red, green, blue).
PALETTES = {
    "hanoi": {"Art": "23, 128, 251", "Photo": "40, 124, 18", "Conference": "255, 255, 0", "Musique": "255, 0, 0", "Expo": "224, 147, 40", "Theatre": "165,42,42"},
    "": {"Rock": "230, 0, 30", "Electro": "0, 255, 150", "Jazz": "255, 140, 0", "Rap": "111, 0, 170", "Chanson": "255, 60, 120", "Live": "125, 125, 125", "Classique": "20, 40, 160"},
}


def style_colour(style: Column, city: Column, alpha: float = 0.5) -> Column:
    """The colour of a style on the map of a city as ``rgba(...)``, black where it has none."""
    table = lambda c: F.create_map(*[F.lit(x) for kv in PALETTES[c].items() for x in kv])[style]
    return F.concat(F.lit("rgba("), F.coalesce(F.when(city == "hanoi", table("hanoi")).otherwise(table("")), F.lit("0, 0, 0")), F.lit(f", {alpha})"))


def choose(key: Column, values: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(table[key], F.lit(default))


def interpolate(x: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Linear between two points, constant outside."""
    inside = F.least(F.greatest(x, F.lit(x0)), F.lit(x1))
    return F.lit(y0) + (inside - F.lit(x0)) * F.lit(y1 - y0) / F.lit(x1 - x0)


def in_circle(x: Column, y: Column, x0: Column, y0: Column, radius: Column) -> Column:
    return F.hypot(x - x0, y - y0) <= radius


def wrap_longitude(longitude: Column, near: Column) -> Column:
    """The longitude plus full turns, at most 180 degrees from ``near``."""
    return longitude + 360 * F.round((near - longitude) / 360)


def place_feature(title: Column, longitude: Column, latitude: Column, icon: Column, description: Column, city: Column) -> Column:
    properties = F.struct(title.alias("title"), icon.alias("icon"), description.alias("description"), city.alias("city"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), title.alias("id"), geometry.alias("geometry"), properties.alias("properties"))


def event_id(place: Column, title: Column, time: Column) -> Column:
    """The same id for the same event in every run."""
    return F.hex(F.xxhash64(place, title, time))

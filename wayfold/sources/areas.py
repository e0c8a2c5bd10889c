"""Polygons from GeoJSON: a FeatureCollection a file, or a feature a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
_POLYGON = "array<array<array<double>>>"


def areas(spark: SparkSession, path: str, names: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    """province, city, county, town and rings (array<array<struct<lat, lon>>>, holes included) of each polygon; a MultiPolygon
    gives a row for each part.

    names: the property behind each place (by default of the same name); absent ones are null. Other geometries and
    broken features are left out. lines=True reads a feature a line, which large files need:
    a FeatureCollection is one value.
    """
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        features = text.select(F.from_json("value", _FEATURE).alias("f"))
    else:
        features = text.select(F.explode(F.from_json("value", f"struct<features: array<{_FEATURE}>>")["features"]).alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(raw, _POLYGON))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{_POLYGON}>"))

    def place(name: str) -> Column:
        return F.col("f.properties")[(names or {}).get(name, name)].alias(name)

    rows = features.select(*(place(n) for n in ("province", "city", "county", "town")), F.explode(parts).alias("rings"))
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))))
    return rows.select("province", "city", "county", "town", rings.alias("rings")).where("size(rings) > 0")

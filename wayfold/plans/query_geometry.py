"""Queries over polygons with holes, read from shapefiles that Spark writes from the nation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import behavior, foundation
from wayfold.plans.oracles import sql
from wayfold.plans.queries import query
from wayfold.sources.shapefile import shapefile_areas, write_shapefiles
from wayfold.sources.trace import table, trace_points

#: A region's corners around its middle, in degrees, and the scales of its outer ring, its hole and the island in it.
CORNERS = ((-0.2, -0.3), (-0.18, 0.3), (0.05, 0.24), (0.2, 0.28), (0.18, -0.3))
SCALES = (1.0, 0.6, 0.25)


def nation_areas(spark: SparkSession, folder: str) -> DataFrame:
    """A region for each nation, with a hole and an island in it, over the box of the traces."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lat = F.lit(22.0) + F.lit(0.41) * (F.col("n_nationkey") % 5) + F.lit(0.2)
    lon = F.lit(113.0) + F.lit(0.61) * F.floor(F.col("n_nationkey") / 5) + F.lit(0.3)

    def ring(scale: float) -> Column:
        return F.array(*(F.struct((lat + dy * scale).alias("lat"), (lon + dx * scale).alias("lon")) for dy, dx in CORNERS))

    county = F.concat("n_name", F.lit("-c"))
    return nations.select(F.col("r_name").alias("province"), F.col("n_name").alias("city"), county.alias("county"), F.lit(None).cast("string").alias("town"), F.array(*(ring(s) for s in SCALES)).alias("rings"))


@query(sql("points", "SELECT p.id, min(h.province) AS province, min(h.city) AS city FROM points p LEFT JOIN hit h ON h.id = p.id GROUP BY p.id", more={
    "area": "SELECT r_name AS province, n_name AS city, 22.0E0 + 0.41E0 * (n_nationkey % 5) + 0.2E0 AS mlat, 113.0E0 + 0.61E0 * (n_nationkey // 5) + 0.3E0 AS mlon FROM nation JOIN region ON n_regionkey = r_regionkey",
    "corner": f"SELECT * FROM (VALUES {', '.join(f'({k}, {dy}E0, {dx}E0)' for k, (dy, dx) in enumerate(CORNERS))}) c(k, dy, dx)",
    "scale": f"SELECT unnest([{', '.join(f'{s}E0' for s in SCALES)}]) AS s",
    "edge": f"SELECT province, city, mlat + a.dy * s AS y1, mlon + a.dx * s AS x1, mlat + b.dy * s AS y2, mlon + b.dx * s AS x2 FROM area, scale, corner a JOIN corner b ON b.k = (a.k + {len(CORNERS) - 1}) % {len(CORNERS)}",
    "hit": "SELECT id, edge.province, edge.city FROM points JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, edge.province, edge.city HAVING count(*) % 2 = 1",
}))
def geocode_shapefile(spark: SparkSession, folder: str) -> DataFrame:
    """All fixes in regions with holes, written as shapefiles and read back by ranges of records."""
    regions = shapefile_areas(spark, write_shapefiles(nation_areas(spark, folder).repartition(3, "city")), records="4")
    bare = trace_points(spark, folder).withColumns({p: F.lit(None).cast("string") for p in behavior.PLACES})
    return foundation.reverse_geocode(bare, regions, most_edges=4).select("id", "province", "city")

"""Trips and events as cards and on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geo import metres_per_degree, uncertainty_m

#: Of the earliest files of a group, so many are asked for a thumbnail.
COVERS = 24


def cards(groups: DataFrame, media: DataFrame, key: str, source_id: int | None = None) -> DataFrame:
    """id, name, started, ended, photos, cover of each group, counted in one aggregation.

    The cover is the first of the earliest COVERS files that has a thumbnail, else the earliest; undated files come
    first. With source_id only its files count, and groups without any are left out.
    """
    members = media.where(F.col(key).isNotNull())
    counted = members if source_id is None else members.where(F.col("source_id") == source_id)
    counts = counted.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("photos"))
    first = Window.partitionBy(key).orderBy(F.col("taken_at").asc_nulls_first(), "id")
    early = members.select(key, "id", "has_thumbnail", F.row_number().over(first).alias("_nth")).where(F.col("_nth") <= COVERS)
    cover = early.groupBy(F.col(key).alias("group_id")).agg(F.min(F.struct(~F.col("has_thumbnail"), "_nth", "id")).alias("_x")).select("group_id", F.col("_x.id").alias("cover"))
    found = groups.join(counts, "id", "left" if source_id is None else "inner").join(cover, F.col("id") == F.col("group_id"), "left")
    return found.select("id", "name", "started", "ended", F.coalesce("photos", F.lit(0)).alias("photos"), "cover")


def points(media: DataFrame) -> DataFrame:
    """id, lat, lon, radius_m, estimated: the own place of each file, or the inherited one (est_lat, est_lon, delta_s)."""
    own = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    lat, lon = F.when(own, F.col("gps_lat")).otherwise(F.col("est_lat")), F.when(own, F.col("gps_lon")).otherwise(F.col("est_lon"))
    return media.withColumns({"lat": lat, "lon": lon, "estimated": ~own & F.col("est_lat").isNotNull(), "radius_m": F.when(~own & F.col("est_lat").isNotNull(), uncertainty_m(F.col("delta_s")))})


def map_summary(placed: DataFrame, key: str) -> DataFrame:
    """Of each group: files, those on the map, own and estimated, those without a place, and the box of all circles."""
    north, east = metres_per_degree(F.col("lat"))
    up, side = F.coalesce(F.col("radius_m") / north, F.lit(0.0)), F.coalesce(F.col("radius_m") / east, F.lit(0.0))
    on = F.col("lat").isNotNull()
    return placed.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(on).alias("on_map"), F.count_if(~on).alias("without"), F.count_if(F.col("estimated")).alias("estimated"),
        F.round(F.min(F.col("lat") - up), 6).alias("south"), F.round(F.max(F.col("lat") + up), 6).alias("north"), F.round(F.min(F.col("lon") - side), 6).alias("west"), F.round(F.max(F.col("lon") + side), 6).alias("east"),
    )


def map_places(placed: DataFrame, unreachable: Column) -> DataFrame:
    """Files by place, to five decimals: how many own and inherited, the largest circle, those out of reach, and the kind."""
    per = placed.where("lat IS NOT NULL").groupBy(F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
    out = per.agg(F.count("*").alias("n"), F.count_if(~F.col("estimated")).alias("own"), F.count_if("estimated").alias("inherited"), F.max("radius_m").alias("radius_m"), F.count_if(unreachable).alias("unreachable"))
    kind = F.when(F.col("inherited") == 0, "read").when(F.col("own") == 0, "estimated").otherwise("mixed")
    return out.withColumn("kind", kind)


def projected(placed: DataFrame, box: DataFrame, key: str) -> DataFrame:
    """x, y of each file in its group's box: degrees of longitude shrunk by the middle latitude, one scale for both axes."""
    shrink = F.cos(F.radians((F.col("south") + F.col("north")) / 2))
    scale = F.greatest((F.col("east") - F.col("west")) * shrink, F.col("north") - F.col("south"), F.lit(1e-9))
    rows = placed.where("lat IS NOT NULL").join(box.select(key, "south", "north", "west", "east"), key)
    return rows.select("id", key, F.round((F.col("lon") - F.col("west")) * shrink / scale, 6).alias("x"), F.round((F.col("north") - F.col("lat")) / scale, 6).alias("y"))

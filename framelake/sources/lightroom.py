"""A Lightroom catalog's tables as assets of an outside catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.sources.external import ASSETS

#: Fixed value: the rating from which on an image is a favourite.
FAVOURITE = 4


def assets(images: DataFrame, files: DataFrame, folders: DataFrame, roots: DataFrame, exif: DataFrame, collections: DataFrame, keywords: DataFrame) -> DataFrame:
    """References (ASSETS) of every image whose file has a global id; no file is opened.

    images: image_id, file_id, capture, rating, pick. files: file_id, global_id, folder_id, base, extension. folders:
    folder_id, root_id, path. roots: root_id, path. exif: image_id, gps_lat, gps_lon. collections and keywords: image_id,
    name. An image without a base name has neither name nor place, one without a root a name only; a moment is a wall
    clock, whatever zone is written after it; names of collections and keywords come once each, in order.
    """
    placed = folders.select("folder_id", "root_id", F.col("path").alias("_inner")).join(roots.select("root_id", F.col("path").alias("_root")), "root_id")
    rows = images.join(files, "file_id").join(placed, "folder_id").join(exif, "image_id", "left").where("coalesce(global_id, '') <> ''")
    listed = lambda of, c: of.where("coalesce(name, '') <> ''").groupBy("image_id").agg(F.array_sort(F.collect_set("name")).alias(c))
    rows = rows.join(listed(collections, "albums"), "image_id", "left").join(listed(keywords, "keywords"), "image_id", "left")
    name = F.when(F.coalesce("base", F.lit("")) != "", F.concat("base", F.when(F.coalesce("extension", F.lit("")) != "", F.concat(F.lit("."), "extension")).otherwise("")))
    path = F.when(F.coalesce("_root", F.lit("")) != "", F.concat("_root", F.coalesce("_inner", F.lit("")), name))
    wall = F.regexp_replace(F.trim("capture"), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    none = F.array().cast("array<string>")
    known = {
        "external_id": F.col("global_id"), "original_path": path, "name": name, "taken_at": F.coalesce(wall.try_cast("timestamp_ntz"), F.substring(wall, 1, 19).try_cast("timestamp_ntz"), F.substring(wall, 1, 10).try_cast("timestamp_ntz")),
        "gps_lat": F.col("gps_lat"), "gps_lon": F.col("gps_lon"), "favourite": (F.coalesce("rating", F.lit(0.0)) >= FAVOURITE) | (F.coalesce("pick", F.lit(0.0)) > 0),
        "albums": F.coalesce("albums", none), "people": none, "keywords": F.coalesce("keywords", none), "is_reference": F.lit(True),
    }
    kinds = [x.split() for x in ASSETS.replace("\n", " ").split(",")]
    return rows.select(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds))

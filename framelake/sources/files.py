"""Files on disk as a DataFrame: discovery, packages, metadata tags and sidecars."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.dates import any_date, offset_seconds

#: Media extensions, junk names, package suffixes, and folders inside a package that hold originals.
MEDIA = (
    "jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp", "gif", "heic", "heif", "hif",
    "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "mp4", "mov", "avi", "m4v",
)
JUNK = (".DS_Store", "Thumbs.db", "desktop.ini")
PACKAGES = (".photoslibrary", ".photolibrary", ".migratedphotolibrary", ".aplibrary", ".lrdata")
ORIGINALS = ("originals", "masters")


def discovered(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """path, bytes, mtime, ext of the media files under root; hidden and ignored names and junk are left out.

    Only the listing is read, not the contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    name = F.element_at(F.split("path", "/"), -1)
    base = "/" + re.sub(r"^\w+:", "", root).strip("/") + "/"
    inside = F.substring("path", F.instr("path", base) + len(base), F.length("path"))
    parts = F.split(inside, "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    keep = ~hidden & ~name.isin(*JUNK) & extension(name).isin(*MEDIA)
    if ignored:
        keep = keep & ~reduce(Column.__or__, [F.concat(F.lit("/"), inside).like(p.replace("*", "%")) | name.like(p.replace("*", "%")) for p in ignored])
    return files.where(keep).withColumn("ext", extension(name))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def role_in_package(path: Column) -> Column:
    """'derived' inside a package, unless the first package in the path is followed by its originals; else 'own'.

    Preview packages have no originals.
    """
    parts = F.split(F.lower(path), "/")
    packed = lambda p: reduce(Column.__or__, [p.endswith(s) for s in PACKAGES])
    at = F.array_position(F.transform(parts, packed), True).cast("int")
    first, after = F.get(parts, at - 1), F.get(parts, at)
    keeps = ~first.endswith(".lrdata") & F.coalesce(after.isin(*ORIGINALS), F.lit(False))
    return F.when((at == 0) | keeps, "own").otherwise("derived")


#: The tags that give each column, the first that is set wins.
PRECEDENCE = {
    "taken_at": ("EXIF:DateTimeOriginal", "EXIF:CreateDate", "XMP:DateTimeOriginal", "QuickTime:CreateDate"),
    "make": ("EXIF:Make", "XMP:Make", "QuickTime:Make"),
    "model": ("EXIF:Model", "XMP:Model", "QuickTime:Model"),
    "offset": ("EXIF:OffsetTimeOriginal", "EXIF:OffsetTime"),
}


def from_tags(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """rows with taken_at, taken_utc, make and model out of a map of tags; utc needs an offset."""
    first = {k: F.coalesce(*(F.nullif(F.trim(F.try_element_at(tags, F.lit(t))), F.lit("")) for t in v)) for k, v in PRECEDENCE.items()}
    out = rows.withColumns({"taken_at": any_date(first["taken_at"]), "make": first["make"], "model": first["model"], "_offset": offset_seconds(first["offset"])})
    return out.withColumn("taken_utc", F.col("taken_at") - F.make_dt_interval(secs=F.col("_offset"))).drop("_offset")


def keyword_levels(text: Column) -> Column:
    """`a|b, c` as [a|b, a, b, c]: the whole path of a hierarchy and each of its levels, without repeats."""
    each = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(each, lambda x: F.when(x.contains("|"), F.concat(F.array(x), F.transform(F.split(x, r"\|"), lambda y: F.trim(y)))).otherwise(F.array(x)))))


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files (path, tags) with the tags of their sidecar (path, tags) over their own.

    A sidecar is `photo.jpg.xmp`, else `photo.xmp` where one file only has that stem. If it has any date, all the
    file's own dates go.
    """
    stem = lambda p: F.regexp_replace(p, r"\.[^./]*$", "")
    side = sidecars.select(stem(F.lower("path")).alias("_key"), F.col("tags").alias("_side"))
    own = files.withColumn("_full", F.lower("path")).withColumn("_stem", stem(F.lower("path")))
    lone = own.groupBy("_stem").agg(F.count("*").alias("_k"))
    full = own.join(side, own["_full"] == side["_key"], "left").withColumnRenamed("_side", "_a").drop("_key")
    both = full.join(lone, "_stem").join(side, (F.col("_stem") == F.col("_key")) & (F.col("_k") == 1), "left")
    found = F.coalesce("_a", "_side")
    dated = F.coalesce(F.exists(F.map_keys(found), lambda k: k.contains("Date")), F.lit(False))
    kept = F.map_filter("tags", lambda k, v: ~(dated & (k.contains("Date") | k.contains("Offset"))) & ~F.coalesce(F.map_contains_key(found, k), F.lit(False)))
    return both.withColumn("tags", F.when(found.isNull(), F.col("tags")).otherwise(F.map_concat(kept, found))).select(*files.columns)


TAKEOUT = "photoTakenTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double>, geoDataExif struct<latitude:double,longitude:double>, description string, favorited boolean, people array<struct<name:string>>"


def takeout(sidecars: DataFrame, json: str = "json") -> DataFrame:
    """taken_utc, gps_lat, gps_lon, favourite, people, album out of an export's JSON sidecars (path, json).

    0/0 is no place; the album is the folder, unless it is one of the export's own by year.
    """
    x = sidecars.withColumn("_x", F.from_json(json, TAKEOUT))
    real = lambda g: F.when((g["latitude"] != 0) | (g["longitude"] != 0), g)
    place = F.coalesce(real(F.col("_x.geoData")), real(F.col("_x.geoDataExif")))
    folder = F.element_at(F.split("path", "/"), -2)
    seconds = F.col("_x.photoTakenTime.timestamp").try_cast("long")
    return x.select("path", F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("taken_utc"), place["latitude"].alias("gps_lat"), place["longitude"].alias("gps_lon"), F.coalesce("_x.favorited", F.lit(False)).alias("favourite"), F.transform("_x.people", lambda p: p["name"]).alias("people"), F.when(~folder.rlike(r"^Photos from \d{4}$"), folder).alias("album"))

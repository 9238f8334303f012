"""Queries that cross the catalog's border: assets of outside libraries come in, verified copies go out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.registry import query
from framelake.session import shared_folder, staged, table
from framelake.sources import copies, external, lightroom


def _library(spark: SparkSession, sf_dir: str) -> str:
    """An export of a photo library, made of the events: rows without id, without file, without zone, half a place."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        F.when(n % 9 != 0, F.concat(F.lit("A"), n)).alias("external_id"), F.when(n % 4 != 0, F.concat(F.lit("/library/"), n, F.when(n % 8 == 1, " ").otherwise(""))).alias("path"),
        F.concat(F.lit("/old/"), n).alias("original_path"), F.concat("event_type", n, F.lit(".jpg")).alias("name"), F.floor(F.col("value") * 1000).alias("bytes"),
        F.col("ts").cast("timestamp_ntz").alias("moment"), F.when(n % 3 != 0, ((n % 5 - 2) * 3600).cast("int")).alias("zone_seconds"),
        F.when(n % 6 == 0, 0.0).otherwise((F.col("user_id") % 7).cast("double")).alias("gps_lat"), F.when(n % 6 == 0, 0.0).when(n % 6 != 1, -(F.col("user_id") % 11).cast("double")).alias("gps_lon"),
        F.when(n % 5 == 0, " ").when(n % 5 != 1, F.concat(F.lit("Title "), n)).alias("title"), F.when(n % 10 < 7, n % 10 == 3).alias("favourite"),
        F.when(n % 7 != 0, F.array(F.concat(F.lit("u"), F.col("user_id") % 9), F.col("event_type"), F.concat(F.lit("u"), F.col("user_id") % 9))).alias("albums"),
    )
    return staged(rows, "library").inputFiles()[0].rsplit("/", 1)[0]


@query("""
WITH library AS (SELECT event_id AS n, CASE WHEN event_id % 9 <> 0 THEN 'A' || event_id END AS external_id, CASE WHEN event_id % 4 <> 0 THEN '/library/' || event_id || CASE WHEN event_id % 8 = 1 THEN ' ' ELSE '' END END AS path,
  event_type || event_id || '.jpg' AS name, CAST(floor(value * 1000) AS BIGINT) AS bytes, ts AS moment, CASE WHEN event_id % 3 <> 0 THEN (event_id % 5 - 2) * 3600 END AS zone,
  CASE WHEN event_id % 6 = 0 THEN 0 ELSE user_id % 7 END AS lat, CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 6 <> 1 THEN -(user_id % 11) END AS lon, event_type, user_id FROM events)
SELECT external_id, path, '/old/' || n AS original_path, name, bytes, moment + to_seconds(coalesce(zone, 0)) AS taken_at, CASE WHEN zone IS NOT NULL THEN moment END AS taken_at_utc,
  CASE WHEN lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN CAST(lat AS DOUBLE) END AS gps_lat, CASE WHEN lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN CAST(lon AS DOUBLE) END AS gps_lon,
  CASE WHEN n % 5 > 1 THEN 'Title ' || n END AS title, n % 10 = 3 AS favourite, CASE WHEN n % 7 <> 0 THEN 'u' || (user_id % 9) || ',' || event_type ELSE '' END AS albums, path IS NULL AS is_reference
FROM library WHERE path IS NOT NULL OR external_id IS NOT NULL""")
def outside_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, SRC-18: assets read through the data source, references without files among them."""
    found = external.catalog(spark, _library(spark, sf_dir))
    return found.select("external_id", "path", "original_path", "name", "bytes", "taken_at", "taken_at_utc", "gps_lat", "gps_lon", "title", "favourite", F.array_join("albums", ",").alias("albums"), "is_reference")


@query("""
WITH library AS (SELECT event_type, user_id, CASE WHEN event_id % 9 <> 0 THEN 1 ELSE 0 END AS named, CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS filed, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')
SELECT CAST(ts AS DATE) AS day, count(*) AS assets, count(*) FILTER (filed = 0) AS only_references FROM library WHERE named + filed > 0 GROUP BY 1""")
def outside_assets_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of time: the limits go down to the export's files."""
    found = external.catalog(spark, _library(spark, sf_dir), since="2024-01-10", until="2024-01-20")
    n = F.coalesce(F.regexp_extract("original_path", "([0-9]+)$", 1).cast("long"), F.lit(0))
    moment = F.coalesce("taken_at_utc", F.col("taken_at"))
    return found.withColumn("n", n).groupBy(moment.cast("date").alias("day")).agg(F.count("*").alias("assets"), F.count_if("is_reference").alias("only_references"))


@query("""
WITH p AS (SELECT page_id AS media_id, html, CASE WHEN page_id % 10 = 0 THEN NULL WHEN page_id % 11 = 3 THEN 'out' ELSE 'in' END AS target, page_id % 13 = 5 AS gone, page_id % 5 = 1 AS taken FROM pages)
SELECT media_id, CASE WHEN target = 'in' AND NOT gone AND html IS NOT NULL AND NOT taken THEN 'verified copy' ELSE 'copy' END AS action,
  CASE WHEN target IS NULL THEN 'error: unsafe destination' WHEN target = 'out' THEN 'error: target outside the root' WHEN gone OR html IS NULL THEN 'error: source out of reach' WHEN taken THEN 'refused: target exists' ELSE 'ok' END AS result,
  CASE WHEN target = 'in' AND NOT gone THEN octet_length(encode(html)) END AS bytes, CASE WHEN target = 'in' AND NOT gone THEN 'sha256:' || sha256(html) END AS digest_before, CASE WHEN target = 'in' AND NOT gone THEN 'sha256:' || sha256(html) END AS digest_after FROM p
UNION ALL SELECT NULL, 'dry run', count(*) FILTER (target IS NOT NULL AND NOT gone AND html IS NOT NULL AND (target = 'out' OR NOT taken)) || ' of ' || count(*) || ' ready',
  coalesce(sum(octet_length(encode(html))) FILTER (target IS NOT NULL AND NOT gone AND html IS NOT NULL AND (target = 'out' OR NOT taken) AND octet_length(encode(html)) > 0), 0), NULL, NULL FROM p
UNION ALL SELECT NULL, 'finished', 'error', count(*) FILTER (target = 'in' AND NOT gone AND html IS NOT NULL AND NOT taken), NULL, NULL FROM p""")
def copy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: the audit of a plan over pages of which some are gone, some targets taken by an earlier plan, some unsafe."""
    root, n = f"{copies.mounted(shared_folder(spark))}/copies-{uuid.uuid4().hex}", F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    inside = F.concat(F.lit("pages/"), (n % 50).cast("string"), F.lit("/"), n.cast("string"), F.lit(".html"))
    earlier = pages.where((n % 5 == 1) & (n % 10 != 0) & (n % 11 != 3)).select(n.alias("media_id"), inside.alias("target"), F.lit(None).cast("string").alias("conflict"), F.lit("earlier").cast("binary").alias("content"))
    target = F.when(n % 10 == 0, None).when(n % 11 == 3, F.concat(F.lit("../"), n.cast("string"))).otherwise(inside)
    content = F.when(n % 13 != 5, F.encode("html", "utf-8"))
    plan = pages.select(n.alias("media_id"), target.alias("target"), F.when(n % 10 == 0, "unsafe destination").alias("conflict"), content.alias("content"))
    for name, own, taken in (("earlier", earlier, earlier.limit(0)), ("plan", plan, earlier)):
        copies.dry_run(own.select("media_id", "target", "conflict", F.octet_length("content").alias("bytes"), F.col("content").isNotNull().alias("there")), taken, root, name)
        audit = copies.copied(own, root, name)
    return audit.select("media_id", "action", "result", "bytes", "digest_before", "digest_after")


@query("""
WITH e AS (SELECT event_id AS n, ts FROM events), l AS (SELECT *, CASE WHEN n % 11 <> 0 THEN 'b' || n END AS base, CASE WHEN n % 3 <> 0 THEN 'CR3' WHEN n % 6 = 0 THEN '' END AS ext, CASE WHEN n % 4 <> 3 THEN '/Volumes/L' || (n % 4) || '/' END AS root, CASE WHEN n % 20 >= 5 THEN 'f' || (n % 20) || '/' END AS inner_ FROM e WHERE n % 13 <> 0)
SELECT 'G' || n AS external_id, base || CASE WHEN coalesce(ext, '') <> '' THEN '.' || ext ELSE '' END AS name, root || coalesce(inner_, '') || base || CASE WHEN coalesce(ext, '') <> '' THEN '.' || ext ELSE '' END AS original_path,
  CASE n % 5 WHEN 0 THEN date_trunc('second', ts) + INTERVAL 670 MILLISECOND WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) END AS taken_at,
  CASE WHEN n % 2 = 0 THEN n / 1000.0 END :: DOUBLE AS gps_lat, n % 6 >= 4 OR n % 10 = 1 AS favourite, CASE n % 4 WHEN 0 THEN 'Best,Trip 0' WHEN 1 THEN 'Best' ELSE '' END AS albums, CASE WHEN n % 3 = 1 THEN 'sea' ELSE '' END AS keywords FROM l""")
def lightroom_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: a catalog's tables with missing pieces of paths, moments in every form, collections and keywords."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    at = lambda form: F.date_format("ts", form)
    capture = F.when(n % 5 == 0, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".67"))).when(n % 5 == 1, at("yyyy-MM-dd")).when(n % 5 == 2, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(n % 5 == 3, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("no date")
    images = e.select(n.alias("image_id"), (n + 7).alias("file_id"), capture.alias("capture"), F.when(n % 6 != 0, (n % 6).cast("double")).alias("rating"), F.when(n % 10 < 3, (n % 10 == 1).cast("double")).alias("pick"))
    files = e.select((n + 7).alias("file_id"), F.when(n % 13 != 0, F.concat(F.lit("G"), n)).otherwise("").alias("global_id"), (n % 20).alias("folder_id"), F.when(n % 11 != 0, F.concat(F.lit("b"), n)).alias("base"), F.when(n % 3 != 0, "CR3").when(n % 6 == 0, "").alias("extension"))
    folders = files.select("folder_id").distinct().select("folder_id", (F.col("folder_id") % 4).alias("root_id"), F.when(F.col("folder_id") >= 5, F.concat(F.lit("f"), "folder_id", F.lit("/"))).alias("path"))
    roots = folders.select("root_id").distinct().select("root_id", F.when(F.col("root_id") != 3, F.concat(F.lit("/Volumes/L"), "root_id", F.lit("/"))).alias("path"))
    exif = e.where(n % 2 == 0).select(n.alias("image_id"), (n / 1000).alias("gps_lat"), F.lit(1.0).alias("gps_lon"))
    collections = e.where(n % 4 < 2).select(n.alias("image_id"), F.explode(F.when(n % 4 == 0, F.array(F.lit("Trip 0"), F.lit("Best"), F.lit("Best"))).otherwise(F.array(F.lit("Best"), F.lit("")))).alias("name"))
    words = e.where(n % 3 == 1).select(n.alias("image_id"), F.lit("sea").alias("name"))
    found = lightroom.assets(images, files, folders, roots, exif, collections, words)
    return found.select("external_id", "name", "original_path", "taken_at", "gps_lat", "favourite", F.array_join("albums", ",").alias("albums"), F.array_join("keywords", ",").alias("keywords"))

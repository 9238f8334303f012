"""The media fact table and its side tables, derived from the driver's tables.

One wide table of media files, one entity-attribute table of curated keywords, places (nation and region), the
sources they come from, and suggestions. Every operator takes such DataFrames; a real catalog brings its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import table


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_of(table(spark, sf_dir, "events"))


def media_of(e: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as media."""
    user, event = F.col("user_id"), F.col("event_id")
    gps = F.col("event_type").isin("purchase", "signup")
    prefix = F.when(F.col("event_type") == "click", "IMG-20240115-WA").when(F.col("event_type") == "view", "Screenshot_").otherwise("IMG_")
    ext = F.get(F.array(*map(F.lit, ("jpg", "cr3", "png", "heic", "mov"))), (event % 5).cast("int"))
    k = (user % 5).cast("int")
    return e.select(
        event.alias("id"),
        (event % 4 + 1).alias("source_id"),
        F.when(~((F.col("event_type") == "error") & (event % 2 == 0)), F.col("ts")).alias("taken_at"),
        F.when(event % 50 != 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("mtime"),
        F.get(F.array(*map(F.lit, ("Canon", "Apple", "SONY", None, "NIKON"))), k).alias("make"),
        F.get(F.array(*map(F.lit, ("Canon EOS R6", "iPhone 15", "ILCE-7M4", None, None))), k).alias("model"),
        F.when(gps, F.round(F.lit(-23.0) + (user % 7) * 0.25, 4)).alias("gps_lat"),
        F.when(gps, F.round(F.lit(-43.0) - (user % 7) * 0.25, 4)).alias("gps_lon"),
        F.concat(F.lit("/Volumes/vol"), user % 3, F.lit("/2024/u_"), user).alias("folder"),
        F.concat(prefix, event, F.lit("."), ext).alias("name"),
        ext.alias("ext"),
        F.floor(F.col("value") * 1000).alias("bytes"),
        F.concat(F.lit("h"), event % 4501).alias("quick_hash"),
        F.when(event % 7 == 0, "witness").otherwise("holding").alias("role"),
        (event % 11 == 0).alias("missing"),
        (event % 13 == 0).alias("offline"),
        F.when(event % 97 == 0, "error").alias("read_error"),
        F.when(gps, user % 25).alias("location_id"),
        user.alias("user_id"),
        "event_type",
        "value",
    )


def sources(spark: SparkSession) -> DataFrame:
    """source_id, kind, available: the fourth is out of reach."""
    kind = F.get(F.array(*map(F.lit, ("folder", "apple_photos", "google_takeout", "lightroom"))), (F.col("id") - 1).cast("int"))
    return spark.range(1, 5, 1, 1).select(F.col("id").alias("source_id"), kind.alias("kind"), (F.col("id") != 4).alias("available"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(F.col("n_nationkey").cast("long").alias("location_id"), F.col("n_name").alias("city"), F.col("r_name").alias("country"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, namespace, key, value: the curated keyword of each file."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("media_id"), F.lit("curated").alias("namespace"), F.lit("keyword").alias("key"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("value"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    level = F.when(F.col("value") < 30, "low").when(F.col("value") < 80, "medium").otherwise("high")
    status = F.get(F.array(*map(F.lit, ("pending", "approved", "rejected", "corrected"))), (F.col("event_id") % 4).cast("int"))
    return e.select(F.col("event_id").alias("media_id"), F.concat(F.lit("cat/"), "event_type").alias("destination"), level.alias("level"), status.alias("status"))


#: The same tables for the SQL twins.
CATALOG_SQL = """
WITH media AS (
  SELECT event_id AS id, event_id % 4 + 1 AS source_id,
    CASE WHEN NOT (event_type = 'error' AND event_id % 2 = 0) THEN ts END AS taken_at,
    CASE WHEN event_id % 50 <> 0 THEN ts + INTERVAL 1 HOUR END AS mtime,
    CASE user_id % 5 WHEN 0 THEN 'Canon' WHEN 1 THEN 'Apple' WHEN 2 THEN 'SONY' WHEN 4 THEN 'NIKON' END AS make,
    CASE user_id % 5 WHEN 0 THEN 'Canon EOS R6' WHEN 1 THEN 'iPhone 15' WHEN 2 THEN 'ILCE-7M4' END AS model,
    CASE WHEN event_type IN ('purchase', 'signup') THEN round(CAST(-23 AS DOUBLE) + (user_id % 7) * CAST(0.25 AS DOUBLE), 4) END AS gps_lat,
    CASE WHEN event_type IN ('purchase', 'signup') THEN round(CAST(-43 AS DOUBLE) - (user_id % 7) * CAST(0.25 AS DOUBLE), 4) END AS gps_lon,
    '/Volumes/vol' || (user_id % 3) || '/2024/u_' || user_id AS folder,
    CASE event_type WHEN 'click' THEN 'IMG-20240115-WA' WHEN 'view' THEN 'Screenshot_' ELSE 'IMG_' END || event_id || '.' ||
      CASE event_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'cr3' WHEN 2 THEN 'png' WHEN 3 THEN 'heic' ELSE 'mov' END AS name,
    CASE event_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'cr3' WHEN 2 THEN 'png' WHEN 3 THEN 'heic' ELSE 'mov' END AS ext,
    CAST(floor(value * 1000) AS BIGINT) AS bytes, 'h' || (event_id % 4501) AS quick_hash,
    CASE WHEN event_id % 7 = 0 THEN 'witness' ELSE 'holding' END AS role,
    event_id % 11 = 0 AS missing, event_id % 13 = 0 AS offline,
    CASE WHEN event_id % 97 = 0 THEN 'error' END AS read_error,
    CASE WHEN event_type IN ('purchase', 'signup') THEN user_id % 25 END AS location_id,
    user_id, event_type, value
  FROM events
), sources AS (
  SELECT * FROM (VALUES (1, 'folder', true), (2, 'apple_photos', true), (3, 'google_takeout', true), (4, 'lightroom', false)) AS t(source_id, kind, available)
), places AS (
  SELECT CAST(n_nationkey AS BIGINT) AS location_id, n_name AS city, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey
), keywords AS (
  SELECT event_id AS media_id, 'curated' AS namespace, 'keyword' AS key, 'k' || json_extract_string(props, '$.k') AS value FROM events
), suggestions AS (
  SELECT event_id AS media_id, 'cat/' || event_type AS destination,
    CASE WHEN value < 30 THEN 'low' WHEN value < 80 THEN 'medium' ELSE 'high' END AS level,
    CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'corrected' END AS status
  FROM events WHERE event_id % 3 <> 0
), ready AS (SELECT * FROM media WHERE role = 'holding' AND NOT missing AND NOT offline)
"""

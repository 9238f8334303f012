"""Scans, merges and moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import ingest
from framelake.plans.registry import query
from framelake.sources import catalog, files
from framelake.sources.catalog import CATALOG_SQL

#: A later scan: without every ninth file, with some grown, and with new ones.
_SCAN = CATALOG_SQL + """, old AS (SELECT folder || '/' || name AS path, bytes, mtime, missing FROM media WHERE id % 10 <> 0),
seen AS (SELECT folder || '/' || name AS path, bytes + CASE WHEN id % 8 = 0 THEN 1 ELSE 0 END AS bytes, mtime FROM media WHERE id % 9 <> 0)
"""


def _scan(spark, sf):
    m = catalog.media(spark, sf).withColumn("path", F.concat("folder", F.lit("/"), "name"))
    old = m.where("id % 10 <> 0").select("path", "bytes", "mtime", "missing")
    seen = m.where("id % 9 <> 0").select("path", (F.col("bytes") + F.when(F.col("id") % 8 == 0, 1).otherwise(0)).alias("bytes"), "mtime")
    return old, seen


@query(_SCAN + "SELECT s.path, CASE WHEN o.path IS NULL THEN 'new' WHEN o.bytes = s.bytes AND o.mtime IS NOT DISTINCT FROM s.mtime THEN 'same' ELSE 'changed' END AS change FROM seen s LEFT JOIN old o USING (path)")
def incremental_changes(spark, sf):
    return ingest.changes(*_scan(spark, sf))


@query(_SCAN + "SELECT path, path NOT IN (SELECT path FROM seen) AS missing FROM old")
def missing_marking(spark, sf):
    old, seen = _scan(spark, sf)
    return ingest.gone(old, seen).select("path", "missing")


@query(_SCAN + "SELECT path, bytes FROM seen UNION ALL SELECT path, bytes FROM old WHERE path NOT IN (SELECT path FROM seen)")
def catalog_upsert(spark, sf):
    old, seen = _scan(spark, sf)
    return ingest.upserted(old.select("path", "bytes"), seen.select("path", "bytes"))


@query(CATALOG_SQL + "SELECT id, folder || '/' || name AS old_path, '/Volumes/vol2' || substr(folder || '/' || name, 14) AS new_path, false AS collides FROM media WHERE starts_with(folder, '/Volumes/vol1/')")
def repoint_preview(spark, sf):
    return ingest.repointed(catalog.media(spark, sf), "/Volumes/vol1", "/Volumes/vol2")


@query(CATALOG_SQL + """, other AS (SELECT id, 'Scanner' AS make, 'X' AS model, -1.0 :: DOUBLE AS gps_lat FROM media WHERE id % 3 = 0)
SELECT m.id, coalesce(m.make, o.make) AS make, coalesce(m.model, o.model) AS model, coalesce(m.gps_lat, o.gps_lat) AS gps_lat FROM media m LEFT JOIN other o USING (id)""")
def source_merge(spark, sf):
    m = catalog.media(spark, sf).select("id", "make", "model", "gps_lat")
    other = m.where("id % 3 = 0").select("id", F.lit("Scanner").alias("make"), F.lit("X").alias("model"), F.lit(-1.0).alias("gps_lat"))
    return ingest.merged(m, other, "id", ["make", "model", "gps_lat"]).select("id", "make", "model", "gps_lat")


@query(CATALOG_SQL + """SELECT media_id, namespace, key, value FROM keywords WHERE media_id % 5 <> 0
  UNION ALL SELECT media_id, namespace, key, 'new' FROM keywords WHERE media_id % 5 = 0""")
def metadata_rewrite(spark, sf):
    k = catalog.keywords(spark, sf)
    return ingest.rewritten(k, k.where("media_id % 5 = 0").withColumn("value", F.lit("new")))


@query(CATALOG_SQL + "SELECT id, name FROM media WHERE id > 100 ORDER BY id LIMIT 200")
def reconcile_page(spark, sf):
    return ingest.next_page(catalog.media(spark, sf), 100, 200).select("id", "name")


@query("""SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'derived' ELSE 'own' END AS role, lower(regexp_extract(url, '\\.([^./?#]+)(?:/|$)', 1)) AS host_end FROM pages""")
def package_roles(spark, sf):
    """Urls as paths: the parts named fr stand for packages."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = F.regexp_replace("url", "/fr/", "/x.photoslibrary/")
    return pages.select("page_id", files.role_in_package(path).alias("role"), F.lower(F.regexp_extract("url", r"\.([^./?#]+)(?:/|$)", 1)).alias("host_end"))


@query("""SELECT event_id, to_timestamp(CAST(json_extract_string(props, '$.k') AS BIGINT)) :: TIMESTAMP :: VARCHAR AS taken FROM events""")
def json_sidecars(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    side = e.select("event_id", F.concat(F.lit("a/Photos from 2024/"), "event_id").alias("path"), F.concat(F.lit('{"photoTakenTime":{"timestamp":"'), F.get_json_object("props", "$.k"), F.lit('"}}')).alias("json"))
    return files.takeout(side).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("event_id"), F.date_format("taken_utc", "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("""SELECT p_partkey, lower(p_brand) || '|' || lower(p_type) || ';' || lower(p_brand) || ';' || lower(p_type) AS words FROM part""")
def keyword_hierarchy(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    text = F.concat(F.lower("p_brand"), F.lit("|"), F.lower("p_type"), F.lit(", "), F.lower("p_type"))
    return part.select("p_partkey", F.array_join(files.keyword_levels(text), ";").alias("words"))

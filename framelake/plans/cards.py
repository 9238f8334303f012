"""Trips and events, details, review and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import folders
from framelake.functions.geo import LEAST_M
from framelake.operators import asof, details, engine, evaluate, facets, groupings, review, sessions, suggest
from framelake.plans.registry import query
from framelake.plans.timelines import _ANCHORS, _ASOF
from framelake.sources import catalog, scan
from framelake.sources.catalog import CATALOG_SQL

#: Trips are the users; a file has a thumbnail where its id leaves 0 or 1 by 5.
_TRIPS = CATALOG_SQL + """, t AS (SELECT *, CASE WHEN event_type <> 'error' THEN user_id END AS trip_id, id % 5 < 2 AS has_thumbnail FROM media),
g AS (SELECT user_id AS id, 'trip ' || user_id AS name, min(taken_at) AS started, max(taken_at) AS ended FROM media GROUP BY 1),
e AS (SELECT trip_id, id, row_number() OVER (PARTITION BY trip_id ORDER BY taken_at NULLS FIRST, id) AS nth, has_thumbnail FROM t WHERE trip_id IS NOT NULL),
c AS (SELECT trip_id, arg_min(id, (CASE WHEN has_thumbnail THEN 0 ELSE 100 END) + nth) AS cover FROM e WHERE nth <= 24 GROUP BY 1)
"""


def _trips(spark, sf):
    m = catalog.media(spark, sf)
    groups = m.groupBy(F.col("user_id").alias("id")).agg(F.concat(F.lit("trip "), F.first("user_id")).alias("name"), F.min("taken_at").alias("started"), F.max("taken_at").alias("ended"))
    return groups, m.withColumns({"trip_id": F.when(F.col("event_type") != "error", F.col("user_id")), "has_thumbnail": F.col("id") % 5 < 2})


@query(_TRIPS + "SELECT g.id, name, started, ended, coalesce(n, 0) AS photos, cover FROM g LEFT JOIN (SELECT trip_id, count(*) AS n FROM t GROUP BY 1) k ON k.trip_id = g.id LEFT JOIN c ON c.trip_id = g.id")
def trip_cards(spark, sf):
    return groupings.cards(*_trips(spark, sf), "trip_id")


@query(_TRIPS + "SELECT g.id, name, started, ended, n AS photos, cover FROM g JOIN (SELECT trip_id, count(*) AS n FROM t WHERE source_id = 2 GROUP BY 1) k ON k.trip_id = g.id LEFT JOIN c ON c.trip_id = g.id")
def trip_cards_of_source(spark, sf):
    return groupings.cards(*_trips(spark, sf), "trip_id", source_id=2)


#: Inherited places: files without GPS whose id leaves 1 by 3 have one, 20 s times (id % 997) away.
_PLACED = CATALOG_SQL + """, e AS (SELECT *, CASE WHEN gps_lat IS NULL AND id % 3 = 1 THEN -22.5 + (id % 11) * 0.5 END AS est_lat, CASE WHEN gps_lat IS NULL AND id % 3 = 1 THEN -43.0 - (id % 11) * 0.5 END AS est_lon,
  CASE WHEN gps_lat IS NULL AND id % 3 = 1 THEN (id % 997) * CAST(20.0 AS DOUBLE) END AS delta_s FROM media),
p AS (SELECT *, CAST(coalesce(gps_lat, est_lat) AS DOUBLE) AS lat, CAST(coalesce(gps_lon, est_lon) AS DOUBLE) AS lon, gps_lat IS NULL AND est_lat IS NOT NULL AS estimated,
  CASE WHEN gps_lat IS NULL AND est_lat IS NOT NULL THEN least(50000.0, greatest(15.0, 6.0 * delta_s)) END :: DOUBLE AS radius_m FROM e),
d AS (SELECT *, radians(lat) AS r FROM p), s AS (SELECT *, coalesce(radius_m / (111132.92 - 559.82 * cos(2 * r) + 1.175 * cos(4 * r) - 0.0023 * cos(6 * r)), 0) AS up,
  coalesce(radius_m / greatest(111412.84 * cos(r) - 93.5 * cos(3 * r) + 0.118 * cos(5 * r), 1.0), 0) AS side FROM d),
box AS (SELECT user_id, count(*) AS total, count(lat) AS on_map, count(*) - count(lat) AS without, count(*) FILTER (estimated) AS estimated, round(min(lat - up), 6) AS south, round(max(lat + up), 6) AS north,
  round(min(lon - side), 6) AS west, round(max(lon + side), 6) AS east FROM s GROUP BY 1)
"""


def _estimated(spark, sf):
    m = catalog.media(spark, sf)
    has = F.col("gps_lat").isNull() & (F.col("id") % 3 == 1)
    return m.withColumns({"est_lat": F.when(has, -22.5 + (F.col("id") % 11) * 0.5), "est_lon": F.when(has, -43.0 - (F.col("id") % 11) * 0.5), "delta_s": F.when(has, (F.col("id") % 997) * 20.0), "donor_id": F.when(has, F.col("id") - 1)})


@query(_PLACED + "SELECT * FROM box")
def map_of_trips(spark, sf):
    return groupings.map_summary(groupings.points(_estimated(spark, sf)), "user_id")


@query(_PLACED + """SELECT round(lat, 5) AS lat, round(lon, 5) AS lon, count(*) AS n, count(*) FILTER (NOT estimated) AS own, count(*) FILTER (estimated) AS inherited, max(radius_m) AS radius_m,
  count(*) FILTER (missing OR offline) AS unreachable, CASE WHEN count(*) FILTER (estimated) = 0 THEN 'read' WHEN count(*) FILTER (NOT estimated) = 0 THEN 'estimated' ELSE 'mixed' END AS kind FROM p WHERE lat IS NOT NULL GROUP BY 1, 2""")
def map_places(spark, sf):
    return groupings.map_places(groupings.points(_estimated(spark, sf)), F.col("missing") | F.col("offline"))


@query(_PLACED + """, k AS (SELECT *, cos(radians((south + north) / 2)) AS shrink FROM box)
SELECT p.id, p.user_id, round((lon - west) * shrink / greatest((east - west) * shrink, north - south, 1e-9), 6) AS x, round((north - lat) / greatest((east - west) * shrink, north - south, 1e-9), 6) AS y
FROM p JOIN k USING (user_id) WHERE lat IS NOT NULL""")
def map_projection(spark, sf):
    placed = groupings.points(_estimated(spark, sf))
    return groupings.projected(placed, groupings.map_summary(placed, "user_id"), "user_id")


@query(_PLACED + """SELECT id, array_to_string(CASE WHEN gps_lat IS NOT NULL THEN ['country', 'region', 'city'] WHEN delta_s IS NULL THEN ['country'] WHEN delta_s <= 600 THEN ['country', 'region', 'city']
  WHEN delta_s <= 7200 THEN ['country', 'region'] ELSE ['country'] END, ',') AS fields FROM e""")
def place_fields(spark, sf):
    shown = details.place_fields(F.col("gps_lat").isNotNull(), F.col("delta_s"))
    return _estimated(spark, sf).select("id", F.array_join(shown, ",").alias("fields"))


@query(_PLACED + """SELECT id, name, e.source_id, strftime(taken_at, '%Y-%m-%dT%H:%M:%S') AS taken, CASE user_id % 5 WHEN 0 THEN 'Canon EOS R6' WHEN 1 THEN 'Apple iPhone 15' WHEN 2 THEN 'SONY ILCE-7M4' WHEN 4 THEN 'NIKON' END AS camera,
  CAST(coalesce(gps_lat, est_lat) AS DOUBLE) AS lat, CAST(coalesce(gps_lon, est_lon) AS DOUBLE) AS lon, gps_lat IS NULL AND est_lat IS NOT NULL AS estimated,
  CASE WHEN missing THEN 'no file here' WHEN NOT available THEN 'source out of reach' WHEN offline THEN 'file gone from disk' END AS why_not FROM e JOIN sources USING (source_id)""")
def listing_rows(spark, sf):
    return details.rows(_estimated(spark, sf), catalog.sources(spark))


@query(CATALOG_SQL + """, k AS (SELECT * FROM keywords UNION ALL SELECT id, 'exif', 'make', make FROM media WHERE make IS NOT NULL UNION ALL SELECT id, 'exif', 'ext', ext FROM media)
SELECT media_id, namespace, CASE namespace WHEN 'curated' THEN 'Keywords and albums' ELSE 'Camera' END AS label, count(*) AS n, string_agg(key || '=' || value, '; ' ORDER BY key || '=' || value) AS entries FROM k GROUP BY 1, 2""")
def metadata_by_namespace(spark, sf):
    m = catalog.media(spark, sf)
    exif = lambda c: m.where(F.col(c).isNotNull()).select(F.col("id").alias("media_id"), F.lit("exif").alias("namespace"), F.lit(c).alias("key"), F.col(c).alias("value"))
    rows = catalog.keywords(spark, sf).unionByName(exif("make")).unionByName(exif("ext"))
    return details.by_namespace(rows).withColumn("entries", F.array_join("entries", "; "))


@query(CATALOG_SQL + """, e AS (SELECT id, 'place' AS field, 'gps' AS origin, country AS value, CAST(0.95 AS DOUBLE) AS score FROM media JOIN places USING (location_id) UNION ALL SELECT id, 'kind', 'file', ext, 0.5 FROM media)
SELECT m.id, name, city, country, destination, level, status, (SELECT string_agg(field || ':' || origin || ':' || value, ' ' ORDER BY -score, field) FROM e WHERE e.id = m.id) AS evidence
FROM media m LEFT JOIN places USING (location_id) LEFT JOIN suggestions ON media_id = m.id""")
def media_detail(spark, sf):
    m, p = catalog.media(spark, sf), catalog.places(spark, sf)
    found = m.join(p, "location_id").select("id", F.lit("place").alias("field"), F.lit("gps").alias("origin"), F.col("country").alias("value"), F.lit(0.95).alias("score"))
    found = found.unionByName(m.select("id", F.lit("kind").alias("field"), F.lit("file").alias("origin"), F.col("ext").alias("value"), F.lit(0.5).alias("score")))
    return details.detail(m, p, catalog.suggestions(spark, sf), found).withColumn("evidence", F.array_join("evidence", " "))


@query(CATALOG_SQL + _ASOF + " SELECT r.id, r.donor_id, round(delta_s, 6) AS delta_s, name AS donor_name, source_id AS donor_source, gps_lat AS donor_lat, gps_lon AS donor_lon FROM r JOIN media m ON m.id = r.donor_id")
def donors_of_heirs(spark, sf):
    from framelake.plans.timelines import _donors

    return details.donors(_donors(spark, sf).withColumn("delta_s", F.round("delta_s", 6)), catalog.media(spark, sf))


_CITIES = """, cities AS (SELECT n_name AS city, CAST(-24.0 + (n_nationkey % 5) * 0.5 AS DOUBLE) AS city_lat, CAST(-44.5 + (n_nationkey // 5) * 0.5 AS DOUBLE) AS city_lon FROM nation)"""


def _cities(spark, sf):
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("city"), (F.lit(-24.0) + (k % 5) * 0.5).alias("city_lat"), (F.lit(-44.5) + F.floor(k / 5) * 0.5).alias("city_lon"))


@query(CATALOG_SQL + _CITIES + """, d AS (SELECT id, city, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(city_lat - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(city_lat)) * pow(sin(radians(city_lon - gps_lon) / 2), 2)))) AS km
  FROM media, cities WHERE gps_lat IS NOT NULL)
SELECT id, city, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, city) AS k FROM d WHERE km <= 40) WHERE k = 1""")
def nearest_city(spark, sf):
    at = catalog.media(spark, sf).where("gps_lat IS NOT NULL").select("id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    return details.nearest_city(at, _cities(spark, sf), within_km=40.0).withColumn("km", F.round("km", 6))


@query(CATALOG_SQL + """SELECT id, 'place ' || (user_id % 7) AS place FROM media WHERE gps_lat IS NOT NULL AND user_id % 7 < 5""")
def cached_places(spark, sf):
    cache = spark.range(5).select(F.round(F.lit(-23.0) + F.col("id") * 0.25, 4).alias("lat"), F.round(F.lit(-43.0) - F.col("id") * 0.25, 4).alias("lon"), F.concat(F.lit("place "), "id").alias("place"))
    return details.cached_places(catalog.media(spark, sf), cache)


@query(CATALOG_SQL + """SELECT s.* FROM suggestions s JOIN media ON id = media_id WHERE status = 'pending' AND level = 'low' AND source_id = 1 AND destination = 'cat/click'""")
def chosen_suggestions(spark, sf):
    return review.chosen(catalog.suggestions(spark, sf), catalog.media(spark, sf), "pending", "low", 1, "cat/click")


@query(CATALOG_SQL + """SELECT media_id, destination, level, CASE WHEN level = 'high' AND status IN ('pending', 'rejected') THEN 'approved' ELSE status END AS status FROM suggestions""")
def bulk_approval(spark, sf):
    s = catalog.suggestions(spark, sf)
    return review.acted(s, review.chosen(s, catalog.media(spark, sf), level="high"), "approve")


@query(CATALOG_SQL + """SELECT media_id, CASE WHEN destination = 'cat/view' AND status <> 'rejected' THEN 'cat/seen' ELSE destination END AS destination, level, CASE WHEN destination = 'cat/view' AND status <> 'rejected' THEN 'corrected' ELSE status END AS status FROM suggestions""")
def bulk_correction(spark, sf):
    s = catalog.suggestions(spark, sf)
    return review.acted(s, review.chosen(s, catalog.media(spark, sf), destination="cat/view"), "correct", "cat/seen")


@query(CATALOG_SQL + """SELECT status, count(*) AS n FROM (SELECT CASE WHEN CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'interrupted' END = 'running' THEN 'interrupted' WHEN id % 3 = 1 THEN 'done' ELSE 'interrupted' END AS status FROM media) GROUP BY 1""")
def orphan_runs(spark, sf):
    runs = catalog.media(spark, sf).select("id", F.get(F.array(*map(F.lit, ("running", "done", "interrupted"))), (F.col("id") % 3).cast("int")).alias("status"))
    return review.stamped(runs).groupBy("status").agg(F.count("*").alias("n"))


@query(_PLACED + """, gone AS (SELECT id FROM media WHERE role = 'witness')
SELECT e.id, CASE WHEN id - 1 NOT IN (SELECT id FROM gone) THEN delta_s END AS delta_s, (SELECT count(*) FROM suggestions WHERE media_id = e.id) AS suggestions FROM e WHERE id NOT IN (SELECT id FROM gone)""")
def witness_removal(spark, sf):
    m = _estimated(spark, sf)
    left, rest = review.removed(m, m.where("role = 'witness'"), {"s": catalog.suggestions(spark, sf)})
    per = rest["s"].groupBy(F.col("media_id").alias("id")).agg(F.count("*").alias("n"))
    return left.join(per, "id", "left").select("id", "delta_s", F.coalesce("n", F.lit(0)).alias("suggestions"))


@query(CATALOG_SQL + """, g AS (SELECT quick_hash, CASE CAST(substr(quick_hash, 2) AS INTEGER) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'burst' WHEN 2 THEN 'variant' ELSE 'visual' END AS level, CAST(sum(bytes) - max(bytes) AS BIGINT) AS reclaimable FROM media GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS n, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS bytes FROM g WHERE level NOT IN ('burst', 'variant')""")
def reclaimable_total(spark, sf):
    per = catalog.media(spark, sf).groupBy("quick_hash").agg(F.count("*").alias("k"), (F.sum("bytes") - F.max("bytes")).alias("reclaimable")).where("k > 1")
    level = F.get(F.array(*map(F.lit, ("exact", "burst", "variant", "visual"))), (F.substring("quick_hash", 2, 9).cast("int") % 4))
    return review.total_reclaimable(per.withColumn("level", level))


@query(CATALOG_SQL + """SELECT count(*) FILTER (status = 'pending') AS waiting, count(*) FILTER (status = 'pending' AND destination = 'cat/click') AS unclassified FROM suggestions""")
def review_queue(spark, sf):
    s = catalog.suggestions(spark, sf)
    return review.queue(s.withColumn("destination", F.when(F.col("destination") == "cat/click", "unsorted/x").otherwise(F.col("destination"))))


@query(CATALOG_SQL + """SELECT user_id % 3 AS volume, '/Volumes/vol' || (user_id % 3) || '/2024' || CASE WHEN count(DISTINCT user_id) = 1 THEN '/u_' || min(user_id) ELSE '' END AS prefix FROM media GROUP BY 1""")
def common_folders(spark, sf):
    from framelake.functions.paths import common_folder

    per = catalog.media(spark, sf).groupBy((F.col("user_id") % 3).alias("volume"))
    ends = per.agg(F.array(F.min(F.concat("folder", F.lit("/"), "name")), F.max(F.concat("folder", F.lit("/"), "name"))).alias("p"))
    return ends.select("volume", common_folder(F.col("p")).alias("prefix"))


@query(CATALOG_SQL + """SELECT folder, count(*) AS n, '[' || string_agg('{"name":"' || name || '","source":"' || id || '"}', ',' ORDER BY name) || ']' AS listing FROM media GROUP BY 1""")
def folder_inventory(spark, sf):
    plan = catalog.media(spark, sf).select(F.col("id").cast("string").alias("source"), F.concat("folder", F.lit("/"), "name").alias("target"))
    return review.folder_inventory(plan)


@query(CATALOG_SQL + """SELECT source_id, kind, count(*) AS files, CASE WHEN available THEN count(*) FILTER (role = 'holding' AND NOT missing AND NOT offline) ELSE 0 END AS ready,
  CASE WHEN available THEN 0 ELSE count(*) FILTER (role = 'holding' AND NOT missing AND NOT offline) END AS out_of_reach FROM media JOIN sources USING (source_id) GROUP BY 1, 2, available""")
def reach_by_source(spark, sf):
    return evaluate.reach_by_source(catalog.media(spark, sf), catalog.sources(spark))


@query(CATALOG_SQL + """SELECT CAST(user_id % 12 - 6 AS VARCHAR) AS "offset", count(*) AS n, count(DISTINCT source_id) AS sources FROM media WHERE taken_at IS NOT NULL AND user_id % 12 <> 3 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8""")
def offset_impact(spark, sf):
    return evaluate.offset_impact(catalog.media(spark, sf), F.when(F.col("user_id") % 12 != 3, (F.col("user_id") % 12 - 6).cast("string")))


@query("""WITH s AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS digest FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 500)
SELECT CASE WHEN id % 17 = 0 THEN 'missing' WHEN id % 13 = 0 THEN 'unreadable' WHEN id % 11 = 0 THEN 'diverged' ELSE 'verified' END AS verdict, count(*) AS n FROM s GROUP BY 1""")
def integrity_sample(spark, sf):
    stored = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    now = stored.where("id % 17 <> 0").withColumn("digest", F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 11 == 0, F.lit("other")).otherwise(F.col("digest")))
    return evaluate.integrity(stored, now, rows=500)


@query(CATALOG_SQL + """, s AS (SELECT user_id, CAST(date_part('day', taken_at) AS BIGINT) AS day, count(*) AS n, avg(CASE WHEN name LIKE 'IMG-%' THEN 1 ELSE 0 END) AS received, avg(CASE WHEN name LIKE 'Screenshot%' THEN 1 ELSE 0 END) AS screen FROM media WHERE taken_at IS NOT NULL GROUP BY 1, 2)
SELECT kind, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS photos FROM (SELECT 'received' AS kind, n FROM s WHERE received >= 0.5 UNION ALL SELECT 'screen', n FROM s WHERE screen >= 0.5) GROUP BY 1""")
def dominance_share(spark, sf):
    m = catalog.media(spark, sf).where("taken_at IS NOT NULL").withColumn("day", F.dayofmonth("taken_at"))
    return evaluate.dominance(m, ["user_id", "day"], {"received": F.col("name").startswith("IMG-"), "screen": F.col("name").startswith("Screenshot")}, least=0.5)


@query(CATALOG_SQL + """SELECT DISTINCT label FROM (SELECT unnest(string_split(folder, '/')) AS label FROM ready UNION ALL SELECT event_type FROM media) WHERE trim(label) <> '' AND NOT regexp_matches(lower(label), '^(volumes|[0-9]+)$')""")
def nameable_labels(spark, sf):
    from framelake.operators import filters

    m = catalog.media(spark, sf)
    return evaluate.nameable(filters.ready(m), m.select(F.col("event_type").alias("label")), "^(volumes|[0-9]+)$")


@query(CATALOG_SQL + """, s AS (SELECT user_id AS span, min(taken_at) AS lo, min(taken_at) + INTERVAL 1 DAY AS hi FROM media WHERE taken_at IS NOT NULL AND user_id % 10 = 0 GROUP BY 1),
h AS (SELECT span, m.*, city, row_number() OVER (PARTITION BY span ORDER BY taken_at, id) AS i FROM s JOIN media m ON taken_at BETWEEN lo AND hi LEFT JOIN places USING (location_id))
SELECT span, count(*) AS n, count(DISTINCT folder) AS folders, coalesce(string_agg(DISTINCT city, ',' ORDER BY city), '') AS cities, string_agg(name, ',' ORDER BY i) FILTER (i <= 8) AS names FROM h GROUP BY 1""")
def cluster_rebuild(spark, sf):
    m = catalog.media(spark, sf)
    spans = m.where("taken_at IS NOT NULL AND user_id % 10 = 0").groupBy(F.col("user_id").alias("span")).agg(F.min("taken_at").alias("lo")).withColumn("hi", F.col("lo") + F.expr("INTERVAL 1 DAY"))
    return evaluate.clusters(spans, m, catalog.places(spark, sf), "span")


@query(CATALOG_SQL + """SELECT 'year' AS facet, coalesce(CAST(year(taken_at) AS VARCHAR), 'no date') AS value, count(*) AS n FROM media GROUP BY 2 UNION ALL
SELECT 'camera', CASE user_id % 5 WHEN 0 THEN 'Canon EOS R6' WHEN 1 THEN 'Apple iPhone 15' WHEN 2 THEN 'SONY ILCE-7M4' WHEN 4 THEN 'NIKON' ELSE 'unknown' END, count(*) FROM media GROUP BY 2 UNION ALL SELECT 'extension', ext, count(*) FROM media GROUP BY 2""")
def panorama_facets(spark, sf):
    return facets.panorama_by(catalog.media(spark, sf))


_HELD = """, i AS (SELECT id, coalesce(taken_at, mtime) AS at, source_id AS origin, gps_lat, gps_lon, CAST(taken_at AS DATE) AS day FROM media WHERE gps_lat IS NOT NULL),
q AS (SELECT h.id, d.id AS donor_id, abs(epoch_us(h.at) - epoch_us(d.at)) / 1e6 AS delta_s, d.at < h.at AS back, h.day,
  2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(d.gps_lat - h.gps_lat) / 2), 2) + cos(radians(h.gps_lat)) * cos(radians(d.gps_lat)) * pow(sin(radians(d.gps_lon - h.gps_lon) / 2), 2)))) AS km
  FROM i h JOIN i d ON d.origin <> h.origin AND d.at BETWEEN h.at - INTERVAL 43200 SECOND AND h.at + INTERVAL 43200 SECOND),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta_s, CASE WHEN back THEN 0 ELSE 1 END, CASE WHEN back THEN -donor_id ELSE donor_id END) AS k FROM q) WHERE k = 1)"""


def _pairs(spark, sf):
    m = catalog.media(spark, sf)
    items = m.where("gps_lat IS NOT NULL").select("id", F.coalesce("taken_at", "mtime").alias("at"), F.col("source_id").alias("origin"), F.lit(True).alias("has_gps"))
    return asof.calibration(asof.nearest_donor(items, hold_out=True), m)


@query(CATALOG_SQL + _HELD + " SELECT id, donor_id, round(delta_s, 6) AS delta_s, round(km, 6) AS km FROM pairs")
def calibration_pairs(spark, sf):
    return _pairs(spark, sf).select("id", "donor_id", F.round("delta_s", 6).alias("delta_s"), F.round("km", 6).alias("km"))


@query(CATALOG_SQL + _HELD + """, h AS (SELECT *, CASE WHEN km * 1000 <= least(50000.0, greatest(15.0, 6.0 * delta_s)) THEN 1 ELSE 0 END AS hit, CASE WHEN delta_s <= 120 THEN 0 WHEN delta_s <= 600 THEN 1 WHEN delta_s <= 7200 THEN 2 WHEN delta_s <= 43200 THEN 3 ELSE 4 END AS band FROM pairs)
SELECT count(*) AS n, round(avg(hit), 6) AS raw, (SELECT round(avg(s), 6) FROM (SELECT avg(hit) AS s FROM h GROUP BY band)) AS by_band, (SELECT round(avg(s), 6) FROM (SELECT avg(hit) AS s FROM h GROUP BY day)) AS by_day FROM h""")
def radius_coverage(spark, sf):
    return asof.coverage(_pairs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("raw", "by_band", "by_day")})


@query(CATALOG_SQL + _HELD + """ SELECT speed, cap AS cap_m, count(*) AS n, count(*) FILTER (km * 1000 <= least(cap, greatest(15.0, speed * delta_s))) AS covered
FROM pairs, (SELECT unnest([1.0, 3.0, 6.0, 10.0, 20.0]) :: DOUBLE AS speed) a, (SELECT unnest([5000.0, 20000.0, 50000.0, 100000.0, 200000.0]) :: DOUBLE AS cap) b GROUP BY 1, 2""")
def radius_sweep(spark, sf):
    assert LEAST_M == 15.0
    return asof.sweep(_pairs(spark, sf), (1.0, 3.0, 6.0, 10.0, 20.0), (5000.0, 20000.0, 50000.0, 100000.0, 200000.0))


@query(CATALOG_SQL + _HELD + """, d AS (SELECT day, avg(CASE WHEN km * 1000 <= least(50000.0, greatest(15.0, 6.0 * delta_s)) THEN 1 ELSE 0 END) AS share FROM pairs GROUP BY day),
n AS (SELECT *, row_number() OVER (ORDER BY day NULLS FIRST) - 1 AS i, count(*) OVER () AS days FROM d),
p AS (SELECT rep, CAST('0x' || substr(md5(rep || ':' || i), 1, 8) AS BIGINT) % days AS i FROM n, (SELECT unnest(range(1, 401)) AS rep)),
c AS (SELECT rep, avg(share) AS c FROM p JOIN n USING (i) GROUP BY rep)
SELECT round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.95), 6) AS p95 FROM c""")
def radius_bootstrap(spark, sf):
    return asof.bootstrap(_pairs(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("p5", "p50", "p95")))


@query(CATALOG_SQL + _ANCHORS + """, kept AS (SELECT m.make, m.model, m.o FROM known k JOIN mid m ON k.make IS NOT DISTINCT FROM m.make AND k.model IS NOT DISTINCT FROM m.model GROUP BY 1, 2, 3, m.n HAVING m.n >= 2 AND quantile_cont(abs(k.d - m.o), 0.5) <= 1e9),
i AS (SELECT id, coalesce(taken_at - to_microseconds(CAST(round(coalesce(o, 0) * 1e6) AS BIGINT)), mtime) AS at, source_id AS origin, gps_lat IS NOT NULL AS has_gps, taken_at IS NULL AS file_time FROM media m LEFT JOIN kept k ON m.make IS NOT DISTINCT FROM k.make AND m.model IS NOT DISTINCT FROM k.model),
p AS (SELECT h.id, d.id AS donor_id, abs(epoch_us(h.at) - epoch_us(d.at)) / 1e6 AS delta_s, d.at < h.at AS back FROM i h JOIN i d ON NOT h.has_gps AND d.has_gps AND d.origin <> h.origin AND d.at BETWEEN h.at - INTERVAL 43200 SECOND AND h.at + INTERVAL 43200 SECOND),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta_s, CASE WHEN back THEN 0 ELSE 1 END, CASE WHEN back THEN -donor_id ELSE donor_id END) AS k FROM p) WHERE k = 1)
SELECT r.id, donor_id, round(delta_s, 6) AS delta_s, gps_lat AS est_lat, gps_lon AS est_lon, CASE WHEN delta_s <= 600 THEN 'city' WHEN delta_s <= 7200 THEN 'region' ELSE 'country' END AS granularity FROM r JOIN media d ON d.id = donor_id""")
def place_inheritance(spark, sf):
    out = engine.inherited(catalog.media(spark, sf), most_mad_s=1e9)
    return out.select("id", "donor_id", F.round("delta_s", 6).alias("delta_s"), "est_lat", "est_lon", "granularity")


_BUILT = CATALOG_SQL + """, g AS (SELECT *, CASE WHEN (epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER w) / 1e6 > 172800 THEN 1 ELSE 0 END AS cut FROM media WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY taken_at, id)),
s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY taken_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g),
k AS (SELECT user_id, session, min(taken_at) AS lo, max(taken_at) AS hi, count(gps_lat) AS placed, count(*) AS size FROM s GROUP BY 1, 2 HAVING count(*) >= 2),
f AS (SELECT *, placed > 0 AND epoch_us(hi) - epoch_us(lo) >= 3 * CAST(86400000000 AS BIGINT) AS is_trip, epoch_us(hi) - epoch_us(lo) > 72000000000 AS long FROM k),
e AS (SELECT s.id, s.user_id, s.session, s.taken_at, is_trip, CASE WHEN is_trip OR long THEN 0 ELSE date_diff('day', CAST(lo AS DATE), CAST(taken_at AS DATE)) END AS block FROM s JOIN f USING (user_id, session)),
b AS (SELECT user_id, session, block, is_trip, min(taken_at) AS started, max(taken_at) AS ended, count(*) AS n, min(id) AS first_id FROM e GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)
"""


@query(_BUILT + "SELECT CASE WHEN is_trip THEN 'trip' ELSE 'event' END AS kind, CAST(row_number() OVER (PARTITION BY is_trip ORDER BY started, first_id) AS BIGINT) AS group_id, user_id, started, ended, n FROM b")
def built_groups(spark, sf):
    return engine.built(catalog.media(spark, sf), "user_id")[0].select("kind", "group_id", "user_id", "started", "ended", "n")


@query(_BUILT + """, r AS (SELECT *, row_number() OVER (PARTITION BY is_trip ORDER BY started, first_id) AS group_id FROM b)
SELECT e.id, CASE WHEN r.is_trip THEN group_id END AS trip_id, CASE WHEN NOT r.is_trip THEN group_id END AS event_id FROM e JOIN r USING (user_id, session, block)""")
def built_assignments(spark, sf):
    return engine.built(catalog.media(spark, sf), "user_id")[1]


_PATHS = """, paths AS (SELECT id, user_id, CASE user_id % 8 WHEN 0 THEN '/fotos/2023/Visconde de Maua - Abril 2023' WHEN 1 THEN '/fotos/2024-05-24 Praia' WHEN 2 THEN '/fotos/Serena 15 Anos' WHEN 3 THEN '/fotos/Brasil/Minas Gerais/Ouro Preto'
  WHEN 4 THEN '/fotos/29 de outubro de 2016/novembro 30' WHEN 5 THEN '/fotos/ITALIA/Roma' WHEN 6 THEN '/fotos/2015-13/24.12.2019' ELSE '/fotos/Brasil' END AS folder FROM media)"""
FOLDERS = ("/fotos/2023/Visconde de Maua - Abril 2023", "/fotos/2024-05-24 Praia", "/fotos/Serena 15 Anos", "/fotos/Brasil/Minas Gerais/Ouro Preto", "/fotos/29 de outubro de 2016/novembro 30", "/fotos/ITALIA/Roma", "/fotos/2015-13/24.12.2019", "/fotos/Brasil")


def _paths(spark, sf):
    return catalog.media(spark, sf).select("id", "user_id", F.get(F.array(*map(F.lit, FOLDERS)), (F.col("user_id") % 8).cast("int")).alias("folder"))


@query(CATALOG_SQL + _PATHS + """SELECT id, CASE user_id % 8 WHEN 0 THEN 'Visconde de Maua' WHEN 1 THEN 'Praia' WHEN 2 THEN 'Serena 15 Anos' WHEN 3 THEN 'Ouro Preto' WHEN 4 THEN '' WHEN 5 THEN 'Roma' WHEN 6 THEN '' ELSE 'Brasil' END AS name,
  CASE user_id % 8 WHEN 0 THEN '2023-04' WHEN 1 THEN '2024-05-24' WHEN 4 THEN '2016-10-29' WHEN 6 THEN '2019-12-24' END AS date FROM paths""")
def folder_dates(spark, sf):
    rows = folders.path_dates(_paths(spark, sf), "folder")
    return rows.select("id", F.col("leaf").alias("name"), folders.date_label(F.col("date")).alias("date"))


@query(CATALOG_SQL + _PATHS + """SELECT id, CASE user_id % 8 WHEN 3 THEN 'Brazil' WHEN 7 THEN 'Brazil' WHEN 5 THEN 'Italy' END AS country, CASE user_id % 8 WHEN 3 THEN 'Minas Gerais' END AS region,
  CASE user_id % 8 WHEN 3 THEN 'Ouro Preto' WHEN 5 THEN 'Roma' END AS city, CASE user_id % 8 WHEN 3 THEN 'Brasil' WHEN 7 THEN 'Brasil' WHEN 5 THEN 'ITALIA' END AS said,
  CASE user_id % 8 WHEN 5 THEN 'Europe/Rome' END AS zone, user_id % 8 = 5 AS sure FROM paths""")
def path_hierarchy(spark, sf):
    names = spark.createDataFrame([("brasil", "Brazil"), ("brazil", "Brazil"), ("italia", "Italy")], "alias string, country string")
    zones = spark.createDataFrame([("Brazil", "America/Sao_Paulo"), ("Brazil", "America/Manaus"), ("Italy", "Europe/Rome")], "country string, zone string")
    return folders.zones(folders.hierarchy(_paths(spark, sf), "folder", names), zones)


@query(CATALOG_SQL + """SELECT id, CASE id % 4 WHEN 0 THEN 'Quang Nam' WHEN 1 THEN 'Bahia' WHEN 2 THEN 'Lazio' ELSE 'Province' END AS region FROM media""")
def plain_regions(spark, sf):
    said = F.get(F.array(*map(F.lit, ("Quang Nam Province", "State of Bahia", " Lazio", "Province"))), (F.col("id") % 4).cast("int"))
    return catalog.media(spark, sf).select("id", folders.plain_region(said).alias("region"))


@query(CATALOG_SQL + """, s AS (SELECT source_id, folder, row_number() OVER (PARTITION BY source_id ORDER BY folder) AS k FROM (SELECT DISTINCT source_id, folder FROM media))
SELECT CAST(id AS BIGINT) AS id, (NOT there) AS offline FROM (SELECT id, offline, id % 3 <> 0 AS there FROM media WHERE NOT missing AND source_id <> 4) WHERE (NOT there) <> offline AND id <= (SELECT max(id) FROM (SELECT id FROM media WHERE NOT missing ORDER BY id LIMIT 300))""")
def reconciliation_pass(spark, sf):
    m = catalog.media(spark, sf)
    return scan.reconciled(m, catalog.sources(spark), m.where("id % 3 <> 0"), 0, rows=300)[0]


@query(CATALOG_SQL + """SELECT id AS media_id, folder || '/' || name || '.xmp' AS sidecar FROM media WHERE id % 10 = 0 UNION ALL SELECT id, folder || '/' || regexp_replace(name, '\\.[^.]*$', '') || '.XMP' FROM media WHERE id % 10 = 1""")
def sidecar_owners(spark, sf):
    m = catalog.media(spark, sf)
    full = m.where("id % 10 = 0").select(F.concat("folder", F.lit("/"), "name", F.lit(".xmp")).alias("path"))
    stem = m.where("id % 10 = 1").select(F.concat("folder", F.lit("/"), F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".XMP")).alias("path"))
    return scan.sidecars(m, full.unionByName(stem))


@query(CATALOG_SQL + """SELECT CASE WHEN id % 5 = 0 THEN 'gone' WHEN id % 7 = 0 THEN 'new' WHEN id % 11 = 0 THEN 'changed' WHEN id % 13 = 0 THEN 'touched' ELSE 'same' END AS change, count(*) AS n FROM media WHERE NOT (id % 35 = 0) GROUP BY 1""")
def sidecar_changes(spark, sf):
    m = catalog.media(spark, sf).where("id % 35 <> 0").select(F.col("id").alias("sidecar"), F.col("quick_hash").alias("digest"), F.lit(1).alias("mtime"))
    k = F.col("sidecar")
    after = m.where(k % 5 != 0).withColumns({"digest": F.when(k % 11 == 0, "other").otherwise(F.col("digest")), "mtime": F.when(k % 13 == 0, 2).otherwise(1)})
    return scan.sidecar_changes(m.where((k % 7 != 0) | (k % 5 == 0)), after).groupBy("change").agg(F.count("*").alias("n"))


@query(CATALOG_SQL + """SELECT source_id, CASE source_id WHEN 1 THEN 'available' WHEN 2 THEN 'drawer' WHEN 3 THEN 'moved' ELSE 'folder gone' END AS state FROM sources WHERE source_id IN (SELECT source_id FROM media)""")
def source_states(spark, sf):
    own = catalog.media(spark, sf).select("source_id").distinct()
    at = {1: ("/Users/me/fotos", None), 2: ("/Volumes/A/fotos", "vA"), 3: ("/Volumes/B/fotos", "vB"), 4: ("/Users/me/old", None)}
    known = spark.createDataFrame([(k, *v) for k, v in at.items()], "source_id long, path string, volume string").join(own, "source_id", "left_semi")
    probes = spark.createDataFrame([("/Users/me/fotos", True, None, None), ("/Users/me/old", False, None, None), (None, None, "vB", "/Volumes/B 1")], "path string, exists boolean, volume string, mounted_at string")
    return scan.availability(known, probes)


@query(CATALOG_SQL + """SELECT id, CASE WHEN id % 6 < 2 THEN source_id WHEN id % 6 < 4 THEN source_id END AS source_id FROM media""")
def source_resolution(spark, sf):
    m = catalog.media(spark, sf)
    known = m.select("source_id").distinct().select("source_id", F.concat(F.lit("/s"), "source_id").alias("path"), F.lit(1).alias("device"), F.col("source_id").alias("inode"))
    k = F.col("id") % 6
    asked = m.select("id", F.when(k < 2, F.concat(F.lit("/s"), "source_id")).otherwise("/elsewhere").alias("path"), F.lit(1).alias("device"), F.when((k >= 2) & (k < 4), F.col("source_id")).otherwise(-1).alias("inode"))
    return scan.resolved(known, asked).select("id", "source_id")

"""Queries in which each branch of a rule has rows: gaps, names, packages, sidecars, states, filters, re-pointing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.dates import date_in_name
from framelake.operators import facets, filters, ingest, repointing, sessions
from framelake.plans.registry import query
from framelake.session import shared_folder, table
from framelake.sources import catalog, copies, files, scan
from framelake.sources.catalog import CATALOG_SQL


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("id"), catalog.media(spark, sf_dir)
    return m.withColumns({
        "inherited_lat": F.when(F.col("gps_lat").isNull() & (n % 3 == 0), 1.0), "image_type": F.when(n % 5 == 0, "screen").when(n % 5 == 1, "received").when(n % 5 != 2, "photo"),
        "confirmed_type": F.when(n % 7 == 0, "photo").when(n % 7 == 1, "screen"), "trip_id": F.when(n % 4 == 0, n % 10), "occasion_id": F.when(n % 4 == 1, n % 6),
    })


_JUDGED = CATALOG_SQL + """, judged AS (SELECT *, CASE WHEN gps_lat IS NULL AND id % 3 = 0 THEN 1.0 END AS inherited_lat, CASE id % 5 WHEN 0 THEN 'screen' WHEN 1 THEN 'received' WHEN 2 THEN NULL ELSE 'photo' END AS image_type,
  CASE id % 7 WHEN 0 THEN 'photo' WHEN 1 THEN 'screen' END AS confirmed_type, CASE WHEN id % 4 = 0 THEN id % 10 END AS trip_id, CASE WHEN id % 4 = 1 THEN id % 6 END AS occasion_id FROM media)"""
_GAPS = {
    "total": "true", "no_date": "taken_at IS NULL", "no_gps": "(gps_lat IS NULL OR gps_lon IS NULL) AND inherited_lat IS NULL", "inherited_place": "inherited_lat IS NOT NULL", "not_photo": "coalesce(confirmed_type, image_type) <> 'photo'",
    "type_to_confirm": "confirmed_type IS NULL AND image_type <> 'photo'", "no_group": "trip_id IS NULL AND occasion_id IS NULL", "no_camera": "make IS NULL AND model IS NULL", "no_suggestion": "id NOT IN (SELECT media_id FROM suggestions)",
    "low_confidence": "id IN (SELECT media_id FROM suggestions WHERE level = 'low')", "medium_confidence": "id IN (SELECT media_id FROM suggestions WHERE level = 'medium')", "read_error": "read_error IS NOT NULL",
}


@query(_JUDGED + " UNION ALL ".join(f" SELECT '{g}' AS gap, count(*) AS n FROM judged WHERE {c}" for g, c in _GAPS.items()))
def panorama_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, AGG-9: all gaps of a catalog with inferred places, kinds and groups."""
    return facets.panorama(_judged(spark, sf_dir), catalog.suggestions(spark, sf_dir))


@query(_JUDGED + " UNION ALL ".join(f" SELECT '{g}' AS gap, id FROM judged WHERE ({c}) AND year(taken_at) = 2024" for g, c in _GAPS.items() if g in ("inherited_place", "not_photo", "type_to_confirm", "no_group")))
def filter_year_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, FLT-11: files of a year by gaps that need inference."""
    m, out = _judged(spark, sf_dir), None
    for g in ("inherited_place", "not_photo", "type_to_confirm", "no_group"):
        one = filters.filtered(m, filters.MediaFilters(year=2024, gap=g)).select(F.lit(g).alias("gap"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(_JUDGED + " SELECT 'trip' AS by, id FROM judged WHERE trip_id = 4 UNION ALL SELECT 'occasion', id FROM judged WHERE occasion_id = 5 UNION ALL SELECT 'source', id FROM judged WHERE source_id = 2 UNION ALL SELECT 'city', id FROM judged JOIN places USING (location_id) WHERE city ILIKE '%an%'")
def filter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, FLT-8: by trip, event, source and city."""
    m, how = _judged(spark, sf_dir), filters.Context(places=catalog.places(spark, sf_dir))
    each = {"trip": filters.MediaFilters(trip_id=4), "occasion": filters.MediaFilters(occasion_id=5), "source": filters.MediaFilters(source_id=2), "city": filters.MediaFilters(city="an")}
    parts = [filters.filtered(m, f, how).select(F.lit(k).alias("by"), "id") for k, f in each.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


#: Names and the dates that they carry.
_NAMES = (
    ("IMG-20240229-WA", "2024-02-29"), ("VID-20230229-WA", None), ("PXL_20210504_", "2021-05-04"), ("Screenshot 2019-12-31 ", "2019-12-31"), ("2020-13-01 ", None), ("99920210504", None), ("x20210504", "2021-05-04"),
    ("photo_1989-01-01_", None), ("19900101", None), ("IMG_", None), ("AUD-20991231-WA", "2099-12-31"), ("2019-12-31 and 20200101 ", "2019-12-31"),
)


@query("WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {'NULL' if d is None else repr(d)})" for k, (n, d) in enumerate(_NAMES)) + f""") AS t(k, name, day))
SELECT event_id AS id, name || '_' || (event_id % 50) || '.jpg' AS name, CASE WHEN name = '19900101' THEN '1990-01-01' ELSE day END AS day FROM events JOIN n ON k = event_id % {len(_NAMES)}""")
def dates_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-5: every form of a date in a name, impossible dates and digits around it."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    name = F.concat(F.get(F.array(*(F.lit(x) for x, _ in _NAMES)), (n % len(_NAMES)).cast("int")), F.lit("_"), n % 50, F.lit(".jpg"))
    return e.select(n.alias("id"), name.alias("name"), date_in_name(name).cast("string").alias("day"))


#: Paths inside and beside packages, and their role.
_PACKAGES = (
    ("/a/b/", "own"), ("/a/My.photoslibrary/originals/", "own"), ("/a/My.photoslibrary/resources/derivatives/masters/", "derived"), ("/a/X.aplibrary/Masters/", "own"), ("/a/X.MIGRATEDPHOTOLIBRARY/Previews/", "derived"),
    ("/a/P.photolibrary/ORIGINALS/", "own"), ("/a/C Smart Previews.lrdata/originals/", "derived"), ("/a/photoslibrary/x/", "own"), ("/a/My.photoslibrary/x/Other.photoslibrary/originals/", "derived"),
)


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{p}', '{r}')" for k, (p, r) in enumerate(_PACKAGES)) + f") AS t(k, folder, role)) SELECT doc_id AS id, folder || doc_id || '.jpg' AS path, role FROM documents JOIN p ON k = doc_id % {len(_PACKAGES)}")
def package_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: all kinds of packages, originals in them and not, packages in packages."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.get(F.array(*(F.lit(p) for p, _ in _PACKAGES)), (n % len(_PACKAGES)).cast("int")), n, F.lit(".jpg"))
    return d.select(n.alias("id"), path.alias("path"), files.role_in_package(path).alias("role"))


@query("""
SELECT event_id AS id, CASE WHEN event_id % 5 <> 0 THEN to_timestamp(1700000000 + event_id) :: TIMESTAMP END AS taken_utc, CASE WHEN event_id % 4 = 1 THEN 1.5 WHEN event_id % 4 = 2 THEN 3.5 END AS gps_lat, CASE WHEN event_id % 4 = 1 THEN 2.5 WHEN event_id % 4 = 2 THEN 4.5 END AS gps_lon,
  event_id % 3 = 0 AS favourite, CASE WHEN event_id % 2 = 0 THEN 'Ana,Rui' END AS people, CASE WHEN event_id % 6 < 3 THEN 'Trip ' || (event_id % 6) END AS album FROM events""")
def takeout_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: dates, places of either kind or none, favourites, people, albums and the export's own folders by year."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    at = lambda a, b: F.struct(F.lit(a).alias("latitude"), F.lit(b).alias("longitude"))
    json = F.to_json(F.struct(
        F.when(n % 5 != 0, F.struct((1_700_000_000 + n).cast("string").alias("timestamp"))).when(n % 10 == 0, F.struct(F.lit("soon").alias("timestamp"))).alias("photoTakenTime"),
        F.when(n % 4 == 1, at(1.5, 2.5)).otherwise(at(0.0, 0.0)).alias("geoData"), F.when(n % 4 == 2, at(3.5, 4.5)).when(n % 4 == 3, at(0.0, 0.0)).alias("geoDataExif"),
        F.when(n % 3 == 0, True).alias("favorited"), F.when(n % 2 == 0, F.array(F.struct(F.lit("Ana").alias("name")), F.struct(F.lit("Rui").alias("name")))).alias("people"),
    ))
    folder = F.when(n % 6 < 3, F.concat(F.lit("Trip "), n % 6)).otherwise("Photos from 2023")
    side = e.select(F.concat(F.lit("Takeout/"), folder, F.lit("/"), n).alias("path"), json.alias("json"))
    return files.takeout(side).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("id"), "taken_utc", "gps_lat", "gps_lon", "favourite", F.array_join("people", ",").alias("people"), "album")


@query("""
SELECT s_suppkey AS source_id, CASE s_suppkey % 5 WHEN 0 THEN 'available' WHEN 1 THEN 'moved' WHEN 2 THEN 'drawer' WHEN 3 THEN 'folder gone' ELSE 'folder gone' END AS state FROM supplier""")
def source_states_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: a source for each supplier: there, mounted elsewhere, not mounted, its folder gone from a mounted or the inner disk."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    path = F.when(k % 5 == 3, F.concat(F.lit("/Users/me/"), k)).otherwise(F.concat(F.lit("/Volumes/v"), k, F.lit("/fotos")))
    known = s.select(k.alias("source_id"), path.alias("path"), F.when(k % 5 != 3, F.concat(F.lit("v"), k)).alias("volume"))
    looked = known.select("path", (F.col("source_id") % 5 == 0).alias("exists"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("mounted_at"))
    mounted = known.where("source_id % 5 IN (0, 1, 4)").select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("exists"), "volume", F.concat(F.lit("/Volumes/v"), "source_id", F.when(F.col("source_id") % 5 == 1, " 1").otherwise("")).alias("mounted_at"))
    return scan.availability(known, looked.unionByName(mounted))


@query("""
WITH m AS (SELECT event_id AS id, event_id % 3 + 1 AS source, CASE WHEN event_id % 5 = 0 THEN 'apple://' || event_id WHEN event_id % 5 = 1 THEN '/Volumes/photo 1/' || (event_id + 1) ELSE '/Volumes/photo/' || event_id END AS path FROM events)
SELECT CAST(source AS INTEGER) AS source_id, count(*) FILTER (starts_with(path, '/Volumes/photo/')) AS moved, count(*) FILTER (NOT starts_with(path, '/Volumes/photo/')) AS untouched,
  (SELECT count(*) FROM (SELECT replace(path, '/Volumes/photo/', '/Volumes/photo 1/') AS p FROM m o WHERE o.source = m.source GROUP BY 1 HAVING count(*) > 1)) AS collisions,
  (SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT path || ' -> ' || replace(path, '/Volumes/photo/', '/Volumes/photo 1/') AS x FROM m o WHERE o.source = m.source AND starts_with(path, '/Volumes/photo/') ORDER BY path LIMIT 10)) AS shown FROM m GROUP BY source""")
def repointing_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22: what re-pointing each source would do; collisions are those of its own paths, references stay."""
    m, out = _pointed(spark, sf_dir), None
    for k in (1, 2, 3):
        one = repointing.preview(m, k, "/Volumes/photo", "/Volumes/photo 1/").withColumn("source_id", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _pointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    path = F.when(n % 5 == 0, F.concat(F.lit("apple://"), n)).when(n % 5 == 1, F.concat(F.lit("/Volumes/photo 1/"), n + 1)).otherwise(F.concat(F.lit("/Volumes/photo/"), n))
    return table(spark, sf_dir, "events").select(n.alias("id"), (n % 3 + 1).alias("source_id"), path.alias("path"))


@query("""
SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'apple://' || event_id WHEN event_id % 3 = 1 THEN '/Volumes/new/x/' || event_id ELSE '/Volumes/photo/' || event_id END AS path FROM events""")
def repointed_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22: two sources re-pointed after a look at samples, one of them back by its audit."""
    n = F.col("event_id")
    path = F.when(n % 5 == 0, F.concat(F.lit("apple://"), n)).otherwise(F.concat(F.lit("/Volumes/photo/"), n))
    rows = table(spark, sf_dir, "events").select(n.alias("id"), (n % 3 + 1).alias("source_id"), path.alias("path"))
    present = rows.select(F.concat(F.lit("/Volumes/new/x/"), "id").alias("path")).unionByName(rows.select(F.concat(F.lit("/Volumes/photo/"), "id").alias("path")))
    for k in (2, 3):
        rows = repointing.applied(rows, present, k, "/Volumes/photo/", "/Volumes/new/x")
    return repointing.undone(rows, present, {"source_id": 3, "old": "/Volumes/photo/", "new": "/Volumes/new/x"}).select("id", "path")


@query(CATALOG_SQL + """, m AS (SELECT id % 60 AS session, id, taken_at, CASE WHEN id % 5 <> 4 THEN country END AS country, CASE WHEN id % 3 <> 0 AND id % 5 <> 4 THEN city END AS city FROM media LEFT JOIN places USING (location_id) WHERE taken_at IS NOT NULL),
c AS (SELECT session, country, count(*) AS n, min(struct_pack(a := taken_at, i := id)) AS f FROM m WHERE country IS NOT NULL GROUP BY 1, 2),
p AS (SELECT session, concat_ws(', ', city, country) AS place, min(struct_pack(a := taken_at, i := id)) AS f FROM m WHERE country IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY f) AS k FROM p)
SELECT session, (SELECT country FROM c WHERE c.session = r.session ORDER BY n DESC, f LIMIT 1) AS country, string_agg(place, '; ' ORDER BY k) FILTER (k <= 5) AS places,
  (SELECT CASE WHEN count(*) >= 2 THEN string_agg(country, '; ' ORDER BY f) END FROM c WHERE c.session = r.session AND n >= 3) AS legs FROM r GROUP BY session""")
def session_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: the country of most files, five places and the legs of each session, in the order in which they were seen."""
    n, m = F.col("id"), catalog.media(spark, sf_dir).where("taken_at IS NOT NULL").join(catalog.places(spark, sf_dir), "location_id", "left")
    rows = m.select("id", (n % 60).alias("session"), "taken_at", F.when(n % 5 != 4, F.col("country")).alias("country"), F.when((n % 3 != 0) & (n % 5 != 4), F.col("city")).alias("city"))
    return sessions.geography(rows, "session", "taken_at").select("session", "country", F.array_join("places", "; ").alias("places"), F.array_join("legs", "; ").alias("legs"))


@query(CATALOG_SQL + """, m AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'apple://' || id WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN upper(folder) ELSE folder END AS f, CASE WHEN id % 4 < 2 THEN 'same' || (id % 50) ELSE name END AS n FROM media JOIN sources USING (source_id)),
r AS (SELECT *, f || '/' || n AS path, available AND NOT missing AND NOT offline AS up FROM m),
k AS (SELECT min(path) AS path, bool_or(up) AS up, bool_or(up AND role = 'holding') AS ready, list(DISTINCT 'the ' || kind) AS names FROM r WHERE f IS NOT NULL AND NOT contains(path, '://') GROUP BY lower(path)),
v AS (SELECT CASE WHEN split_part(path, '/', 2) = 'Volumes' THEN '/Volumes/' || split_part(path, '/', 3) ELSE '/' END AS root, up, ready, names FROM k)
SELECT root, count(*) AS photos, count(*) FILTER (up) AS reachable, count(*) FILTER (ready) AS ready, array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS sources FROM v GROUP BY root
UNION ALL SELECT NULL, count(*), 0, 0, '' FROM r WHERE f IS NULL OR contains(path, '://')""")
def inventory_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: one photo of several sources and spellings, names of sources, references without a path."""
    n, m = F.col("id"), catalog.media(spark, sf_dir)
    folder = F.when(n % 17 == 0, F.concat(F.lit("apple://"), n)).when(n % 19 == 0, None).when(n % 23 == 0, F.upper("folder")).otherwise(F.col("folder"))
    m = m.withColumns({"folder": folder, "name": F.when(n % 4 < 2, F.concat(F.lit("same"), n % 50)).otherwise(F.col("name"))})
    named = catalog.sources(spark).withColumn("name", F.concat(F.lit("the "), "kind"))
    return facets.places_of_files(m, named)


@query("""
SELECT event_id AS path, CASE WHEN event_id % 3 = 0 THEN 'new' WHEN event_id % 7 = 1 OR event_id % 11 = 2 THEN 'changed' ELSE 'same' END AS change, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'changed' END AS forced FROM events""")
def changes_by_inode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: a file of the same size and time under another inode has changed; a forced scan reads everything again."""
    n = F.col("event_id")
    seen = table(spark, sf_dir, "events").select(n.alias("path"), n.alias("bytes"), F.col("ts").alias("mtime"), (n % 100).alias("inode"))
    known = seen.where("path % 3 <> 0").withColumns({"inode": F.when(F.col("path") % 7 == 1, -1).otherwise(F.col("inode")), "bytes": F.when(F.col("path") % 11 == 2, 0).otherwise(F.col("bytes"))})
    return ingest.changes(known, seen).join(ingest.changes(known, seen, force=True).withColumnRenamed("change", "forced"), "path")


@query("""
WITH p AS (SELECT page_id, page_id % 10 = 0 AS unsafe, page_id % 13 = 5 OR html IS NULL AS gone FROM pages)
SELECT count(*) AS total, count(*) FILTER (NOT unsafe AND NOT gone) AS done, CAST(0 AS BIGINT) AS refused, count(*) FILTER (unsafe OR gone) AS errors, count(*) FILTER (unsafe) AS conflicts, CAST(0 AS BIGINT) AS open,
  count(*) FILTER (NOT unsafe AND NOT gone) || ' of ' || count(*) || ' ready' AS dry_run FROM p""")
def copy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: a plan's counts after two runs, the second of which found its own copies there, and the last dry run."""
    root, n = f"{copies.mounted(shared_folder(spark))}/copies-{uuid.uuid4().hex}", F.col("page_id")
    target, content = F.when(n % 10 != 0, F.concat(F.lit("d/"), n % 20, F.lit("/"), n)), F.when(n % 13 != 5, F.encode("html", "utf-8"))
    plan = table(spark, sf_dir, "pages").select(n.alias("media_id"), target.alias("target"), F.when(n % 10 == 0, "unsafe destination").alias("conflict"), content.alias("content"))
    about = plan.select("media_id", "target", "conflict", F.octet_length("content").alias("bytes"), F.col("content").isNotNull().alias("there"))
    for _ in range(2):
        copies.dry_run(about, about.limit(0), root, "plan")
        audit = copies.copied(plan, root, "plan")
    return copies.summary(plan, audit)

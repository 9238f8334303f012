"""Queries of what arrives: imports of outside catalogs, tags of files, trees of folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import imports
from framelake.plans.registry import query
from framelake.session import staged, table
from framelake.sources import discovery, tags

NOW = "2024-01-25 00:00:00"


def _import(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, files, assets): assets of which some have no file, some files that can't be read, are unchanged or new."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    ts, second = F.col("ts").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz")
    shift = F.make_dt_interval(hours=(n % 5 - 2).cast("int"))
    path = F.concat(F.lit("/library/u"), F.col("user_id") % 10, F.lit("/"), n, F.lit(".JPG"))
    referred = n % 4 == 0
    texts = lambda *x: F.array(*x)
    assets = e.where(n % 10 != 9).select(
        F.concat(F.lit("A"), n).alias("external_id"), F.when(~referred, path).alias("path"), F.when(n % 8 == 0, F.concat(F.lit("/old/"), n, F.lit(".CR3"))).alias("original_path"),
        F.when(n % 12 != 0, F.concat("event_type", n, F.lit(".CR3"))).alias("name"), F.when(n % 24 == 0, F.concat(F.lit("Title "), n)).alias("title"), F.when(n % 3 == 0, F.concat(F.lit("About "), n)).alias("description"),
        F.when(n % 16 != 0, n).alias("bytes"), F.when(n % 7 != 1, F.when(n % 40 == 0, F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00"))).otherwise(ts + shift)).alias("taken_at"), F.when((n % 7 != 1) & (n % 3 != 0) & (n % 40 != 0), ts).alias("taken_at_utc"),
        F.when(n % 6 < 2, (n % 90).cast("double")).alias("gps_lat"), F.when(n % 6 < 2, -(n % 180).cast("double")).alias("gps_lon"), (n % 5 == 0).alias("favourite"),
        F.when(n % 2 == 0, texts(F.lit("album"), F.concat(F.lit("a"), n % 3))).alias("albums"), F.when(n % 11 == 0, texts(F.lit("Ana"))).alias("people"), F.when(n % 3 != 1, texts(F.lit("Selected"), F.concat(F.lit("k"), n % 4))).alias("keywords"),
    )
    wall = F.when(n % 6 == 3, second + F.expr("INTERVAL 1 DAY")).when(n % 6 != 0, second + shift)
    files = e.where(~referred & (n % 13 != 3)).select(
        path.alias("path"), (n % 1000 + 1).alias("bytes"), second.alias("mtime"), wall.alias("taken_at"), F.when(n % 6 == 5, second).alias("taken_at_utc"),
        F.lit("Canon").alias("make"), F.when(n % 2 == 1, "R6").alias("model"), F.when(n % 9 == 1, 1.5).alias("gps_lat"), F.when(n % 9 == 1, 2.5).alias("gps_lon"),
    )
    late = F.when(n % 3 == 0, F.expr("INTERVAL 1 SECOND")).otherwise(F.expr("INTERVAL 5 SECOND"))
    catalog = e.where(n % 3 != 1).select(
        F.when(referred, F.concat(F.lit("apple://A"), n)).otherwise(path).alias("path"), F.lit("/known").alias("folder"), F.lit("known").alias("name"), F.lit("x").alias("ext"), F.when(n % 5 == 0, 0).otherwise(n % 1000 + 1).alias("bytes"), (second + late).alias("mtime"),
        F.lit(None).cast("timestamp_ntz").alias("taken_at"), F.lit(None).cast("timestamp_ntz").alias("taken_at_utc"), F.lit("Known").alias("make"), F.lit(None).cast("string").alias("model"), F.lit(7.0).alias("gps_lat"), F.lit(8.0).alias("gps_lon"), (n % 2 == 0).alias("missing"), F.lit("holding").alias("role"),
    )
    return catalog, files, assets


@query(f"""
WITH e AS (SELECT event_id AS n, event_id % 4 = 0 AS ref, ts, date_trunc('second', ts) AS sec, to_hours(event_id % 5 - 2) AS shift, event_type, '/library/u' || (user_id % 10) || '/' || event_id || '.JPG' AS p FROM events),
r AS (SELECT *, n % 10 <> 9 AS seen, NOT ref AND n % 13 <> 3 AS there, n % 3 <> 1 AS known, n % 3 = 0 AND n % 5 <> 0 AS alike,
  CASE WHEN n % 7 <> 1 THEN CASE WHEN n % 40 = 0 THEN TIMESTAMP '2100-01-01' ELSE ts + shift END END AS aw, CASE WHEN n % 7 <> 1 AND n % 3 <> 0 AND n % 40 <> 0 THEN ts END AS au,
  CASE WHEN n % 6 = 3 THEN sec + INTERVAL 1 DAY WHEN n % 6 <> 0 THEN sec + shift END AS fw, CASE WHEN n % 6 = 5 THEN sec END AS fu FROM e),
c AS (SELECT *, CASE WHEN NOT seen THEN 'unseen' WHEN ref THEN 'reference' WHEN NOT there THEN 'unreadable' WHEN known AND alike THEN 'same' WHEN known THEN 'changed' ELSE 'new' END AS change FROM r WHERE (seen OR known) AND NOT (seen AND NOT ref AND NOT there AND NOT known)),
k AS (SELECT *, change IN ('unseen', 'unreadable', 'same') AS kept, CASE WHEN aw <= TIMESTAMP '{NOW}' + INTERVAL 1 DAY THEN aw END AS rw FROM c)
SELECT CASE WHEN ref THEN 'apple://A' || n ELSE p END AS path, change,
  CASE WHEN kept THEN '/known' WHEN ref THEN CASE WHEN n % 8 = 0 THEN '/old' WHEN known THEN '/known' ELSE '' END ELSE regexp_replace(p, '/[^/]*$', '') END AS folder,
  CASE WHEN kept THEN 'known' WHEN ref THEN CASE WHEN n % 12 <> 0 THEN event_type || n || '.CR3' WHEN n % 24 = 0 THEN 'Title ' || n ELSE 'apple:A' || n END ELSE n || '.JPG' END AS name,
  CASE WHEN kept THEN 'x' WHEN ref THEN CASE WHEN n % 12 <> 0 THEN 'cr3' WHEN known THEN 'x' ELSE '' END ELSE 'jpg' END AS ext,
  CASE WHEN kept THEN CASE WHEN n % 5 = 0 THEN 0 ELSE n % 1000 + 1 END WHEN ref THEN CASE WHEN n % 16 <> 0 THEN n WHEN known THEN CASE WHEN n % 5 = 0 THEN 0 ELSE n % 1000 + 1 END ELSE 0 END ELSE n % 1000 + 1 END AS bytes,
  CASE WHEN kept THEN NULL WHEN ref THEN rw ELSE coalesce(fw, aw) END AS taken_at,
  CASE WHEN kept THEN NULL WHEN ref THEN CASE WHEN rw IS NOT NULL THEN coalesce(au, rw) END WHEN fw IS NOT NULL THEN coalesce(fu, CASE WHEN abs(epoch_us(aw) - epoch_us(fw)) < 1000000 THEN fw + (au - aw) END, fw) ELSE coalesce(au, aw) END AS taken_at_utc,
  CASE WHEN kept THEN 'Known' WHEN ref THEN CASE WHEN known THEN 'Known' END ELSE 'Canon' END AS make, CASE WHEN NOT kept AND NOT ref AND n % 2 = 1 THEN 'R6' END AS model,
  CASE WHEN kept THEN 7.0 WHEN NOT ref AND n % 9 = 1 THEN 1.5 WHEN n % 6 < 2 THEN n % 90 WHEN known THEN 7.0 END :: DOUBLE AS gps_lat, CASE WHEN kept THEN 8.0 WHEN NOT ref AND n % 9 = 1 THEN 2.5 WHEN n % 6 < 2 THEN -(n % 180) WHEN known THEN 8.0 END :: DOUBLE AS gps_lon,
  CASE WHEN NOT kept AND ref THEN true ELSE known AND n % 2 = 0 END AS missing, CASE WHEN NOT kept AND ref THEN 'witness' ELSE 'holding' END AS role FROM k""")
def import_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: new, changed, same, references, unreadable and unseen rows; pairs of moments chosen together."""
    out = imports.imported(*_import(spark, sf_dir), "apple", F.to_timestamp_ntz(F.lit(NOW)))
    return out.select("path", "change", "folder", "name", "ext", "bytes", "taken_at", "taken_at_utc", "make", "model", "gps_lat", "gps_lon", "missing", "role")


@query("""
WITH e AS (SELECT event_id AS n, CASE WHEN event_id % 4 = 0 THEN 'apple://A' || event_id ELSE '/library/u' || (user_id % 10) || '/' || event_id || '.JPG' END AS key, CASE WHEN event_id % 7 <> 1 THEN CASE WHEN event_id % 40 = 0 THEN TIMESTAMP '2100-01-01' ELSE ts + to_hours(event_id % 5 - 2) END END AS aw,
  CASE WHEN event_id % 7 <> 1 AND event_id % 3 <> 0 AND event_id % 40 <> 0 THEN ts END AS au FROM events WHERE event_id % 10 <> 9),
new AS (SELECT key, 'apple' AS namespace, 'titulo' AS name, 'Title ' || n AS value FROM e WHERE n % 24 = 0 UNION ALL SELECT key, 'apple', 'descricao', 'About ' || n FROM e WHERE n % 3 = 0 UNION ALL SELECT key, 'apple', 'favorito', 'true' FROM e WHERE n % 5 = 0
  UNION ALL SELECT key, 'apple', 'album', unnest(['album', 'a' || (n % 3)]) FROM e WHERE n % 2 = 0 UNION ALL SELECT key, 'apple', 'pessoa', 'Ana' FROM e WHERE n % 11 = 0 UNION ALL SELECT key, 'apple', 'palavra_chave', unnest(['Selected', 'k' || (n % 4)]) FROM e WHERE n % 3 <> 1
  UNION ALL SELECT key, 'apple', 'gps', (n % 90) || '.000000,' || CASE WHEN n % 180 = 0 THEN '-0' ELSE CAST(-(n % 180) AS VARCHAR) END || '.000000' FROM e WHERE n % 6 < 2
  UNION ALL SELECT key, 'apple', 'data', strftime(aw, '%Y-%m-%dT%H:%M:%S.%f') FROM e WHERE aw IS NOT NULL UNION ALL SELECT key, 'apple', 'data_utc', strftime(au, '%Y-%m-%dT%H:%M:%S.%f') FROM e WHERE au IS NOT NULL)
SELECT * FROM new UNION ALL SELECT key, 'curadoria', 'palavra_chave', value FROM new WHERE name = 'palavra_chave'
UNION ALL SELECT '/other/' || event_id, 'apple', 'titulo', 'stays' FROM events WHERE event_id % 10 = 9 UNION ALL SELECT key, 'curadoria', 'palavra_chave', 'own' FROM e WHERE n % 5 = 1""")
def import_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19, SRC-20: a namespace said anew, curated words united."""
    _, _, assets = _import(spark, sf_dir)
    new = staged(imports.entries(assets, "apple"), "entries")
    n = F.regexp_extract("key", "([0-9]+)(\\.JPG)?$", 1).cast("long")
    keys = new.select("key").distinct()
    old = lambda df, namespace, name, value: df.select("key", F.lit(namespace).alias("namespace"), F.lit(name).alias("name"), F.lit(value).alias("value"))
    others = table(spark, sf_dir, "events").where("event_id % 10 = 9").select(F.concat(F.lit("/other/"), "event_id").alias("key"))
    everyone = assets.select(F.coalesce("path", F.concat(F.lit("apple://"), "external_id")).alias("key"))
    parts = [old(keys, "apple", "titulo", "outdated"), old(others, "apple", "titulo", "stays"), old(everyone.where(n % 5 == 1), "curadoria", "palavra_chave", "own"), old(new.where("name = 'palavra_chave' AND value = 'k2'").select("key").distinct(), "curadoria", "palavra_chave", "k2")]
    return imports.after_import(reduce(DataFrame.unionByName, parts), new, everyone, "apple")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    say = lambda c, form: F.date_format(c, form)
    when = lambda k, m, v: F.when(n % m == k, v)
    tree = F.struct(
        when(0, 8, F.concat(say("ts", "yyyy:MM:dd HH:mm:ss"), F.lit(".32"))).alias("Composite:SubSecDateTimeOriginal"), when(1, 4, say("ts", "yyyy:MM:dd HH:mm:ss")).alias("EXIF:DateTimeOriginal"), when(2, 8, say("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("XMP:DateCreated"),
        when(3, 8, say("ts", "yyyy:MM:dd")).alias("IPTC:DateCreated"), when(6, 8, F.lit("2100:01:01 00:00:00")).alias("EXIF:CreateDate"), F.lit("2020:02:02 02:02:02").alias("EXIF:ModifyDate"),
        when(0, 3, F.lit("+02:00")).alias("EXIF:OffsetTimeOriginal"), when(1, 3, F.lit("-03:30")).alias("EXIF:OffsetTime"), when(0, 2, F.lit("Canon")).alias("EXIF:Make"), F.lit("Other").alias("XMP:Make"), when(0, 5, F.lit("")).alias("EXIF:Model"), F.lit("M").alias("XMP:Model"),
        when(1, 5, F.lit("RF 50")).alias("MakerNotes:LensType"), when(0, 4, F.lit("Rotate 90 CW")).alias("EXIF:Orientation"), when(0, 7, (n % 4000)).alias("EXIF:ImageWidth"), when(1, 7, F.lit("+300 ")).alias("File:ImageHeight"),
        when(0, 6, F.col("value")).alias("Composite:GPSLatitude"), when(0, 6, F.lit("-43.5")).alias("Composite:GPSLongitude"), when(0, 9, F.concat(F.lit(" id"), n)).alias("QuickTime:ContentIdentifier"),
        when(0, 3, F.array(F.lit("Viagens|2019|Sul"), F.lit("Sul"))).alias("XMP:HierarchicalSubject"), when(1, 3, F.lit(" solo ")).alias("IPTC:Keywords"), F.lit("(Binary data 7 bytes)").alias("EXIF:Blob"), F.lit("zzz").alias("EXIF:ThumbnailImage"),
        F.struct((n % 3).alias("a"), F.array(F.struct(F.lit("x").alias("b")), F.struct(n.cast("string").alias("b"))).alias("list"), F.array(F.lit("p"), F.lit("q")).alias("words")).alias("XMP:Tree"),
    )
    return staged(e.select(n.alias("id"), F.to_json(tree).alias("json")), "tags").select("id", F.parse_json("json").alias("tree"))


@query(f"""
WITH e AS (SELECT event_id AS id, event_id AS n, date_trunc('second', ts) AS sec, value,
  CASE WHEN event_id % 8 = 0 OR event_id % 4 = 1 OR event_id % 8 = 2 THEN date_trunc('second', ts) WHEN event_id % 8 = 6 THEN NULL WHEN event_id % 8 = 3 THEN date_trunc('day', ts) ELSE TIMESTAMP '2020-02-02 02:02:02' END AS raw FROM events),
t AS (SELECT *, CASE WHEN raw <= TIMESTAMP '{NOW}' + INTERVAL 1 DAY THEN raw END AS taken FROM e)
SELECT id, taken, CASE n % 3 WHEN 0 THEN taken - INTERVAL 2 HOUR WHEN 1 THEN taken + INTERVAL 210 MINUTE END AS taken_utc, CASE WHEN n % 2 = 0 THEN 'Canon' ELSE 'Other' END AS make, 'M' AS model, CASE WHEN n % 5 = 1 THEN 'RF 50' END AS lens,
  CASE WHEN n % 4 = 0 THEN 6 END AS orientation, CASE WHEN n % 7 = 0 THEN n % 4000 END AS width, CASE WHEN n % 7 = 1 THEN 300 END AS height, CASE WHEN n % 6 = 0 THEN value END AS gps_lat, CASE WHEN n % 6 = 0 THEN -43.5 END :: DOUBLE AS gps_lon,
  CASE WHEN n % 9 = 0 THEN 'id' || n END AS capture_id, CASE n % 3 WHEN 0 THEN 'Viagens|2019|Sul,Viagens,2019,Sul' WHEN 1 THEN 'solo' ELSE '' END AS keywords FROM t""")
def tags_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9, SRC-12: the canonical row out of VARIANT tags, by precedence, with lists and single words as keywords."""
    out = tags.canonical(_tagged(spark, sf_dir), "tree", F.to_timestamp_ntz(F.lit(NOW)))
    return out.select("id", "taken", "taken_utc", "make", "model", "lens", "orientation", "width", "height", "gps_lat", "gps_lon", "capture_id", F.array_join("keywords", ",").alias("keywords"))


@query("""
SELECT namespace, name, count(*) AS n, min(value) AS least FROM (
  SELECT 'exif' AS namespace, 'ModifyDate' AS name, '2020:02:02 02:02:02' AS value FROM events UNION ALL SELECT 'xmp', 'Make', 'Other' FROM events UNION ALL SELECT 'exif', 'Make', 'Canon' FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'exif', 'Model', '' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'xmp', 'Model', 'M' FROM events UNION ALL SELECT 'exif', 'Orientation', 'Rotate 90 CW' FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT 'exif', 'OffsetTimeOriginal', '+02:00' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'exif', 'OffsetTime', '-03:30' FROM events WHERE event_id % 3 = 1
  UNION ALL SELECT 'exif', 'DateTimeOriginal', strftime(ts, '%Y:%m:%d %H:%M:%S') FROM events WHERE event_id % 4 = 1 UNION ALL SELECT 'xmp', 'DateCreated', strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM events WHERE event_id % 8 = 2
  UNION ALL SELECT 'iptc', 'DateCreated', strftime(ts, '%Y:%m:%d') FROM events WHERE event_id % 8 = 3 UNION ALL SELECT 'exif', 'CreateDate', '2100:01:01 00:00:00' FROM events WHERE event_id % 8 = 6
  UNION ALL SELECT 'exif', 'ImageWidth', CAST(event_id % 4000 AS VARCHAR) FROM events WHERE event_id % 7 = 0 UNION ALL SELECT 'quicktime', 'ContentIdentifier', ' id' || event_id FROM events WHERE event_id % 9 = 0
  UNION ALL SELECT 'xmp', 'HierarchicalSubject', '["Viagens|2019|Sul","Sul"]' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'iptc', 'Keywords', ' solo ' FROM events WHERE event_id % 3 = 1
  UNION ALL SELECT 'xmp', 'Tree', '{"a":' || (event_id % 3) || ',"list":[{"b":"x"},{"b":"' || event_id || '"}],"words":["p","q"]}' FROM events) GROUP BY 1, 2""")
def tags_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: the entries worth keeping, counted by tag; lists and trees as JSON, pictures and maker notes left out."""
    kept = tags.kept_entries(_tagged(spark, sf_dir), "id", "tree")
    return kept.groupBy("namespace", "name").agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query("""
WITH e AS (SELECT event_id AS id, CAST(event_id AS VARCHAR) AS n FROM events)
SELECT id, 'user' AS name, 'u' || n AS value FROM e UNION ALL SELECT id, 'place.city', 'c' FROM e UNION ALL SELECT id, 'place.deep.er', n FROM e UNION ALL SELECT id, 'words', 'a; b; ' || n FROM e UNION ALL SELECT id, 'rows.k', unnest(['1', n]) FROM e
UNION ALL SELECT id, 'rows', 'plain' FROM e UNION ALL SELECT id, 'props.k', json_extract_string(props, '$.k') FROM events e2 JOIN e ON id = event_id WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def tags_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-29: nested trees made flat: objects in objects, lists of texts, of objects, and of both."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{"user":"u'), n, F.lit('","none":null,"place":{"city":"c","deep":{"er":'), n, F.lit('},"empty":{}},"words":["a","b",'), n, F.lit('],"rows":[{"k":1},"plain",{"k":"'), n, F.lit('"}],"props":'), F.coalesce("props", F.lit("null")), F.lit("}"),
    )
    return tags.flattened(e.select(F.col("event_id").alias("id"), F.parse_json(text).alias("tree")), "id", "tree")


_TREE = """
WITH RECURSIVE d AS (SELECT doc_id AS n, doc_id % 20 AS a, doc_id % 7 AS b FROM documents),
listing AS (
  SELECT '/r/s' || a || '/' || CASE b WHEN 0 THEN '.hidden' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'App.xcassets' WHEN 3 THEN 'skip' ELSE 'f' || b END AS parent, n || CASE n % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.CR3' WHEN 2 THEN '.txt' WHEN 3 THEN '.tmp.jpg' ELSE '.mov' END AS name, 'file' AS kind, n % 50 = 4 AS is_link, NULL AS target, 1 AS device, 100000 + n AS inode, CASE WHEN n % 97 = 5 THEN 'denied' END AS error FROM d
  UNION ALL SELECT DISTINCT '/r/s' || a, CASE b WHEN 0 THEN '.hidden' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'App.xcassets' WHEN 3 THEN 'skip' ELSE 'f' || b END, 'folder', false, NULL, 1, 1000 + 10 * a + b, CASE WHEN a = 3 AND b = 4 THEN 'unmounted' END FROM d
  UNION ALL SELECT DISTINCT '/r', 's' || a, 'folder', false, NULL, 1, 10 + a, NULL FROM d
  UNION ALL SELECT DISTINCT '/r/s' || a || '/f4', 'up', 'folder', true, '/r/s' || ((a + 1) % 20), 1, 10 + (a + 1) % 20, NULL FROM d WHERE b = 4
  UNION ALL SELECT DISTINCT '/r/s' || a, 'again', 'folder', false, NULL, 1, 10 + a, NULL FROM d)
"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a tree whose folders are sources of documents, with links up the tree and folders listed twice."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    a, b = (n % 20).cast("string"), (n % 7).cast("int")
    inner = F.get(F.array(*map(F.lit, (".hidden", "node_modules", "App.xcassets", "skip", "f4", "f5", "f6"))), b)
    under, none = F.concat(F.lit("/r/s"), a), F.lit(None).cast("string")
    end = F.get(F.array(*map(F.lit, (".jpg", ".CR3", ".txt", ".tmp.jpg", ".mov"))), (n % 5).cast("int"))
    row = lambda parent, name, kind, link, target, inode, error: d.select(parent.alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), link.alias("is_link"), target.alias("target"), F.lit(1).alias("device"), inode.alias("inode"), error.alias("error"))
    to = (n % 20 + 1) % 20
    parts = [
        row(F.concat(under, F.lit("/"), inner), F.concat(n, end), "file", n % 50 == 4, none, 100_000 + n, F.when(n % 97 == 5, "denied")),
        row(under, inner, "folder", F.lit(False), none, 1000 + 10 * (n % 20) + n % 7, F.when((n % 20 == 3) & (b == 4), "unmounted")).distinct(),
        row(F.lit("/r"), F.concat(F.lit("s"), a), "folder", F.lit(False), none, 10 + n % 20, none).distinct(),
        row(F.concat(under, F.lit("/f4")), F.when(b == 4, "up"), "folder", F.lit(True), F.concat(F.lit("/r/s"), to), 10 + to, none).where("name IS NOT NULL").distinct(),
        row(under, F.lit("again"), "folder", F.lit(False), none, 10 + n % 20, none).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(_TREE + """, walk AS (SELECT '/r' AS at, '/r' AS path, [] :: VARCHAR[] AS inodes, NULL :: VARCHAR AS error, 'folder' AS kind, NULL :: VARCHAR AS name
  UNION ALL SELECT l.parent || '/' || l.name, w.path || '/' || l.name, list_append(w.inodes, CAST(l.inode AS VARCHAR)), l.error, l.kind, l.name FROM walk w JOIN listing l ON l.parent = w.at AND w.kind = 'folder' AND w.error IS NULL
  WHERE NOT l.is_link AND NOT starts_with(l.name, '.') AND l.name NOT LIKE '%.tmp.%' AND l.name <> 'skip' AND NOT (l.kind = 'folder' AND (lower(l.name) = 'node_modules' OR lower(l.name) LIKE '%.xcassets' OR list_contains(w.inodes, CAST(l.inode AS VARCHAR)))))
SELECT path, error FROM walk WHERE error IS NOT NULL OR (kind = 'file' AND NOT ends_with(name, '.txt'))""")
def discovered_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: media of a tree with hidden, software and ignored folders, links, a cycle, and errors as rows."""
    return discovery.walked(_listing(spark, sf_dir), "/r", ("*.tmp.*", "s*/skip"))

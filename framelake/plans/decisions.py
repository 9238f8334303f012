"""Duplicates, kinds, suggestions and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions.camera import camera_name
from framelake.functions.confidence import level_of, weakest
from framelake.functions.dates import date_in_name, month_label
from framelake.functions.image_type import image_type
from framelake.functions import templates
from framelake.operators import classify, duplicates, filters, suggest
from framelake.plans.registry import query
from framelake.sources import catalog
from framelake.sources.catalog import CATALOG_SQL


@query("""SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
  CAST(sum(octet_length(encode(text))) - max(octet_length(encode(text))) AS BIGINT) AS reclaimable FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return duplicates.exact(docs, F.col("text").cast("binary"), F.octet_length("text"), "doc_id")


#: Signs of embeddings, and of each a twin with its first 0 to 11 bits turned.
_SIGNED = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
s AS (SELECT 2 * vec_id AS id, b FROM v UNION ALL SELECT 2 * vec_id + 1, list_transform(range(1, 65), lambda i: CASE WHEN i <= vec_id % 12 THEN 1 - b[i] ELSE b[i] END) FROM v),
u AS (SELECT b, min(id) AS id, count(*) AS n, row_number() OVER (ORDER BY min(id)) AS k FROM s GROUP BY b),
p AS (SELECT x.id AS a, y.id AS b, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(x.b[i] - y.b[i]))) AS INTEGER) AS distance FROM u x JOIN u y ON x.id < y.id)"""
_GREEDY = _SIGNED + """, near AS (SELECT a, b, distance FROM p WHERE distance <= 8 UNION ALL SELECT b, a, distance FROM p WHERE distance <= 8),
nb AS (SELECT u.k, u.id, u.n, coalesce(list(struct_pack(id := near.b, d := CAST(distance AS BIGINT))) FILTER (near.b IS NOT NULL), []) AS ns FROM u LEFT JOIN near ON near.a = u.id GROUP BY 1, 2, 3),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS seen, CAST([] AS STRUCT(seed BIGINT, id BIGINT, d BIGINT)[]) AS found UNION ALL
  SELECT nb.k, CASE WHEN list_contains(seen, nb.id) THEN seen ELSE list_concat(list_concat(seen, [nb.id]), CASE WHEN n = 1 THEN list_transform(list_filter(ns, lambda x: NOT list_contains(seen, x.id)), lambda x: x.id) ELSE [] END) END,
    CASE WHEN list_contains(seen, nb.id) THEN found ELSE list_concat(list_concat(found, [struct_pack(seed := nb.id, id := nb.id, d := CAST(0 AS BIGINT))]),
      CASE WHEN n = 1 THEN list_transform(list_filter(ns, lambda x: NOT list_contains(seen, x.id)), lambda x: struct_pack(seed := nb.id, id := x.id, d := x.d)) ELSE [] END) END FROM r JOIN nb ON nb.k = r.k + 1),
g AS (SELECT unnest(found) AS x FROM r WHERE k = (SELECT max(k) FROM r)), m AS (SELECT x.seed AS seed, s.id, x.d AS distance FROM g JOIN u ON u.id = x.id JOIN s ON s.b = u.b)
SELECT seed, id, distance FROM m WHERE seed IN (SELECT seed FROM m GROUP BY 1 HAVING count(*) > 1)"""


def _signed(spark, sf):
    own = spark.read.parquet(f"{sf}/embeddings.parquet").select((2 * F.col("vec_id")).alias("id"), duplicates.sign_bits(F.col("embedding")).alias("sig"))
    turned = F.col("sig").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("id") / 2) % 12).cast("int")) - 1)
    return own.unionByName(own.select((F.col("id") + 1).alias("id"), turned.alias("sig")))


@query(_SIGNED + " SELECT a, b, distance FROM p WHERE distance <= 8")
def dup_hamming_pairs(spark, sf):
    return duplicates.near_pairs(_signed(spark, sf).groupBy("sig").agg(F.min("id").alias("id")))


@query(_GREEDY)
def dup_greedy_groups(spark, sf):
    return duplicates.greedy_groups(_signed(spark, sf))


@query(CATALOG_SQL + """SELECT event_type, user_id, count(*) AS n, count(DISTINCT ext) > 1 AND bool_or(ext = 'cr3') AS is_variant FROM media GROUP BY 1, 2""")
def dup_variants(spark, sf):
    m = catalog.media(spark, sf).withColumns({"name": F.concat(F.lit("IMG."), "ext"), "grp": F.concat("event_type", F.lit("|"), "user_id")})
    out = duplicates.is_variant(m, "grp")
    return out.select(F.split_part("grp", F.lit("|"), F.lit(1)).alias("event_type"), F.split_part("grp", F.lit("|"), F.lit(2)).cast("long").alias("user_id"), "n", "is_variant")


@query(CATALOG_SQL + """, k AS (SELECT media_id, count(*) AS richness FROM keywords GROUP BY 1), m AS (
  SELECT quick_hash, id, row_number() OVER (PARTITION BY quick_hash ORDER BY CASE WHEN kind = 'folder' THEN 0 ELSE 1 END, -(length(folder) - length(replace(folder, '/', ''))),
    CASE WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), '^(img|dsc|dscn|dcim|pxl|mvimg|vid|mov|p|photo|foto)[_-]?[0-9]+$', 'i') THEN 1 ELSE 0 END, -richness, id) AS r, count(*) OVER (PARTITION BY quick_hash) AS n
  FROM media JOIN sources USING (source_id) JOIN k ON media_id = id)
SELECT quick_hash, id AS principal, n FROM m WHERE r = 1 AND n > 1""")
def dup_principal(spark, sf):
    rich = catalog.keywords(spark, sf).groupBy(F.col("media_id").alias("id")).agg(F.count("*").alias("richness"))
    members = catalog.media(spark, sf).join(catalog.sources(spark), "source_id").join(rich, "id")
    return duplicates.principals(members, "quick_hash")


@query(CATALOG_SQL + "SELECT quick_hash, count(*) AS n, count(DISTINCT source_id) AS sources, CAST(sum(bytes) - max(bytes) AS BIGINT) AS reclaimable, bool_or(role = 'witness') AS witnessed FROM media GROUP BY 1 HAVING count(*) > 1")
def dup_reclaimable(spark, sf):
    per = catalog.media(spark, sf).groupBy("quick_hash")
    return per.agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), (F.sum("bytes") - F.max("bytes")).alias("reclaimable"), F.bool_or(F.col("role") == "witness").alias("witnessed")).where("n > 1")


@query(CATALOG_SQL + """SELECT id, CASE WHEN gps_lat IS NOT NULL THEN 'photo' WHEN name LIKE 'IMG-20240115-WA%' THEN 'received' WHEN name LIKE 'Screenshot%' THEN 'screen'
  WHEN make IS NULL AND model IS NULL AND ext = 'png' THEN 'screen' ELSE 'photo' END AS kind,
  CASE WHEN gps_lat IS NOT NULL THEN 0.95 WHEN name LIKE 'IMG-20240115-WA%' THEN 0.95 WHEN name LIKE 'Screenshot%' THEN 0.95
  WHEN make IS NULL AND model IS NULL AND ext = 'png' THEN 0.55 WHEN make IS NULL AND model IS NULL THEN 0.5 ELSE 0.9 END :: DOUBLE AS score FROM media""")
def classify_image_type(spark, sf):
    kind = image_type(F.col("name"), F.col("ext"), F.col("make").isNotNull() | F.col("model").isNotNull(), F.col("gps_lat").isNotNull())
    return catalog.media(spark, sf).select("id", kind.alias("x")).select("id", "x.kind", "x.score")


@query(CATALOG_SQL + "SELECT id, CASE WHEN name LIKE 'IMG-%' THEN '2024-01-15' END AS day, CASE WHEN name LIKE 'IMG-%' THEN 'jan.2024' END AS label FROM media")
def date_in_file_name(spark, sf):
    day = date_in_name(F.col("name"))
    return catalog.media(spark, sf).select("id", day.cast("string").alias("day"), month_label(day).alias("label"))


@query(CATALOG_SQL + """SELECT id, CASE user_id % 5 WHEN 0 THEN 'Canon EOS R6' WHEN 1 THEN 'Apple iPhone 15' WHEN 2 THEN 'SONY ILCE-7M4' WHEN 4 THEN 'NIKON' END AS camera FROM media""")
def camera_names(spark, sf):
    return catalog.media(spark, sf).select("id", camera_name(F.col("make"), F.col("model")).alias("camera"))


@query(CATALOG_SQL + """SELECT id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS level, s AS score FROM (
  SELECT id, least(CASE WHEN taken_at IS NOT NULL THEN 0.95 ELSE 0.4 END, CASE WHEN gps_lat IS NOT NULL THEN 0.95 ELSE 0.6 END) :: DOUBLE AS s FROM media)""")
def confidence_weakest_link(spark, sf):
    scores = F.array(F.when(F.col("taken_at").isNotNull(), 0.95).otherwise(0.4), F.when(F.col("gps_lat").isNotNull(), 0.95).otherwise(0.6))
    return catalog.media(spark, sf).select("id", level_of(weakest(scores)).alias("level"), weakest(scores).alias("score"))


_EVIDENCE = CATALOG_SQL + """, named AS (SELECT *, CASE WHEN name LIKE 'IMG-%' THEN DATE '2024-01-15' END AS day FROM media), evidence AS (
  SELECT id, 'year' AS field, CASE WHEN taken_at IS NOT NULL THEN 'exif' WHEN day IS NOT NULL THEN 'nome_arquivo' ELSE 'fs' END AS origin,
    CAST(year(coalesce(taken_at, CAST(day AS TIMESTAMP), mtime)) AS VARCHAR) AS value, CASE WHEN taken_at IS NOT NULL THEN 0.95 WHEN day IS NOT NULL THEN 0.65 ELSE 0.4 END :: DOUBLE AS score
  FROM named WHERE coalesce(taken_at, CAST(day AS TIMESTAMP), mtime) IS NOT NULL
  UNION ALL SELECT id, 'country', 'gps', country, 0.95 :: DOUBLE FROM media JOIN places USING (location_id)
  UNION ALL SELECT id, 'kind', 'arquivo', CASE WHEN gps_lat IS NOT NULL THEN 'photo' WHEN name LIKE 'IMG-20240115-WA%' THEN 'received' WHEN name LIKE 'Screenshot%' THEN 'screen'
      WHEN make IS NULL AND model IS NULL AND ext = 'png' THEN 'screen' ELSE 'photo' END,
    CASE WHEN gps_lat IS NOT NULL THEN 0.95 WHEN name LIKE 'IMG-20240115-WA%' THEN 0.95 WHEN name LIKE 'Screenshot%' THEN 0.95
      WHEN make IS NULL AND model IS NULL AND ext = 'png' THEN 0.55 WHEN make IS NULL AND model IS NULL THEN 0.5 ELSE 0.9 END :: DOUBLE FROM media)
"""


@query(_EVIDENCE + "SELECT id, field, origin, value, score FROM evidence")
def evidence_union(spark, sf):
    return suggest.evidence(catalog.media(spark, sf), catalog.places(spark, sf)).select("id", "field", "origin", "value", "score")


@query(_EVIDENCE + """SELECT id, name FROM media WHERE role = 'holding' AND id IN (SELECT id FROM evidence WHERE score >= 0.5 AND score < 0.8) AND id IN (SELECT id FROM evidence WHERE origin = 'exif')""")
def filter_provenance(spark, sf):
    media = catalog.media(spark, sf)
    context = filters.Context(evidence=suggest.evidence(media, catalog.places(spark, sf)))
    return filters.filtered(media, filters.parse_tokens("role:holding confidence:medium origin:exif"), context).select("id", "name")


@query(_EVIDENCE + """, f AS (SELECT id, max(CASE WHEN field = 'kind' THEN value END) AS kind, max(CASE WHEN field = 'kind' THEN score END) AS ks, max(CASE WHEN field = 'year' THEN value END) AS y,
  max(CASE WHEN field = 'year' THEN score END) AS ys, max(CASE WHEN field = 'country' THEN value END) AS c, max(CASE WHEN field = 'country' THEN score END) AS cs FROM evidence GROUP BY id),
u AS (SELECT id, coalesce(nullif(concat_ws('/', CASE WHEN kind = 'photo' THEN c ELSE kind END, y), ''), 'unsorted') AS destination, coalesce(least(CASE WHEN kind = 'photo' THEN cs ELSE ks END, ys), 0.0) AS score FROM f)
SELECT id, destination, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM u""")
def suggestions_from_evidence(spark, sf):
    return suggest.suggested(suggest.evidence(catalog.media(spark, sf), catalog.places(spark, sf)))


@query(CATALOG_SQL + """, r AS (SELECT s.*, folder, gps_lat, location_id, missing, offline FROM suggestions s JOIN media ON id = media_id), f AS (
  SELECT destination, folder, count(*) AS n, row_number() OVER (PARTITION BY destination ORDER BY count(*) DESC, folder) AS rank FROM r GROUP BY 1, 2)
SELECT destination, count(*) AS n, CASE min(CASE level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS level,
  count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (gps_lat IS NULL AND location_id IS NOT NULL) AS estimated, count(*) FILTER (missing OR offline) AS unreachable, (SELECT string_agg(folder, ', ' ORDER BY rank) FROM f WHERE f.destination = r.destination AND rank <= 3) AS folders FROM r GROUP BY destination""")
def suggestion_groups(spark, sf):
    return suggest.groups(catalog.suggestions(spark, sf), catalog.media(spark, sf))


@query(CATALOG_SQL + "SELECT status, level, count(*) AS n FROM suggestions GROUP BY 1, 2")
def suggestion_statuses(spark, sf):
    return suggest.statuses(catalog.suggestions(spark, sf))


@query(CATALOG_SQL + "SELECT media_id, destination, level, status FROM suggestions WHERE status <> 'pending' OR media_id IN (SELECT id FROM ready)")
def orphan_purge(spark, sf):
    return suggest.purged(catalog.suggestions(spark, sf), filters.ready(catalog.media(spark, sf)))


_PLAN = CATALOG_SQL + """, p AS (SELECT media_id, destination, folder || '/' || name AS source, CASE WHEN media_id % 50 = 1 THEN 'IMG (2).' || ext WHEN media_id % 10 = 1 THEN 'IMG.' || ext ELSE name END AS name
  FROM suggestions JOIN media ON id = media_id WHERE status IN ('approved', 'corrected') AND media_id % 17 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY destination, name ORDER BY media_id) AS nth, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '\\.[^.]*$') AS ext FROM p),
c AS (SELECT *, nth + CASE WHEN stem = 'IMG' AND EXISTS (SELECT 1 FROM n o WHERE o.destination = n.destination AND o.name = 'IMG (2)' || n.ext) THEN 1 ELSE 0 END AS k FROM n),
plan AS (SELECT media_id, source, destination || '/' || CASE WHEN nth = 1 THEN name ELSE stem || ' (' || k || ')' || ext END AS target,
  CASE WHEN nth > 1 THEN 'taken; renamed to ' || stem || ' (' || k || ')' || ext END AS conflict FROM c)
"""


def _plan(spark, sf):
    m = catalog.media(spark, sf)
    name = F.when(F.col("id") % 50 == 1, F.concat(F.lit("IMG (2)."), "ext")).when(F.col("id") % 10 == 1, F.concat(F.lit("IMG."), "ext")).otherwise(F.col("name"))
    copied = m.where("id % 17 = 0").select(F.col("id").alias("media_id"))
    plan = suggest.copy_plan(catalog.suggestions(spark, sf), m.withColumn("name", name), copied)
    return plan.drop("source").join(m.select(F.col("id").alias("media_id"), F.concat("folder", F.lit("/"), "name").alias("source")), "media_id")


@query(_PLAN + "SELECT * FROM plan")
def copy_plan(spark, sf):
    return _plan(spark, sf)


@query(_PLAN + """SELECT CASE WHEN missing THEN 'missing' WHEN offline THEN 'offline' WHEN read_error IS NOT NULL THEN 'unreadable' WHEN bytes = 0 THEN 'empty' ELSE 'fine' END AS verdict,
  count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan JOIN media ON id = media_id GROUP BY 1""")
def audit_verdict(spark, sf):
    m = catalog.media(spark, sf)
    return suggest.verdicts(_plan(spark, sf), m)


@query(CATALOG_SQL + """SELECT v.variant, count(*) AS n, count(*) FILTER (CASE v.variant WHEN 'by_value' THEN (value > 50) WHEN 'by_place' THEN (location_id IS NOT NULL) ELSE true END = (gps_lat IS NOT NULL)) AS right
  FROM media, (VALUES ('by_value'), ('by_place'), ('always')) AS v(variant) GROUP BY 1""".replace("AS right", 'AS "right"'))
def accuracy_matrix(spark, sf):
    said = {"by_value": F.col("value") > 50, "by_place": F.col("location_id").isNotNull(), "always": F.lit(True)}
    return suggest.accuracy(catalog.media(spark, sf), F.col("gps_lat").isNotNull(), said)


@query("""SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding :: DOUBLE[], b.embedding :: DOUBLE[]), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(a.embedding :: DOUBLE[], b.embedding :: DOUBLE[]) >= 0.3""")
def embedding_cosine(spark, sf):
    """The contract of face similarity: the faces of one label within reach of the ones asked about."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    e = e.withColumn("norm", norm)
    a = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("v").alias("q"), F.col("norm").alias("qn"))
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(e, "label").where("query_id <> vec_id").withColumn("cosine", dot / (F.col("qn") * F.col("norm"))).where("cosine >= 0.3").select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(CATALOG_SQL + """, s AS (SELECT user_id, min(folder) AS folder, date_diff('day', min(taken_at), max(taken_at)) AS days, max(country) AS country,
    CASE WHEN count(gps_lat) > 0 THEN round(max(abs(gps_lat + 22.5)) * 111.0, 6) END AS home_km
  FROM media LEFT JOIN places USING (location_id) WHERE taken_at IS NOT NULL GROUP BY 1)
SELECT user_id, CASE WHEN home_km > 100 THEN 'trip' WHEN country IS NOT NULL AND days >= 3 AND home_km IS NULL THEN 'trip' WHEN days <= 2 THEN 'occasion' ELSE 'neutral' END AS kind,
  CASE WHEN home_km > 100 THEN coalesce(country, 'u_' || user_id) WHEN country IS NOT NULL AND days >= 3 AND home_km IS NULL THEN country WHEN days <= 2 THEN 'u_' || user_id END AS label FROM s""")
def session_kinds(spark, sf):
    m = catalog.media(spark, sf).where("taken_at IS NOT NULL").join(catalog.places(spark, sf), "location_id", "left")
    per = m.groupBy("user_id").agg(
        F.min("folder").alias("folder"),
        F.date_diff(F.max("taken_at"), F.min("taken_at")).alias("days"),
        F.max("country").alias("country"),
        F.round(F.max(F.abs(F.col("gps_lat") + 22.5)) * 111.0, 6).alias("home_km"),
    )
    aliases = catalog.places(spark, sf).select(F.col("country").alias("alias"), "country").distinct()
    return classify.classified(per.withColumn("period", F.concat(F.lit("u_"), "user_id")), aliases, "user_id").select("user_id", "kind", "label")


@query(CATALOG_SQL + """SELECT id, concat_ws('/', CASE event_type WHEN 'click' THEN 'received' ELSE 'photo' END, concat_ws(' - ', CAST(year(taken_at) AS VARCHAR), 'u_' || user_id), country) AS target
  FROM media LEFT JOIN places USING (location_id)""")
def template_targets(spark, sf):
    m = catalog.media(spark, sf).join(catalog.places(spark, sf), "location_id", "left")
    kind = F.when(F.col("event_type") == "click", "received").otherwise("photo")
    fields = {"categoria": kind, "ano": F.year("taken_at").cast("string"), "viagem": F.concat(F.lit("u_"), "user_id"), "pais": F.col("country")}
    return m.select("id", templates.render(templates.DEFAULT, fields).alias("target"))

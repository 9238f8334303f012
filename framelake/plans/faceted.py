"""Filters and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import facets, filters
from framelake.operators.filters import Context, MediaFilters
from framelake.plans.registry import query
from framelake.sources import catalog
from framelake.sources.catalog import CATALOG_SQL

READY = "role = 'holding' AND NOT missing AND NOT offline"
REACH = READY + " AND source_id NOT IN (SELECT source_id FROM sources WHERE NOT available)"


def _context(spark: SparkSession, sf: str) -> Context:
    return Context(catalog.sources(spark), catalog.places(spark, sf), catalog.keywords(spark, sf), catalog.suggestions(spark, sf))


def _filtered(spark: SparkSession, sf: str, **how) -> DataFrame:
    return filters.filtered(catalog.media(spark, sf), MediaFilters(**how), _context(spark, sf))


@query(CATALOG_SQL + f"SELECT id, source_id, name FROM media WHERE {REACH}")
def filter_reach(spark, sf):
    return _filtered(spark, sf, reach="ready").select("id", "source_id", "name")


@query(CATALOG_SQL + f"SELECT source_id, count(*) AS n FROM media WHERE NOT ({REACH}) GROUP BY source_id")
def filter_lacking(spark, sf):
    return _filtered(spark, sf, reach="lacking").groupBy("source_id").agg(F.count("*").alias("n"))


@query(CATALOG_SQL + f"SELECT id, folder FROM media WHERE {REACH} AND (gps_lat IS NULL OR gps_lon IS NULL)")
def filter_gap_no_gps(spark, sf):
    return _filtered(spark, sf, reach="ready", gap="no_gps").select("id", "folder")


@query(CATALOG_SQL + "SELECT id, name FROM media WHERE name ILIKE '%wa1%' OR folder || '/' || name ILIKE '%wa1%' OR id IN (SELECT media_id FROM keywords WHERE value ILIKE '%wa1%')")
def filter_search(spark, sf):
    return _filtered(spark, sf, search="wa1").select("id", "name")


@query(CATALOG_SQL + "SELECT id, folder FROM media WHERE folder = '/Volumes/vol1/2024' OR starts_with(folder, '/Volumes/vol1/2024/')")
def filter_folder_prefix(spark, sf):
    return _filtered(spark, sf, folder="/Volumes/vol1/2024").select("id", "folder")


@query(CATALOG_SQL + "SELECT id, make, model FROM media WHERE coalesce(make, '') || ' ' || coalesce(model, '') ILIKE '%eos%'")
def filter_camera(spark, sf):
    return _filtered(spark, sf, camera="eos").select("id", "make", "model")


@query(CATALOG_SQL + "SELECT id, ext FROM media WHERE taken_at >= TIMESTAMP '2024-01-01' AND taken_at < TIMESTAMP '2024-02-01' AND ext = 'jpg'")
def filter_month_range(spark, sf):
    return _filtered(spark, sf, month="2024-01", ext="jpg").select("id", "ext")


@query(CATALOG_SQL + "SELECT id, location_id FROM media WHERE location_id IN (SELECT location_id FROM places WHERE country ILIKE '%amer%')")
def filter_place_semi(spark, sf):
    return _filtered(spark, sf, country="amer").select("id", "location_id")


@query(CATALOG_SQL + "SELECT id FROM media WHERE id IN (SELECT media_id FROM keywords WHERE namespace = 'curated' AND key = 'keyword' AND value ILIKE 'k1%')")
def filter_keyword_semi(spark, sf):
    return _filtered(spark, sf, keyword="k1%").select("id")


@query(CATALOG_SQL + "SELECT id FROM media WHERE id NOT IN (SELECT media_id FROM suggestions)")
def filter_no_suggestion_anti(spark, sf):
    return _filtered(spark, sf, gap="no_suggestion").select("id")


@query(CATALOG_SQL + "SELECT id FROM media WHERE id IN (SELECT media_id FROM suggestions WHERE level = 'low')")
def filter_low_confidence_semi(spark, sf):
    return _filtered(spark, sf, gap="low_confidence").select("id")


@query(CATALOG_SQL + "SELECT id, name FROM media WHERE role = 'holding' AND ext = 'png' AND coalesce(make, '') || ' ' || coalesce(model, '') ILIKE '%iPhone 15%'")
def filter_token_language(spark, sf):
    return filters.filtered(catalog.media(spark, sf), filters.parse_tokens('role:holding ext:png camera:"iPhone 15"'), _context(spark, sf)).select("id", "name")


@query(CATALOG_SQL + "SELECT id, name, bytes FROM media ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 100 OFFSET 50")
def listing_sorted_page(spark, sf):
    return filters.page(catalog.media(spark, sf), "date_desc", 100, 50).select("id", "name", "bytes")


@query(CATALOG_SQL + """SELECT make, model, n, CASE WHEN coalesce(model, '') = '' THEN make WHEN make IS NULL THEN model
  WHEN lower(substr(model, 1, length(make))) = lower(make) AND NOT regexp_matches(substr(model, length(make) + 1, 1), '[A-Za-z0-9]') THEN model ELSE make || ' ' || model END AS camera
  FROM (SELECT make, model, count(*) AS n FROM media WHERE make IS NOT NULL OR model IS NOT NULL GROUP BY make, model) ORDER BY n DESC, make, model LIMIT 60""")
def facet_camera(spark, sf):
    return facets.cameras(catalog.media(spark, sf))


@query(CATALOG_SQL + "SELECT country, count(*) AS n FROM media JOIN places USING (location_id) GROUP BY country")
def facet_country(spark, sf):
    return facets.countries(catalog.media(spark, sf), catalog.places(spark, sf))


@query(CATALOG_SQL + "SELECT value, count(DISTINCT media_id) AS n FROM keywords WHERE media_id IN (SELECT id FROM media) GROUP BY value ORDER BY n DESC, value LIMIT 80")
def facet_keywords_distinct(spark, sf):
    return facets.keyword_counts(catalog.media(spark, sf), catalog.keywords(spark, sf))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def facet_year(spark, sf):
    return facets.years(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def timeline_months(spark, sf):
    return facets.months(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate")


@query(CATALOG_SQL + "SELECT ext, count(*) AS n FROM media GROUP BY ext")
def facet_extensions(spark, sf):
    return facets.extensions(catalog.media(spark, sf))


@query(CATALOG_SQL + "SELECT coalesce(CAST(year(taken_at) AS VARCHAR), 'no date') AS year, source_id, count(*) AS n FROM media GROUP BY 1, 2")
def crosstab_year_source(spark, sf):
    return facets.year_by_source(catalog.media(spark, sf))


@query(CATALOG_SQL + "SELECT s.source_id, s.kind, s.available, count(m.id) AS n FROM sources s LEFT JOIN media m ON m.source_id = s.source_id GROUP BY 1, 2, 3")
def sources_with_counts(spark, sf):
    return facets.by_source(catalog.media(spark, sf), catalog.sources(spark))


_GAP_SQL = {
    "total": "true",
    "no_date": "taken_at IS NULL",
    "no_gps": "gps_lat IS NULL OR gps_lon IS NULL",
    "inherited_place": "false",
    "not_photo": "false",
    "type_to_confirm": "false",
    "no_group": "true",
    "no_camera": "make IS NULL AND model IS NULL",
    "no_suggestion": "id NOT IN (SELECT media_id FROM suggestions)",
    "low_confidence": "id IN (SELECT media_id FROM suggestions WHERE level = 'low')",
    "medium_confidence": "id IN (SELECT media_id FROM suggestions WHERE level = 'medium')",
    "read_error": "read_error IS NOT NULL",
}


@query(CATALOG_SQL + " UNION ALL ".join(f"SELECT '{g}' AS gap, count(*) AS n FROM media WHERE {c}" for g, c in _GAP_SQL.items()))
def panorama_gaps(spark, sf):
    return facets.panorama(catalog.media(spark, sf), catalog.suggestions(spark, sf))


@query(CATALOG_SQL + """SELECT count(*) FILTER (role <> 'witness') AS holdings, count(read_error) AS errors, count(DISTINCT source_id) AS sources,
  count(*) FILTER (role = 'witness') AS witnesses, count(*) FILTER (role = 'witness' AND gps_lat IS NOT NULL) AS witnesses_with_gps FROM media""")
def statistics(spark, sf):
    return facets.statistics(catalog.media(spark, sf))


@query(CATALOG_SQL + f"""SELECT split_part(substr(folder, 15), '/', 1) AS child, count(*) AS n, count(*) FILTER ({READY}) AS n_ready,
  count(*) FILTER (NOT contains(substr(folder, 15), '/')) AS n_direct FROM media WHERE starts_with(folder, '/Volumes/vol1/') GROUP BY 1 ORDER BY 1 LIMIT 400""")
def folder_tree_level(spark, sf):
    ready = (F.col("role") == "holding") & ~F.col("missing") & ~F.col("offline")
    return facets.folder_level(catalog.media(spark, sf), "/Volumes/vol1", ready)


_KNOWN = """, known AS (
  SELECT lower(folder || '/' || name) AS path, count(*) AS records, bool_or(available AND NOT missing AND NOT offline) AS reachable,
    bool_or(available AND NOT missing AND NOT offline AND role = 'holding') AS is_ready, min(folder) AS folder
  FROM media JOIN sources USING (source_id) GROUP BY 1
)"""


@query(CATALOG_SQL + _KNOWN + """, held AS (SELECT DISTINCT '/Volumes/' || split_part(folder, '/', 3) AS root, source_id FROM media)
SELECT '/Volumes/' || split_part(folder, '/', 3) AS root, count(*) AS photos, count(*) FILTER (reachable) AS reachable, count(*) FILTER (is_ready) AS ready,
  (SELECT count(*) FROM held h WHERE h.root = '/Volumes/' || split_part(any_value(known.folder), '/', 3)) AS sources FROM known GROUP BY 1""")
def inventory_by_root(spark, sf):
    return facets.inventory(catalog.media(spark, sf), catalog.sources(spark))


@query(CATALOG_SQL + _KNOWN + "SELECT CAST(sum(records) AS BIGINT) AS records, count(*) AS known, count(*) FILTER (reachable) AS reachable, count(*) FILTER (is_ready) AS ready FROM known")
def funnel(spark, sf):
    return facets.funnel(catalog.media(spark, sf), catalog.sources(spark))


@query(CATALOG_SQL + "SELECT namespace, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM keywords GROUP BY namespace")
def namespace_weight(spark, sf):
    return facets.namespace_weight(catalog.keywords(spark, sf))


@query(CATALOG_SQL + """SELECT source_id, date_trunc('hour', taken_at) AS taken_at, make, model, count(*) AS n, count(DISTINCT ext) AS exts,
  array_to_string(list_sort(list(DISTINCT ext)), '+') AS formats FROM media WHERE taken_at IS NOT NULL AND role = 'holding' AND (make IS NOT NULL OR model IS NOT NULL) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT ext) > 1""")
def siblings_having(spark, sf):
    hours = F.date_trunc("hour", "taken_at").cast("timestamp_ntz")  # clocks of the hour, so that captures coincide
    return facets.siblings(catalog.media(spark, sf).withColumn("taken_at", hours))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def topk_per_group(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return facets.top_per_group(orders, "o_custkey", F.desc("o_totalprice"), "o_orderkey", 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query(CATALOG_SQL + "SELECT source_id, max(id) AS id, arg_max(name, id) AS name FROM media WHERE read_error IS NOT NULL GROUP BY source_id")
def latest_per_source(spark, sf):
    return catalog.media(spark, sf).where("read_error IS NOT NULL").groupBy("source_id").agg(F.max("id").alias("id"), F.max_by("name", "id").alias("name"))


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_join_revenue(spark, sf):
    """Sums meet by customer before the dimensions join, which are then small."""
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    line = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    per = line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    named = per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))

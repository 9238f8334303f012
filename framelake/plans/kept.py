"""Queries of what is kept from run to run: versions of decisions, inventories, roll-ups of facets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import rollups
from framelake.plans.registry import query
from framelake.session import shared_folder
from framelake.sources import catalog
from framelake.sources.catalog import CATALOG_SQL
from framelake.sources.versions import Versions, inventory


@query(CATALOG_SQL + """, v AS (SELECT 1 AS version, media_id, status FROM suggestions WHERE status = 'approved' UNION ALL SELECT 2, media_id, status FROM suggestions WHERE status IN ('approved', 'rejected')
  UNION ALL SELECT unnest([3, 4]), media_id, status FROM suggestions WHERE status = 'corrected')
SELECT version, status, count(*) AS n, min(media_id) AS first_id FROM v WHERE version > 1 GROUP BY 1, 2""")
def decision_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: decisions added, added to, replaced, compacted; the first version is forgotten, the others can be read."""
    store, rows = Versions(spark, f"{shared_folder(spark)}/framelake/decisions-{uuid.uuid4().hex}"), catalog.suggestions(spark, sf_dir)
    store.add(rows.where("status = 'approved'"))
    second = store.add(rows.where("status = 'rejected'"))
    store.replace(rows.where("status = 'corrected'"), second)
    store.compact()
    store.retain(3)
    parts = [store.read(n).withColumn("version", F.lit(n)) for n in store.numbers()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("version", "status").agg(F.count("*").alias("n"), F.min("media_id").alias("first_id"))


@query("""
WITH p AS (SELECT page_id, '/out/' || (page_id % 30) AS folder, page_id || '.html' AS name, url AS source, octet_length(encode(html)) AS bytes, sha256(html) AS digest FROM pages WHERE page_id % 9 <> 0)
SELECT folder, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(name || ' ' || digest) AS least FROM p WHERE html_known GROUP BY 1""".replace(" WHERE html_known", ""))
def inventory_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: the inventory as rows, added plan by plan, summed up by folder."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    store, n = Versions(spark, f"{shared_folder(spark)}/framelake/inventory-{uuid.uuid4().hex}"), F.col("page_id")
    target = F.when(n % 9 != 0, F.concat(F.lit("/out/"), n % 30, F.lit("/"), n, F.lit(".html"))).otherwise("")
    plan = pages.select("page_id", target.alias("target"), F.col("url").alias("source"), F.octet_length("html").cast("long").alias("bytes"), F.sha2(F.encode("html", "utf-8"), 256).alias("digest"))
    for k in (0, 1):
        store.add(inventory(plan.where(n % 2 == k)))
    return store.read().groupBy("folder").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min(F.concat_ws(" ", "name", "digest")).alias("least"))


@query(CATALOG_SQL + """, kept AS (SELECT * FROM media WHERE NOT (source_id = 2 AND id % 10 = 0))
SELECT 'ext' AS facet, ext AS value, count(*) AS n FROM kept GROUP BY 2 UNION ALL SELECT 'make', make, count(*) FROM kept GROUP BY 2
UNION ALL SELECT 'month', strftime(taken_at, '%Y-%m'), count(*) FROM kept GROUP BY 2""")
def facets_by_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5, AGG-9: facets out of the merged roll-ups of two scans and of the rows that went, without reading the catalog again."""
    counts, _ = _rollups(spark, sf_dir)
    months = counts.where("facet = 'ext'").groupBy(F.col("month").alias("value")).agg(F.sum("n").alias("n")).select(F.lit("month").alias("facet"), "value", "n")
    return rollups.facet(counts, "ext").select(F.lit("ext").alias("facet"), "value", "n").unionByName(rollups.facet(counts, "make").select(F.lit("make").alias("facet"), "value", "n")).unionByName(months)


@query(CATALOG_SQL + """SELECT name, exact, true AS within FROM (SELECT 'folder' AS name, count(DISTINCT folder) AS exact FROM media UNION ALL SELECT 'name', count(DISTINCT name) FROM media)""")
def distinct_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values across sources and months by united sketches, held against the exact numbers: three standard errors."""
    _, sketches = _rollups(spark, sf_dir)
    exact = catalog.media(spark, sf_dir).agg(F.count_distinct("folder").alias("folder"), F.count_distinct("name").alias("name"))
    exact = exact.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("exact")) for c in ("folder", "name")))).alias("x")).select("x.*")
    error = 3 * 1.04 / 2 ** (rollups.LG_K / 2)
    return rollups.distinct(sketches).join(exact, "name").select("name", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), error * F.col("exact"))).alias("within"))


def _rollups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = catalog.media(spark, sf_dir)
    how = ({"ext": F.col("ext"), "make": F.col("make")}, F.date_format("taken_at", "yyyy-MM"), {"folder": F.col("folder"), "name": F.col("name")})
    parts = [rollups.part(m.where(F.col("id") % 2 == k), *how) for k in (0, 1)]
    went = rollups.part(m.where("source_id = 2 AND id % 10 = 0"), *how, sign=-1)
    return rollups.merged([c for c, _ in [*parts, went]], [s for _, s in parts])

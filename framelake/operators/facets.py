"""Facets and roll-ups of the media table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.camera import camera_name
from framelake.functions.paths import root_of
from framelake.operators.filters import GAPS, gap


def top(df: DataFrame, keys: list[str], limit: int, count: str = "n") -> DataFrame:
    return df.orderBy(F.desc(count), *(F.col(k).asc_nulls_last() for k in keys)).limit(limit)


def extensions(media: DataFrame) -> DataFrame:
    return media.groupBy("ext").agg(F.count("*").alias("n"))


def years(media: DataFrame, column: str = "taken_at") -> DataFrame:
    return media.where(F.col(column).isNotNull()).groupBy(F.year(column).cast("long").alias("year")).agg(F.count("*").alias("n"))


def months(media: DataFrame, column: str = "taken_at") -> DataFrame:
    """The timeline: counts by month, files without a date left out."""
    return media.where(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def cameras(media: DataFrame, limit: int = 60) -> DataFrame:
    """The most frequent (make, model) pairs, named after the cut."""
    known = media.where(F.col("make").isNotNull() | F.col("model").isNotNull())
    return top(known.groupBy("make", "model").agg(F.count("*").alias("n")), ["make", "model"], limit).withColumn("camera", camera_name(F.col("make"), F.col("model")))


def countries(media: DataFrame, places: DataFrame) -> DataFrame:
    """Counted by place before the join, which then has few rows."""
    per = media.where(F.col("location_id").isNotNull()).groupBy("location_id").agg(F.count("*").alias("n"))
    return per.join(places, "location_id").groupBy("country").agg(F.sum("n").alias("n"))


def keyword_counts(media: DataFrame, keywords: DataFrame, limit: int = 80) -> DataFrame:
    tagged = keywords.where("namespace = 'curated' AND key = 'keyword'").join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return top(tagged.groupBy("value").agg(F.countDistinct("media_id").alias("n")), ["value"], limit)


def folder_level(media: DataFrame, prefix: str, ready: Column, limit: int = 400) -> DataFrame:
    """The folders one level below prefix: files at any depth, those ready, and those directly in them."""
    base = prefix.rstrip("/") + "/"
    below = media.where(F.col("folder").startswith(base)).withColumn("rest", F.substring("folder", F.lit(len(base) + 1), F.length("folder")))
    name = F.split_part("rest", F.lit("/"), F.lit(1))
    per = below.withColumn("child", name).where("child <> ''").groupBy("child")
    return per.agg(F.count("*").alias("n"), F.count_if(ready).alias("n_ready"), F.count_if(F.col("rest") == F.col("child")).alias("n_direct")).orderBy("child").limit(limit)


def by_source(media: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source with its number of files, 0 for those without."""
    per = media.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(per, "source_id", "left").select("source_id", "kind", "available", F.coalesce("n", F.lit(0)).alias("n"))


def panorama(media: DataFrame, suggestions: DataFrame) -> DataFrame:
    """gap, n: the total and every gap's count in one pass; the suggestion-based ones come from one join."""
    level = suggestions.groupBy(F.col("media_id").alias("id")).agg(F.bool_or(F.col("level") == "low").alias("low"), F.bool_or(F.col("level") == "medium").alias("medium"))
    rows = media.join(level, "id", "left")
    special = {"no_suggestion": F.col("low").isNull(), "low_confidence": F.col("low"), "medium_confidence": F.col("medium")}
    counts = [F.count_if(special[g] if g in special else gap(g, media.columns)).alias(g) for g in GAPS]
    one = rows.agg(F.count("*").alias("total"), *counts)
    pairs = F.array(*(F.struct(F.lit(g).alias("gap"), F.col(g).alias("n")) for g in ("total", *GAPS)))
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def panorama_by(media: DataFrame) -> DataFrame:
    """facet (year, camera, extension), value, n: counts by year (null: no date), by shown camera name, by extension."""
    year = media.groupBy(F.coalesce(F.year("taken_at").cast("string"), F.lit("no date")).alias("value")).agg(F.count("*").alias("n"))
    pairs = media.groupBy("make", "model").agg(F.count("*").alias("n"))
    camera = pairs.groupBy(F.coalesce(camera_name(F.col("make"), F.col("model")), F.lit("unknown")).alias("value")).agg(F.sum("n").alias("n"))
    ext = media.groupBy(F.col("ext").alias("value")).agg(F.count("*").alias("n"))
    parts = [x.select(F.lit(name).alias("facet"), "value", "n") for name, x in (("year", year), ("camera", camera), ("extension", ext))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def year_by_source(media: DataFrame) -> DataFrame:
    return media.groupBy(F.coalesce(F.year("taken_at").cast("string"), F.lit("no date")).alias("year"), "source_id").agg(F.count("*").alias("n"))


def statistics(media: DataFrame) -> DataFrame:
    witness = F.col("role") == "witness"
    return media.agg(
        F.count_if(~witness).alias("holdings"),
        F.count_if(F.col("read_error").isNotNull()).alias("errors"),
        F.countDistinct("source_id").alias("sources"),
        F.count_if(witness).alias("witnesses"),
        F.count_if(witness & F.col("gps_lat").isNotNull()).alias("witnesses_with_gps"),
    )


def _known(media: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each photo known by its path, over all sources that hold it."""
    reach = sources.select("source_id", "available")
    path = F.lower(F.concat("folder", F.lit("/"), "name"))
    per = media.join(reach, "source_id").withColumn("reachable", F.col("available") & ~F.col("missing") & ~F.col("offline"))
    per = per.withColumn("ready", F.col("reachable") & (F.col("role") == "holding"))
    return per.groupBy(path.alias("path")).agg(F.count("*").alias("records"), F.max("reachable").alias("reachable"), F.max("ready").alias("ready"), F.min("folder").alias("folder"))


def inventory(media: DataFrame, sources: DataFrame) -> DataFrame:
    """Photos by root volume: how many are known, within reach and ready, and by how many sources.

    The sources are counted over folders, of which there are far fewer than files.
    """
    photos = _known(media, sources).groupBy(root_of(F.col("folder")).alias("root")).agg(F.count("*").alias("photos"), F.count_if("reachable").alias("reachable"), F.count_if("ready").alias("ready"))
    held = media.select("folder", "source_id").distinct().groupBy(root_of(F.col("folder")).alias("root")).agg(F.countDistinct("source_id").alias("sources"))
    return photos.join(held, "root")


def places_of_files(media: DataFrame, sources: DataFrame) -> DataFrame:
    """root, photos, reachable, ready, sources (their names, sorted) by root volume, most photos first; the last row, of root
    null, counts the files that no path leads to, references of outside catalogs.

    One photo is what shares a path, whatever its case; its root is that of the least spelling. sources: source_id,
    available, name.
    """
    path = F.concat("folder", F.lit("/"), "name")
    there = F.coalesce("available", F.lit(False)) & ~F.col("missing") & ~F.col("offline")
    rows = media.join(sources.select("source_id", "available", F.col("name").alias("source")), "source_id").withColumns({"path": path, "reachable": there, "ready": there & (F.col("role") == "holding")})
    lost = F.col("folder").isNull() | path.contains("://")
    photos = rows.where(~lost).groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path"), F.max("reachable").alias("reachable"), F.max("ready").alias("ready"), F.array_sort(F.collect_set("source")).alias("names"))
    # names first meet by root and set of names, of which there are few
    per = photos.groupBy(root_of(F.col("path")).alias("root"), "names").agg(F.count("*").alias("photos"), F.count_if("reachable").alias("reachable"), F.count_if("ready").alias("ready"))
    per = per.groupBy("root").agg(*(F.sum(c).alias(c) for c in ("photos", "reachable", "ready")), F.flatten(F.collect_set("names")).alias("names"))
    named = per.select("root", "photos", "reachable", "ready", F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("sources"))
    none = rows.where(lost).agg(F.count("*").alias("photos")).select(F.lit(None).cast("string").alias("root"), "photos", F.lit(0).cast("long").alias("reachable"), F.lit(0).cast("long").alias("ready"), F.lit("").alias("sources"))
    return named.unionByName(none).orderBy(F.col("root").isNull(), F.desc("photos"), "root")


def funnel(media: DataFrame, sources: DataFrame) -> DataFrame:
    return _known(media, sources).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count("*").alias("known"), F.count_if("reachable").alias("reachable"), F.count_if("ready").alias("ready"))


def namespace_weight(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("namespace").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def siblings(media: DataFrame) -> DataFrame:
    """Holdings of one exact moment, source and known camera that exist in several formats."""
    own = media.where("role = 'holding' AND taken_at IS NOT NULL AND (make IS NOT NULL OR model IS NOT NULL)")
    per = own.groupBy("source_id", "taken_at", "make", "model")
    return per.agg(F.count("*").alias("n"), F.countDistinct("ext").alias("exts"), F.array_join(F.array_sort(F.collect_set("ext")), "+").alias("formats")).where("exts > 1")


def top_per_group(df: DataFrame, group: str, by: Column, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(by, tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

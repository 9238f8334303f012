"""What one file shows: its row, its details, its metadata, its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.camera import camera_name
from framelake.functions.geo import haversine_km, reliable_fields

#: What the namespaces of metadata are called.
LABELS = {"curated": "Keywords and albums", "exif": "Camera", "xmp": "Edits", "takeout": "Google Takeout", "lightroom": "Lightroom"}
#: Degrees of a cell in which points and cities meet.
CELL = 1.0


def place_fields(own: Column, delta_s: Column) -> Column:
    """The fields of a place that may be shown: all of an own one, of an inherited one what its time difference bears."""
    borne = F.transform(reliable_fields(delta_s, F.lit(False)), lambda x: x["field"])
    return F.when(own, F.array(*map(F.lit, ("country", "region", "city")))).when(delta_s.isNull(), F.array(F.lit("country"))).otherwise(borne)


def unavailable(media: DataFrame, sources: DataFrame) -> DataFrame:
    """media with why_not: no file, source out of reach, or file gone; null where it can be opened."""
    off = sources.where("NOT available").select("source_id", F.lit(True).alias("_off"))
    rows = media.join(off, "source_id", "left")
    why = F.when(F.col("missing"), "no file here").when(F.col("_off"), "source out of reach").when(F.col("offline"), "file gone from disk")
    return rows.withColumn("why_not", why).select(*media.columns, "why_not")


def rows(media: DataFrame, sources: DataFrame) -> DataFrame:
    """The listing's row of each file."""
    seen = unavailable(media, sources)
    return seen.select("id", "name", "source_id", F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss").alias("taken"), camera_name(F.col("make"), F.col("model")).alias("camera"), F.coalesce("gps_lat", "est_lat").alias("lat"), F.coalesce("gps_lon", "est_lon").alias("lon"), (F.col("gps_lat").isNull() & F.col("est_lat").isNotNull()).alias("estimated"), "why_not")


def by_namespace(keywords: DataFrame) -> DataFrame:
    """media_id, namespace, label, n, entries (key=value, in order) of each file's metadata."""
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), "namespace"), F.col("namespace"))
    per = keywords.groupBy("media_id", "namespace").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))).alias("entries"))
    return per.select("media_id", "namespace", label.alias("label"), "n", "entries")


def detail(media: DataFrame, places: DataFrame, suggestions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each file with its place, its suggestion and its evidence, the strongest first."""
    best = evidence.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "field", "origin", "value"))).alias("_e"))
    told = F.transform("_e", lambda x: F.concat_ws(":", x["field"], x["origin"], x["value"]))
    said = suggestions.select(F.col("media_id").alias("id"), "destination", "level", "status")
    return media.join(places, "location_id", "left").join(said, "id", "left").join(best, "id", "left").select("id", "name", "city", "country", "destination", "level", "status", told.alias("evidence"))


def donors(heirs: DataFrame, media: DataFrame) -> DataFrame:
    """heirs (id, donor_id, delta_s) with the donor's name, source and place."""
    own = media.select(F.col("id").alias("donor_id"), F.col("name").alias("donor_name"), F.col("source_id").alias("donor_source"), F.col("gps_lat").alias("donor_lat"), F.col("gps_lon").alias("donor_lon"))
    return heirs.join(own, "donor_id", "left")


def cached_places(media: DataFrame, cache: DataFrame, decimals: int = 3) -> DataFrame:
    """id, place of the files whose rounded coordinates the cache (lat, lon, place) knows."""
    key = lambda lat, lon: F.concat_ws(",", F.format_number(lat, decimals), F.format_number(lon, decimals))
    known = cache.select(key(F.col("lat"), F.col("lon")).alias("_key"), "place").dropDuplicates(["_key"])
    return media.where("gps_lat IS NOT NULL AND gps_lon IS NOT NULL").withColumn("_key", key(F.col("gps_lat"), F.col("gps_lon"))).join(known, "_key").select("id", "place")


def nearest_city(points: DataFrame, cities: DataFrame, within_km: float = 50.0) -> DataFrame:
    """id, city, km: of points (id, lat, lon) the nearest of cities (city, city_lat, city_lon) within within_km.

    Cities are dealt to the cells around theirs as far as within_km reaches at their latitude, so each point meets the
    cities of one cell only.
    """
    up = F.ceil(F.lit(within_km / 111.0 / CELL)).cast("int")
    side = F.ceil(F.least(F.lit(within_km / 111.0 / CELL) / F.greatest(F.cos(F.radians(F.least(F.abs("city_lat") + within_km / 111.0, F.lit(89.9)))), F.lit(1e-3)), F.lit(180 / CELL))).cast("int")
    cell = lambda c: F.floor(c / CELL).cast("int")
    spread = cities.withColumn("i", F.explode(F.sequence(cell(F.col("city_lat")) - up, cell(F.col("city_lat")) + up)))
    turn = int(360 / CELL)
    spread = spread.withColumn("j", F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col("city_lon")) - side, cell(F.col("city_lon")) + side), lambda x: F.pmod(x, F.lit(turn))))))
    met = points.withColumns({"i": cell(F.col("lat")), "j": F.pmod(cell(F.col("lon")), F.lit(turn))}).join(spread, ["i", "j"])
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("city_lat"), F.col("city_lon"))
    best = met.withColumn("km", km).where(F.col("km") <= within_km).groupBy("id").agg(F.min(F.struct("km", "city")).alias("x"))
    return best.select("id", "x.city", "x.km")

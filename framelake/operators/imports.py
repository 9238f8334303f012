"""Merging an outside catalog into the own one: what is new, what has changed, what stays, what only is referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.dates import plausible
from framelake.operators.ingest import once

#: Fixed value: seconds that two file systems may differ in the time of one unchanged file.
SAME_TIME_S = 2.0
COLUMNS = ("path", "folder", "name", "ext", "bytes", "mtime", "taken_at", "taken_at_utc", "make", "model", "gps_lat", "gps_lon", "missing", "role")
NAMED, CURATED, KEYWORD = "palavra_chave", "curadoria", "palavra_chave"


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def moments(file_wall: Column, file_utc: Column, wall: Column, utc: Column) -> Column:
    """struct(taken_at, taken_at_utc), chosen together: the file's wall clock with its own moment, or with the offset that
    the outside catalog knows where both tell of one capture to the second; else the catalog's pair. A wall clock of an
    unknown zone is its own moment; without a wall clock there is none."""
    close = F.abs(_micros(wall) - _micros(file_wall)) < 1_000_000
    borrowed = F.when(close & utc.isNotNull(), F.timestamp_micros(_micros(file_wall) + _micros(utc) - _micros(wall)).cast("timestamp_ntz"))
    own = F.struct(file_wall.alias("taken_at"), F.coalesce(file_utc, borrowed, file_wall).alias("taken_at_utc"))
    other = F.struct(wall.alias("taken_at"), F.when(wall.isNotNull(), F.coalesce(utc, wall)).alias("taken_at_utc"))
    return F.when(file_wall.isNotNull(), own).otherwise(other)


def imported(catalog: DataFrame, files: DataFrame, assets: DataFrame, namespace: str, now: Column) -> DataFrame:
    """The catalog's columns of every row after the import, and change: new, changed, same (the file was not read again),
    reference, unreadable (no such file; a row is kept if there was one) or unseen (not in the outside catalog).

    catalog: COLUMNS of one source. files: path, bytes, mtime, taken_at, taken_at_utc, make, model, gps_lat, gps_lon, what
    reading each reachable file gives. assets: as outside catalogs give them; of two of one path or id the one of the
    largest values counts. References take the path namespace://id, are missing, and bear witness only; dates after now
    are not theirs.
    """
    key = F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.concat(F.lit(f"{namespace}://"), "external_id"))
    given = once(assets.withColumn("_key", key).select("_key", "external_id", "path", "original_path", "name", "title", "bytes", "taken_at", "taken_at_utc", "gps_lat", "gps_lon"), "_key", "external_id")
    a = given.select("_key", *(F.col(c).alias(f"a_{c}") for c in given.columns if c != "_key"))
    f = files.select(F.col("path").alias("_key"), F.lit(True).alias("f_there"), *(F.col(c).alias(f"f_{c}") for c in files.columns if c != "path"))
    c = catalog.select(F.col("path").alias("_key"), F.lit(True).alias("c_there"), *(F.col(x).alias(f"c_{x}") for x in COLUMNS if x != "path"))
    rows = a.withColumn("a_there", F.lit(True)).join(f, "_key", "left").join(c, "_key", "full")
    seen, there, known, reference = F.col("a_there").isNotNull(), F.col("f_there").isNotNull(), F.col("c_there").isNotNull(), F.col("a_path").isNull()
    still = known & (F.col("c_bytes") == F.col("f_bytes")) & (F.abs(_micros(F.col("c_mtime")) - _micros(F.col("f_mtime"))) < int(SAME_TIME_S * 1e6))
    change = F.when(~seen, "unseen").when(reference, "reference").when(~there, "unreadable").when(F.coalesce(still, F.lit(False)), "same").when(known, "changed").otherwise("new")
    rows = rows.withColumn("change", change).where(F.col("c_there").isNotNull() | (F.col("change") != "unreadable"))
    kept, referred = F.col("change").isin("unseen", "unreadable", "same"), F.col("change") == "reference"
    told = F.when(F.col("a_taken_at").isNotNull(), plausible(F.col("a_taken_at"), now))
    pair = F.when(referred, F.struct(told.alias("taken_at"), F.when(told.isNotNull(), F.coalesce("a_taken_at_utc", told)).alias("taken_at_utc")))
    pair = pair.otherwise(moments(F.col("f_taken_at"), F.col("f_taken_at_utc"), F.col("a_taken_at"), F.col("a_taken_at_utc")))
    place = lambda p: F.when(F.col(f"{p}_gps_lat").isNotNull(), F.struct(F.col(f"{p}_gps_lat").alias("lat"), F.col(f"{p}_gps_lon").alias("lon")))
    spot = F.coalesce(F.when(~referred, place("f")), place("a"), place("c"))
    where = F.when(referred, F.col("a_original_path")).otherwise(F.col("_key"))
    folder = F.regexp_replace(where, "/[^/]*$", "")
    name = F.when(referred, F.coalesce("a_name", "a_title", F.concat(F.lit(f"{namespace}:"), "a_external_id"))).otherwise(F.element_at(F.split("_key", "/"), -1))
    ext = F.lower(F.regexp_extract(F.when(referred, F.col("a_name")).otherwise(name), r"\.([^.]+)$", 1))
    new = {
        "folder": F.when(referred, F.coalesce(folder, F.col("c_folder"), F.lit(""))).otherwise(folder), "name": name, "ext": F.coalesce(ext, F.col("c_ext"), F.lit("")),
        "bytes": F.when(referred, F.coalesce("a_bytes", "c_bytes", F.lit(0))).otherwise(F.col("f_bytes")), "mtime": F.when(referred, F.col("c_mtime")).otherwise(F.col("f_mtime")),
        "taken_at": pair["taken_at"], "taken_at_utc": pair["taken_at_utc"], "make": F.when(referred, F.col("c_make")).otherwise(F.col("f_make")), "model": F.when(referred, F.col("c_model")).otherwise(F.col("f_model")),
        "gps_lat": spot["lat"], "gps_lon": spot["lon"], "missing": F.when(referred, True).otherwise(F.coalesce("c_missing", F.lit(False))), "role": F.when(referred, "witness").otherwise(F.coalesce("c_role", F.lit("holding"))),
    }
    return rows.select(F.col("_key").alias("path"), *(F.when(kept, F.col(f"c_{k}")).otherwise(v).alias(k) for k, v in new.items()), "change")


def entries(assets: DataFrame, namespace: str) -> DataFrame:
    """key, namespace, name, value: what only the outside catalog says about each asset (its path, or namespace://id)."""
    own = F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.concat(F.lit(f"{namespace}://"), "external_id"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))
    many = lambda name, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))
    spot = F.when(F.col("gps_lat").isNotNull(), F.format_string("%.6f,%.6f", "gps_lat", "gps_lon"))
    said = F.concat(
        one("titulo", F.col("title")), one("descricao", F.col("description")), one("favorito", F.when(F.col("favourite"), "true")), many("album", F.col("albums")), many("pessoa", F.col("people")),
        many(KEYWORD, F.col("keywords")), one("gps", spot), one("data", iso(F.col("taken_at"))), one("data_utc", iso(F.col("taken_at_utc"))),
    )
    return assets.select(own.alias("key"), F.lit(namespace).alias("namespace"), F.explode(said).alias("x")).select("key", "namespace", "x.name", "x.value").where("value IS NOT NULL")


def after_import(before: DataFrame, new: DataFrame, assets_seen: DataFrame, namespace: str) -> DataFrame:
    """Entries (key, namespace, name, value) after an import: what the namespace said about the assets seen (key) is
    replaced, and their keywords join the curated ones, each word once for a file whoever says it."""
    replaced = before.join(assets_seen.select("key").distinct(), "key", "left_semi").where(F.col("namespace") == namespace)
    kept = before.join(replaced.select("key", "namespace").distinct(), ["key", "namespace"], "left_anti")
    words = new.where(F.col("name") == KEYWORD).select("key", F.lit(CURATED).alias("namespace"), "name", "value").distinct()
    more = words.join(before.where(F.col("namespace") == CURATED), ["key", "namespace", "name", "value"], "left_anti")
    return kept.unionByName(new).unionByName(more)

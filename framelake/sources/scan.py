"""Sources over time: which ones there are, which can be reached, and whether their files are still there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What every outside catalog hands over, one row an asset; a reader of it is a DataFrame of this schema.
ASSET = T.StructType([T.StructField(n, t) for n, t in (("external_id", T.StringType()), ("path", T.StringType()), ("name", T.StringType()), ("taken_at", T.TimestampNTZType()), ("taken_at_utc", T.TimestampNTZType()), ("gps_lat", T.DoubleType()), ("gps_lon", T.DoubleType()), ("favourite", T.BooleanType()), ("albums", T.ArrayType(T.StringType())), ("keywords", T.ArrayType(T.StringType())))])
LEAST_BUDGET, BUDGET_SHARE = 20_000, 0.2


def apple_assets(rows: DataFrame) -> DataFrame:
    """Rows of a photo library (uuid, original_path, original_name, date with zone, zone, lat, lon, favorite, albums,
    keywords) as assets: the wall clock of the photo's zone and the moment in UTC; 0/0 is no place."""
    utc = F.to_utc_timestamp(F.col("date").cast("timestamp"), F.current_timezone())
    at = F.when(~((F.col("lat") == 0) & (F.col("lon") == 0)), F.struct("lat", "lon"))
    out = rows.select(
        F.col("uuid").alias("external_id"), F.col("original_path").alias("path"), F.col("original_name").alias("name"),
        F.from_utc_timestamp(utc, F.coalesce("zone", F.lit("UTC"))).cast("timestamp_ntz").alias("taken_at"), utc.cast("timestamp_ntz").alias("taken_at_utc"),
        at["lat"].cast("double").alias("gps_lat"), at["lon"].cast("double").alias("gps_lon"), F.col("favorite").alias("favourite"), "albums", "keywords",
    )
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ASSET.fields))


def resolved(known: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path, device, inode) with source_id: that of the same path, else of the same device and inode, else null:
    it is to be created. known: source_id, path, device, inode."""
    same = known.groupBy("path").agg(F.min("source_id").alias("_by_path"))
    twin = known.where("device IS NOT NULL AND inode IS NOT NULL").groupBy("device", "inode").agg(F.min("source_id").alias("_by_inode"))
    rows = asked.join(same, "path", "left").join(twin, ["device", "inode"], "left")
    return rows.select(*asked.columns, F.coalesce("_by_path", "_by_inode").alias("source_id"))


def availability(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """source_id, state: available, moved (its volume is mounted elsewhere), drawer (volume not mounted) or folder gone.

    sources: source_id, path, volume (null: the inner disk). probes: path, exists, volume, mounted_at, of what was looked at.
    """
    at = probes.where("path IS NOT NULL").groupBy("path").agg(F.bool_or("exists").alias("_exists"))
    mounts = probes.where("volume IS NOT NULL").groupBy("volume").agg(F.max("mounted_at").alias("_mount"))
    rows = sources.join(at, "path", "left").join(mounts, "volume", "left")
    there = F.coalesce("_exists", F.lit(False))
    moved = F.col("_mount").isNotNull() & ~F.concat("path", F.lit("/")).startswith(F.concat("_mount", F.lit("/")))
    state = F.when(there, "available").when(moved, "moved").when(F.col("volume").isNotNull() & F.col("_mount").isNull(), "drawer").otherwise("folder gone")
    return rows.select("source_id", state.alias("state"))


def reconciled(media: DataFrame, sources: DataFrame, present: DataFrame, checkpoint: int, rows: int | None = None) -> tuple[DataFrame, int]:
    """(id, offline of the files looked at whose state changes, next checkpoint) of one pass over the catalog in id order.

    A pass looks at up to rows files after checkpoint, by default at least LEAST_BUDGET and at most BUDGET_SHARE of all
    that can be looked at. Files of sources out of reach are not judged: the checkpoint stops before the first of
    them. After the last file the next pass starts again at 0. present: id of the files that are on disk.
    """
    own = media.where(~F.concat("folder", F.lit("/"), "name").contains("://") & ~F.col("missing")).join(sources.select("source_id", "available"), "source_id")
    budget = rows if rows is not None else max(1, min(LEAST_BUDGET, int(BUDGET_SHARE * own.count())))
    page = own.where(F.col("id") > checkpoint).orderBy("id").limit(budget)
    ends = page.agg(F.count("*").alias("n"), F.max("id").alias("last"), F.min(F.when(~F.col("available"), F.col("id"))).alias("frozen")).first()
    seen = page.where("available").join(present.select("id", F.lit(True).alias("_there")), "id", "left")
    changed = seen.withColumn("now", F.col("_there").isNull()).where("now <> offline").select("id", F.col("now").alias("offline"))
    if ends.frozen is not None:
        return changed, ends.frozen - 1
    return changed, ends.last if ends.n == budget else 0


def sidecars(media: DataFrame, found: DataFrame) -> DataFrame:
    """media_id, sidecar of each sidecar file (path): name and extension first (a.jpg.xmp), else the one file of its stem
    (a.xmp); where several files share the stem it belongs to none."""
    cut = lambda c: F.lower(F.regexp_replace(c, r"\.[^./]*$", ""))
    names = found.select(F.col("path").alias("sidecar"), cut(F.col("path")).alias("_full"))
    files = media.select(F.col("id").alias("media_id"), F.lower(F.concat("folder", F.lit("/"), "name")).alias("_path"))
    exact = names.join(files, F.col("_full") == F.col("_path")).groupBy("sidecar").agg(F.min("media_id").alias("media_id"), F.count("*").alias("_n")).where("_n = 1")
    stems = files.withColumn("_stem", cut(F.col("_path"))).groupBy("_stem").agg(F.min("media_id").alias("media_id"), F.count("*").alias("_n")).where("_n = 1")
    loose = names.join(exact, "sidecar", "left_anti").join(stems, F.col("_full") == F.col("_stem"))
    return exact.select("media_id", "sidecar").unionByName(loose.select("media_id", "sidecar"))


def sidecar_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """sidecar, change (new, gone, same, touched: only its time differs, changed) of two states (sidecar, digest, mtime)."""
    x, y = before.alias("x"), after.alias("y")
    both = x.join(y, F.col("x.sidecar") == F.col("y.sidecar"), "full")
    change = F.when(F.col("x.sidecar").isNull(), "new").when(F.col("y.sidecar").isNull(), "gone").when(~F.col("x.digest").eqNullSafe(F.col("y.digest")), "changed")
    return both.select(F.coalesce("x.sidecar", "y.sidecar").alias("sidecar"), change.when(~F.col("x.mtime").eqNullSafe(F.col("y.mtime")), "touched").otherwise("same").alias("change"))

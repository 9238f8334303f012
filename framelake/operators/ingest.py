"""Keeping a catalog current: what changed, what went, what moved, and merging other catalogs in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.paths import on_filesystem


def changes(catalog: DataFrame, seen: DataFrame, force: bool = False) -> DataFrame:
    """path, change of what a scan saw: new, changed (size or mtime by a microsecond, or the inode where both tables have
    one) or same; a path seen twice counts as it was seen last. With force nothing is the same: all is read again."""
    by_inode = "inode" in catalog.columns and "inode" in seen.columns
    more = ["inode"] if by_inode else []
    seen = once(seen.select("path", "bytes", "mtime", *more), "path", "mtime")
    old = catalog.select("path", F.col("bytes").alias("_bytes"), F.col("mtime").alias("_mtime"), *(F.col(c).alias(f"_{c}") for c in more), F.lit(True).alias("_old"))
    apart = F.coalesce(F.abs(F.timestamp_diff("MICROSECOND", F.col("_mtime"), F.col("mtime"))) >= 1, F.lit(True))
    same = F.col("bytes").eqNullSafe(F.col("_bytes")) & (F.col("mtime").eqNullSafe(F.col("_mtime")) | ~apart)
    if by_inode:
        same = same & F.col("inode").eqNullSafe(F.col("_inode"))
    change = F.when(F.col("_old").isNull(), "new").when(same & F.lit(not force), "same").otherwise("changed")
    return seen.join(old, "path", "left").select("path", change.alias("change"))


def once(rows: DataFrame, key: str, last: str) -> DataFrame:
    """One row of each key: that of the largest last, and of the largest values where several have that."""
    rest = [c for c in rows.columns if c not in (key, last)]
    return rows.groupBy(key).agg(F.max(F.struct(last, *rest)).alias("_x")).select(key, "_x.*").select(*rows.columns)


def upserted(catalog: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """The catalog with seen rows in place of its own, one of each key; columns as in the catalog."""
    new = seen.select(*catalog.columns)
    return catalog.join(new.select(key), key, "left_anti").unionByName(once(new, key, next(c for c in ("mtime", *catalog.columns) if c in catalog.columns and c != key)))


def gone(catalog: DataFrame, seen: DataFrame, complete: Column | bool = True) -> DataFrame:
    """The catalog with missing set on files that a complete scan did not see; others keep what they had."""
    marks = seen.select("path", F.lit(True).alias("_seen")).distinct()
    lost = on_filesystem(F.col("path")) & F.col("_seen").isNull() & (F.lit(complete) if isinstance(complete, bool) else complete)
    return catalog.join(marks, "path", "left").withColumn("missing", F.when(lost, True).when(F.col("_seen"), False).otherwise(F.col("missing"))).drop("_seen")


def repointed(media: DataFrame, old: str, new: str) -> DataFrame:
    """id, old_path, new_path, collides: paths under the prefix old as they would be under new."""
    path = F.concat("folder", F.lit("/"), "name")
    base = old.rstrip("/")
    moved = media.where(path.startswith(base + "/")).select("id", path.alias("old_path"), F.concat(F.lit(new.rstrip("/")), F.substring(path, F.lit(len(base) + 1), F.length(path))).alias("new_path"))
    still = media.where(~path.startswith(base + "/")).select(path.alias("new_path")).distinct().withColumn("taken", F.lit(True))
    twice = moved.groupBy("new_path").agg(F.count("*").alias("k"))
    return moved.join(twice, "new_path").join(still, "new_path", "left").select("id", "old_path", "new_path", (F.coalesce("taken", F.lit(False)) | (F.col("k") > 1)).alias("collides"))


def merged(own: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """own with nulls filled from other; what own has stays."""
    theirs = other.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = own.join(theirs, key, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def rewritten(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entity-attribute rows with the namespaces of each file in new replaced, without repeats."""
    return entries.join(new.select("media_id", "namespace").distinct(), ["media_id", "namespace"], "left_anti").unionByName(new).dropDuplicates()


def next_page(media: DataFrame, checkpoint: int, budget: int) -> DataFrame:
    """The next ids after a checkpoint, in order; the caller goes back to 0 when there are none."""
    return media.where(F.col("id") > checkpoint).orderBy("id").limit(budget)

"""Re-pointing a source whose volume is mounted elsewhere: a preview, a step that is validated by samples, and its undoing.

Only paths under the old prefix are rewritten; references of outside catalogs (namespace://id) are no paths and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paths shown in a preview, and paths that are looked for before anything is written.
SHOWN, LOOKED_FOR = 10, 20


class Refused(RuntimeError):
    """Nothing was written; the message says why."""


def _moved(rows: DataFrame, old: str, new: str) -> tuple[Column, Column]:
    base = old.rstrip("/")
    under = (F.col("path") == base) | F.col("path").startswith(base + "/")
    return under, F.when(under, F.concat(F.lit(new.rstrip("/")), F.substring("path", F.lit(len(base) + 1), F.length("path")))).otherwise(F.col("path"))


def preview(rows: DataFrame, source_id: int, old: str, new: str) -> DataFrame:
    """moved, untouched, collisions (new paths that two rows of the source would share), shown (the first by path)."""
    under, path = _moved(rows, old, new)
    own = rows.where(F.col("source_id") == source_id).select("path", under.alias("under"), path.alias("new_path"))
    twice = own.groupBy("new_path").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("collisions"))
    first = own.where("under").orderBy("path").limit(SHOWN).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" -> ", "path", "new_path"))), "; ").alias("shown"))
    counts = own.agg(F.count_if("under").alias("moved"), F.count_if(~F.col("under")).alias("untouched"))
    return counts.join(twice).join(first)  # one row each


def applied(rows: DataFrame, present: DataFrame, source_id: int, old: str, new: str, looked_for: int = LOOKED_FOR) -> DataFrame:
    """rows with the paths of the source rewritten; refused where nothing is to be moved, where two rows would share a
    path, or where one of up to looked_for new paths, picked by hash, is not among those present (path)."""
    under, path = _moved(rows, old, new)
    own = rows.where((F.col("source_id") == source_id) & under)
    n = own.count()
    if not n:
        raise Refused(f"no path of source {source_id} lies under {old}")
    if preview(rows, source_id, old, new).first()["collisions"]:
        raise Refused("two files would share a path")
    # a sample by hash, as even as every k-th row and without numbering the source
    sample = own.select(path.alias("path")).orderBy(F.xxhash64("id"), "id").limit(looked_for)
    lost = sample.join(present.select("path"), "path", "left_anti").count()
    if lost:
        raise Refused(f"{lost} of {min(n, looked_for)} new paths are not there")
    return rows.withColumn("path", F.when(F.col("source_id") == source_id, path).otherwise(F.col("path")))


def undone(rows: DataFrame, present: DataFrame, audit: dict) -> DataFrame:
    """rows as before the step that audit tells of (source_id, old, new): the same step back, validated the same way."""
    return applied(rows, present, audit["source_id"], audit["new"], audit["old"])

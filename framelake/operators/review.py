"""Reviewing suggestions in bulk, and what follows from decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The status that each action leads to and those that it may start from.
ACTIONS = {"approve": ("approved", ("pending", "rejected")), "reject": ("rejected", ("pending", "approved", "corrected")), "undo": ("pending", ("approved", "rejected", "corrected")), "correct": ("corrected", ("pending", "approved", "corrected"))}


def chosen(suggestions: DataFrame, media: DataFrame, status: str | None = None, level: str | None = None, source_id: int | None = None, destination: str | None = None) -> DataFrame:
    """The suggestions under all given filters."""
    given = [F.col(c) == v for c, v in (("status", status), ("level", level), ("destination", destination)) if v is not None]
    out = suggestions.where(reduce(Column.__and__, given)) if given else suggestions
    if source_id is None:
        return out
    own = media.where(F.col("source_id") == source_id).select(F.col("id").alias("media_id"))
    return out.join(own, "media_id", "left_semi")


def acted(suggestions: DataFrame, which: DataFrame, action: str, destination: str | None = None) -> DataFrame:
    """All suggestions after one action on those in which (media_id); others, and those it can't start from, stay."""
    to, start = ACTIONS[action]
    hit = which.select("media_id").distinct().withColumn("_hit", F.lit(True))
    rows = suggestions.join(hit, "media_id", "left")
    on = F.coalesce("_hit", F.lit(False)) & F.col("status").isin(*start)
    new = F.when(on, F.lit(destination)).otherwise(F.col("destination")) if action == "correct" else F.col("destination")
    return rows.withColumns({"destination": new, "status": F.when(on, to).otherwise(F.col("status"))}).select(*suggestions.columns)


def stamped(runs: DataFrame) -> DataFrame:
    """Runs that a stopped program left as running are interrupted."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def removed(media: DataFrame, gone: DataFrame, dependents: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """media without the ids in gone, places that those lent taken back, and dependents (media_id) without their rows."""
    ids = gone.select("id").distinct()
    left = media.join(ids, "id", "left_anti")
    lent = ids.select(F.col("id").alias("donor_id"), F.lit(True).alias("_lost"))
    kept = left.join(lent, "donor_id", "left")
    lost = F.coalesce("_lost", F.lit(False))
    cleared = {c: F.when(~lost, F.col(c)) for c in ("donor_id", "est_lat", "est_lon", "delta_s")}
    return kept.withColumns(cleared).select(*media.columns), {k: d.join(ids.withColumnRenamed("id", "media_id"), "media_id", "left_anti") for k, d in dependents.items()}


def total_reclaimable(groups: DataFrame) -> DataFrame:
    """bytes that duplicates waste (level, reclaimable); bursts and variants are no waste."""
    return groups.where("level NOT IN ('burst', 'variant')").agg(F.count("*").alias("n"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("bytes"))


def unclassified(destination: Column) -> Column:
    return (destination == "unsorted") | destination.startswith("unsorted/")


def queue(suggestions: DataFrame) -> DataFrame:
    """How many wait for an answer, and how many of those have no real destination."""
    waits = F.col("status") == "pending"
    return suggestions.agg(F.count_if(waits).alias("waiting"), F.count_if(waits & unclassified(F.col("destination"))).alias("unclassified"))


def folder_inventory(plan: DataFrame) -> DataFrame:
    """folder, n, listing: a JSON list of what each target folder receives, by name; plan: source, target."""
    folder = F.regexp_replace("target", "/[^/]*$", "")
    entry = F.struct(F.regexp_extract("target", "[^/]*$", 0).alias("name"), F.col("source"))
    return plan.where("target <> ''").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(entry))).alias("listing"))


def schema_changes(old: T.StructType, new: T.StructType) -> list[str]:
    """What a snapshot of schema old lacks or holds otherwise for a reader of schema new; empty: it can be restored."""
    have = {f.name: f.dataType for f in old.fields}
    gone = [f"{f.name} is missing" for f in new.fields if f.name not in have and not f.nullable]
    return gone + [f"{f.name} was {have[f.name].simpleString()}" for f in new.fields if f.name in have and have[f.name] != f.dataType]


def snapshot(table: DataFrame, folder: str, version: str) -> None:
    """A version of decisions as Parquet of its own; versions are never overwritten."""
    table.write.mode("errorifexists").parquet(f"{folder}/version={version}")

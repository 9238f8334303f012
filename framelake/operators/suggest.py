"""Evidence, suggestions, and the plan that reviewed suggestions become."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.confidence import LEVELS, level_of, level_rank, score_of, weakest
from framelake.functions.dates import date_in_name
from framelake.functions.image_type import image_type
from framelake.functions.paths import extension_of, inside, safe_relative, stem_of
from framelake.operators.ranks import numbered


def evidence(media: DataFrame, places: DataFrame) -> DataFrame:
    """id, field, origin, value, score: date (exif, else name, else file), place (own GPS), kind (file signals)."""
    named = date_in_name(F.col("name"))
    date = F.when(F.col("taken_at").isNotNull(), F.struct(F.lit("exif").alias("origin"), F.date_format("taken_at", "yyyy").alias("value")))
    date = date.when(named.isNotNull(), F.struct(F.lit("nome_arquivo").alias("origin"), F.year(named).cast("string").alias("value")))
    date = date.when(F.col("mtime").isNotNull(), F.struct(F.lit("fs").alias("origin"), F.date_format("mtime", "yyyy").alias("value")))
    parts = [media.select("id", F.lit("year").alias("field"), date.alias("x")).where("x IS NOT NULL").select("id", "field", "x.origin", "x.value")]
    placed = media.where("location_id IS NOT NULL").join(places, "location_id")
    parts.append(placed.select("id", F.lit("country").alias("field"), F.lit("gps").alias("origin"), F.col("country").alias("value")))
    kind = image_type(F.col("name"), F.col("ext"), F.col("make").isNotNull() | F.col("model").isNotNull(), F.col("gps_lat").isNotNull())
    parts.append(media.select("id", F.lit("kind").alias("field"), F.lit("arquivo").alias("origin"), kind["kind"].alias("value"), kind["score"].alias("score")))
    scored = [p if "score" in p.columns else p.withColumn("score", score_of(F.col("origin"))) for p in parts]
    return reduce(DataFrame.unionByName, scored)


def suggested(found: DataFrame) -> DataFrame:
    """id, destination, score, level: the fields used and their weakest link; what is no photo goes apart.

    Of several evidences of a field the last counts, by a column nth if there is one, else by score, origin and value.
    """
    last = F.col("nth") if "nth" in found.columns else F.struct("score", "origin", "value")
    single = found.groupBy("id", "field").agg(F.max_by(F.struct("value", "score"), last).alias("x"))
    per = single.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "x")))).alias("f"))
    part = lambda name: F.try_element_at("f", F.lit(name))
    photo = part("kind")["value"] == "photo"
    used = F.filter(F.transform(F.when(photo, F.array(part("country"), part("year"))).otherwise(F.array(part("kind"), part("year"))), lambda x: x), lambda x: x.isNotNull())
    path = F.array_join(F.transform(used, lambda x: x["value"]), "/")
    score = weakest(F.transform(used, lambda x: x["score"]))
    return per.select("id", F.when(path == "", "unsorted").otherwise(path).alias("destination"), score.alias("score"), level_of(score).alias("level"))


def groups(suggestions: DataFrame, media: DataFrame, top: int = 3) -> DataFrame:
    """destination, n, level (weakest), pending, estimated, unreachable, folders (the top ones by count) of each destination."""
    away = F.col("missing") | F.col("offline")
    estimated = F.col("gps_lat").isNull() & F.col("location_id").isNotNull()
    rows = suggestions.join(media.select(F.col("id").alias("media_id"), "folder", away.alias("away"), estimated.alias("estimated")), "media_id")
    counts = (F.count_if(F.col("status") == "pending").alias("pending"), F.count_if("estimated").alias("estimated"), F.count_if("away").alias("unreachable"))
    per_folder = rows.groupBy("destination", "folder").agg(F.count("*").alias("n"), F.min(level_rank(F.col("level"))).alias("low"), *counts)
    order = Window.partitionBy("destination").orderBy(F.desc("n"), "folder")
    ranked = per_folder.withColumn("rank", F.row_number().over(order))
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "folder"))))
    out = ranked.groupBy("destination").agg(F.sum("n").alias("n"), F.min("low").alias("low"), *(F.sum(c).alias(c) for c in ("pending", "estimated", "unreachable")), F.array_join(F.transform(best, lambda x: x["folder"]), ", ").alias("folders"))
    return out.select("destination", "n", F.get(F.array(*map(F.lit, LEVELS)), F.col("low")).alias("level"), "pending", "estimated", "unreachable", "folders")


def purged(suggestions: DataFrame, ready: DataFrame) -> DataFrame:
    """Suggestions without the pending ones of files that are not ready; decisions stay."""
    alive = ready.select(F.col("id").alias("media_id"))
    return suggestions.where("status <> 'pending'").unionByName(suggestions.where("status = 'pending'").join(alive, "media_id", "left_semi"))


def copy_plan(suggestions: DataFrame, media: DataFrame, copied: DataFrame | None = None, versions: DataFrame | None = None, root: str = "", sources: DataFrame | None = None) -> DataFrame:
    """media_id, source, target, conflict: approved files under their destination, none over another.

    Files in copied (media_id: those that an earlier plan has finished) and in versions (media_id: redundant copies
    of a group whose principal is settled) are left out. The first file of a name, by id, keeps it; the others get
    the least free number before the extension, from ` (2)` on, where names that other files bear are not free. A
    destination that leaves root has no target. A file whose source (sources: source_id, path; without it the file's own
    folder) holds root is marked, as the next scan would find the copies; that mark comes before a new name's.
    """
    files = media.select(F.col("id").alias("media_id"), "folder", "name", *([] if sources is None else ["source_id"]))
    if sources is None:
        files = files.withColumn("_tree", F.col("folder"))
    else:
        files = files.join(sources.select("source_id", F.col("path").alias("_tree")), "source_id", "left")
    rows = suggestions.where("status IN ('approved', 'corrected')").join(files, "media_id")
    for gone in (copied, versions):
        if gone is not None:
            rows = rows.join(gone.select("media_id"), "media_id", "left_anti")
    rows = rows.withColumn("safe", safe_relative(F.col("destination")))
    fine = numbered(rows.where("safe IS NOT NULL"), ["safe", "name"], "media_id", "nth")
    stem, ext = stem_of(F.col("name")), extension_of(F.col("name"))
    # numbers that names bear already: the k-th of a family, least first, leaves so many free ones below it
    taken = fine.where("nth = 1").select("safe", F.regexp_extract(stem, r"^(.*) \(([1-9][0-9]{0,8})\)$", 1).alias("stem"), ext.alias("ext"), F.expr(r"try_cast(regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), ' \\(([1-9][0-9]{0,8})\\)$', 1) AS bigint)").alias("k")).where("k >= 2")
    family = Window.partitionBy("safe", "stem", "ext")
    taken = taken.withColumn("free", F.col("k") - 1 - F.row_number().over(family.orderBy("k")))
    more = fine.where("nth > 1").withColumns({"stem": stem, "ext": ext})
    marks = taken.select("safe", "stem", "ext", F.col("free").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("media_id"), F.lit(None).cast("long").alias("nth"))
    both = marks.unionByName(more.select("safe", "stem", "ext", (F.col("nth") - 2).alias("at"), F.lit(1).alias("side"), "media_id", "nth"))
    skipped = F.count_if(F.col("side") == 0).over(family.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    number = both.withColumn("number", F.col("nth") + skipped).where("side = 1").select("media_id", "number")
    placed = rows.join(number, "media_id", "left")
    name = F.when(F.col("number").isNull(), F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("number").cast("string"), F.lit(")"), ext))
    target = F.when(F.col("safe").isNotNull(), F.concat(F.lit(root.rstrip("/") + "/" if root else ""), "safe", F.lit("/"), name)).otherwise("")
    conflict = F.when(F.col("safe").isNull(), "unsafe destination").when(F.lit(bool(root)) & F.coalesce(inside(F.lit(root), F.col("_tree")), F.lit(False)), "destination inside the source")
    conflict = conflict.when(F.col("number").isNotNull(), F.concat(F.lit("taken; renamed to "), name))
    return placed.select("media_id", F.concat("folder", F.lit("/"), "name").alias("source"), target.alias("target"), conflict.alias("conflict"))


def verdicts(plan: DataFrame, media: DataFrame) -> DataFrame:
    """verdict, n, bytes of a dry run: missing, offline, unreadable, empty or fine."""
    rows = plan.join(media.select(F.col("id").alias("media_id"), "missing", "offline", "read_error", "bytes"), "media_id")
    verdict = F.when(F.col("missing"), "missing").when(F.col("offline"), "offline").when(F.col("read_error").isNotNull(), "unreadable").when(F.col("bytes") == 0, "empty").otherwise("fine")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def statuses(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("status", "level").agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, truth: Column, said: dict[str, Column]) -> DataFrame:
    """variant, n, right: how often each variant says the truth, all variants in one pass."""
    counts = [F.count_if(c == truth).alias(k) for k, c in said.items()]
    one = rows.agg(F.count("*").alias("n"), *counts)
    return one.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.col(k).alias("right")) for k in said))).alias("x")).select("x.variant", "n", "x.right")

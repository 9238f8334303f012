"""Places from the nearest donor: clock offsets, the as-of join with an inequality, and its calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geo import LEAST_M, MOST_M, SPEED, haversine_km
from framelake.operators.sessions import seconds

WINDOW_S = 43_200.0
#: Upper ends of the bands of time differences, in seconds.
EDGES = (120.0, 600.0, 7200.0, 43_200.0)


def nearest_donor(items: DataFrame, window_s: float = WINDOW_S, hold_out: bool = False) -> DataFrame:
    """id, donor_id, delta_s: for each heir (has_gps false) the nearest donor of another origin within window_s.

    With hold_out the heirs are the donors themselves, each without its own place: pairs whose true distance is known.

    items: id, at, origin, has_gps. Ties go to the earlier side, then to the latest before and the earliest after.
    Rows are dealt by time buckets as wide as the window, donors to the buckets next to theirs too, so no window
    sorts the whole table. Donors of one origin in a row are a run; next to the nearest donor, each donor knows
    the nearest one of another run on the same side, which is all that an heir of its origin needs.
    """
    bucket = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / int(window_s * 1e6))
    rows = items.where("at IS NOT NULL").withColumn("bucket", bucket)
    heirs = rows.where("has_gps" if hold_out else "NOT has_gps")
    spread = F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)
    donors = rows.where("has_gps").withColumn("bucket", F.explode(spread))
    w = Window.partitionBy("bucket").orderBy("at", "id")
    me = F.struct("id", "at", "origin")
    donors = donors.withColumn("new", (~F.col("origin").eqNullSafe(F.lag("origin").over(w))).cast("int"))
    # the last donor of the run before, and the first of the run after
    donors = donors.withColumn("before", F.lag(me).over(w))
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    donors = donors.withColumn("run", run)
    in_run = Window.partitionBy("bucket", "run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donors = donors.withColumn("other_before", F.first("before").over(in_run))
    after = F.lead(me).over(w)
    donors = donors.withColumn("after", after).withColumn("other_after", F.last("after").over(in_run))
    both = donors.select("bucket", "at", "id", "origin", F.lit(True).alias("donor"), F.struct(me.alias("me"), F.col("other_before").alias("other")).alias("back"), F.struct(me.alias("me"), F.col("other_after").alias("other")).alias("ahead"))
    none = F.lit(None).cast(both.schema["back"].dataType)
    every = both.unionByName(heirs.select("bucket", "at", "id", "origin", F.lit(False).alias("donor"), none.alias("back"), none.alias("ahead")))
    # earlier donors come before an heir of the same time only if strictly earlier
    back = Window.partitionBy("bucket").orderBy(F.col("at"), F.col("donor"), F.col("id")).rowsBetween(Window.unboundedPreceding, -1)
    # the other way round the frame grows too, which takes one step a row
    ahead = Window.partitionBy("bucket").orderBy(F.desc("at"), F.desc("donor"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    seen = every.withColumn("p", F.last("back", ignorenulls=True).over(back)).withColumn("q", F.last("ahead", ignorenulls=True).over(ahead)).where("NOT donor")
    pick = lambda s: F.when(~F.col(f"{s}.me.origin").eqNullSafe(F.col("origin")), F.col(f"{s}.me")).otherwise(F.col(f"{s}.other"))
    seen = seen.withColumn("p", pick("p")).withColumn("q", pick("q"))
    dp, dq = seconds(F.col("at"), F.col("p.at")), seconds(F.col("q.at"), F.col("at"))
    seen = seen.withColumn("dp", F.when(dp <= window_s, dp)).withColumn("dq", F.when(dq <= window_s, dq))
    first = F.col("dp").isNotNull() & (F.col("dq").isNull() | (F.col("dp") <= F.col("dq")))
    out = seen.select("id", F.when(first, F.col("p.id")).when(F.col("dq").isNotNull(), F.col("q.id")).alias("donor_id"), F.when(first, F.col("dp")).otherwise(F.col("dq")).alias("delta_s"))
    return out.where("donor_id IS NOT NULL")


def anchors(media: DataFrame, *keys: str) -> DataFrame:
    """a < b: pairs that share one of the keys (quick_hash if none is named), each pair once, in different sources, of
    which exactly one side has GPS.

    A key is a file's content, so its group is as small as a file has copies.
    """
    held = F.array_distinct(F.filter(F.array(*map(F.col, keys or ("quick_hash",))), lambda k: F.coalesce(k, F.lit("")) != ""))
    own = media.where("taken_at IS NOT NULL").select("id", F.explode(held).alias("key"), "source_id", "taken_at", "make", "model", F.col("gps_lat").isNotNull().alias("gps"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.source_id") != F.col("b.source_id")) & (F.col("a.gps") != F.col("b.gps")))
    side = lambda g: F.when(F.col("a.gps") == g, F.struct("a.id", "a.taken_at", "a.make", "a.model")).otherwise(F.struct("b.id", "b.taken_at", "b.make", "b.model"))
    x = pairs.select(side(True).alias("ref"), side(False).alias("cam"))
    known = F.col("cam.make").isNotNull() | F.col("cam.model").isNotNull()
    out = x.where(known).select(F.col("ref.id").alias("ref_id"), F.col("cam.id").alias("cam_id"), F.col("cam.make").alias("make"), F.col("cam.model").alias("model"), seconds(F.col("ref.taken_at"), F.col("cam.taken_at")).alias("delta_s"))
    return out.dropDuplicates(["ref_id", "cam_id"]) if len(keys) > 1 else out


def clock_offsets(pairs: DataFrame, least: int = 2, most_mad_s: float = 180.0) -> DataFrame:
    """make, model, n, offset_s, mad_s, kept: the median difference of each camera's clock and its spread."""
    mid = pairs.groupBy("make", "model").agg(F.count("*").alias("n"), F.percentile("delta_s", F.lit(0.5)).alias("offset_s"))
    named = mid.withColumnsRenamed({"make": "_make", "model": "_model"})
    same = F.col("make").eqNullSafe(F.col("_make")) & F.col("model").eqNullSafe(F.col("_model"))
    apart = pairs.join(named, same).select("make", "model", "n", "offset_s", F.abs(F.col("delta_s") - F.col("offset_s")).alias("d"))
    out = apart.groupBy("make", "model", "n", "offset_s").agg(F.percentile("d", F.lit(0.5)).alias("mad_s"))
    return out.withColumn("kept", (F.col("n") >= least) & (F.col("mad_s") <= most_mad_s))


def band_of(delta_s: Column, edges: tuple[float, ...] = EDGES) -> Column:
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(delta_s <= edges[k], k).otherwise(band)
    return band


def coverage_bands(pairs: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """band, n, mean_delta_s of inherited places by time difference."""
    return pairs.groupBy(band_of(F.col("delta_s"), edges).cast("long").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("delta_s"), 6).alias("mean_delta_s"))


def calibration(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs (id, donor_id, delta_s) with km, the true distance. places: id, gps_lat, gps_lon, taken_at."""
    own = places.select("id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), F.to_date("taken_at").alias("day"))
    theirs = places.select(F.col("id").alias("donor_id"), F.col("gps_lat").alias("lat2"), F.col("gps_lon").alias("lon2"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return pairs.join(own, "id").join(theirs, "donor_id").select("id", "donor_id", "delta_s", "day", km.alias("km"))


def coverage(pairs: DataFrame, speed: float = SPEED, most_m: float = MOST_M) -> DataFrame:
    """n, raw, by_band, by_day: how often the true place lies in the circle; over pairs, bands alike, and days alike."""
    inside = (F.col("km") * 1000 <= F.least(F.lit(most_m), F.greatest(F.lit(LEAST_M), speed * F.abs("delta_s")))).cast("int")
    per = pairs.groupBy(band_of(F.col("delta_s")).alias("band"), "day").agg(F.count("*").alias("n"), F.sum(inside).alias("k"))
    band = per.groupBy("band").agg((F.sum("k") / F.sum("n")).alias("share")).agg(F.avg("share").alias("by_band"))
    day = per.groupBy("day").agg((F.sum("k") / F.sum("n")).alias("share")).agg(F.avg("share").alias("by_day"))
    one = per.agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("raw"))
    return one.join(band).join(day)  # one row each


def sweep(pairs: DataFrame, speeds: tuple[float, ...], caps_m: tuple[float, ...]) -> DataFrame:
    """speed, cap_m, n, covered of every combination of parameters, all in one pass over the pairs."""
    sides = [(s, c) for s in speeds for c in caps_m]
    hits = [F.count_if(F.col("km") * 1000 <= F.least(F.lit(c), F.greatest(F.lit(LEAST_M), s * F.abs("delta_s")))).alias(f"h{i}") for i, (s, c) in enumerate(sides)]
    one = pairs.agg(F.count("*").alias("n"), *hits)
    each = F.array(*(F.struct(F.lit(s).alias("speed"), F.lit(c).alias("cap_m"), F.col(f"h{i}").alias("covered")) for i, (s, c) in enumerate(sides)))
    return one.select("n", F.explode(each).alias("x")).select("x.speed", "x.cap_m", "n", "x.covered")


def bootstrap(pairs: DataFrame, reps: int = 400, speed: float = SPEED, most_m: float = MOST_M) -> DataFrame:
    """p5, p50, p95 of the coverage over reps draws of days with replacement: the i-th pick of a draw is the day whose
    number is MD5's first 32 bits of `rep:i`, modulo the number of days."""
    inside = (F.col("km") * 1000 <= F.least(F.lit(most_m), F.greatest(F.lit(LEAST_M), speed * F.abs("delta_s")))).cast("int")
    days = pairs.groupBy("day").agg(F.avg(inside).alias("share"))
    ranked = days.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))  # days are few
    draws = ranked.select("n", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), "i")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    picks = draws.select("rep", (drawn % F.col("n")).cast("int").alias("i"))
    per = picks.join(ranked.select("i", "share"), "i").groupBy("rep").agg(F.avg("share").alias("c"))
    return per.agg(*(F.percentile("c", F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.05, 0.5, 0.95)))

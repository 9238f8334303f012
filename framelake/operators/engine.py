"""The runs of the whole catalog: places inherited from donors, and sessions made into trips and events, whole or as far
as new files reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geo import haversine_km, reliable_fields, uncertainty_m
from framelake.operators import asof, classify, clocks, sessions
from framelake.session import staged

#: Days without a photo that end a session, files of a session at least, and hours after which a session
#: is one happening whatever its rhythm.
GAP_DAYS, LEAST, WHOLE_HOURS = 3, 2, 20.0
#: Seconds of a gap that never and that always parts two happenings, files of a happening at least.
NEVER_S, ALWAYS_S, LEAST_BLOCK = 5400.0, 28_800.0, 10
#: Kilometres from home within which files are at home.
AT_HOME_KM = 30.0


def inherited(media: DataFrame, window_s: float = asof.WINDOW_S, most_mad_s: float = 180.0) -> DataFrame:
    """id, donor_id, delta_s, est_lat, est_lon, radius_m, granularity of every file without GPS that has a donor.

    Clocks are set right first: a camera whose anchors agree on an offset has it taken off its times. A time of the
    file system makes a place less sure. The result is a function of the catalog, so a run replaces the last one.
    """
    offsets = clocks.offsets(media, most_mad_s=most_mad_s).where("kept").select(F.col("make").alias("_make"), F.col("model").alias("_model"), "offset_s")
    same = F.col("make").eqNullSafe(F.col("_make")) & F.col("model").eqNullSafe(F.col("_model"))
    off = F.round(F.coalesce("offset_s", F.lit(0.0)) * 1e6).cast("long")
    right = F.timestamp_micros(F.unix_micros(F.col("taken_at").cast("timestamp")) - off).cast(media.schema["taken_at"].dataType)
    timed = media.join(offsets, same, "left")
    items = timed.select("id", F.coalesce(right, F.col("mtime")).alias("at"), F.col("source_id").alias("origin"), F.col("gps_lat").isNotNull().alias("has_gps"))
    found = asof.nearest_donor(items, window_s)
    lent = media.select(F.col("id").alias("donor_id"), F.col("gps_lat").alias("est_lat"), F.col("gps_lon").alias("est_lon"))
    rows = found.join(lent, "donor_id").join(media.select("id", F.col("taken_at").isNull().alias("_file_time")), "id")
    fields = reliable_fields(F.col("delta_s"), F.col("_file_time"))
    return rows.select("id", "donor_id", "delta_s", "est_lat", "est_lon", uncertainty_m(F.col("delta_s")).alias("radius_m"), F.element_at(fields, -1)["field"].alias("granularity"))


def built(media: DataFrame, owner: str, gap_days: float = 2.0, trip_days: float = 3.0, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Groups (kind, group_id, owner, started, ended, n) and assignments (id, trip_id, event_id).

    Sessions of an owner end at a gap; one with a place that lasts trip_days is a trip, whole. Others are events, by
    day unless they last too long to part. Blocks of fewer than least files make no group. Ids follow the start.
    """
    rows = sessions.by_gap(media, owner, "taken_at", gap_days * 86_400)
    key = [owner, "session"]
    span = rows.groupBy(*key).agg(F.min("taken_at").alias("lo"), F.max("taken_at").alias("hi"), F.count("gps_lat").alias("placed"), F.count("*").alias("size")).where(F.col("size") >= least)
    trip = (F.col("placed") > 0) & (sessions.seconds(F.col("hi"), F.col("lo")) >= trip_days * 86_400)
    named = rows.join(span.select(*key, "lo", trip.alias("is_trip")), key)
    parts = sessions.by_policy(named.withColumn("day", F.date_diff("taken_at", "lo")), key, "taken_at", "is_trip", "day")
    groups = parts.groupBy(*key, "block", "is_trip").agg(F.min("taken_at").alias("started"), F.max("taken_at").alias("ended"), F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= least)
    # groups are far fewer than files: numbering them takes one sort of groups by kind
    nth = F.row_number().over(Window.partitionBy("is_trip").orderBy("started", "first_id")).cast("long")
    groups = groups.withColumn("group_id", nth).withColumn("kind", F.when(F.col("is_trip"), "trip").otherwise("event"))
    mine = parts.select("id", *key, "block").join(groups.select(*key, "block", "is_trip", "group_id"), [*key, "block"])
    return groups, mine.select("id", F.when(F.col("is_trip"), F.col("group_id")).alias("trip_id"), F.when(~F.col("is_trip"), F.col("group_id")).alias("event_id"))


def _gathered(rows: DataFrame, key: str, home: tuple[float, float] | None) -> DataFrame:
    """key, days, home_km, country, legs, period of each group of rows: what the cascade judges."""
    km = haversine_km(F.col("lat"), F.col("lon"), F.lit(home[0]), F.lit(home[1])) if home else F.lit(None).cast("double")
    own = rows.withColumn("km", km)
    per = own.groupBy(key).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.bool_or("dated").alias("dated"), F.count("*").alias("n"))
    where = sessions.geography(own if "city" in own.columns else own.withColumn("city", F.lit(None).cast("string")), key, "at").select(key, "country", "legs")
    middle = sessions.upper_median(own, [key], "km").select(key, F.col("median").alias("home_km"))
    per = per.join(where, key, "left").join(middle, key, "left")
    return per.withColumns({"days": F.ceil(sessions.seconds(F.col("hi"), F.col("lo")) / 86_400).cast("int"), "period": F.concat_ws("/", F.date_format("lo", "MM-yyyy"), F.when(F.date_format("lo", "MM-yyyy") != F.date_format("hi", "MM-yyyy"), F.date_format("hi", "MM-yyyy")))})


def _judged(rows: DataFrame, key: str, home: tuple[float, float] | None, aliases: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """key, lo, hi, n, kind, label, rule; groups without a date of capture are neutral."""
    per = staged(_gathered(rows, key, home), "gathered")
    said = classify.classified(per, aliases, key, rows.select(key, "folder"), lexicon)
    undated = ~F.col("dated")
    return said.select(key, "lo", "hi", "n", F.when(undated, "neutral").otherwise(F.col("kind")).alias("kind"), F.when(~undated, F.col("label")).alias("label"), F.when(undated, "none").otherwise(F.col("rule")).alias("rule"))


def gap_sessions(media: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """media with at (time of capture, else of the file) and gap_session; rows without a time are left out."""
    rows = media.withColumn("at", F.coalesce("taken_at", "mtime")).where("at IS NOT NULL").withColumn("_day", F.to_date("at"))
    days = sessions.global_days(rows, "at", gap_days).select(F.col("day").alias("_day"), F.col("session").alias("gap_session"))
    return rows.join(days, "_day").drop("_day")


def happenings(media: DataFrame, home: tuple[float, float] | None, aliases: DataFrame, lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of the whole catalog. groups: group_id (the least id of its files, so a group keeps its id as
    long as it keeps that file), kind, label, rule, started, ended, n. members: id, group_id, gap_session.

    media: id, taken_at, mtime, folder, lat, lon (own or inherited), country. In this order: sessions by gaps; parts at
    home and away, where home is known; parts of fewer than LEAST files go; the cascade; what is no trip and lasts no
    longer than WHOLE_HOURS is parted where the rhythm breaks, small parts joining their neighbours; and parts of a parted session are judged again, by
    themselves.
    """
    rows = gap_sessions(media).withColumn("dated", F.col("taken_at").isNotNull())
    if home:
        away = haversine_km(F.col("lat"), F.col("lon"), F.lit(home[0]), F.lit(home[1])) > AT_HOME_KM
        rows = sessions.home_away(rows.withColumn("_away", away), "gap_session", "at", "_away").drop("_away")
    else:
        rows = rows.withColumn("segment", F.lit(0).cast("long"))
    per = rows.groupBy("gap_session", "segment").agg(F.min("id").alias("part"), F.count("*").alias("_n")).where(F.col("_n") >= LEAST).drop("_n")
    rows = staged(rows.join(per, ["gap_session", "segment"]), "parts")
    first = staged(_judged(rows, "part", home, aliases, lexicon), "first-judgement")
    short = sessions.seconds(F.col("hi"), F.col("lo")) <= WHOLE_HOURS * 3600
    open_ = rows.join(first.where((F.col("kind") != "trip") & short).select("part"), "part", "left_semi")
    # own GPS or an heir's tell of moves, as lat and lon do
    cut = sessions.by_rhythm(open_.withColumnsRenamed({"lat": "gps_lat", "lon": "gps_lon"}), "part", "at", NEVER_S, ALWAYS_S).withColumnsRenamed({"gps_lat": "lat", "gps_lon": "lon"})
    cut = staged(cut, "rhythm")
    sizes = sessions.absorb_small(cut.groupBy("part", "event").agg(F.count("*").alias("_size")), "part", "event", "_size", LEAST_BLOCK).select("part", "event", "merged")
    blocks = cut.join(sizes, ["part", "event"])
    several = sizes.groupBy("part").agg(F.count_distinct("merged").alias("_k")).where("_k > 1").select("part")
    ids = blocks.join(several, "part", "left_semi").groupBy("part", "merged").agg(F.min("id").alias("group_id"))
    again = staged(blocks.join(ids, ["part", "merged"]).drop("merged", "event"), "blocks")
    second = _judged(again, "group_id", home, aliases, lexicon)
    whole = first.join(several, "part", "left_anti").withColumnRenamed("part", "group_id")
    groups = whole.unionByName(second).withColumnsRenamed({"lo": "started", "hi": "ended"})
    members = again.select("id", "group_id", "gap_session").unionByName(rows.join(several, "part", "left_anti").select("id", F.col("part").alias("group_id"), "gap_session"))
    return groups, members


def with_new_files(media: DataFrame, groups: DataFrame, members: DataFrame, home: tuple[float, float] | None, aliases: DataFrame, lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of media, given those of an earlier run over a part of it, and the same home and lists.

    Only sessions by gaps that new files fall into, or join, are built again; the groups of all others stay as they are.
    """
    rows = gap_sessions(media).select("id", "gap_session")
    known = members.select("id").withColumn("_known", F.lit(True))
    # a session whose files were all judged before, and none else, is as it was; files that were in no group are new to it
    fresh = rows.join(known, "id", "left").where("_known IS NULL").select("gap_session").distinct()
    touched = staged(rows.join(fresh, "gap_session", "left_semi").select("id"), "touched")
    new_groups, new_members = happenings(media.join(touched, "id", "left_semi"), home, aliases, lexicon)
    still = members.join(touched, "id", "left_anti")
    return groups.join(still.select("group_id").distinct(), "group_id", "left_semi").unionByName(new_groups), still.unionByName(new_members)

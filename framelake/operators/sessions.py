"""Sessions, home and away, and events, from ordered timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geo import equirectangular_km

#: Seconds of one chunk of a timeline; a key is worked on chunk by chunk.
CHUNK_S = 86_400.0


def seconds(after: Column, before: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", before, after) / 1e6


def by_gap(df: DataFrame, key: str, time: str, gap_seconds: float, tie: str = "id") -> DataFrame:
    """session (0, 1, ..) of each row within its key: a new one where the gap to the row before is larger."""
    w = Window.partitionBy(key).orderBy(time, tie)
    cut = F.coalesce(seconds(F.col(time), F.lag(time).over(w)) > gap_seconds, F.lit(False))
    return df.where(F.col(time).isNotNull()).withColumn("_cut", cut.cast("int")).withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_cut")


def global_days(df: DataFrame, time: str, gap_days: int) -> DataFrame:
    """day, session over the whole table without sorting it: days are aggregated first, and a gap of more than
    gap_days between the last and first moments of two days is found among days alone."""
    day = df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count("*").alias("n"))
    w = Window.orderBy("day")  # one row a day
    cut = F.coalesce(seconds(F.col("lo"), F.lag("hi").over(w)) > gap_days * 86400.0, F.lit(False)).cast("int")
    return day.withColumn("_cut", cut).withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_cut", "lo", "hi")


def home_cells(media: DataFrame, least_points: int = 20, least_share: float = 0.3) -> DataFrame:
    """Cells of a tenth of a degree with their counts and shares; is_home marks the one that is home, if any is."""
    cell = media.where("gps_lat IS NOT NULL AND gps_lon IS NOT NULL").groupBy(F.round("gps_lat", 1).alias("lat"), F.round("gps_lon", 1).alias("lon"))
    cells = cell.agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    every, best = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first_id")
    cells = cells.withColumn("total", F.sum("n").over(every)).withColumn("rank", F.row_number().over(best).cast("long"))
    return cells.withColumn("share", F.col("n") / F.col("total")).withColumn("is_home", (F.col("rank") == 1) & (F.col("total") >= least_points) & (F.col("share") >= least_share)).drop("total")


def _chunk(time: str, chunk_s: float) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / int(chunk_s * 1e6))


def _running(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows (key, _chunk) with name, the sum of value up to each row of its key: sums of chunks, and sums within them."""
    chunks = rows.groupBy(key, "_chunk").agg(F.sum(value).alias("_all"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col(key).alias("_key_of"), F.col("_chunk").alias("_chunk_of"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(chunks, rows[key].eqNullSafe(F.col("_key_of")) & (rows["_chunk"] == F.col("_chunk_of")))
    return met.withColumn(name, (F.col("_before") + F.sum(value).over(own)).cast("long")).drop("_before", "_key_of", "_chunk_of")


def home_away(df: DataFrame, key: str, time: str, state: str, tie: str = "id", chunk_s: float = CHUNK_S) -> DataFrame:
    """segment of each row within its key: cut where the known state changes and the next known one confirms it.

    Unknown states join the running segment. Keys are worked on in chunks of time; what a chunk has to know of the
    others, the next known state and the last confirmed one, comes from a row for each chunk.
    """
    order = [time, tie]
    known = df.where(F.col(state).isNotNull()).select(key, time, tie, state, _chunk(time, chunk_s).alias("_chunk"))
    at, w = F.struct(*order), Window.partitionBy(key, "_chunk").orderBy(*order)
    chunks, of_key = known.groupBy(key, "_chunk").agg(F.min_by(state, at).alias("_first")), Window.partitionBy(key).orderBy("_chunk")
    chunks = chunks.withColumn("_ahead", F.lead("_first").over(of_key)).withColumn("_start", F.first("_first").over(of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    chunks = chunks.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), "_ahead", "_start")
    sure = known.join(chunks, known[key].eqNullSafe(F.col("_k")) & (known["_chunk"] == F.col("_c"))).drop("_k", "_c")
    sure = sure.withColumn("_ok", F.coalesce(F.coalesce(F.lead(state).over(w), "_ahead") == F.col(state), F.lit(False)))
    ends = sure.where("_ok").groupBy(key, "_chunk").agg(F.max_by(state, at).alias("_end"))
    ends = known.select(key, "_chunk").distinct().alias("x").join(ends.alias("y"), F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")) & (F.col("x._chunk") == F.col("y._chunk")), "left").select(F.col(f"x.{key}").alias("_k"), F.col("x._chunk").alias("_c"), "_end")
    ends = ends.select("_k", "_c", F.last("_end", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    sure = sure.join(ends, sure[key].eqNullSafe(F.col("_k")) & (sure["_chunk"] == F.col("_c"))).drop("_k", "_c")
    last_sure = F.coalesce(F.last(F.when(F.col("_ok"), F.col(state)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_carried", "_start")
    marks = sure.select(F.col(key).alias("_k"), F.col(tie).alias("_t"), (F.col("_ok") & (F.col(state) != last_sure)).cast("int").alias("_cut"))
    rows = df.withColumn("_chunk", _chunk(time, chunk_s))
    rows = rows.join(marks, rows[key].eqNullSafe(F.col("_k")) & (rows[tie] == F.col("_t")), "left").drop("_k", "_t").withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    return _running(rows, key, order, "_cut", "segment").drop("_cut", "_chunk")


def by_rhythm(df: DataFrame, key: str, time: str, floor_s: float, always_s: float, factor: float = 6.0, behind: int = 12, move_km: float = 3.0, tie: str = "id", chunk_s: float = CHUNK_S) -> DataFrame:
    """event of each row within its key: cut at a move of move_km; at a gap of always_s; never under floor_s; else
    where the gap is longer than factor times the median of the up to behind gaps before it.

    Keys are worked on in chunks of time. Each chunk gets the last behind + 1 rows before it from the chunks before,
    and events are numbered by the sums of cuts of whole chunks.
    """
    order, halo = [time, tie], behind + 1
    rows = df.where(F.col(time).isNotNull()).withColumn("_chunk", _chunk(time, chunk_s))
    last = Window.partitionBy(key, "_chunk").orderBy(F.desc(time), F.desc(tie))
    tail = rows.select(key, "_chunk", time, tie, "gps_lat", "gps_lon", F.row_number().over(last).alias("_r")).where(F.col("_r") <= halo)
    chunks = tail.groupBy(key, "_chunk").agg(F.collect_list(F.struct(time, tie, "gps_lat", "gps_lon")).alias("_own"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(-halo, -1)  # each chunk has a row at least
    carried = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("_own").over(before)))), 1, halo)
    halos = chunks.withColumn("_tail", carried).select(key, "_chunk", F.explode("_tail").alias("x")).select(key, "_chunk", F.col(f"x.{time}").alias(time), F.col(f"x.{tie}").alias(tie), "x.gps_lat", "x.gps_lon", F.lit(True).alias("_halo"))
    both = rows.select(key, "_chunk", time, tie, "gps_lat", "gps_lon", F.lit(False).alias("_halo")).unionByName(halos)
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    both = both.withColumn("_gap", seconds(F.col(time), F.lag(time).over(w)))
    # the first row that was carried has no gap of its own, and nothing looks at it
    usual = F.percentile("_gap", F.lit(0.5)).over(w.rowsBetween(-behind, -1))
    moved = equirectangular_km(F.lag("gps_lat").over(w), F.lag("gps_lon").over(w), F.col("gps_lat"), F.col("gps_lon")) >= move_km
    both = both.withColumn("_usual", usual).withColumn("_moved", F.coalesce(moved, F.lit(False))).where("NOT _halo")
    cut = F.when(F.col("_gap").isNull(), False).when(F.col("_moved"), True).when(F.col("_gap") >= always_s, True).when(F.col("_gap") < floor_s, False).otherwise(F.coalesce(F.col("_gap") > factor * F.col("_usual"), F.lit(False)))
    marks = both.select(F.col(key).alias("_k"), F.col(tie).alias("_t"), cut.cast("int").alias("_cut"))
    met = rows.join(marks, rows[key].eqNullSafe(F.col("_k")) & (rows[tie] == F.col("_t"))).drop("_k", "_t")
    return _running(met, key, order, "_cut", "event").drop("_cut", "_chunk")


def by_policy(df: DataFrame, key: list[str], time: str, is_trip: str, event: str, most_hours: float = 20.0) -> DataFrame:
    """block of each row: 0 for all of a session (key) that is a trip or spans over most_hours, else its event."""
    spans = df.where(F.col(time).isNotNull()).groupBy(*key).agg(((seconds(F.max(time), F.min(time)) > most_hours * 3600) | F.bool_or(is_trip)).alias("_whole"))
    return df.where(F.col(time).isNotNull()).join(spans, key).withColumn("block", F.when(F.col("_whole"), F.lit(0)).otherwise(F.col(event)).cast("long")).drop("_whole")


def absorb_small(blocks: DataFrame, key: str, block: str, size: str, least: int = 10) -> DataFrame:
    """merged block of each block: a small one joins the block before it, a small first group the one after it."""
    w = Window.partitionBy(key).orderBy(block)
    starts = (F.row_number().over(w) == 1) | (F.col(size) >= least)
    rows = blocks.withColumn("_s", starts.cast("int")).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.sum(F.when(F.col("_g") == 1, F.col(size))).over(Window.partitionBy(key))
    groups = F.max("_g").over(Window.partitionBy(key))
    rows = rows.withColumn("_shift", (first < least) & (groups > 1))
    return rows.withColumn("merged", F.when(F.col("_shift"), F.greatest(F.col("_g") - 2, F.lit(0))).otherwise(F.col("_g") - 1).cast("long")).drop("_s", "_g", "_shift")


def bursts(df: DataFrame, group: str, time: str, within_s: float = 10.0, tie: str = "id") -> DataFrame:
    """group, is_burst: one known camera, all dates known, every gap within within_s."""
    w = Window.partitionBy(group).orderBy(time, tie)
    gaps = df.withColumn("_gap", seconds(F.col(time), F.lag(time).over(w)))
    camera = F.count_distinct(F.struct("make", "model")) == 1
    known = F.bool_and(F.col("make").isNotNull() | F.col("model").isNotNull())
    return gaps.groupBy(group).agg(F.count("*").alias("n"), (camera & known & F.bool_and(F.col(time).isNotNull()) & F.coalesce(F.max("_gap") <= within_s, F.lit(True))).alias("is_burst"))


def legs(df: DataFrame, session: list[str], place: str, time: str, least: int = 3, tie: str = "id") -> DataFrame:
    """The places of each session with at least least photos, in the order first seen, if there are two or more."""
    per = df.where(F.col(place).isNotNull()).groupBy(*session, place).agg(F.count("*").alias("n"), F.min(F.struct(time, tie)).alias("first")).where(F.col("n") >= least)
    order = F.array_sort(F.collect_list(F.struct("first", place)))
    return per.groupBy(*session).agg(F.count("*").alias("n_legs"), F.array_join(F.transform(order, lambda x: x[place]), " - ").alias("legs")).where("n_legs >= 2")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of an even number of values the upper one of the middle two."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("median"), F.row_number().over(w.orderBy(value)).alias("_i"), F.count("*").over(w).alias("n"))
    return ranked.where("_i = n div 2 + 1").select(*keys, "n", "median")


def overlapping(spans: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """How many marks (at, label) lie in each span (lo, hi, both inclusive), by label.

    Marks are counted by day, and spans meet these counts. Of a span's first and last day, what lies outside it is taken
    off: a running count of the day's marks of a label, with the spans' ends among them. So no mark meets a span.
    """
    dated = marks.where("at IS NOT NULL").select("at", "label", F.to_date("at").alias("_day"), F.lit(1).alias("_kind"))
    per = dated.groupBy("_day", "label").agg(F.count("*").alias("_n"))
    first, last = F.to_date("lo"), F.to_date("hi")
    met = spans.where("lo <= hi").select(*keys, "lo", "hi", F.explode(F.sequence(first, last)).alias("_day")).join(per, "_day")
    end = lambda kind, at, there: F.when(there, F.struct(F.lit(kind).alias("_kind"), F.col(at).alias("at")))
    # the first end comes before all marks of its moment, the last one after them
    parts = F.array_compact(F.array(end(0, "lo", F.col("_day") == first), end(2, "hi", F.col("_day") == last)))
    ends = met.select(*keys, "label", "_day", "_n", F.explode(parts).alias("_x")).select(*keys, "label", "_day", "_n", "_x.*")
    upto = F.sum((F.col("_kind") == 1).cast("long")).over(Window.partitionBy("label", "_day").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.unionByName(dated, allowMissingColumns=True).withColumn("_upto", upto).where("_kind <> 1")
    off = F.when(F.col("_kind") == 0, -F.col("_upto")).otherwise(F.col("_upto") - F.col("_n"))
    every = met.select(*keys, "label", F.col("_n").alias("n")).unionByName(ends.select(*keys, "label", off.alias("n")))
    return every.groupBy(*keys, "label").agg(F.sum("n").alias("n")).where("n > 0")


def geography(df: DataFrame, key: str, time: str, least: int = 3, most_places: int = 5, tie: str = "id") -> DataFrame:
    """key, country (of most rows, the first seen of equals), places (up to most_places `city, country`, as first seen) and
    legs (countries of at least least rows, as first seen, if there are two or more). df: country and city, of which a
    row that inherits them has only what its donor's distance allows."""
    at = F.struct(time, tie)
    per = df.where("country IS NOT NULL").groupBy(key, "country").agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    order = F.array_sort(F.collect_list(F.when(F.col("_n") >= least, F.struct("_first", "country"))))
    stops = F.transform(order, lambda x: x["country"])
    best = F.max_by("country", F.struct(F.col("_n"), -F.unix_micros(F.col(f"_first.{time}").cast("timestamp")), -F.col(f"_first.{tie}")))
    countries = per.groupBy(key).agg(best.alias("country"), stops.alias("legs"))
    place = F.concat_ws(", ", F.when(F.col("city") != "", F.col("city")), F.when(F.col("country") != "", F.col("country")))
    spots = df.withColumn("_place", place).where("_place <> ''").groupBy(key, "_place").agg(F.min(at).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_first"))
    spots = spots.withColumn("_r", rank).where(F.col("_r") <= most_places).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_place"))), lambda x: x["_place"]).alias("places"))
    both = spots.select(F.col(key).alias("_k"), "places").join(countries, F.col("_k").eqNullSafe(countries[key]), "left")
    return both.select(F.col("_k").alias(key), "country", "places", F.when(F.size("legs") >= 2, F.col("legs")).alias("legs"))

"""Sessions, as-of joins and distances."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framelake.functions import geo
from framelake.operators import asof, clocks, engine, sessions
from framelake.plans.registry import query
from framelake.session import shared_folder, staged, table
from framelake.sources import catalog
from framelake.sources.catalog import CATALOG_SQL
from framelake.streaming import inheritance, live


@query(CATALOG_SQL + """, g AS (SELECT *, CASE WHEN (epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER w) / 1e6 > 259200 THEN 1 ELSE 0 END AS cut
  FROM media WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY taken_at, id))
SELECT user_id, session, count(*) AS n, min(taken_at) AS started, max(taken_at) AS ended FROM (
  SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY taken_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) GROUP BY 1, 2""")
def sessions_gap(spark, sf):
    rows = sessions.by_gap(catalog.media(spark, sf), "user_id", "taken_at", 259_200.0)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("taken_at").alias("started"), F.max("taken_at").alias("ended"))


@query("""WITH g AS (SELECT o_orderdate, o_orderkey, CASE WHEN epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderdate, o_orderkey) > 86400000000 THEN 1 ELSE 0 END AS cut FROM orders)
SELECT session, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM (
  SELECT *, CAST(sum(cut) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) GROUP BY session""")
def sessions_global(spark, sf):
    days = sessions.global_days(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate", 1)
    return days.groupBy("session").agg(F.sum("n").alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query(CATALOG_SQL + """, c AS (SELECT round(gps_lat, 1) AS lat, round(gps_lon, 1) AS lon, count(*) AS n, min(id) AS first_id FROM media WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL GROUP BY 1, 2)
SELECT lat, lon, n, first_id, CAST(row_number() OVER (ORDER BY n DESC, first_id) AS BIGINT) AS rank, n / CAST(sum(n) OVER () AS DOUBLE) AS share,
  row_number() OVER (ORDER BY n DESC, first_id) = 1 AND sum(n) OVER () >= 20 AND n / CAST(sum(n) OVER () AS DOUBLE) >= 0.3 AS is_home FROM c""")
def home_cell(spark, sf):
    return sessions.home_cells(catalog.media(spark, sf))


@query(CATALOG_SQL + """, t AS (SELECT id, user_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN value > 50 END AS away FROM media JOIN (SELECT event_id AS eid, ts FROM events) ON id = eid),
k AS (SELECT *, lead(away) OVER w = away AS ok, first(away) OVER (PARTITION BY user_id ORDER BY ts, id) AS first FROM t WHERE away IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
c AS (SELECT *, last_value(CASE WHEN ok THEN away END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sure FROM k),
m AS (SELECT id, CASE WHEN coalesce(ok, false) AND away <> coalesce(sure, first) THEN 1 ELSE 0 END AS cut FROM c)
SELECT t.id, t.user_id, CAST(sum(coalesce(cut, 0)) OVER (PARTITION BY t.user_id ORDER BY t.ts, t.id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM t LEFT JOIN m USING (id)""")
def home_away_segments(spark, sf):
    rows = catalog.media(spark, sf).select("id", "user_id", F.when(F.col("event_type").isin("purchase", "signup"), F.col("value") > 50).alias("away"))
    at = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), "ts")
    return sessions.home_away(rows.join(at, "id"), "user_id", "ts", "away").select("id", "user_id", "segment")


@query(CATALOG_SQL + """, g AS (SELECT *, (epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER w) / 1e6 AS gap, lag(gps_lat) OVER w AS plat, lag(gps_lon) OVER w AS plon
  FROM media WHERE taken_at IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY taken_at, id)),
r AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY source_id ORDER BY taken_at, id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS usual,
  6371.0 * sqrt(pow(radians(gps_lon - plon) * cos(radians((plat + gps_lat) / 2)), 2) + pow(radians(gps_lat - plat), 2)) >= 3 AS moved FROM g),
c AS (SELECT *, CASE WHEN gap IS NULL THEN 0 WHEN coalesce(moved, false) THEN 1 WHEN gap >= 28800 THEN 1 WHEN gap < 600 THEN 0 WHEN gap > 3 * usual THEN 1 ELSE 0 END AS cut FROM r),
b AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY source_id ORDER BY taken_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM c)
SELECT source_id, event, count(*) AS n, min(id) AS first_id FROM b GROUP BY 1, 2""")
def event_split_rhythm(spark, sf):
    rows = sessions.by_rhythm(catalog.media(spark, sf), "source_id", "taken_at", 600.0, 28_800.0, factor=3.0)
    return rows.groupBy("source_id", "event").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(CATALOG_SQL + """, b AS (SELECT user_id, CAST(date_part('day', taken_at) AS BIGINT) AS block, count(*) AS n FROM media WHERE taken_at IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY block) = 1 OR n >= 3 THEN 1 ELSE 0 END AS s FROM b),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS g FROM s),
f AS (SELECT *, sum(CASE WHEN g = 1 THEN n END) OVER (PARTITION BY user_id) AS firsts, max(g) OVER (PARTITION BY user_id) AS gs FROM g)
SELECT user_id, block, n, CAST(CASE WHEN firsts < 3 AND gs > 1 THEN greatest(g - 2, 0) ELSE g - 1 END AS BIGINT) AS merged FROM f""")
def small_block_absorb(spark, sf):
    blocks = catalog.media(spark, sf).where("taken_at IS NOT NULL").groupBy("user_id", F.dayofmonth("taken_at").cast("long").alias("block")).agg(F.count("*").alias("n"))
    return sessions.absorb_small(blocks, "user_id", "block", "n", least=3)


@query(CATALOG_SQL + """, g AS (SELECT quick_hash, taken_at, make, model, (epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER (PARTITION BY quick_hash ORDER BY taken_at NULLS FIRST, id)) / 1e6 AS gap FROM media)
SELECT quick_hash, count(*) AS n, count(DISTINCT coalesce(make, '-') || '/' || coalesce(model, '-')) = 1 AND bool_and(make IS NOT NULL OR model IS NOT NULL) AND bool_and(taken_at IS NOT NULL) AND coalesce(max(gap) <= 1000, true) AS is_burst FROM g GROUP BY 1""")
def burst_groups(spark, sf):
    return sessions.bursts(catalog.media(spark, sf), "quick_hash", "taken_at", within_s=1000.0)


@query(CATALOG_SQL + """, p AS (SELECT user_id, CAST(date_part('day', taken_at) AS BIGINT) // 10 AS part, event_type, count(*) AS n, min(struct_pack(t := taken_at, i := id)) AS first
  FROM media WHERE taken_at IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT user_id, part, count(*) AS n_legs, string_agg(event_type, ' - ' ORDER BY first) AS legs FROM p GROUP BY 1, 2 HAVING count(*) >= 2""")
def session_legs(spark, sf):
    rows = catalog.media(spark, sf).where("taken_at IS NOT NULL").withColumn("part", F.floor(F.dayofmonth("taken_at") / 10))
    return sessions.legs(rows, ["user_id", "part"], "event_type", "taken_at")


@query(CATALOG_SQL + """, d AS (SELECT user_id, round(value, 6) AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM media)
SELECT user_id, n, v AS median FROM d WHERE i = n // 2""")
def upper_median_distance(spark, sf):
    return sessions.upper_median(catalog.media(spark, sf).withColumn("v", F.round("value", 6)), ["user_id"], "v")


@query(CATALOG_SQL + """, s AS (SELECT user_id, min(taken_at) AS lo, min(taken_at) + INTERVAL 2 DAY AS hi FROM media WHERE taken_at IS NOT NULL GROUP BY 1)
SELECT s.user_id, m.event_type AS label, count(*) AS n FROM s JOIN media m ON m.taken_at BETWEEN s.lo AND s.hi WHERE m.role = 'witness' GROUP BY 1, 2""")
def overlap_album_counts(spark, sf):
    m = catalog.media(spark, sf)
    spans = m.where("taken_at IS NOT NULL").groupBy("user_id").agg(F.min("taken_at").alias("lo")).withColumn("hi", F.col("lo") + F.expr("INTERVAL 2 DAYS"))
    return sessions.overlapping(spans, m.where("role = 'witness' AND taken_at IS NOT NULL").select(F.col("taken_at").alias("at"), F.col("event_type").alias("label")), ["user_id"])


_ASOF = """, i AS (SELECT id, coalesce(taken_at, mtime) AS at, source_id AS origin, gps_lat IS NOT NULL AS has_gps FROM media),
p AS (SELECT h.id, d.id AS donor_id, abs(epoch_us(h.at) - epoch_us(d.at)) / 1e6 AS delta_s, d.at AS dat, d.at < h.at AS back
  FROM i h JOIN i d ON NOT h.has_gps AND d.has_gps AND d.origin <> h.origin AND d.at BETWEEN h.at - INTERVAL 43200 SECOND AND h.at + INTERVAL 43200 SECOND),
r AS (SELECT id, donor_id, delta_s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta_s, CASE WHEN back THEN 0 ELSE 1 END,
  CASE WHEN back THEN -donor_id ELSE donor_id END) AS k FROM p) WHERE k = 1)"""


def _donors(spark, sf):
    items = catalog.media(spark, sf).select("id", F.coalesce("taken_at", "mtime").alias("at"), F.col("source_id").alias("origin"), F.col("gps_lat").isNotNull().alias("has_gps"))
    return asof.nearest_donor(items)


@query(CATALOG_SQL + _ASOF + " SELECT id, donor_id, round(delta_s, 6) AS delta_s FROM r")
def asof_nearest_other_origin(spark, sf):
    return _donors(spark, sf).select("id", "donor_id", F.round("delta_s", 6).alias("delta_s"))


@query(CATALOG_SQL + _ASOF + " SELECT id, donor_id, round(delta_s, 6) AS delta_s FROM r")
def live_inheritance(spark, sf):
    """The same as a stream of the events' files: stateful, revised by late donors, and started anew from its checkpoint."""
    items = catalog.media_of(live.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    items = items.select("id", F.coalesce("taken_at", "mtime").alias("at"), F.col("source_id").alias("origin"), F.col("gps_lat").isNotNull().alias("has_gps"))
    folder, key = f"{shared_folder(spark)}/framelake/live-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, inheritance.STATE_STORE)
    try:
        told = inheritance.inherited(items, "3650 days").writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        told.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/told/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return inheritance.latest(spark.read.parquet(f"{folder}/told")).select("id", "donor_id", F.round("delta_s", 6).alias("delta_s"))


@query(CATALOG_SQL + _ASOF + """ SELECT CAST(CASE WHEN delta_s <= 120 THEN 0 WHEN delta_s <= 600 THEN 1 WHEN delta_s <= 7200 THEN 2 WHEN delta_s <= 43200 THEN 3 ELSE 4 END AS BIGINT) AS band,
  count(*) AS n, round(avg(delta_s), 6) AS mean_delta_s FROM r GROUP BY 1""")
def asof_bands(spark, sf):
    return asof.coverage_bands(_donors(spark, sf))


@query(CATALOG_SQL + _ASOF + """ SELECT id, round(least(50000.0, greatest(15.0, 6.0 * delta_s)), 6) AS radius_m, CASE WHEN delta_s <= 600 THEN 'country,region,city' WHEN delta_s <= 7200 THEN 'country,region' ELSE 'country' END AS fields FROM r""")
def reliable_fields(spark, sf):
    rows = _donors(spark, sf)
    found = geo.reliable_fields(F.col("delta_s"), F.lit(False))
    return rows.select("id", F.round(geo.uncertainty_m(F.col("delta_s")), 6).alias("radius_m"), F.array_join(F.transform(found, lambda x: x["field"]), ",").alias("fields"))


_ANCHORS = """, pairs AS (SELECT CASE WHEN a.gps_lat IS NOT NULL THEN b.make ELSE a.make END AS make, CASE WHEN a.gps_lat IS NOT NULL THEN b.model ELSE a.model END AS model,
  CASE WHEN a.gps_lat IS NOT NULL THEN epoch_us(a.taken_at) - epoch_us(b.taken_at) ELSE epoch_us(b.taken_at) - epoch_us(a.taken_at) END / 1e6 AS d
  FROM media a JOIN media b ON a.quick_hash = b.quick_hash AND a.id < b.id AND a.source_id <> b.source_id AND (a.gps_lat IS NULL) <> (b.gps_lat IS NULL)
  WHERE a.taken_at IS NOT NULL AND b.taken_at IS NOT NULL), known AS (SELECT * FROM pairs WHERE make IS NOT NULL OR model IS NOT NULL),
mid AS (SELECT make, model, count(*) AS n, quantile_cont(d, 0.5) AS o FROM known GROUP BY 1, 2)"""


@query(CATALOG_SQL + _ANCHORS + """ SELECT m.make, m.model, m.n, round(m.o, 6) AS offset_s, round(quantile_cont(abs(k.d - m.o), 0.5), 6) AS mad_s, m.n >= 2 AND quantile_cont(abs(k.d - m.o), 0.5) <= 180 AS kept
  FROM known k JOIN mid m ON k.make IS NOT DISTINCT FROM m.make AND k.model IS NOT DISTINCT FROM m.model GROUP BY 1, 2, 3, 4, m.o""")
def clock_offsets_mad(spark, sf):
    out = clocks.offsets(catalog.media(spark, sf))
    return out.withColumns({"offset_s": F.round("offset_s", 6), "mad_s": F.round("mad_s", 6)})


@query(CATALOG_SQL + _ANCHORS.replace("a.quick_hash = b.quick_hash", "(a.quick_hash = b.quick_hash OR a.id % 3001 = b.id % 3001)") + """ SELECT m.make, m.model, m.n, round(m.o, 6) AS offset_s, round(quantile_cont(abs(k.d - m.o), 0.5), 6) AS mad_s, m.n >= 2 AND quantile_cont(abs(k.d - m.o), 0.5) <= 180 AS kept
  FROM known k JOIN mid m ON k.make IS NOT DISTINCT FROM m.make AND k.model IS NOT DISTINCT FROM m.model GROUP BY 1, 2, 3, 4, m.o""")
def clock_offsets_either_key(spark, sf):
    media = catalog.media(spark, sf).withColumn("perceptual_hash", F.concat(F.lit("p"), F.col("id") % 3001))
    out = clocks.offsets(media, "quick_hash", "perceptual_hash")
    return out.withColumns({"offset_s": F.round("offset_s", 6), "mad_s": F.round("mad_s", 6)})


@query(CATALOG_SQL + """SELECT id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(gps_lat - -22.9) / 2), 2) + cos(radians(-22.9)) * cos(radians(gps_lat)) * pow(sin(radians(gps_lon - -43.2) / 2), 2)))), 6) AS km
  FROM media WHERE gps_lat IS NOT NULL""")
def haversine(spark, sf):
    m = catalog.media(spark, sf).where("gps_lat IS NOT NULL")
    return m.select("id", F.round(geo.haversine_km(F.lit(-22.9), F.lit(-43.2), F.col("gps_lat"), F.col("gps_lon")), 6).alias("km"))


@query(CATALOG_SQL + """, b AS (SELECT source_id, min(gps_lat) AS s, max(gps_lat) AS n, min(gps_lon) AS w, max(gps_lon) AS e FROM media WHERE gps_lat IS NOT NULL GROUP BY 1),
p AS (SELECT *, radians((s + n) / 2) AS p FROM b)
SELECT source_id, round(s - 1000 / (111132.92 - 559.82 * cos(2 * p) + 1.175 * cos(4 * p) - 0.0023 * cos(6 * p)), 6) AS south, round(n + 1000 / (111132.92 - 559.82 * cos(2 * p) + 1.175 * cos(4 * p) - 0.0023 * cos(6 * p)), 6) AS north,
  round(w - 1000 / (111412.84 * cos(p) - 93.5 * cos(3 * p) + 0.118 * cos(5 * p)), 6) AS west, round(e + 1000 / (111412.84 * cos(p) - 93.5 * cos(3 * p) + 0.118 * cos(5 * p)), 6) AS east FROM p""")
def bbox_map(spark, sf):
    box = catalog.media(spark, sf).where("gps_lat IS NOT NULL").groupBy("source_id").agg(F.min("gps_lat").alias("s"), F.max("gps_lat").alias("n"), F.min("gps_lon").alias("w"), F.max("gps_lon").alias("e"))
    north, east = geo.metres_per_degree((F.col("s") + F.col("n")) / 2)
    return box.select("source_id", F.round(F.col("s") - 1000 / north, 6).alias("south"), F.round(F.col("n") + 1000 / north, 6).alias("north"), F.round(F.col("w") - 1000 / east, 6).alias("west"), F.round(F.col("e") + 1000 / east, 6).alias("east"))


def _timeline(spark, sf):
    """Files in forty sessions: away, first at home and then away, at home, of no known place; some days, some hours with a
    pause; some without a date of capture; one in the folder of an occasion."""
    e, n, g = table(spark, sf, "events"), F.col("event_id"), F.col("user_id") % 40
    short = g % 8 >= 2
    short = short & (g % 8 <= 3)
    step = F.when(short, (n % 40) * 600 + F.when(n % 40 >= 20, 7800).otherwise(0)).otherwise((n % 97) * 1800)
    at = F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")) + F.make_dt_interval(days=(g * 10).cast("int"), secs=step)
    away = (g % 4 == 0) | ((g % 4 == 1) & (n % 97 >= 48))
    placed = (g % 4 != 3) & (n % 3 == 0)
    return e.select(
        n.alias("id"), F.when(g % 10 != 7, at).alias("taken_at"), F.when(g % 10 == 7, at).alias("mtime"), F.when(g == 2, "/a/Aniversario da Ana").otherwise("/a/misc").alias("folder"),
        F.when(placed, F.when(away, F.lit(-10.0) - g / 100).otherwise(-23.0)).alias("lat"), F.when(placed, F.when(away, -70.0).otherwise(-43.0)).alias("lon"), F.when(placed & away, "Chile").alias("country"),
    )


_HAPPENINGS = """
WITH t AS (SELECT event_id AS id, user_id % 40 AS g, event_id % 97 AS k, TIMESTAMP '2020-01-01' + to_days(CAST(10 * (user_id % 40) AS INTEGER)) + to_seconds(CASE WHEN user_id % 40 % 8 IN (2, 3) THEN (event_id % 40) * 600 + CASE WHEN event_id % 40 >= 20 THEN 7800 ELSE 0 END ELSE (event_id % 97) * 1800 END) AS tm,
  user_id % 40 % 4 <> 3 AND event_id % 3 = 0 AS known, user_id % 40 % 4 = 0 OR (user_id % 40 % 4 = 1 AND event_id % 97 >= 48) AS away FROM events),
f AS (SELECT *, first_value(CASE WHEN known AND away THEN struct_pack(a := tm, i := id) END IGNORE NULLS) OVER (PARTITION BY g ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS edge, count(*) FILTER (known AND away) OVER (PARTITION BY g) AS far, count(*) FILTER (known AND NOT away) OVER (PARTITION BY g) AS near FROM t),
s AS (SELECT *, CASE WHEN far >= 2 AND near >= 1 AND struct_pack(a := tm, i := id) >= edge THEN 1 ELSE 0 END AS segment FROM f),
p AS (SELECT *, min(id) OVER w AS part, count(*) OVER w AS n, (epoch_us(max(tm) OVER w) - epoch_us(min(tm) OVER w)) / 3.6e9 AS hours, count(*) FILTER (known AND away) OVER w AS out_, count(*) FILTER (known) OVER w AS placed FROM s WINDOW w AS (PARTITION BY g, segment)),
q AS (SELECT *, out_ > 0 AND out_ > placed - out_ AND g % 10 <> 7 AS trip FROM p WHERE n >= 2),
o AS (SELECT *, (epoch_us(tm) - lag(epoch_us(tm)) OVER w) / 1e6 AS gap FROM q WHERE NOT trip AND hours <= 20 WINDOW w AS (PARTITION BY part ORDER BY tm, id)),
u AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY part ORDER BY tm, id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS usual FROM o),
c AS (SELECT *, sum(CASE WHEN gap IS NULL THEN 0 WHEN gap >= 28800 THEN 1 WHEN gap < 5400 THEN 0 WHEN gap > 6 * usual THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY tm, id ROWS UNBOUNDED PRECEDING) AS event FROM u),
b AS (SELECT part, event, count(*) AS n FROM c GROUP BY 1, 2),
d AS (SELECT *, sum(CASE WHEN r = 1 OR n >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY event ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event) AS r FROM b)),
m AS (SELECT *, CASE WHEN sum(n) FILTER (grp = 1) OVER (PARTITION BY part) < 10 AND max(grp) OVER (PARTITION BY part) > 1 THEN greatest(grp - 2, 0) ELSE grp - 1 END AS merged FROM d),
k AS (SELECT c.id, c.part, m.merged, count(DISTINCT merged) OVER (PARTITION BY c.part) AS several FROM c JOIN m USING (part, event)),
v AS (SELECT id, min(id) OVER (PARTITION BY part, merged) AS group_id FROM k WHERE several > 1),
w AS (SELECT q.id, coalesce(v.group_id, q.part) AS group_id, q.g, q.tm, q.trip FROM q LEFT JOIN v ON v.id = q.id)
"""


@query(_HAPPENINGS + """SELECT group_id, CASE WHEN any_value(trip) THEN 'trip' WHEN any_value(g) = 2 THEN 'occasion' ELSE 'neutral' END AS kind, CASE WHEN any_value(trip) THEN 'Chile' WHEN any_value(g) = 2 THEN 'Aniversario da Ana' END AS label,
  CASE WHEN any_value(trip) THEN 'distance' WHEN any_value(g) = 2 THEN 'word' ELSE 'none' END AS rule, min(tm) AS started, max(tm) AS ended, count(*) AS n FROM w GROUP BY 1""")
def session_driver(spark, sf):
    """DOM-9: gaps, home and away, the cascade, the rhythm, and the second judgement, one after the other."""
    media = staged(_timeline(spark, sf), "timeline")
    groups, _ = engine.happenings(media, _home(media), _no_countries(spark))
    return groups.select("group_id", "kind", "label", "rule", "started", "ended", "n")


@query(_HAPPENINGS + "SELECT id, group_id FROM w")
def session_driver_incremental(spark, sf):
    """DOM-9, DOM-10: the groups of every file after a third of them came later; only sessions they touch are built again."""
    media = staged(_timeline(spark, sf), "timeline")
    home, names = _home(media), _no_countries(spark)
    earlier = media.where("id % 3 <> 1 OR date_trunc('month', coalesce(taken_at, mtime)) <> TIMESTAMP_NTZ '2020-05-01'")
    groups, members = (staged(x, "earlier") for x in engine.happenings(earlier, home, names))
    return engine.with_new_files(media, groups, members, home, names)[1].select("id", "group_id")


def _home(media):
    found = sessions.home_cells(media.withColumnsRenamed({"lat": "gps_lat", "lon": "gps_lon"})).where("is_home").select("lat", "lon").first()  # one row
    return (found.lat, found.lon) if found else None


def _no_countries(spark):
    return spark.createDataFrame([("peru", "Peru")], "alias string, country string")

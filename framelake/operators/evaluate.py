"""What the catalog's own measurements ask: reach, integrity, dominance, labels, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.sessions import overlapping
from framelake.session import staged

#: Strips of numbers in distinct_between(): its table has their square of counters at most.
STRIPS = 512


def reach_by_source(media: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, kind, files, on disk, ready and lost to reach, of each source."""
    present = ~F.col("missing") & ~F.col("offline")
    per = media.groupBy("source_id").agg(F.count("*").alias("files"), F.count_if(present).alias("present"), F.count_if(present & (F.col("role") == "holding")).alias("holdings"))
    out = per.join(sources.select("source_id", "kind", "available"), "source_id")
    return out.select("source_id", "kind", "files", F.when(F.col("available"), F.col("holdings")).otherwise(0).alias("ready"), F.when(F.col("available"), 0).otherwise(F.col("holdings")).alias("out_of_reach"))


def offset_impact(media: DataFrame, offset: Column, top: int = 8) -> DataFrame:
    """offset, n, sources: the most frequent offsets of dated files."""
    dated = media.where("taken_at IS NOT NULL").withColumn("offset", offset).where("offset IS NOT NULL")
    return dated.groupBy("offset").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources")).orderBy(F.desc("n"), "offset").limit(top)


def integrity(stored: DataFrame, found: DataFrame, rows: int, seed: int = 1) -> DataFrame:
    """verdict, n of a sample of rows stored files (id, digest), by seeded hash: verified, diverged, unreadable (null
    digest in found) or missing."""
    sample = stored.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), "id").limit(rows)
    seen = sample.join(found.select("id", F.col("digest").alias("now"), F.lit(True).alias("there")), "id", "left")
    verdict = F.when(F.col("there").isNull(), "missing").when(F.col("now").isNull(), "unreadable").when(F.col("now") == F.col("digest"), "verified").otherwise("diverged")
    return seen.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def dominance(media: DataFrame, session: list[str], kinds: dict[str, Column], least: float = 0.8) -> DataFrame:
    """kind, sessions, photos: the sessions of which a kind makes up least or more, and their files."""
    shares = media.groupBy(*session).agg(F.count("*").alias("n"), *(F.avg(c.cast("int")).alias(k) for k, c in kinds.items()))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("share")) for k in kinds))
    return shares.select("n", F.explode(each).alias("x")).where(F.col("x.share") >= least).groupBy("x.kind").agg(F.count("*").alias("sessions"), F.sum("n").alias("photos"))


def nameable(media: DataFrame, albums: DataFrame, technical: str) -> DataFrame:
    """label: every part of a ready file's folder that says something, and every album."""
    parts = media.select("folder").distinct().select(F.explode(F.split("folder", "/")).alias("label")).where(F.trim("label") != "")
    own = parts.where(~F.lower("label").rlike(technical))
    return own.unionByName(albums.select("label").where("label IS NOT NULL")).distinct()


def clusters(spans: DataFrame, media: DataFrame, places: DataFrame, key: str, names: int = 8) -> DataFrame:
    """Of each span (key, lo, hi; a key has one span): files in it, their first names, their folders and cities.

    Files of the spans' days are numbered by time, so a span is a stretch of numbers: its length is n, its first numbers
    give the names. Cities are counted as sessions.overlapping() does it, folders by distinct_between(); no file meets a span.
    """
    own = staged(spans.where(F.col(key).isNotNull() & (F.col("lo") <= F.col("hi"))).select(F.col(key).alias("_span"), "lo", "hi"), "spans")
    days = own.select(F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("_day")).distinct()
    dated = media.where("taken_at IS NOT NULL").withColumn("_day", F.to_date("taken_at")).join(days, "_day", "left_semi")
    ends = own.select("_span", F.explode(F.array(F.struct(F.lit(0).alias("_kind"), F.col("lo").alias("at")), F.struct(F.lit(2).alias("_kind"), F.col("hi").alias("at")))).alias("_x")).select("_span", "_x.*")
    rows = dated.select("_day", F.lit(1).alias("_kind"), F.col("taken_at").alias("at"), "id", "folder", "name").unionByName(ends.withColumn("_day", F.to_date("at")), allowMissingColumns=True)
    file = (F.col("_kind") == 1).cast("long")
    upto = F.sum(file).over(Window.partitionBy("_day").orderBy("at", "_kind", "id").rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # days are few
    per = rows.groupBy("_day").agg(F.sum(file).alias("_n")).select("_day", earlier.alias("_earlier"))
    ranked = staged(rows.withColumn("_upto", upto).join(per, "_day").select("_kind", "_span", (F.col("_earlier") + F.col("_upto")).alias("nth"), "folder", "name"), "ranked")
    bounds = ranked.where("_kind <> 1").groupBy("_span").agg(F.max(F.when(F.col("_kind") == 0, F.col("nth"))).alias("a"), F.max(F.when(F.col("_kind") == 2, F.col("nth"))).alias("b"))
    bounds, files = staged(bounds.where("b > a"), "bounds"), ranked.where("_kind = 1")
    wanted = bounds.select("_span", F.explode(F.sequence(F.col("a") + 1, F.least("b", F.col("a") + names))).alias("nth"))
    early = wanted.join(files.select("nth", "name"), "nth").groupBy("_span").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]), ",").alias("names"))
    placed = dated.join(places, "location_id").where("city IS NOT NULL").select(F.col("taken_at").alias("at"), F.col("city").alias("label"))
    cities = overlapping(own, placed, ["_span"]).groupBy("_span").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("cities"))
    folders = distinct_between(files.select("nth", F.col("folder").alias("value")), bounds, "_span").withColumnRenamed("n", "folders")
    out = bounds.join(folders, "_span", "left").join(cities, "_span", "left").join(early, "_span")
    return out.select(F.col("_span").alias(key), (F.col("b") - F.col("a")).alias("n"), F.coalesce("folders", F.lit(0)).alias("folders"), F.coalesce("cities", F.lit("")).alias("cities"), "names")


def distinct_between(rows: DataFrame, stretches: DataFrame, key: str, strips: int = STRIPS) -> DataFrame:
    """key, n: the different values (none of them null) of rows (nth from 1, value) in each stretch (key; a < nth <= b).

    A value is counted at its first row in a stretch: where the row before it of that value lies at a or earlier. So n is
    the number of rows up to b whose predecessors lie up to a, without all rows up to a. Numbers are cut into strips: rows
    are counted by the strips of both numbers, which is a table of fixed size, and only a stretch's own strips are searched.
    """
    before = F.coalesce(F.lag("nth").over(Window.partitionBy("value").orderBy("nth")), F.lit(0))
    points = staged(rows.where("value IS NOT NULL").select("nth", before.alias("prev")), "points")
    width = ((points.agg(F.max("nth")).first()[0] or 0) // strips) + 1
    strip = lambda c: F.floor(F.col(c) / width)
    table = np.zeros((strips + 1, strips + 1), np.int64)
    for r in points.groupBy(strip("prev").alias("p"), strip("nth").alias("c")).count().collect():
        table[r.p + 1, r.c + 1] = r["count"]
    table = table.cumsum(0).cumsum(1)

    kind = f"{key} {stretches.schema[key].dataType.simpleString()}, n long"

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            at = (np.minimum(x[c].to_numpy() // width, strips) for c in ("x", "y"))
            yield pd.DataFrame({key: x[key], "n": x["sign"].to_numpy() * table[*at]})

    def searched(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        nth, prev = points["nth"].to_numpy(), points["prev"].to_numpy()
        n = [np.count_nonzero((prev <= x) & (nth <= y)) for x, y in zip(asked["x"], asked["y"], strict=True)]
        return pd.DataFrame({key: asked[key], "n": asked["sign"] * np.array(n, np.int64)})

    row = lambda **c: F.struct(*((F.lit(v) if isinstance(v, int) else v).cast("long").alias(k) for k, v in c.items()))
    a, b = F.col("a"), F.col("b")
    asked = stretches.select(key, F.explode(F.array(row(x=a, y=b, sign=1), row(x=a, y=a, sign=-1))).alias("_x")).select(key, "_x.*")
    # rows whose predecessor lies in the strip of x, and rows in the strip of y whose predecessor lies in a strip before x's
    parts = F.array(row(side=0, strip=strip("x"), x=F.col("x"), y=F.col("y")), row(side=1, strip=strip("y"), x=strip("x") * width - 1, y=F.col("y")))
    parts = asked.select(key, "sign", F.explode(parts).alias("_x")).select(key, "sign", "_x.*")
    dealt = points.select("nth", "prev", F.explode(F.array(row(side=0, strip=strip("prev")), row(side=1, strip=strip("nth")))).alias("_x")).select("nth", "prev", "_x.*")
    dealt = dealt.join(parts.select("side", "strip").distinct(), ["side", "strip"], "left_semi")
    found = dealt.groupBy("side", "strip").cogroup(parts.groupBy("side", "strip")).applyInPandas(searched, kind)
    return asked.mapInPandas(whole, kind).unionByName(found).groupBy(key).agg(F.sum("n").alias("n"))

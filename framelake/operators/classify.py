"""What a session is: an ordered cascade over its folders, places, distance and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import naming

#: Kilometres from home and days that make a trip, days that an occasion may last.
TRIP_KM, TRIP_DAYS, OCCASION_DAYS = 100.0, 3, 2


def classified(
    sessions: DataFrame,
    aliases: DataFrame,
    key: str,
    folders: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    albums: DataFrame | None = None,
    cameras: DataFrame | None = None,
) -> DataFrame:
    """sessions (key, days, country, home_km, period, legs) with kind, label and rule: the first that holds, of a trips
    folder, an occasion's word, a list of countries, a country in a folder, distance from home, a stay of days where home
    is unknown, and a short session with an album-like name, which is a trip where the lexicon calls it a place.

    folders (key, folder) are the sessions' own; without them sessions have a column folder. A trip that no folder names is
    named by its legs if it has two or more, else by its country or period. albums (key, album, photos) rename such derived
    labels only, and never a neutral session; aliases are (alias, country), the lexicon is (name, kind)."""
    facts = naming.session_facts(folders if folders is not None else sessions.select(key, "folder"), key, aliases, lexicon)
    facts = facts.select(key, *(F.col(c).alias(f"_{c}") for c in facts.columns if c != key))
    rows = sessions.join(facts, key, "left")

    def said(kind: str, label: Column, rule: str, derived: bool = False) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"), F.lit(rule).alias("rule"), F.lit(derived).alias("derived"))

    legs = F.when(F.size("legs") >= 2, F.array_join("legs", " – ")) if "legs" in sessions.columns else F.lit(None)
    derived = F.coalesce(legs, "country", "period")
    name, kind = F.col("_album.name"), F.col("_album.kind")
    known = F.when(kind.isNull(), F.col("_known"))
    cascade = (
        F.when(F.col("_trips"), said("trip", derived, "folder", True))
        .when(F.col("_keyword").isNotNull(), said("occasion", F.col("_keyword.name"), "word"))
        .when(F.col("_listed").isNotNull(), said("trip", F.col("_listed.name"), "countries"))
        .when(F.col("_named").isNotNull(), said("trip", F.col("_named.name"), "country"))
        .when(F.col("home_km") > TRIP_KM, said("trip", derived, "distance", True))
        .when(F.col("country").isNotNull() & (F.col("days") >= TRIP_DAYS) & F.col("home_km").isNull(), said("trip", derived, "stay", True))
        .when(name.isNotNull() & (F.col("days") <= OCCASION_DAYS),
            F.when(kind == "place", said("trip", name, "lexicon"))
            .when(known["kind"] == "place", said("trip", known["name"], "lexicon"))
            .when(known["kind"] == "occasion", said("occasion", known["name"], "lexicon"))
            .otherwise(said("occasion", name, "name")))
        .otherwise(said("neutral", F.lit(None), "none"))
    )
    rows = rows.withColumn("_x", cascade)
    label = F.col("_x.label")
    if albums is not None:
        chosen = naming.chosen_albums(albums, [key], cameras).select(key, F.col("name").alias("_chosen"))
        rows = rows.join(chosen, key, "left")
        label = F.when(F.col("_x.derived") & F.col("_chosen").isNotNull(), F.col("_chosen")).otherwise(label)
    return rows.select(*sessions.columns, F.col("_x.kind").alias("kind"), label.alias("label"), F.col("_x.rule").alias("rule"))

"""All evidence about a file, in the order in which it is heard, and the destination that follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import templates
from framelake.functions.confidence import SCORES, level_of, score_of, weakest
from framelake.functions.dates import date_in_name, month_label
from framelake.functions.folders import hierarchy, path_dates
from framelake.functions.image_type import LABELS, image_type
from framelake.functions.names import folded

#: The fields of evidence in the order in which they are heard, those that name a destination, and places.
FIELDS = ("tipo", "data", "ano", "pais", "regiao", "cidade", "viagem", "evento", "categoria")
NAMING = ("categoria", "viagem", "evento", "pais", "regiao", "cidade")
PLACE = ("pais", "regiao", "cidade")
#: Folder names and keywords, folded, and the category that they mean.
CATEGORIES = {"viagens": "Viagens", "viagem": "Viagens", "familia": "Família", "eventos": "Eventos", "evento": "Eventos"}
#: Where files go that are no photos, that nothing names, and that have no date either.
NO_PHOTO, UNNAMED, UNDATED = "Não são fotos", "Não classificadas", "sem data"
_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _category(plain: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.try_element_at(table, plain)


def _said(rows: DataFrame, field: str, origin: Column, value: Column, score: Column | None = None) -> DataFrame:
    nth = F.lit(FIELDS.index(field))
    out = rows.select("id", nth.alias("nth"), F.lit(field).alias("field"), origin.alias("origin"), value.alias("value"), (score_of(origin) if score is None else score).alias("score"))
    return out.where("value IS NOT NULL AND value <> ''")


def folder_facts(media: DataFrame, countries: DataFrame) -> DataFrame:
    """folder, plain, date, category, pais, regiao, cidade: what each folder's path says; every folder is read once."""
    own = media.select("folder").where("folder IS NOT NULL").distinct()
    dated = path_dates(own, "folder").select("folder", "date")
    placed = hierarchy(own.withColumn("id", F.col("folder")), "folder", countries).select(F.col("id").alias("folder"), F.col("country").alias("pais"), F.col("region").alias("regiao"), F.col("city").alias("cidade"))
    parts = own.select("folder", F.posexplode(F.split("folder", "/")).alias("at", "part"))
    names = parts.select("part").distinct().select("part", _category(folded(F.col("part"))).alias("category"))
    kinds = parts.join(names, "part").groupBy("folder").agg(F.max_by("category", F.when(F.col("category").isNotNull(), F.col("at"))).alias("category"))
    plain = own.select("folder", folded(F.col("folder")).alias("plain"))
    return plain.join(dated, "folder").join(placed, "folder").join(kinds, "folder")


def assembled(media: DataFrame, places: DataFrame, facts: DataFrame, heirs: DataFrame, sessions: DataFrame, keywords: DataFrame) -> DataFrame:
    """id, nth, field, origin, value, score of every evidence.

    media: id, folder, name, ext, taken_at, mtime, make, model, gps_lat, location_id, kind_confirmed, session_id. places:
    location_id, country, region, city. facts: folder_facts(). heirs: id, location_id, factors (of each field that the
    donor's distance in time allows: name -> factor). sessions: session_id, kind (viagem, evento or other), label,
    label_origin, origin, country (that of most of its files), category (an advisor's). keywords: media_id, value.

    A place is heard of one witness only: the file's own GPS, else a donor, else the folder, else its session. A
    category is the deepest folder's that is one, else what the session is, else a keyword's, else the advisor's.
    """
    rows = media.join(facts, "folder", "left")
    kind = image_type(F.col("name"), F.col("ext"), F.col("make").isNotNull() | F.col("model").isNotNull(), F.col("gps_lat").isNotNull(), folder=F.coalesce("plain", F.lit("")))
    typed = rows.withColumn("_kind", kind)
    named = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    told = F.col("kind_confirmed").isNotNull()
    label = F.when(told & (F.col("kind_confirmed") != "photo"), F.col("kind_confirmed")).when(~told & (F.col("_kind.kind") != "photo"), F.col("_kind.kind"))
    out = [_said(typed, "tipo", F.when(told, "usuario").otherwise("arquivo"), F.try_element_at(named, label), F.when(told, 1.0).otherwise(F.col("_kind.score")))]

    stamped = date_in_name(F.col("name"))
    origin = F.when(F.col("taken_at").isNotNull(), "exif").when(stamped.isNotNull(), "nome_arquivo").otherwise("fs")
    when = F.coalesce(F.date_format("taken_at", _ISO), F.date_format(stamped.cast("timestamp_ntz"), _ISO), F.date_format("mtime", _ISO))
    out.append(_said(rows, "data", origin, when))
    out.append(_said(rows, "ano", F.lit("pasta"), F.col("date.year").cast("string")))

    lent = heirs.select("id", F.col("location_id").alias("_lent"), "factors")
    near = places.select(F.col("location_id").alias("_lent"), *(F.col(c).alias(f"_{c}") for c in ("country", "region", "city")))
    of_session = sessions.select("session_id", F.col("country").alias("_most"), *(F.col(c).alias(f"_{c}_of") for c in ("kind", "label", "label_origin", "origin", "category")))
    geo = rows.join(places, "location_id", "left").join(lent, "id", "left").join(near, "_lent", "left").join(of_session, "session_id", "left")
    told = lambda origin, values, scores: F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(origin).alias("origin"), v.alias("value"), s.cast("double").alias("score")) for f, v, s in zip(PLACE, values, scores, strict=True))), lambda x: x["value"].isNotNull() & (x["value"] != "") & x["score"].isNotNull())
    fixed = lambda origin: [F.lit(SCORES[origin])] * 3
    factor = [F.round(SCORES["vizinhanca_temporal"] * F.try_element_at("factors", F.lit(f)), 3) for f in PLACE]
    none = F.lit(None).cast("string")
    own = F.when(F.col("gps_lat").isNotNull(), told("geocoding_offline", [F.col(c) for c in ("country", "region", "city")], fixed("geocoding_offline")))
    donor = told("vizinhanca_temporal", [F.col(c) for c in ("_country", "_region", "_city")], factor)
    folder = F.when(F.col("pais").isNotNull(), told("pasta", [F.col(c) for c in PLACE], fixed("pasta")))
    session = told("vizinhanca", [F.col("_most"), none, none], fixed("vizinhanca"))
    heard = F.coalesce(*(F.when(F.size(x) > 0, x) for x in (own, donor, folder, session)))
    spots = geo.select("id", F.explode(heard).alias("x")).select("id", "x.*")
    order = F.create_map(*(F.lit(x) for f in PLACE for x in (f, FIELDS.index(f))))
    out.append(spots.select("id", F.element_at(order, F.col("field")).alias("nth"), "field", "origin", "value", "score"))

    for kind_ in ("viagem", "evento"):
        out.append(_said(geo.where(F.col("_kind_of") == kind_), kind_, F.col("_label_origin_of"), F.col("_label_of")))

    spoken = keywords.select("value").distinct().select("value", _category(folded(F.col("value"))).alias("_word")).where("_word IS NOT NULL")
    words = keywords.join(spoken, "value").groupBy(F.col("media_id").alias("id")).agg(F.min_by("_word", "value").alias("_word"))
    sort = F.when(F.col("_kind_of") == "viagem", "Viagens").when(F.col("_kind_of") == "evento", "Eventos")
    steps = [(F.col("category"), F.lit("pasta")), (sort, F.col("_origin_of")), (F.col("_word"), F.lit("curadoria")), (F.col("_category_of"), F.lit("llm"))]
    both = geo.join(words, "id", "left")
    first = F.coalesce(*(F.when(v.isNotNull(), F.struct(v.alias("value"), o.alias("origin"))) for v, o in steps))
    out.append(_said(both.withColumn("_first", first), "categoria", F.col("_first.origin"), F.col("_first.value")))
    return reduce(DataFrame.unionByName, out)


def destined(found: DataFrame, media: DataFrame, facts: DataFrame, template: str = templates.DEFAULT) -> DataFrame:
    """id, destination, score, level, used, context of every file in media: used are the fields that made the destination,
    whose weakest score counts; context are places that were heard of but made no folder.

    Of several evidences of a field the last counts, by nth and then by score, origin and value. What is no photo goes
    by kind and year; what nothing names by year and month; all else by the template, where a trip or an event takes the
    place's folders away and the year is that of the date, if there is one.
    """
    last = F.struct("nth", "score", "origin", "value")
    one = lambda f: F.max_by(F.when(F.col("field") == f, F.struct("value", "score")), F.when(F.col("field") == f, last)).alias(f"_{f}")
    per = found.groupBy("id").agg(*map(one, FIELDS))
    base = media.select("id", "folder", "name", "ext", "make", "model", "gps_lat", "kind_confirmed").join(facts.select("folder", "plain", "date"), "folder", "left")
    kind = image_type(F.col("name"), F.col("ext"), F.col("make").isNotNull() | F.col("model").isNotNull(), F.col("gps_lat").isNotNull(), folder=F.coalesce("plain", F.lit("")))["kind"]
    rows = base.withColumn("_sort", F.coalesce("kind_confirmed", kind)).join(per, "id", "left")
    value = lambda f: F.col(f"_{f}.value")
    at = F.try_to_timestamp(value("data"), F.lit(_ISO))
    year = F.coalesce(F.year(at).cast("string"), value("ano"))
    grouped = value("viagem").isNotNull() | value("evento").isNotNull()
    fields = {f: F.when(~grouped, value(f)) if f in PLACE else value(f) for f in NAMING} | {"ano": year}
    rows = rows.withColumns({f"{f}_": v for f, v in fields.items()})
    marked = reduce(lambda t, f: t.replace("{" + f + "}", "{" + f + "_}"), fields, template)
    rows = templates.rendered(rows, marked, "_path")
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    apart = F.concat_ws("/", F.lit(NO_PHOTO), F.element_at(labels, F.col("_sort")), F.year(at).cast("string"))
    of_path = F.to_date(F.concat_ws("-", F.col("date.year").cast("string"), F.coalesce("date.month", F.lit(1)).cast("string"), F.lit("1")), "yyyy-M-d")
    month = F.when(at.isNotNull(), F.concat_ws("/", F.year(at).cast("string"), month_label(at)))
    month = month.when(F.col("date").isNull(), UNDATED).when(F.col("date.month").isNull(), F.col("date.year").cast("string")).otherwise(F.concat_ws("/", F.col("date.year").cast("string"), month_label(of_path)))
    unnamed = F.concat_ws("/", F.lit(UNNAMED), month)
    other, nameless = F.col("_sort") != "photo", ~reduce(Column.__or__, [value(f).isNotNull() for f in NAMING])
    destination = F.when(other, apart).when(nameless, unnamed).otherwise(F.coalesce("_path", F.lit(UNNAMED)))
    dated = F.col("_data").isNotNull()
    in_template = [f for f in FIELDS if "{" + f + "}" in template and f != "ano"]
    entry = lambda f, say=None: F.when(F.lit(True) if say is None else say, F.when(F.col(f"_{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"_{f}.score").alias("score"))))
    by_year = [entry("data", dated), entry("ano", ~dated)] if "{ano}" in template else []
    some = lambda *each: F.filter(F.array(*each), lambda x: x.isNotNull())
    made = some(*by_year, *(entry(f, ~grouped if f in PLACE else None) for f in in_template))
    used = F.when(other, some(entry("tipo"), entry("data"))).when(nameless, some(entry("data"))).otherwise(made)
    score = weakest(F.transform(used, lambda x: x["score"]))
    names = F.transform(used, lambda x: x["field"])
    lost = F.filter(F.array(*(F.when(value(f).isNotNull() & ~F.array_contains(names, f), F.concat(F.lit(f"{f}="), value(f))) for f in PLACE)), lambda x: x.isNotNull())
    return rows.select("id", destination.alias("destination"), score.alias("score"), level_of(score).alias("level"), F.array_join(F.array_sort(names), ",").alias("used"), F.when(other, "").otherwise(F.array_join(lost, ",")).alias("context"))

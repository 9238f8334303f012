"""Names for sessions and sources: what folders tell, which album names a period, labels that tell sources apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import folders as reading
from framelake.functions import names
from framelake.functions.geo import LEAST_M, MOST_M, SPEED, uncertainty_m

#: Folders under which people keep trips, parents of user names, levels in which an album's name may lie.
TRIP_FOLDERS, USER_PARENTS, ALBUM_LEVELS, LEAST_PHOTOS = ("viagens", "viagem"), ("users", "home"), 3, 3


def folder_facts(folders: DataFrame, aliases: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """folder, trips, keyword, album, listed, named, known: of each distinct folder whether it lies under trips; the
    deepest name of an occasion and of an album as (level, name), without their dates; the deepest part that lists
    countries; the first that is one; the deepest name that the lexicon (name, kind) knows as place or occasion."""
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    each = folders.select("folder").distinct().withColumn("_parts", parts).select("folder", (F.size("_parts") - 1).alias("_last"), F.posexplode("_parts").alias("_pos", "_part"), "_parts")
    each = each.withColumns({"_up": F.when(F.col("_pos") > 0, F.get("_parts", F.col("_pos") - 1)), "_level": F.col("_last") - F.col("_pos")}).drop("_parts")
    read = names.listed_countries(reading.part_dates(each, "_part").drop("year", "month", "day"), "_part", aliases)
    read = names.canonical_country(read, "_part", aliases).withColumnRenamed("country", "_named")
    read = names.canonical_country(read, "rest", aliases).withColumnRenamed("country", "_is_country")
    read = reading.settled(read, _plain=names.folded(F.col("rest")))
    own = ~F.coalesce(names.folded(F.col("_up")).isin(*USER_PARENTS), F.lit(False))
    read = read.withColumn("_names", own & (F.col("rest") != "") & names.content(F.col("_plain")) & F.col("_is_country").isNull()).withColumn("_kw", names.occasion(F.col("_plain")))
    if lexicon is None:
        read = read.withColumn("_kind", F.lit(None).cast("string"))
    else:
        known = lexicon.where(F.col("kind").isin("place", "occasion")).groupBy(F.col("name").alias("rest")).agg(F.min("kind").alias("_kind"))
        read = read.join(known, "rest", "left")
    told = F.struct(F.col("_level").alias("level"), F.col("rest").alias("name"), F.col("_kind").alias("kind"))
    return read.groupBy("folder").agg(
        F.bool_or(names.folded(F.col("_part")).isin(*TRIP_FOLDERS)).alias("trips"),
        F.min(F.when(F.col("_names") & F.col("_kw"), told)).alias("keyword"),
        F.min(F.when(F.col("_names") & ~F.col("_kw") & (F.col("_level") < ALBUM_LEVELS), told)).alias("album"),
        F.min(F.when(F.size("listed") >= 2, F.struct(F.col("_level").alias("level"), F.trim("_part").alias("name")))).alias("listed"),
        F.min(F.when(F.col("_named").isNotNull(), F.struct(F.col("_pos").alias("level"), F.col("_named").alias("name")))).alias("named"),
        F.min(F.when(F.col("_kind").isNotNull(), told)).alias("known"),
    )


def session_facts(folders: DataFrame, key: str, aliases: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """key with the facts of its folders (key, folder): the least level first, then the least folder."""
    per = folders.select(key, "folder").distinct().join(folder_facts(folders, aliases, lexicon), "folder")
    deepest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.level"), F.col("folder"), F.col(c).alias("x"))))["x"].alias(c)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("folder", F.col(c).alias("x"))))["x"].alias(c)
    return per.groupBy(key).agg(F.bool_or("trips").alias("trips"), deepest("keyword"), deepest("album"), first("listed"), first("named"), first("known"))


def event_names(folders: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """key, name, by_word: the name of an occasion in a session's folders, else that of an album, else null."""
    facts = session_facts(folders, key, aliases)
    return facts.select(key, F.coalesce("keyword.name", "album.name").alias("name"), F.col("keyword").isNotNull().alias("by_word"))


def camera_keys(media: DataFrame) -> DataFrame:
    """camera: models, and makes with models, as folded names."""
    both = F.array(F.col("model"), F.concat_ws(" ", F.when(F.coalesce("make", F.lit("")) != "", F.col("make")), "model"))
    pairs = media.select("make", "model").where("model <> ''").distinct()
    return pairs.select(F.explode(both).alias("_n")).select(names.folded(F.col("_n")).alias("camera")).where(F.length("camera") >= names.LEAST_NAME).distinct()


def album_names(rows: DataFrame, album: str, cameras: DataFrame | None = None) -> DataFrame:
    """rows with name and shelf: the album's name without its date, null where it names no occasion.

    A camera counts where the name is its own or, from eight characters on, holds it; the two meet by the eight first
    characters of the camera, so names and cameras are never paired one by one."""
    read = reading.part_dates(rows.select(F.col(album).alias("_raw")).where("_raw IS NOT NULL").distinct(), "_raw").select("_raw", F.trim("rest").alias("_name"))
    read = reading.settled(read, _whole=names.folded(F.col("_raw")), _plain=names.folded(F.col("_name")))
    read = read.where((F.col("_name") != "") & names.tells(F.col("_whole")) & names.tells(F.col("_plain")))
    if cameras is not None:
        n = names.LEAST_CAMERA
        forms = read.select("_raw", F.explode(F.array("_whole", "_plain")).alias("_f"))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_f") - (n - 1), F.lit(1))), lambda i: F.substring("_f", i, F.lit(n))))
        held = forms.withColumn("_g", F.explode(grams)).join(cameras.where(F.length("camera") >= n).withColumn("_g", F.substring("camera", 1, n)), "_g").where(F.col("_f").contains(F.col("camera"))).select("_raw")
        same = forms.join(cameras, F.col("_f") == F.col("camera")).select("_raw")
        read = read.join(held.unionByName(same).distinct(), "_raw", "left_anti")
    read = read.select("_raw", F.col("_name").alias("name"), F.col("_plain").isin(*names.SHELVES).alias("shelf"))
    return rows.join(read, F.col(album) == F.col("_raw"), "left").drop("_raw")


def _candidates(counts: DataFrame, cameras: DataFrame | None, least: int) -> DataFrame:
    return album_names(counts.where(F.col("photos") >= least), "album", cameras).where("name IS NOT NULL")


def chosen_albums(counts: DataFrame, key: list[str], cameras: DataFrame | None = None, least: int = LEAST_PHOTOS) -> DataFrame:
    """key, name, photos: of each period's albums (key, album, photos) the one that names it: no shelf if there is another,
    then most photos, the shorter name, the alphabet. Periods without a candidate are left out."""
    best = F.min(F.struct("shelf", (-F.col("photos")).alias("less"), F.length("name").alias("length"), "name"))
    return _candidates(counts, cameras, least).groupBy(*key).agg(best.alias("_b")).select(*key, F.col("_b.name").alias("name"), (-F.col("_b.less")).alias("photos"))


def album_criteria(counts: DataFrame, key: list[str], cameras: DataFrame | None = None, least: int = LEAST_PHOTOS) -> DataFrame:
    """key, rule, most_frequent, least_frequent, longest, candidates: what other ways to choose would give. A name's count
    is that of its largest album; last ties go by the alphabet."""
    per = _candidates(counts, cameras, least).groupBy(*key, "name").agg(F.max("photos").alias("photos"), F.min("shelf").alias("shelf"))
    n, size = F.col("photos"), F.length("name")
    least_of = lambda *by: F.min(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(by)), F.col("name").alias("name")))["name"]
    return per.groupBy(*key).agg(
        least_of(F.col("shelf"), -n, size).alias("rule"),
        least_of(-n, size).alias("most_frequent"),
        least_of(n, size).alias("least_frequent"),
        least_of(-size).alias("longest"),
        F.count("*").alias("candidates"),
    )


def date_shifts(dated: DataFrame, by: list[str], taken: str, zone: str) -> DataFrame:
    """by, verdict, hours, n: how far local times of a zone, stored as if they were right, lie from UTC.

    Times that a change of clocks makes double, or that it skips, are ambiguous; the offsets of the days around decide,
    so two changes within two days are not told apart."""
    local, day = F.col(taken).cast("timestamp"), F.expr("INTERVAL 1 DAY")
    guess = F.to_utc_timestamp(local, zone)
    offset = lambda at: F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)
    early, late = offset(guess - day), offset(guess + day)
    utc = lambda o: F.timestamp_micros(F.unix_micros(local) - o)
    right = lambda o: F.from_utc_timestamp(utc(o), zone) == local
    sure = F.when(early == late, early).when(right(early) & ~right(late), early).when(right(late) & ~right(early), late)
    hours = -sure / 3_600_000_000
    verdict = F.when(local.isNull(), "undated").when(sure.isNull(), "ambiguous").when(sure == 0, "unchanged").otherwise("shifted")
    return dated.groupBy(*by, verdict.alias("verdict"), hours.alias("hours")).agg(F.count("*").alias("n"))


def source_labels(sources: DataFrame) -> DataFrame:
    """source_id, label of sources (source_id, nickname, path): the nickname or the last folder; where several share it,
    as many last folders as tell all of them apart, else the whole path."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    named = sources.select("source_id", "path", parts.alias("_parts"), F.coalesce("nickname", F.try_element_at(parts, F.lit(-1)), "path").alias("_name"))
    sizes = named.groupBy("_name").agg(F.count("*").alias("_n"), F.max(F.size("_parts")).alias("_most"))
    shared = named.join(sizes.where("_n > 1 AND _most > 1"), "_name")
    tail = lambda k: F.array_join(F.slice("_parts", F.greatest(F.size("_parts") - k + 1, F.lit(1)), k), "/")
    tried = shared.withColumn("_k", F.explode(F.sequence(F.lit(2), F.col("_most")))).withColumn("_tail", tail(F.col("_k")))
    enough = tried.groupBy("_name", "_k").agg(F.count_distinct("_tail").alias("_d"), F.max("_n").alias("_n")).where("_d = _n").groupBy("_name").agg(F.min("_k").alias("_k"))
    out = named.join(sizes, "_name").join(enough, "_name", "left")
    return out.select("source_id", F.when(F.col("_n") == 1, F.col("_name")).when(F.col("_k").isNotNull(), tail(F.col("_k"))).otherwise(F.col("path")).alias("label"))


def radius_sentence(delta_s: Column, donor: Column) -> Column:
    """Why the circle of an inherited place has its size: the receiver's error, the time, or where it stops to grow."""
    radius = uncertainty_m(delta_s)
    who = F.coalesce(F.concat(F.lit("de "), F.when(donor != "", donor)), F.lit("de outra foto"))
    start, size, when = F.concat(F.lit("Lugar herdado "), who), reading.readable_metres(radius), reading.readable_time(delta_s)
    # fixed values: the sentences' words
    receiver = F.concat(start, F.lit(", no mesmo instante — o raio de "), size, F.lit(" é só a imprecisão do receptor de GPS que emprestou a coordenada."))
    apart = F.concat(start, F.lit(", a "), when, F.lit(" de distância — "))
    still = F.concat(apart, F.lit("o raio para de crescer em "), size, F.lit(": neste acervo, quem fotografa o dia inteiro passa o dia na mesma região."))
    grows = F.concat(apart, F.lit(f"a {round(SPEED * 3.6)} km/h, a velocidade de quem anda por uma cidade contando as paradas, isso dá "), size, F.lit(" de dúvida."))
    return F.when(radius <= LEAST_M, receiver).when(radius >= MOST_M, still).otherwise(grows)

"""Names of folders, albums, countries, sources; sessions by every rule; shifts of dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import names
from framelake.operators import classify, naming
from framelake.plans.registry import query
from framelake.session import table
from framelake.sources import catalog

#: What people call folders, by event, and what their rules say: under trips, occasion, list, country, album.
_FOLDERS = (
    ("/Viagens/Praia", True, None, None, None, "Praia"),
    ("/Serena 15 Anos", False, "Serena 15 Anos", None, None, None),
    ("/Dubai, Thai & Viet/[Developed]", False, None, "Dubai, Thai & Viet", None, "Dubai, Thai & Viet"),
    ("/Japão/Tóquio", False, None, None, "Japão", "Tóquio"),
    ("/DCIM", False, None, None, None, None),
    ("/2025_05_24/[Originals]", False, None, None, None, None),
    ("/Quizomba", False, None, None, None, "Quizomba"),
    ("/WhatsApp", False, None, None, None, None),
    ("/Canon EOS R6m2", False, None, None, None, None),
    ("/Portfolio/Fotos Organizadas/Visconde de Maua - Abril 2015", False, None, None, None, "Visconde de Maua"),
    ("/Pantanal/Dia 2", False, None, None, None, "Dia 2"),
    ("/Ano Novo 2024/exports", False, "Ano Novo", None, None, None),
    ("/BoraChurrascoRio.imageset", False, None, None, None, None),
    ("/Pictures.wrp2", False, None, None, None, None),
)
_ALIASES = (
    ("Dubai", "Emirados Árabes Unidos"), ("Tailândia", "Tailândia"), ("Thailand", "Tailândia"), ("Vietnã", "Vietnã"), ("Vietnam", "Vietnã"),
    ("Viet Nam", "Vietnã"), ("Japão", "Japão"), ("Japan", "Japão"), ("Guiné", "Guiné"), ("Guiné-Bissau", "Guiné-Bissau"),
)
#: Albums, the name they give, and whether that is a shelf.
_ALBUMS = (
    ("Férias", "Férias", True), ("Portugal e Italia com as Meninas", "Portugal e Italia com as Meninas", False), ("Canon EOS 5D Mark IV", None, False), ("WhatsApp", None, False),
    ("Peru - Julho de 2026", "Peru", False), ("Empolga 2025", "Empolga", False), ("Fotos da ILCE-7M4", None, False), ("2019", None, False), ("Family", "Family", True), ("Salvo do Flickr", None, False),
)
_SPELLED = ("São Paulo", "Ålesund", "Straße", " Praça do Comércio ", "Crème brûlée", "Đà Nẵng", "東京 2024", "İstanbul", "Añb")
_PLAIN = ("sao paulo", "alesund", "strae", "praca do comercio", "creme brulee", "a nang", "2024", "istanbul", "anb")


def _sql(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join([str(k), *map(_sql, row)]) + ")" for k, row in enumerate(rows))


def _one_of(texts, at):
    return F.get(F.array(*map(F.lit, texts)), at.cast("int"))


def _aliases(spark):
    return spark.createDataFrame(list(_ALIASES), "alias string, country string")


_SESSIONS_SQL = f"""WITH f(k, folder, trips, keyword, listed, named, album) AS ({_values(_FOLDERS)}),
e AS (SELECT *, event_id % {len(_FOLDERS)} AS k FROM events),
s AS (SELECT user_id || ':' || k AS session, user_id, k, min(event_id % 7) AS days, count(*) AS n FROM e GROUP BY 2, 3)"""


def _sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("event_id") % len(_FOLDERS))
    session = F.concat_ws(":", "user_id", "k")
    folder = F.concat(F.lit("/Users/u"), "user_id", _one_of([f[0] for f in _FOLDERS], F.col("k")))
    return e.withColumns({"session": session, "folder": folder})


@query(_SESSIONS_SQL + "SELECT session, coalesce(keyword, album) AS name, keyword IS NOT NULL AS by_word FROM s JOIN f USING (k)")
def folder_events(spark, sf):
    return naming.event_names(_sessions(spark, sf).select("session", "folder"), "session", _aliases(spark))


@query(_SESSIONS_SQL + """, d AS (SELECT *, CASE user_id % 3 WHEN 1 THEN 40.0 WHEN 2 THEN 150.0 END AS home_km, CASE WHEN user_id % 2 = 0 THEN 'Brasil' END AS country,
  CASE WHEN user_id % 10 = 0 THEN 'Peru – Brasil' END AS legs, 'period ' || user_id AS period FROM s JOIN f USING (k)),
r AS (SELECT *, CASE WHEN trips THEN 'folder' WHEN keyword IS NOT NULL THEN 'word' WHEN listed IS NOT NULL THEN 'countries' WHEN named IS NOT NULL THEN 'country' WHEN home_km > 100 THEN 'distance'
  WHEN country IS NOT NULL AND days >= 3 AND home_km IS NULL THEN 'stay' WHEN album IS NOT NULL AND days <= 2 THEN CASE WHEN k IN (9, 10) THEN 'lexicon' ELSE 'name' END ELSE 'none' END AS rule, coalesce(legs, country, period) AS derived FROM d)
SELECT session, rule, CASE WHEN rule IN ('word', 'name') THEN 'occasion' WHEN rule = 'none' THEN 'neutral' ELSE 'trip' END AS kind,
  CASE rule WHEN 'word' THEN keyword WHEN 'countries' THEN listed WHEN 'country' THEN named WHEN 'name' THEN album WHEN 'lexicon' THEN CASE k WHEN 9 THEN album ELSE 'Pantanal' END WHEN 'none' THEN NULL
    ELSE CASE WHEN n >= 3 AND user_id % 4 = 0 THEN 'Peru' ELSE derived END END AS label FROM r""")
def session_cascade(spark, sf):
    e = _sessions(spark, sf)
    user = F.col("user_id")
    per = e.groupBy("session", "user_id").agg(F.min(F.col("event_id") % 7).alias("days"))
    per = per.withColumns({
        "home_km": F.when(user % 3 == 1, 40.0).when(user % 3 == 2, 150.0),
        "country": F.when(user % 2 == 0, "Brasil"),
        "legs": F.when(user % 10 == 0, F.array(F.lit("Peru"), F.lit("Brasil"))),
        "period": F.concat(F.lit("period "), user),
    })
    lexicon = spark.createDataFrame([("Pantanal", "place"), ("Visconde de Maua", "place"), ("Serena", "person")], "name string, kind string")
    albums = e.where("user_id % 4 = 0").groupBy("session", F.lit("Peru - Julho de 2026").alias("album")).agg(F.count("*").alias("photos"))
    return classify.classified(per, _aliases(spark), "session", e.select("session", "folder"), lexicon, albums).select("session", "kind", "label", "rule")


_COUNTS_SQL = f"""WITH a(k, album, name, shelf) AS ({_values(_ALBUMS)}),
c AS (SELECT event_type, user_id % 5 AS part, event_id % {len(_ALBUMS)} AS k, count(*) AS photos FROM events GROUP BY 1, 2, 3),
g AS (SELECT event_type, part, name, shelf, photos FROM c JOIN a USING (k) WHERE photos >= 3 AND name IS NOT NULL)"""


def _album_counts(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).alias("part"), _one_of([a[0] for a in _ALBUMS], F.col("event_id") % len(_ALBUMS)).alias("album"))
    return e.groupBy("event_type", "part", "album").agg(F.count("*").alias("photos")), naming.camera_keys(catalog.media(spark, sf))


@query(_COUNTS_SQL + "SELECT event_type, part, name, photos FROM g QUALIFY row_number() OVER (PARTITION BY event_type, part ORDER BY shelf, photos DESC, length(name), name) = 1")
def album_choice(spark, sf):
    counts, cameras = _album_counts(spark, sf)
    return naming.chosen_albums(counts, ["event_type", "part"], cameras)


@query(_COUNTS_SQL + """SELECT event_type, part, first(name ORDER BY shelf, photos DESC, length(name), name) AS rule, first(name ORDER BY photos DESC, length(name), name) AS most_frequent,
  first(name ORDER BY photos, length(name), name) AS least_frequent, first(name ORDER BY length(name) DESC, name) AS longest, count(*) AS candidates FROM g GROUP BY 1, 2""")
def album_criteria(spark, sf):
    counts, cameras = _album_counts(spark, sf)
    return naming.album_criteria(counts, ["event_type", "part"], cameras)


@query(f"WITH p(k, plain) AS (VALUES {', '.join(f'({k}, {_sql(p)})' for k, p in enumerate(_PLAIN))}) SELECT plain, plain || ' ' || user_id AS tail, count(*) AS n FROM events JOIN p ON k = event_id % {len(_PLAIN)} GROUP BY 1, 2")
def folded_names(spark, sf):
    e = table(spark, sf, "events").select("user_id", _one_of(_SPELLED, F.col("event_id") % len(_SPELLED)).alias("name"))
    tail = names.folded(F.concat(F.trim("name"), F.lit(" "), "user_id"))
    return e.groupBy(names.folded(F.col("name")).alias("plain"), tail.alias("tail")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT event_id, event_id % 3 AS way, a.n_name AS a, left(b.n_name, 4) AS b FROM events JOIN nation a ON a.n_nationkey = event_id % 25 JOIN nation b ON b.n_nationkey = user_id % 25),
u AS (SELECT left(n_name, 4) AS b, min(n_name) AS whole FROM nation GROUP BY 1 HAVING count(*) = 1)
SELECT event_id, CASE WHEN way = 2 OR whole IS NULL THEN '' WHEN whole = a THEN a ELSE a || '|' || whole END AS countries FROM m LEFT JOIN u USING (b)""")
def country_lists(spark, sf):
    nation = table(spark, sf, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), nation.select(F.col("n_nationkey").alias("kb"), F.substring("n_name", 1, 4).alias("b"))
    e = table(spark, sf, "events").join(a, F.col("event_id") % 25 == F.col("ka")).join(b, F.col("user_id") % 25 == F.col("kb"))
    way = F.col("event_id") % 3
    text = F.when(way == 0, F.concat("a", F.lit(", "), "b")).when(way == 1, F.concat("a", F.lit(" e "), F.lower("b"))).otherwise(F.concat("a", F.lit(" & festa")))
    aliases = nation.select(F.col("n_name").alias("alias"), F.col("n_name").alias("country"))
    found = names.listed_countries(e.select("event_id", text.alias("text")), "text", aliases)
    return found.select("event_id", F.array_join("listed", "|").alias("countries"))


@query("""WITH t AS (SELECT event_id % 4 AS source, CASE WHEN event_id % 9 <> 0 THEN ts + to_days(CAST(event_id % 366 AS INTEGER)) END AS taken FROM events)
SELECT source, CASE WHEN taken IS NULL THEN 'undated' WHEN amb THEN 'ambiguous' ELSE 'shifted' END AS verdict,
  CASE WHEN taken IS NULL OR amb THEN NULL WHEN taken >= TIMESTAMP '2024-03-10 03:00:00' AND taken < TIMESTAMP '2024-11-03 01:00:00' THEN CAST(4 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS hours, count(*) AS n
FROM (SELECT *, taken >= TIMESTAMP '2024-03-10 02:00:00' AND taken < TIMESTAMP '2024-03-10 03:00:00' OR taken >= TIMESTAMP '2024-11-03 01:00:00' AND taken < TIMESTAMP '2024-11-03 02:00:00' AS amb FROM t) GROUP BY 1, 2, 3""")
def takeout_shifts(spark, sf):
    e = table(spark, sf, "events")
    taken = F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 366).cast("int")))
    return naming.date_shifts(e.select((F.col("event_id") % 4).alias("source"), taken.alias("taken")), ["source"], "taken", "America/New_York")


_PATH_SQL = "CASE WHEN user_id % 2 = 0 THEN '/a' || (event_id % 2) || '/b' || (user_id % 3) || '/u' || (user_id % 50) ELSE '/x/u' || user_id END"


@query(f"""WITH s AS (SELECT min(event_id) AS source_id, {_PATH_SQL} AS path FROM events GROUP BY 2),
n AS (SELECT *, string_split(path[2:], '/') AS p, CASE WHEN source_id % 9 = 0 THEN 'acervo' ELSE split_part(path, '/', -1) END AS name FROM s),
t AS (SELECT name, k, count(DISTINCT array_to_string(p[greatest(len(p) - k + 1, 1):], '/')) AS d, count(*) AS n FROM n, range(2, 4) r(k) GROUP BY 1, 2),
b AS (SELECT name, min(k) FILTER (d = n) AS k, max(n) AS n FROM t GROUP BY 1)
SELECT source_id, CASE WHEN b.n = 1 THEN name WHEN k IS NULL THEN path ELSE array_to_string(p[greatest(len(p) - k + 1, 1):], '/') END AS label FROM n JOIN b USING (name)""")
def source_labels(spark, sf):
    s = table(spark, sf, "events").groupBy(F.expr(_PATH_SQL).alias("path")).agg(F.min("event_id").alias("source_id"))
    return naming.source_labels(s.withColumn("nickname", F.when(F.col("source_id") % 9 == 0, "acervo")))


@query("""WITH d AS (SELECT event_id, event_id * 7 % 20000 AS s, CASE WHEN event_id % 5 <> 0 THEN 'de iPhone ' || user_id ELSE 'de outra foto' END AS who FROM events),
r AS (SELECT *, least(50000, greatest(15, 6 * s)) AS m FROM d),
w AS (SELECT *, CASE WHEN m < 1000 THEN m || ' m' ELSE replace(regexp_replace(printf('%.1f', m / 1000.0), '\\.0$', ''), '.', ',') || ' km' END AS size,
  CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s // 60 % 60 = 0 THEN (s // 3600) || ' h' ELSE (s // 3600) || ' h ' || (s // 60 % 60) || ' min' END AS apart FROM r)
SELECT event_id, CASE WHEN m <= 15 THEN 'Lugar herdado ' || who || ', no mesmo instante — o raio de ' || size || ' é só a imprecisão do receptor de GPS que emprestou a coordenada.'
  WHEN m >= 50000 THEN 'Lugar herdado ' || who || ', a ' || apart || ' de distância — o raio para de crescer em ' || size || ': neste acervo, quem fotografa o dia inteiro passa o dia na mesma região.'
  ELSE 'Lugar herdado ' || who || ', a ' || apart || ' de distância — a 22 km/h, a velocidade de quem anda por uma cidade contando as paradas, isso dá ' || size || ' de dúvida.' END AS sentence FROM w""")
def radius_sentences(spark, sf):
    e = table(spark, sf, "events")
    donor = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("iPhone "), "user_id"))
    return e.select("event_id", naming.radius_sentence(F.col("event_id") * 7 % 20000, donor).alias("sentence"))

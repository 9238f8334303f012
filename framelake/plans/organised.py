"""Queries of the whole engine: all evidence about a file, its destination, and the guarded plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import evidence, suggest
from framelake.plans.registry import query
from framelake.session import staged, table

#: Folders of the files of these queries, and what each says: year, month, category, country, region, city, kind of file.
FOLDERS = (
    ("/Volumes/A/Viagens/Paris 2019-05", 2019, 5, "Viagens", None, None, None, None),
    ("/Volumes/A/Família/x", None, None, "Família", None, None, None, None),
    ("/Volumes/A/Screenshots/Abril 2015", 2015, 4, None, None, None, None, "screen"),
    ("/Volumes/A/misc", None, None, None, None, None, None, None),
    ("/Volumes/A/Brasil/Bahia/Salvador", None, None, None, "Brasil", "Bahia", "Salvador", None),
    ("/Volumes/A/Fotos - Maio 2016", 2016, 5, None, None, None, None, None),
    ("/Volumes/A/WhatsApp Images", None, None, None, None, None, None, "received"),
    ("/Volumes/A/Downloads", None, None, None, None, None, None, "downloaded"),
    ("/Volumes/A/eventos/Viagem", None, None, "Viagens", None, None, None, None),
)


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, user = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    folder = F.get(F.array(*(F.lit(f[0]) for f in FOLDERS)), (n % len(FOLDERS)).cast("int"))
    gps, ts = n % 11 == 0, F.col("ts").cast("timestamp_ntz")
    stem = F.when(n % 7 == 0, F.concat(F.lit("IMG-20240115-WA"), n)).when(n % 7 == 1, F.concat(F.lit("Screenshot_"), n)).otherwise(F.concat(F.lit("P"), n))
    return e.select(
        n.alias("id"), user.alias("user_id"), F.when(n % 101 != 0, folder).alias("folder"), F.concat(stem, F.lit(".jpg")).alias("name"), F.lit("jpg").alias("ext"),
        F.when(n % 3 != 0, ts).alias("taken_at"), F.when(n % 5 != 0, ts + F.expr("INTERVAL 1 HOUR")).alias("mtime"), F.when(n % 4 != 0, "Canon").alias("make"), F.lit(None).cast("string").alias("model"),
        F.when(gps, 1.0).alias("gps_lat"), F.when(gps, user % 25).alias("location_id"), F.when(n % 53 == 1, "photo").when(n % 53 == 2, "screen").alias("kind_confirmed"), F.when(user % 6 != 5, user % 20).alias("session_id"),
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    media = staged(_media(spark, sf_dir), "engine-media")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("long").alias("location_id"), F.col("r_name").alias("country"), F.when(F.col("r_regionkey") != 3, F.concat(F.lit("R"), "r_regionkey")).alias("region"), F.col("n_name").alias("city"))
    k = F.col("session_id")
    sessions = media.select("session_id").where("session_id IS NOT NULL").distinct().select(
        "session_id", F.when(k % 4 == 0, "viagem").when(k % 4 == 1, "evento").otherwise("neutra").alias("kind"), F.concat(F.when(k % 8 == 0, "Família – ").otherwise("Nome "), k).alias("label"),
        F.when(k % 8 < 4, "agrupamento").otherwise("album_externo").alias("label_origin"), F.lit("geocoding_offline").alias("origin"), F.when(k % 4 == 2, "Chile").alias("country"), F.when(k % 8 == 7, "Família").alias("category"),
    )
    n = F.col("id")
    factors = F.map_from_arrays(F.when(n % 20 == 3, F.array(F.lit("pais"), F.lit("regiao"))).otherwise(F.array(F.lit("pais"))), F.when(n % 20 == 3, F.array(F.lit(1.0), F.lit(0.8))).otherwise(F.array(F.lit(0.9))))
    heirs = media.where("gps_lat IS NULL AND id % 10 = 3").select("id", ((F.col("user_id") + 1) % 25).alias("location_id"), factors.alias("factors"))
    said = F.when(n % 12 == 0, F.array(F.lit("other"), F.lit(" FAMÍLIA "))).otherwise(F.array(F.lit("Evento"), F.lit("familia")))
    keywords = media.where("id % 6 = 0").select(n.alias("media_id"), F.explode(said).alias("value"))
    countries = spark.createDataFrame([("brasil", "Brasil"), ("chile", "Chile")], "alias string, country string")
    return media, places, staged(evidence.folder_facts(media, countries), "folder-facts"), heirs, sessions, keywords


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in (i, *f)) + ")" for i, f in enumerate(FOLDERS))
_SQL = f"""
WITH folders AS (SELECT * FROM (VALUES {_VALUES}) AS t(k, folder, year, month, category, pais, regiao, cidade, mark)),
places AS (SELECT CAST(n_nationkey AS BIGINT) AS location_id, r_name AS country, CASE WHEN r_regionkey <> 3 THEN 'R' || r_regionkey END AS region, n_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 101 <> 0 THEN event_id % {len(FOLDERS)} END AS k, event_id % 7 AS stem, CASE WHEN event_id % 3 <> 0 THEN ts END AS taken_at, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 1 HOUR END AS mtime,
  event_id % 4 = 0 AS bare, event_id % 11 = 0 AS gps, CASE WHEN event_id % 11 = 0 THEN user_id % 25 END AS location_id, CASE event_id % 53 WHEN 1 THEN 'photo' WHEN 2 THEN 'screen' END AS confirmed, CASE WHEN user_id % 6 <> 5 THEN user_id % 20 END AS s FROM events),
t AS (SELECT m.*, f.year AS fy, f.month AS fm, f.category, f.pais, f.regiao, f.cidade,
  CASE WHEN gps THEN 'photo' WHEN stem = 0 THEN 'received' WHEN stem = 1 THEN 'screen' WHEN mark IN ('received', 'screen') THEN mark WHEN bare AND mark = 'downloaded' THEN mark ELSE 'photo' END AS found,
  CASE WHEN gps OR stem < 2 THEN 0.95 WHEN mark IN ('received', 'screen') THEN 0.85 WHEN bare AND mark = 'downloaded' THEN 0.8 WHEN bare THEN 0.5 ELSE 0.9 END :: DOUBLE AS kind_score,
  CASE s % 4 WHEN 0 THEN 'viagem' WHEN 1 THEN 'evento' END AS sort, CASE WHEN s % 8 = 0 THEN 'Família – ' || s ELSE 'Nome ' || s END AS label, CASE WHEN s % 8 < 4 THEN 'agrupamento' ELSE 'album_externo' END AS label_origin,
  CASE WHEN s % 4 = 2 THEN 'Chile' END AS most, CASE WHEN s % 8 = 7 THEN 'Família' END AS advised,
  CASE WHEN taken_at IS NOT NULL THEN taken_at WHEN stem = 0 THEN TIMESTAMP '2024-01-15' ELSE mtime END AS moment, CASE WHEN taken_at IS NOT NULL THEN 'exif' WHEN stem = 0 THEN 'nome_arquivo' ELSE 'fs' END AS moment_origin
  FROM m LEFT JOIN folders f USING (k)),
g AS (SELECT t.*, p.country AS c0, p.region AS r0, p.city AS x0, q.country AS c1, CASE WHEN t.id % 20 = 3 THEN q.region END AS r1,
  CASE WHEN gps THEN 0 WHEN t.id % 10 = 3 THEN 1 WHEN pais IS NOT NULL THEN 2 WHEN most IS NOT NULL THEN 3 END AS step FROM t LEFT JOIN places p USING (location_id) LEFT JOIN places q ON q.location_id = (t.user_id + 1) % 25),
evidence AS (
  SELECT id, 0 AS nth, 'tipo' AS field, CASE WHEN confirmed IS NOT NULL THEN 'usuario' ELSE 'arquivo' END AS origin, CASE coalesce(confirmed, found) WHEN 'screen' THEN 'Captura de tela' WHEN 'received' THEN 'Recebida em mensageiro' ELSE 'Baixada da web' END AS value, CASE WHEN confirmed IS NOT NULL THEN 1.0 ELSE kind_score END :: DOUBLE AS score FROM t WHERE coalesce(confirmed, found) <> 'photo'
  UNION ALL SELECT id, 1, 'data', moment_origin, strftime(moment, '%Y-%m-%dT%H:%M:%S'), CASE moment_origin WHEN 'exif' THEN 0.95 WHEN 'nome_arquivo' THEN 0.65 ELSE 0.4 END FROM t WHERE moment IS NOT NULL
  UNION ALL SELECT id, 2, 'ano', 'pasta', CAST(fy AS VARCHAR), 0.6 FROM t WHERE fy IS NOT NULL
  UNION ALL SELECT id, 3, 'pais', CASE step WHEN 0 THEN 'geocoding_offline' WHEN 1 THEN 'vizinhanca_temporal' WHEN 2 THEN 'pasta' ELSE 'vizinhanca' END, CASE step WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN pais ELSE most END,
    CASE step WHEN 0 THEN 0.85 WHEN 1 THEN CASE WHEN id % 20 = 3 THEN 0.75 ELSE 0.675 END WHEN 2 THEN 0.6 ELSE 0.55 END FROM g WHERE step IS NOT NULL
  UNION ALL SELECT id, 4, 'regiao', CASE step WHEN 0 THEN 'geocoding_offline' WHEN 1 THEN 'vizinhanca_temporal' ELSE 'pasta' END, CASE step WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE regiao END AS v, CASE step WHEN 0 THEN 0.85 WHEN 1 THEN 0.6 ELSE 0.6 END FROM g WHERE step < 3 AND v IS NOT NULL
  UNION ALL SELECT id, 5, 'cidade', CASE step WHEN 0 THEN 'geocoding_offline' ELSE 'pasta' END, CASE step WHEN 0 THEN x0 ELSE cidade END, CASE step WHEN 0 THEN 0.85 ELSE 0.6 END FROM g WHERE step IN (0, 2)
  UNION ALL SELECT id, CASE sort WHEN 'viagem' THEN 6 ELSE 7 END, sort, label_origin, label, CASE label_origin WHEN 'agrupamento' THEN 0.7 ELSE 0.55 END FROM t WHERE sort IS NOT NULL
  UNION ALL SELECT id, 8, 'categoria', CASE WHEN category IS NOT NULL THEN 'pasta' WHEN sort IS NOT NULL THEN 'geocoding_offline' WHEN id % 6 = 0 THEN 'curadoria' ELSE 'llm' END,
    CASE WHEN category IS NOT NULL THEN category WHEN sort = 'viagem' THEN 'Viagens' WHEN sort = 'evento' THEN 'Eventos' WHEN id % 12 = 0 THEN 'Família' WHEN id % 6 = 0 THEN 'Eventos' ELSE advised END AS v,
    CASE WHEN category IS NOT NULL THEN 0.6 WHEN sort IS NOT NULL THEN 0.85 ELSE 0.55 END FROM t WHERE v IS NOT NULL)
"""


@query(_SQL + "SELECT id, nth, field, origin, value, score FROM evidence")
def engine_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-6: each kind of evidence, each step of the cascades of dates, places and categories."""
    media, places, facts, heirs, sessions, keywords = _inputs(spark, sf_dir)
    return evidence.assembled(media, places, facts, heirs, sessions, keywords)


@query(_SQL + """, wide AS (SELECT t.id, any_value(coalesce(confirmed, found)) AS kind, any_value(moment) AS moment, any_value(fy) AS fy, any_value(fm) AS fm, any_value(fy) IS NOT NULL AS dated,
""" + ", ".join(f"max(e.value) FILTER (field = '{f}') AS {f}, max(e.score) FILTER (field = '{f}') AS {f}_s" for f in evidence.FIELDS) + """
  FROM t LEFT JOIN evidence e USING (id) GROUP BY t.id),
told AS (SELECT *, viagem IS NOT NULL OR evento IS NOT NULL AS grouped, coalesce(categoria, viagem, evento, pais, regiao, cidade) IS NULL AS nameless, coalesce(CAST(year(moment) AS VARCHAR), ano) AS y,
  ['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'] AS months FROM wide),
-- a name that the category has said already, or that the place above has, is not said again
u AS (SELECT *, CASE WHEN kind <> 'photo' THEN concat_ws('/', 'Não são fotos', tipo, CAST(year(moment) AS VARCHAR))
  WHEN nameless AND moment IS NOT NULL THEN 'Não classificadas/' || year(moment) || '/' || months[month(moment)] || '.' || year(moment)
  WHEN nameless THEN 'Não classificadas/' || CASE WHEN fy IS NULL THEN 'sem data' WHEN fm IS NULL THEN CAST(fy AS VARCHAR) ELSE fy || '/' || months[fm] || '.' || fy END
  ELSE concat_ws('/', categoria, nullif(concat_ws(' - ', y, viagem), ''), evento, CASE WHEN NOT grouped THEN pais END, CASE WHEN NOT grouped THEN regiao END, CASE WHEN NOT grouped THEN nullif(cidade, pais) END) END AS destination,
  CASE WHEN kind <> 'photo' THEN [tipo_s, data_s] WHEN nameless THEN [data_s] ELSE [CASE WHEN moment IS NOT NULL THEN data_s ELSE ano_s END, categoria_s, viagem_s, evento_s, CASE WHEN NOT grouped THEN pais_s END, CASE WHEN NOT grouped THEN regiao_s END, CASE WHEN NOT grouped THEN cidade_s END] END AS scores,
  CASE WHEN kind <> 'photo' THEN concat_ws(',', CASE WHEN data IS NOT NULL THEN 'data' END, CASE WHEN tipo IS NOT NULL THEN 'tipo' END) WHEN nameless THEN coalesce(CASE WHEN data IS NOT NULL THEN 'data' END, '')
    ELSE concat_ws(',', CASE WHEN data IS NULL AND ano IS NOT NULL THEN 'ano' END, CASE WHEN categoria IS NOT NULL THEN 'categoria' END, CASE WHEN cidade IS NOT NULL AND NOT grouped THEN 'cidade' END, CASE WHEN data IS NOT NULL THEN 'data' END,
    CASE WHEN evento IS NOT NULL THEN 'evento' END, CASE WHEN pais IS NOT NULL AND NOT grouped THEN 'pais' END, CASE WHEN regiao IS NOT NULL AND NOT grouped THEN 'regiao' END, CASE WHEN viagem IS NOT NULL THEN 'viagem' END) END AS used,
  CASE WHEN kind <> 'photo' OR NOT grouped THEN '' ELSE concat_ws(',', 'pais=' || pais, 'regiao=' || regiao, 'cidade=' || cidade) END AS context FROM told)
SELECT id, destination, coalesce(list_min(list_filter(scores, lambda x: x IS NOT NULL)), 0) :: DOUBLE AS score, CASE WHEN coalesce(list_min(list_filter(scores, lambda x: x IS NOT NULL)), 0) >= 0.8 THEN 'high' WHEN coalesce(list_min(list_filter(scores, lambda x: x IS NOT NULL)), 0) >= 0.5 THEN 'medium' ELSE 'low' END AS level, used, context FROM u""")
def engine_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-7: destinations by each of the three branches, with what was used and what is context."""
    media, places, facts, heirs, sessions, keywords = _inputs(spark, sf_dir)
    return evidence.destined(evidence.assembled(media, places, facts, heirs, sessions, keywords), media, facts)


@query("""
WITH m AS (SELECT event_id AS media_id, event_id % 4 AS source, event_id % 9 AS d, CASE WHEN event_id % 12 = 5 THEN 'same.jpg' ELSE event_id || '.jpg' END AS name FROM events),
p AS (SELECT *, CASE d WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'a_b/c' WHEN 4 THEN 'x/' || repeat('y', 80) WHEN 5 THEN 'end' ELSE 'fotos/' || d END AS safe FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY safe, name ORDER BY media_id) AS nth FROM p),
q AS (SELECT *, CASE WHEN nth = 1 THEN name ELSE 'same (' || nth || ').jpg' END AS said FROM n)
SELECT media_id, CASE WHEN safe IS NULL THEN '' ELSE '/Volumes/A/out/' || safe || '/' || said END AS target,
  CASE WHEN safe IS NULL THEN 'unsafe destination' WHEN source < 2 THEN 'destination inside the source' WHEN nth > 1 THEN 'taken; renamed to ' || said END AS conflict FROM q""")
def copy_plan_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-12, SCL-20: a plan below a root that two of the sources hold, with destinations that need cleaning or lead out."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    trees = ("/Volumes/A", "/Volumes/A/./out/", "/Volumes/B", "/Volumes/A/output")
    places = [" ../up", "~home/x", "a/ . /..", "a<b/./c ", "x//" + "y" * 120, " end. ", *(f"fotos\\{d}" for d in (6, 7, 8))]
    suggestions = e.select(n.alias("media_id"), F.get(F.array(*map(F.lit, places)), (n % 9).cast("int")).alias("destination"), F.when(n % 2 == 0, "approved").otherwise("corrected").alias("status"))
    tree = F.get(F.array(*map(F.lit, trees)), (n % 4).cast("int"))
    media = e.select(n.alias("id"), (n % 4).alias("source_id"), F.concat(tree, F.lit("/2024")).alias("folder"), F.when(n % 12 == 5, "same.jpg").otherwise(F.concat(n, F.lit(".jpg"))).alias("name"))
    sources = media.select("source_id").distinct().withColumn("path", F.get(F.array(*map(F.lit, trees)), F.col("source_id").cast("int")))
    return suggest.copy_plan(suggestions, media, root="/Volumes/A/out", sources=sources).select("media_id", "target", "conflict")

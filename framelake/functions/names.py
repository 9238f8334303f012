"""What folder and album names say: plain spelling, occasions, technical names, countries in a list."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of occasions, as they stand in a plain name.
OCCASION_WORDS = (
    "aniversario", "casamento", "formatura", "batizado", "cha de bebe", "festa", "natal", "reveillon", "ano novo", "pascoa",
    "churrasco", "show", "festival", "despedida", "confraternizacao", "bodas",
)
AGE = r"\b\d{1,3}\s*anos?\b"
#: Whole names that dates, cameras, editing steps and systems give.
TECHNICAL_NAMES = (
    r"\d{4}([-_ .]\d{1,2}){0,2}", r"\d{1,2}([-_ .]\d{1,2})?", r"img[-_ ]?\d*", r"dsc[-_ ]?\d*", "dcim",
    "originals?", "exports?", "edits?", "edicoes", "raw", "jpe?g", "selecao", "selects?",
    "developed", "revelad[ao]s?", "tratad[ao]s?", "finalizad[ao]s?", "culling",
    "picks?", "rejects?", "descartes?", "lixo", "previews?", "thumbs?", "cache", "sidecars?",
    "fotos?", "photos?", "imagens", "camera", "backup", "nova pasta", "sem titulo", "untitled",
    "pictures", "users", "home", "volumes", "desktop", "documents", "downloads", "library",
)
#: Endings of folders that hold software.
CODE_ENDINGS = (
    ".xcassets", ".imageset", ".appiconset", ".colorset", ".dataset", ".xcodeproj", ".xcworkspace", ".playground", ".lproj",
    ".framework", ".bundle", ".app",
)
#: Folders of categories and of storing, which name no content.
CATEGORIES = ("viagens", "viagem", "familia", "eventos", "album", "albuns")
CONTAINERS = (
    "portfolio", "portifolio", "fotos organizadas", "organizadas", "organizado", "acervo", "catalogo", "biblioteca", "galeria",
    "colecao", "colecoes", "arquivo", "arquivos", "diversos", "geral", "varios", "outros", "misc", "temp", "tmp", "novo", "novas",
)
#: Services and devices that name albums by themselves.
SERVICES = (
    "instagram", "twitter", "x", "facebook", "flickr", "tiktok", "snapchat", "linkedin", "pinterest", "dropbox", "icloud", "email",
    "e-mail", "airdrop", "drone", "gopro", "print", "prints", "recentes", "recents", "favoritos", "favorites", "importados",
    "imported", "sem titulo", "untitled", "novo album", "new album", "whatsapp", "telegram", "signal", "messenger", "screenshots",
    "capturas de tela", "capturas", "downloads", "transferencias",
)
#: Makers and lines of equipment.
BRANDS = (
    "canon", "nikon", "sony", "fujifilm", "fuji", "olympus", "panasonic", "lumix", "leica", "pentax", "sigma", "hasselblad",
    "phase one", "iphone", "ipad", "ipod", "pixel", "galaxy", "xiaomi", "motorola", "eos", "nikkor", "alpha", "dji", "mavic", "insta360",
)
#: Albums that say where photos are kept, taken only where no other name is left.
SHELVES = (
    "ferias", "vacation", "vacations", "holiday", "holidays", "familia", "family", "viagens", "viagem", "trips", "trip", "travel",
    "eventos", "events", "momentos", "moments", "memories", "lembrancas", "melhores", "best of", "selecao", "selection", "geral",
    "general", "diversos", "misc", "casa", "home", "trabalho", "work", "album", "albuns", "albums", "fotos", "photos", "pictures", "imagens",
)
LEAST_NAME, LEAST_CAMERA, LEAST_PREFIX = 3, 8, 4
_LIST = r"(?i)\s*(?:,|&|\+|/|\se\s)\s*"
_PAIR, _SIDE = "\x01", "\x02"


@cache
def _spellings() -> tuple[str, str, str, str]:
    """Characters whose compatibility form has one ASCII character, those characters, and, as pairs and as a pattern,
    the characters whose form has several."""
    single, several = [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        form = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(form) == 1:
            single.append((c, form))
        elif form:
            several.append((c, form))
    pairs = _PAIR.join(f"{c}{_SIDE}{form}" for c, form in several)
    return "".join(c for c, _ in single), "".join(f for _, f in single), pairs, "[" + "".join(c for c, _ in several) + "]"


def _ascii(text: Column) -> Column:
    """The ASCII characters of the compatibility decomposition; all others go."""
    single, plain, pairs, pattern = _spellings()
    table = F.str_to_map(F.lit(pairs), F.lit(_PAIR), F.lit(_SIDE))
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")  # the long pattern is slow, so it sees these alone
    found = F.array_distinct(F.regexp_extract_all(other, F.lit(pattern), F.lit(0)))
    spelled = F.aggregate(found, text, lambda done, c: F.replace(done, c, F.try_element_at(table, c)))
    return F.regexp_replace(F.translate(spelled, single, plain), r"[^\x00-\x7F]", "")


def folded(text: Column) -> Column:
    """Lower case without accents and outer blanks; characters that have no ASCII form go."""
    return F.lower(F.regexp_replace(_ascii(text), r"^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$", ""))


def letters_and_digits(text: Column) -> Column:
    """The folded name with one blank for all else: the key of country names."""
    return F.trim(F.regexp_replace(F.lower(_ascii(text)), r"[^a-z0-9]+", " "))


def occasion(plain: Column) -> Column:
    """Whether a folded name tells of an occasion."""
    return plain.rlike(AGE) | plain.rlike("|".join(OCCASION_WORDS))


def technical(plain: Column) -> Column:
    """Whether a folded name says how a folder came to be, not what it holds."""
    whole = r"^\[?(" + "|".join(TECHNICAL_NAMES) + r")\]?$"
    bare = F.regexp_replace(plain, r"\.[a-z0-9]{1,16}$", "")
    software = plain.rlike("(" + "|".join(e.replace(".", r"\.") for e in CODE_ENDINGS) + ")$")
    return plain.rlike(whole) | software | bare.rlike(whole)


def tells(plain: Column) -> Column:
    """Whether a folded name may be that of an album: letters, and neither service nor equipment."""
    service, brand = (r"\b(" + "|".join(words) + r")\b" for words in (SERVICES, BRANDS))
    return (F.length(plain) >= LEAST_NAME) & ~plain.rlike(service) & ~plain.rlike(brand) & plain.rlike("[a-z]")


def content(plain: Column) -> Column:
    """Whether a folded folder name names content; that it is no country is the caller's to see."""
    return ~technical(plain) & tells(plain) & ~plain.isin(*CATEGORIES) & ~plain.isin(*CONTAINERS)


def country_keys(aliases: DataFrame) -> DataFrame:
    """alias, country: one country for each spelling, aliases as keys."""
    return aliases.groupBy(letters_and_digits(F.col("alias")).alias("alias")).agg(F.min("country").alias("country")).where("alias <> ''")


def canonical_country(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with country: what the name is an alias of, else null."""
    keyed = rows.withColumn("_alias", letters_and_digits(F.col(name)))
    return keyed.join(country_keys(aliases).withColumnRenamed("alias", "_alias"), "_alias", "left").drop("_alias")


def listed_countries(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with listed: the countries of a name that lists two parts or more, all of them countries, by whole alias or
    by a start of four characters or more that only one country has; empty else. Each name is read once."""
    known = country_keys(aliases)
    starts = known.select("country", F.explode(F.transform(F.sequence(F.lit(LEAST_PREFIX), F.greatest(F.length("alias"), F.lit(LEAST_PREFIX))), lambda n: F.substring("alias", F.lit(1), n))).alias("_key"))
    starts = starts.where(F.length("_key") >= LEAST_PREFIX).groupBy("_key").agg(F.count_distinct("country").alias("_n"), F.min("country").alias("_start")).where("_n = 1").drop("_n")
    names = rows.select(F.col(name).alias("_name")).where(F.col("_name").rlike(_LIST)).distinct()
    parts = F.filter(F.split("_name", _LIST), lambda p: F.trim(p) != "")
    each = names.withColumn("_parts", parts).where(F.size("_parts") >= 2).select("_name", F.posexplode("_parts").alias("_pos", "_part")).withColumn("_key", letters_and_digits(F.col("_part")))
    found = each.join(known.select(F.col("alias").alias("_key"), F.col("country").alias("_whole")), "_key", "left").join(starts, "_key", "left").withColumn("_c", F.coalesce("_whole", "_start"))
    in_order = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_c"))), lambda x: x["_c"]))
    per = found.groupBy("_name").agg(in_order.alias("listed"), F.count_if(F.col("_c").isNull()).alias("_unknown")).where("_unknown = 0").drop("_unknown")
    out = rows.join(per, F.col(name) == F.col("_name"), "left").drop("_name")
    return out.withColumn("listed", F.coalesce("listed", F.array().cast("array<string>")))

"""What folder names say: dates, countries, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of months, longest first within a month.
MONTHS = (
    ("janeiro", "january", "jan"), ("fevereiro", "february", "fev", "feb"), ("março", "marco", "march", "mar"), ("abril", "april", "abr", "apr"),
    ("maio", "mai", "may"), ("junho", "june", "jun"), ("julho", "july", "jul"), ("agosto", "august", "ago", "aug"),
    ("setembro", "september", "sept", "set", "sep"), ("outubro", "october", "out", "oct"), ("novembro", "november", "nov"), ("dezembro", "december", "dez", "dec"),
)
_NAMES = "|".join(sorted((n for own in MONTHS for n in own), key=lambda n: (-len(n), n)))
_YEAR, _SEP = r"(?:18|19|20)\d{2}", r"[-_./ ]"
#: Ways to write a date, the most precise first, and the groups that hold year, month (number or name) and day.
FORMS = (
    (rf"(?U)\b({_YEAR}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})\b", 1, 2, 3),
    (rf"(?U)\b(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}({_YEAR})\b", 3, 2, 1),
    (rf"(?iU)\b(\d{{1,2}}){_SEP}de{_SEP}({_NAMES}){_SEP}de{_SEP}({_YEAR})\b", 3, 2, 1),
    (rf"(?iU)\b({_NAMES})\.?{_SEP}?(?:de{_SEP})?({_YEAR})\b", 2, 1, 0),
    (rf"(?U)\b({_YEAR})[-_.](\d{{1,2}})\b", 1, 2, 0),
    (rf"(?U)\b({_YEAR})\b", 1, 0, 0),
)
_DAY_ONLY = rf"(?iU)^(?:{_NAMES}){_SEP}(\d{{1,2}})$"
_EDGES = " \\-–—_.,;:/\\t"
#: Administrative words that a region's name may carry.
ADMIN_BEFORE = r"(?i)^(province|state|region|prefecture|governorate|department)\s+of\s+"
ADMIN_AFTER = r"(?i)\s+(province|state|region|prefecture|county|district|governorate|municipality|oblast|territory|department|canton|emirate|autonomous region|metropolitan city|federal district)$"


def month_number(name: Column) -> Column:
    """1 .. 12 of a month's number or name."""
    named = F.str_to_map(F.lit(",".join(f"{n}:{k}" for k, own in enumerate(MONTHS, 1) for n in own)), F.lit(","), F.lit(":"))
    return F.coalesce(name.try_cast("int"), F.try_element_at(named, F.lower(name)).cast("int"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), f"^[{_EDGES}]+|[{_EDGES}]+$", "")


def _first_valid(part: Column, form: str, y: int, m: int, d: int) -> Column:
    """struct(year, month, day, text) of the first match of a form that is a date."""

    def read(text: Column) -> Column:
        get = lambda k: F.regexp_extract(text, form, k) if k else F.lit(None).cast("string")
        month, day = month_number(get(m)), get(d).cast("int")
        fine = (F.lit(m == 0) | month.between(1, 12)) & (F.lit(d == 0) | day.between(1, 31))
        return F.when(fine, F.struct(get(y).cast("int").alias("year"), month.alias("month"), day.alias("day"), text.alias("text")))

    found = F.regexp_extract_all(part, F.lit(form), F.lit(0))
    return F.get(F.filter(F.transform(found, read), lambda x: x.isNotNull()), F.lit(0))


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with long expressions as columns that later conditions read: the optimizer would copy them into each of those."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def part_dates(parts: DataFrame, part: str) -> DataFrame:
    """parts with rest, year, month, day of each folder name: the first form that gives a valid date; rest is the name
    without it. A month and day without a year leave no name and no date."""
    forms = {f"_f{k}": _first_valid(F.col(part), *form) for k, form in enumerate(FORMS)}
    rows = parts.withColumns(forms).withColumn("_date", F.coalesce(*forms)).drop(*forms)
    text = F.col("_date.text")
    rows = rows.withColumn("_at", F.instr(part, text))
    rest = F.concat(F.substring(part, F.lit(1), F.col("_at") - 1), F.lit(" "), F.substring(part, F.col("_at") + F.length(text), F.length(part)))
    day_only = F.regexp_extract(F.trim(part), _DAY_ONLY, 1).try_cast("int").between(1, 31)
    rows = rows.withColumn("_day_only", F.coalesce(day_only, F.lit(False)))
    name = F.when(F.col("_date").isNotNull(), _trimmed(rest)).when(F.col("_day_only"), "").otherwise(_trimmed(F.col(part)))
    rows = settled(rows, rest=name, **{c: F.col(f"_date.{c}") for c in ("year", "month", "day")})
    return rows.drop("_date", "_at", "_day_only")


def path_dates(rows: DataFrame, folder: str) -> DataFrame:
    """rows with date, a struct (year, month, day), and leaf, the deepest folder's name without its date: the deepest date
    on the path, refined by the folders above of the same year. Every folder is read once, however many files it has."""
    parts = rows.select(folder).distinct().select(folder, F.posexplode(F.filter(F.split(folder, "/"), lambda p: p != "")).alias("_pos", "_part"))
    read = part_dates(parts, "_part")
    exact = lambda x: x["month"].isNotNull().cast("int") + x["day"].isNotNull().cast("int")
    better = lambda best, x: F.when((x["year"] == best["year"]) & (exact(x) > exact(best)), x).otherwise(best)
    dated = F.array_sort(F.collect_list(F.when(F.col("year").isNotNull(), F.struct((-F.col("_pos")).alias("up"), "year", "month", "day"))))
    per = read.groupBy(folder).agg(F.max_by("rest", "_pos").alias("leaf"), dated.alias("_dates"))
    found = F.when(F.size("_dates") > 0, F.aggregate("_dates", F.get("_dates", F.lit(0)), better))
    per = per.withColumn("_best", found)
    date = F.when(F.col("_best").isNotNull(), F.struct("_best.year", "_best.month", "_best.day"))
    return rows.join(per.select(folder, date.alias("date"), "leaf"), folder, "left")


def date_label(date: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(date["year"].cast("string"), F.when(date["month"].isNull(), "").otherwise(F.concat(F.lit("-"), two(date["month"]), F.when(date["day"].isNull(), "").otherwise(F.concat(F.lit("-"), two(date["day"]))))))


def plain_region(name: Column) -> Column:
    """A region's own name, without the administrative words around it; null if nothing is left."""
    cut = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, ADMIN_BEFORE, "")), ADMIN_AFTER, ""))
    return F.when(cut != "", cut)


def hierarchy(rows: DataFrame, folder: str, countries: DataFrame, key: str = "id") -> DataFrame:
    """key, country, region, city, said: of each folder the first part that names a country (countries: alias, country;
    aliases in lower case) and what follows it: nothing, a city, or a region and a city."""
    folders = rows.select(folder).distinct().withColumn("_parts", F.filter(F.split(folder, "/"), lambda p: p != ""))
    named = folders.select(folder, F.posexplode("_parts").alias("_at", "_part")).withColumn("alias", F.lower(F.trim("_part")))
    first = named.join(countries, "alias").groupBy(folder).agg(F.min(F.struct("_at", "country", "_part")).alias("_x"))
    found = folders.join(first, folder).withColumn("_rest", F.slice("_parts", F.col("_x._at") + 2, 10_000))
    city = F.when(F.size("_rest") > 0, F.element_at("_rest", -1))
    region = F.when(F.size("_rest") > 1, F.try_element_at("_rest", F.lit(-2)))
    told = found.select(folder, F.col("_x.country").alias("country"), region.alias("region"), city.alias("city"), F.col("_x._part").alias("said"))
    return rows.select(key, folder).join(told, folder, "left").drop(folder)


def zones(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (country) with zone and sure: the country's only time zone (table: country, zone), none where it has several."""
    per = table.groupBy("country").agg(F.min("zone").alias("zone"), F.count_distinct("zone").alias("_n"))
    return rows.join(per, "country", "left").withColumns({"zone": F.when(F.col("_n") == 1, F.col("zone")), "sure": F.coalesce(F.col("_n") == 1, F.lit(False))}).drop("_n")


def readable_metres(m: Column) -> Column:
    km = F.translate(F.call_function("format_number", m / 1000, F.lit("0.#")), ".", ",")  # ties by the double itself, halves to even
    return F.when(m < 1000, F.concat(F.format_string("%.0f", F.bround(m)), F.lit(" m"))).otherwise(F.concat(km, F.lit(" km")))


def readable_time(s: Column) -> Column:
    whole = F.floor(F.abs(s)).cast("long")
    h, m = F.floor(whole / 3600).cast("string"), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    hours = F.when(m == 0, F.concat(h, F.lit(" h"))).otherwise(F.concat(h, F.lit(" h "), m.cast("string"), F.lit(" min")))
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit(" s"))).when(whole < 3600, F.concat(m.cast("string"), F.lit(" min"))).otherwise(hours)



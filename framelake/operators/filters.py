"""The filter algebra over the media table: every filter is a Column or a semi-join, and they are and-ed."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.confidence import level_of

REACHES = ("all", "ready", "lacking")
#: Named gaps: what a file lacks or what waits for an answer.
GAPS = ("no_date", "no_gps", "inherited_place", "not_photo", "type_to_confirm", "no_group", "no_camera", "no_suggestion", "low_confidence", "medium_confidence", "read_error")
SORTS = ("date_desc", "date_asc", "name", "size")


@dataclass(frozen=True)
class Context:
    """Side tables that some filters need."""

    sources: DataFrame | None = None
    places: DataFrame | None = None
    keywords: DataFrame | None = None
    suggestions: DataFrame | None = None
    evidence: DataFrame | None = None


@dataclass(frozen=True)
class MediaFilters:
    reach: str = "all"
    role: str | None = None
    search: str | None = None
    ext: str | None = None
    month: str | None = None
    year: int | None = None
    source_id: int | None = None
    trip_id: int | None = None
    occasion_id: int | None = None
    camera: str | None = None
    country: str | None = None
    city: str | None = None
    keyword: str | None = None
    folder: str | None = None
    gap: str | None = None
    confidence: str | None = None
    origin: str | None = None
    position: str | None = None


def ready(media: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Holdings that are present, online and in a source within reach."""
    own = media.where((F.col("role") == "holding") & ~F.col("missing") & ~F.col("offline"))
    if sources is None:
        return own
    return own.join(sources.where("NOT available").select("source_id"), "source_id", "left_anti")


def under_folder(path: str) -> Column:
    """The folder itself or anything below it; no wildcard in path is one."""
    return (F.col("folder") == path) | F.col("folder").startswith(path.rstrip("/") + "/")


def month_range(month: str, column: str = "taken_at") -> Column:
    """A half-open range, which Parquet can skip row groups by."""
    year, number = map(int, month.split("-"))
    after = datetime(year + number // 12, number % 12 + 1, 1)
    return (F.col(column) >= F.lit(f"{year:04d}-{number:02d}-01").cast("timestamp_ntz")) & (F.col(column) < F.lit(after.strftime("%Y-%m-%d")).cast("timestamp_ntz"))


def year_range(year: int, column: str = "taken_at") -> Column:
    return (F.col(column) >= F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")) & (F.col(column) < F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz"))


def camera_like(pattern: str) -> Column:
    return F.concat(F.coalesce("make", F.lit("")), F.lit(" "), F.coalesce("model", F.lit(""))).ilike(f"%{pattern}%")


def gap(name: str, columns: list[str]) -> Column | None:
    """The gap as a Column, or None for those that need the suggestions."""
    has = lambda c: F.col(c) if c in columns else F.lit(None)  # noqa: E731  catalogs without inference lack these columns
    kind = F.coalesce(has("confirmed_type"), has("image_type"))
    known = {
        "no_date": F.col("taken_at").isNull(),
        "no_gps": (F.col("gps_lat").isNull() | F.col("gps_lon").isNull()) & has("inherited_lat").isNull(),
        "inherited_place": has("inherited_lat").isNotNull(),
        "not_photo": F.coalesce(kind != "photo", F.lit(False)),
        "type_to_confirm": has("confirmed_type").isNull() & F.coalesce(has("image_type") != "photo", F.lit(False)),
        "no_group": has("trip_id").isNull() & has("occasion_id").isNull(),
        "no_camera": F.col("make").isNull() & F.col("model").isNull(),
        "read_error": F.col("read_error").isNotNull(),
    }
    return known.get(name)


def filtered(media: DataFrame, filters: MediaFilters, context: Context = Context()) -> DataFrame:
    """media under all filters; unknown reaches and gaps raise before anything is planned."""
    if filters.reach not in REACHES:
        raise ValueError(f"unknown reach {filters.reach!r}")
    if filters.gap is not None and filters.gap not in GAPS:
        raise ValueError(f"unknown gap {filters.gap!r}")
    out, conditions = media, []
    if filters.reach != "all":
        inside = (F.col("role") == "holding") & ~F.col("missing") & ~F.col("offline")
        if context.sources is not None:
            reachable = context.sources.select("source_id", F.col("available").alias("_available"))
            out = out.join(reachable, "source_id", "left")
            inside = inside & F.coalesce("_available", F.lit(True))
        out = out.where(inside if filters.reach == "ready" else ~inside).select(*media.columns)
    if filters.search is not None:
        like = f"%{filters.search}%"
        hit = F.col("name").ilike(like) | F.concat("folder", F.lit("/"), "name").ilike(like)
        if context.keywords is not None:
            tagged = context.keywords.where((F.col("namespace") == "curated") & F.col("value").ilike(like)).select(F.col("media_id").alias("_tagged")).distinct()
            out = out.join(tagged, out["id"] == F.col("_tagged"), "left")
            hit = hit | F.col("_tagged").isNotNull()
        out = out.where(hit).select(*media.columns)
    for name, column in (("ext", "ext"), ("source_id", "source_id"), ("trip_id", "trip_id"), ("occasion_id", "occasion_id"), ("role", "role")):
        if getattr(filters, name) is not None:
            conditions.append(F.col(column) == getattr(filters, name))
    if filters.month:
        conditions.append(month_range(filters.month))
    if filters.year is not None:
        conditions.append(year_range(filters.year))
    if filters.camera:
        conditions.append(camera_like(filters.camera))
    if filters.folder:
        conditions.append(under_folder(filters.folder))
    if filters.position:
        conditions.append(F.col("gps_lat" if filters.position == "measured" else "inherited_lat").isNotNull())
    if filters.gap and (known := gap(filters.gap, media.columns)) is not None:
        conditions.append(known)
    if conditions:
        out = out.where(reduce(Column.__and__, conditions))
    for field, column in (("country", "country"), ("city", "city")):
        if getattr(filters, field):
            found = context.places.where(F.col(column).ilike(f"%{getattr(filters, field)}%")).select("location_id")
            out = out.join(found, "location_id", "left_semi").select(*media.columns)
    if filters.keyword:
        tagged = context.keywords.where((F.col("namespace") == "curated") & (F.col("key") == "keyword") & F.col("value").ilike(filters.keyword))
        out = out.join(tagged.select(F.col("media_id").alias("id")), "id", "left_semi").select(*media.columns)
    # a file's evidence of a level and its evidence of an origin may be two rows
    for name, wanted in (("confidence", level_of(F.col("score")) == filters.confidence), ("origin", F.col("origin") == filters.origin)):
        if getattr(filters, name):
            out = out.join(context.evidence.where(wanted).select("id"), "id", "left_semi").select(*media.columns)
    if filters.gap == "no_suggestion":
        out = out.join(context.suggestions.select(F.col("media_id").alias("id")), "id", "left_anti").select(*media.columns)
    if filters.gap in ("low_confidence", "medium_confidence"):
        level = filters.gap.split("_")[0]
        out = out.join(context.suggestions.where(F.col("level") == level).select(F.col("media_id").alias("id")), "id", "left_semi").select(*media.columns)
    return out


def page(media: DataFrame, sort: str = "date_desc", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a listing; ids break ties, limits are kept within 1 .. 500, unknown sorts are date_desc."""
    by = {
        "date_asc": [F.col("taken_at").asc_nulls_last(), F.col("id").asc()],
        "name": [F.col("name").asc(), F.col("id").asc()],
        "size": [F.col("bytes").desc(), F.col("id").asc()],
    }.get(sort, [F.col("taken_at").desc_nulls_last(), F.col("id").desc()])
    return media.orderBy(*by).offset(max(0, offset)).limit(min(500, max(1, limit)))


#: The token language: field:value pairs and free text.
TOKENS = {"role": "role", "ext": "ext", "camera": "camera", "place": "country", "keyword": "keyword", "folder": "folder", "confidence": "confidence", "origin": "origin", "position": "position"}
#: What fields of a closed vocabulary may say.
VOCABULARY = {"role": ("holding", "witness"), "confidence": ("low", "medium", "high"), "position": ("estimated", "measured")}


def parse_tokens(text: str) -> MediaFilters:
    """`ext:jpg camera:"EOS R6" holiday` as filters; unknown or repeated fields are errors, other words are free text."""
    import shlex

    found, free = {}, []
    for word in shlex.split(text):
        name, colon, value = word.partition(":")
        name = name.strip().lower()
        if not colon:
            free.append(word)
        elif name not in TOKENS or not value:
            raise ValueError(f"unknown field or empty value in {word!r}")
        elif TOKENS[name] in found:
            raise ValueError(f"field {name!r} is given twice")
        else:
            found[TOKENS[name]] = value
    for name, values in VOCABULARY.items():
        if name in found:
            found[name] = found[name].strip().lower()
            if found[name] not in values:
                raise ValueError(f"{name} is one of {', '.join(values)}, not {found[name]!r}")
    if free:
        found["search"] = " ".join(free)
    return MediaFilters(**found)


def serialise_tokens(filters: MediaFilters) -> str:
    """The text that parse_tokens reads back to the same filters."""
    from shlex import quote

    back = {v: k for k, v in TOKENS.items()}
    words = [f"{back[f.name]}:{quote(getattr(filters, f.name))}" for f in fields(filters) if f.name in back and getattr(filters, f.name) is not None]
    return " ".join([*words, *([quote(filters.search)] if filters.search else [])])

"""Tags of files, as JSON objects of any shape: the canonical row, the entries worth keeping, nested trees made flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.dates import any_date, offset_seconds, plausible
from framelake.session import staged

#: The tags that give each column; the first that is set wins.
PRECEDENCE = {
    "taken": ("Composite:SubSecDateTimeOriginal", "EXIF:DateTimeOriginal", "Composite:SubSecCreateDate", "EXIF:CreateDate", "QuickTime:CreateDate", "XMP:DateCreated", "IPTC:DateCreated", "EXIF:ModifyDate"),
    "offset": ("EXIF:OffsetTimeOriginal", "EXIF:OffsetTimeDigitized", "EXIF:OffsetTime"),
    "make": ("EXIF:Make", "XMP:Make"),
    "model": ("EXIF:Model", "XMP:Model"),
    "lens": ("EXIF:LensModel", "MakerNotes:LensType", "XMP:Lens", "Composite:LensID"),
    "orientation": ("EXIF:Orientation",),
    "width": ("EXIF:ExifImageWidth", "EXIF:ImageWidth", "File:ImageWidth", "QuickTime:ImageWidth"),
    "height": ("EXIF:ExifImageHeight", "EXIF:ImageHeight", "File:ImageHeight", "QuickTime:ImageHeight"),
    "gps_lat": ("Composite:GPSLatitude",),
    "gps_lon": ("Composite:GPSLongitude",),
    "capture_id": ("Apple:ContentIdentifier", "QuickTime:ContentIdentifier", "Keys:ContentIdentifier", "XMP:ContentIdentifier"),
}
#: The tags of keywords, in the order in which their words are listed.
KEYWORDS = ("XMPSidecar:TagsList", "XMP:TagsList", "XMPSidecar:HierarchicalSubject", "XMP:HierarchicalSubject", "XMPSidecar:Subject", "XMP:Subject", "IPTC:Keywords")
#: Orientations by name, groups of tags that are kept and their namespaces, tags of pictures within files.
ORIENTATIONS = ("Horizontal (normal)", "Mirror horizontal", "Rotate 180", "Mirror vertical", "Mirror horizontal and rotate 270 CW", "Rotate 90 CW", "Mirror horizontal and rotate 90 CW", "Rotate 270 CW")
GROUPS = {"EXIF": "exif", "GPS": "gps", "IPTC": "iptc", "XMP": "xmp", "ICC_Profile": "icc", "QuickTime": "quicktime", "PNG": "png", "XMPSidecar": "xmp_sidecar"}
OPAQUE = ("ThumbnailImage", "PreviewImage", "JpgFromRaw", "OtherImage", "ThumbnailTIFF", "PhotoshopThumbnail", "DataDump", "Padding")
LONGEST, DEEPEST = 2000, 64


def _text(tree: Column, tag: str) -> Column:
    return F.try_variant_get(tree, f"$['{tag}']", "string")


def _first(tree: Column, tags: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(_text(tree, t) != "", _text(tree, t)) for t in tags))


def keywords(tree: Column) -> Column:
    """The words of all keyword tags, a list or one text each, and of a hierarchy `a|b` each level, without repeats."""
    each = lambda t: F.coalesce(F.try_variant_get(tree, f"$['{t}']", "array<string>"), F.array(_text(tree, t)))
    words = F.filter(F.transform(F.flatten(F.array(*map(each, KEYWORDS))), lambda w: F.trim(w)), lambda w: w.isNotNull() & (w != ""))
    levels = F.transform(words, lambda w: F.when(w.contains("|"), F.concat(F.array(w), F.filter(F.transform(F.split(w, r"\|"), lambda p: F.trim(p)), lambda p: p != ""))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(levels))


def canonical(rows: DataFrame, tree: str, now: Column) -> DataFrame:
    """rows with the columns of PRECEDENCE out of a VARIANT of tags, and keywords: taken (plausible until now), taken_utc
    (where the file declares an offset), numbers as numbers, orientation 1 to 8; unknown forms are null."""
    t = F.col(tree)
    first = {k: _first(t, tags) for k, tags in PRECEDENCE.items()}
    number = lambda c: F.regexp_replace(F.trim(c), r"^\++", "").try_cast("double")
    out = rows.withColumns({"_taken": plausible(any_date(first["taken"]), now), "_offset": offset_seconds(F.trim(first["offset"]))})
    out = out.withColumns({k: first[k] for k in ("make", "model", "lens")} | {"capture_id": F.when(F.trim(first["capture_id"]) != "", F.trim(first["capture_id"]))})
    out = out.withColumns({k: number(first[k]).cast("int") for k in ("width", "height")} | {k: number(_text(t, PRECEDENCE[k][0])) for k in ("gps_lat", "gps_lon")})
    at = F.array_position(F.array(*map(F.lit, ORIENTATIONS)), F.coalesce(first["orientation"], F.lit(""))).cast("int")
    out = out.withColumns({"orientation": F.when(at > 0, at), "keywords": keywords(t), "taken": F.col("_taken"), "taken_utc": F.col("_taken") - F.make_dt_interval(secs=F.col("_offset"))})
    return out.drop("_taken", "_offset")


def kept_entries(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """key, namespace, name, value of the tags worth keeping: those of GROUPS, no pictures, LONGEST characters at most."""
    flat = rows.select(key, tree).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(tree).outer())).select(key, F.split_part(F.col("key"), F.lit(":"), F.lit(1)).alias("_group"), F.regexp_extract("key", r"^[^:]*:(.*)$", 1).alias("name"), F.col("value").alias("_value"))
    table = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))
    text = F.coalesce(F.try_variant_get("_value", "$", "string"), F.to_json("_value"))
    out = flat.select(key, F.try_element_at(table, F.col("_group")).alias("namespace"), "name", F.substring(text, 1, LONGEST).alias("value"))
    return out.where(F.col("namespace").isNotNull() & ~F.col("name").isin(*OPAQUE) & ~F.col("value").startswith("(Binary data") & F.col("value").isNotNull())


def flattened(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """key, name, value of a VARIANT tree: names of nested objects are joined by dots, plain items of a list by `; `, and
    what a list nests goes on under the list's name. Nulls say nothing. A round reads one level; levels are staged."""
    spark = rows.sparkSession
    level, out = staged(rows.select(key, F.lit("").alias("name"), F.col(tree).alias("value")), "tree-level"), []
    for _ in range(DEEPEST):
        kind = F.schema_of_variant("value")
        typed = level.where("value IS NOT NULL").withColumn("kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list").otherwise("plain"))
        out.append(typed.where("kind = 'plain'").select(key, "name", F.try_variant_get("value", "$", "string").alias("value")).where("value IS NOT NULL"))
        boxes = staged(typed.where("kind <> 'plain'").withColumn("box", F.monotonically_increasing_id()), "tree-boxes")
        if boxes.isEmpty():
            break
        inner = boxes.withColumnsRenamed({"value": "_tree"}).lateralJoin(spark.tvf.variant_explode(F.col("_tree").outer())).select(key, "name", "box", "kind", "pos", F.col("key").alias("_field") if key != "key" else F.col("key"), "value")
        nested = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
        fields = inner.where("kind = 'object'").select(key, F.concat_ws(".", F.when(F.col("name") != "", F.col("name")), "_field").alias("name"), "value")
        items = inner.where("kind = 'list'")
        said = F.array_sort(F.collect_list(F.struct("pos", F.try_variant_get("value", "$", "string").alias("text"))))
        lists = items.where(~nested).groupBy(key, "name", "box").agg(said.alias("x")).select(key, "name", F.array_join(F.transform("x", lambda p: p["text"]), "; ").alias("value"))
        out.append(lists.where("value <> ''"))
        level = staged(fields.unionByName(items.where(nested).select(key, "name", "value")), "tree-level")
    done = out[0]
    for o in out[1:]:
        done = done.unionByName(o)
    return done

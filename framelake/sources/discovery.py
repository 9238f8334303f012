"""Discovery over listings: which files of a tree are media, by rules that folders hand down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.sources.files import JUNK, MEDIA, extension
from framelake.session import staged

#: Folders of systems and of software, and endings of software's folders.
JUNK_FOLDERS = ("@eadir", ".thumbnails")
CODE_FOLDERS = ("node_modules", "bower_components", "__pycache__", "site-packages", "deriveddata", "pods", "venv", "vendor", "target", "cache", "caches")
CODE_ENDINGS = (".xcassets", ".imageset", ".appiconset", ".colorset", ".dataset", ".xcodeproj", ".xcworkspace", ".playground", ".lproj", ".framework", ".bundle", ".app")


def walked(listing: DataFrame, root: str, ignored: tuple[str, ...] = (), hidden: bool = False, follow_links: bool = False, media: tuple[str, ...] = MEDIA) -> DataFrame:
    """path, error of every media file below root, and of every folder or entry that could not be read (error not null).

    listing: parent, name, kind (file or folder), is_link, target (of links to folders: the folder's path), device, inode
    (of the entry, of its target if it is a link), error (null: readable), one row an entry. The walk goes on one level a
    round: the folders just found are joined with the listing, and a folder that was seen before, by device and inode,
    is not entered again, whatever name it has now; of two names in one round the lesser counts. What a folder's name
    rules out is never listed. Patterns are matched with names and with paths below root; `*` stands for anything.
    """
    rows = listing.withColumn("_low", F.lower("name"))
    outward = [~F.col("name").startswith(".")] if not hidden else []
    outward += [] if follow_links else [~F.coalesce("is_link", F.lit(False))]
    rows = rows.where(reduce(Column.__and__, outward, F.lit(True)))
    code = F.col("_low").isin(*JUNK_FOLDERS, *CODE_FOLDERS) | reduce(Column.__or__, (F.col("_low").endswith(e) for e in CODE_ENDINGS))
    rows = staged(rows.where(~((F.col("kind") == "folder") & code) & ~((F.col("kind") == "file") & F.col("_low").isin(*(j.lower() for j in JUNK)))).drop("_low"), "listing")
    base = root.rstrip("/")
    frontier = staged(listing.sparkSession.createDataFrame([(base, base)], "at string, path string"), "frontier")  # at: where it is listed, path: how it was reached
    seen, out = None, []
    while True:
        found = rows.join(frontier, rows["parent"] == frontier["at"]).select("name", "kind", "target", "is_link", "device", "inode", "error", "at", F.concat("path", F.lit("/"), "name").alias("path"))
        inside = F.substring("path", F.lit(len(base) + 2), F.length("path"))
        for p in ignored:
            like = p.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%").replace("*", "%").replace("?", "_")
            found = found.where(~F.col("name").like(like) & ~inside.like(like))
        found = staged(found, "found")
        out.append(found.where("error IS NOT NULL").select("path", "error"))
        out.append(found.where(F.col("error").isNull() & (F.col("kind") == "file") & F.coalesce(extension(F.col("name")).isin(*media), F.lit(False))).select("path", "error"))
        at = F.coalesce(F.when(F.col("is_link"), F.col("target")), F.concat("at", F.lit("/"), "name"))
        folders = found.where("kind = 'folder' AND error IS NULL").select("device", "inode", F.struct("path", at.alias("at")).alias("x"))
        folders = folders.groupBy("device", "inode").agg(F.min("x").alias("x"))
        if seen is not None:
            folders = folders.join(seen, ["device", "inode"], "left_anti")
        folders = staged(folders.select("device", "inode", "x.*"), "frontier")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, out)
        marks = folders.select("device", "inode")
        seen, frontier = (marks if seen is None else seen.unionByName(marks)), folders.select("at", "path")

"""Imports, tags and discovery on odd rows."""

from pyspark.sql import functions as F

from framelake.operators import imports
from framelake.sources import discovery, external, tags

CATALOG = "path string, folder string, name string, ext string, bytes long, mtime timestamp_ntz, taken_at timestamp_ntz, taken_at_utc timestamp_ntz, make string, model string, gps_lat double, gps_lon double, missing boolean, role string"
FILES = "path string, bytes long, mtime timestamp_ntz, taken_at timestamp_ntz, taken_at_utc timestamp_ntz, make string, model string, gps_lat double, gps_lon double"


def test_import_of_nothing_and_into_nothing(spark):
    now = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    catalog, files, assets = spark.createDataFrame([], CATALOG), spark.createDataFrame([], FILES), spark.createDataFrame([], external.ASSETS)
    assert imports.imported(catalog, files, assets, "x", now).count() == 0
    one = spark.createDataFrame([("id", None, None, None, None, None, None, None, None, None, None, None, None, None, None, True)], external.ASSETS)
    twice = one.unionByName(one)
    (r,) = imports.imported(catalog, files, twice, "x", now).collect()
    assert (r.path, r.name, r.change, r.missing, r.role, r.bytes, r.taken_at_utc) == ("x://id", "x:id", "reference", True, "witness", 0, None)
    assert imports.entries(one, "x").count() == 0


def test_offset_is_borrowed_within_a_second_only(spark):
    rows = [("2024-01-01 10:00:00", None, "2024-01-01 10:00:00.9", "2024-01-01 08:00:00.9", "2024-01-01 08:00:00"), ("2024-01-01 10:00:00", None, "2024-01-01 10:00:01", "2024-01-01 08:00:01", "2024-01-01 10:00:00"), ("2024-01-01 10:00:00", "2024-01-01 07:00:00", "2024-01-01 10:00:00", "2024-01-01 08:00:00", "2024-01-01 07:00:00"), (None, None, None, "2024-01-01 08:00:00", None), (None, "2024-01-01 07:00:00", "2024-01-01 10:00:00", None, "2024-01-01 10:00:00")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fw string, fu string, aw string, au string, want string").select("i", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("fw", "fu", "aw", "au", "want")))
    got = df.select("i", "want", imports.moments(*(F.col(c) for c in ("fw", "fu", "aw", "au")))["taken_at_utc"].alias("utc")).collect()
    assert all(r.utc == r.want for r in got)


def test_trees_of_any_shape(spark):
    texts = ['{"a":[[1,2],[3,[4]]],"b":{"c":[]},"d":""}', "{}", "[]", "7", "null", None, '{"deep":' + '{"x":' * 20 + "1" + "}" * 21]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", F.try_parse_json("t").alias("tree"))
    got = sorted((r.id, r.name, r.value) for r in tags.flattened(df, "id", "tree").collect())
    assert got == [(0, "a", "1; 2"), (0, "a", "3"), (0, "a", "4"), (0, "d", ""), (3, "", "7"), (6, "deep" + ".x" * 20, "1")]
    assert tags.flattened(df.limit(0), "id", "tree").count() == 0


def test_tags_of_odd_forms(spark):
    texts = ['{"EXIF:Make":7,"EXIF:Model":["a"],"Composite:GPSLatitude":"north","XMP:Subject":["a",null," a ","b|c|"],"EXIF:OffsetTime":"+15:00","EXIF:DateTimeOriginal":"2024:01:01 10:00:00","EXIF:Orientation":"sideways"}', "{}", "[1]", None, '{"EXIF:DateTimeOriginal":"","EXIF:CreateDate":"2023-05-06T07:08:09Z","EXIF:OffsetTimeOriginal":"-03:00"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", F.try_parse_json("t").alias("tree"))
    got = {r.id: r for r in tags.canonical(df, "tree", F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))).collect()}
    assert got[0].make == "7" and got[0].gps_lat is None and got[0].keywords == ["a", "b|c|", "b", "c"] and got[0].taken_utc is None and got[0].orientation is None and got[0].taken is not None
    assert all(v is None or v == [] for i in (1, 2, 3) for k, v in got[i].asDict().items() if k not in ("id", "tree"))
    assert (str(got[4].taken), str(got[4].taken_utc)) == ("2023-05-06 07:08:09", "2023-05-06 10:08:09")


LISTING = "parent string, name string, kind string, is_link boolean, target string, device long, inode long, error string"


def test_discovery_follows_links_once(spark):
    rows = [("/r", "a", "folder", False, None, 1, 2, None), ("/r/a", "x.jpg", "file", False, None, 1, 9, None), ("/r/a", "loop", "folder", True, "/r/a", 1, 2, None), ("/r", "b", "folder", True, "/elsewhere", 2, 2, None), ("/elsewhere", "Y.JPG", "file", None, None, 2, 3, None), ("/elsewhere", "Thumbs.db", "file", False, None, 2, 4, None), ("/r", ".h.jpg", "file", False, None, 1, 5, None), ("/r", "noext", "file", False, None, 1, 6, None), ("/r", "cache", "folder", False, None, 1, 7, None), ("/r/cache", "z.jpg", "file", False, None, 1, 8, None)]
    df = spark.createDataFrame(rows, LISTING)
    assert [r.path for r in discovery.walked(df, "/r").collect()] == ["/r/a/x.jpg"]
    assert sorted(r.path for r in discovery.walked(df, "/r/", follow_links=True, hidden=True).collect()) == ["/r/.h.jpg", "/r/a/x.jpg", "/r/b/Y.JPG"]
    assert discovery.walked(df.limit(0), "/r").count() == 0


def test_repointing_is_refused_without_proof(spark):
    import pytest

    from framelake.operators import repointing

    rows = spark.createDataFrame([(1, 1, "/v/a"), (2, 1, "/v/b"), (3, 1, "/w/a"), (4, 2, "/v/a"), (5, 1, "apple://x"), (6, 1, "/vv/a")], "id long, source_id long, path string")
    there = rows.select("path").unionByName(spark.createDataFrame([("/n/a",), ("/n/b",)], "path string"))
    with pytest.raises(repointing.Refused, match="share"):
        repointing.applied(rows, there, 1, "/v", "/w")
    with pytest.raises(repointing.Refused, match="not there"):
        repointing.applied(rows, rows.select("path"), 1, "/v", "/n")
    with pytest.raises(repointing.Refused, match="no path"):
        repointing.applied(rows, there, 3, "/v", "/n")
    moved = repointing.applied(rows, there, 1, "/v/", "/n/")
    assert {r.id: r.path for r in moved.collect()} == {1: "/n/a", 2: "/n/b", 3: "/w/a", 4: "/v/a", 5: "apple://x", 6: "/vv/a"}
    back = repointing.undone(moved, there, {"source_id": 1, "old": "/v/", "new": "/n/"})
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))

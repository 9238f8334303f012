"""Operators on small inputs: boundaries, nulls, ties, empty tables, and sequential twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions.camera import camera_name
from framelake.functions.dates import any_date, date_in_name, offset_seconds
from framelake.functions.geo import reliable_fields, uncertainty_m
from framelake.functions.paths import generic_name, root_of
from framelake.operators import asof, duplicates, filters, graph, ingest, sessions, suggest

T0 = dt.datetime(2024, 5, 1)
ITEMS = "id long, k long, at timestamp_ntz, gps_lat double, gps_lon double, state boolean"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_gap_of_exactly_three_days_stays(spark):
    days = 259_200
    rows = [(1, 1, at(0), None, None, None), (2, 1, at(days), None, None, None), (3, 1, at(2 * days) + dt.timedelta(microseconds=1), None, None, None), (4, 1, None, None, None, None)]
    out = sessions.by_gap(spark.createDataFrame(rows, ITEMS), "k", "at", float(days)).select("id", "session").collect()
    assert {r.id: r.session for r in out} == {1: 0, 2: 0, 3: 1}


def _home_away(states):
    """One item after another: a change counts once the next known item confirms it."""
    known = [(i, s) for i, s in enumerate(states) if s is not None]
    cuts, current = set(), known[0][1] if known else None
    sure = None
    for j, (i, s) in enumerate(known):
        if j + 1 < len(known) and known[j + 1][1] == s:
            if s != (sure if sure is not None else current):
                cuts.add(i)
            sure = s
    out, seg = [], 0
    for i in range(len(states)):
        seg += i in cuts
        out.append(seg)
    return out


def test_home_and_away_against_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        states = [rng.choice([True, False, None]) for _ in range(rng.randint(1, 12))]
        for i, (s, w) in enumerate(zip(states, _home_away(states), strict=True)):
            rows.append((k * 100 + i, k, at(i), None, None, s))
            want[k * 100 + i] = w
    out = sessions.home_away(spark.createDataFrame(rows, ITEMS), "k", "at", "state").select("id", "segment").collect()
    assert {r.id: r.segment for r in out} == want


def test_small_blocks_are_absorbed(spark):
    rows = [(1, 0, 2), (1, 1, 3), (1, 2, 20), (1, 3, 1), (2, 0, 2), (2, 1, 3), (3, 0, 12), (3, 1, 4), (3, 2, 15)]
    out = sessions.absorb_small(spark.createDataFrame(rows, "k long, b long, n long"), "k", "b", "n").collect()
    assert {(r.k, r.b): r.merged for r in out} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 0, (2, 0): 0, (2, 1): 0, (3, 0): 0, (3, 1): 0, (3, 2): 1}


def _nearest(items, window):
    out = {}
    for i, t, o, g in items:
        if g or t is None:
            continue
        best = None
        for j, u, p, h in items:
            if h and u is not None and p != o:
                d = abs((t - u).total_seconds())
                if d <= window:
                    back = u < t
                    key = (d, 0 if back else 1, -j if back else j)
                    best = min(best, (key, j)) if best else (key, j)
        if best:
            out[i] = (best[1], best[0][0])
    return out


def test_nearest_donor_against_a_loop(spark):
    rng = random.Random(11)
    items = [(i, at(rng.randint(0, 900)) if rng.random() > 0.05 else None, rng.choice([1, 2, 3, None]), rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(items, "id long, at timestamp_ntz, origin long, has_gps boolean")
    out = asof.nearest_donor(df, window_s=60.0).collect()
    assert {r.id: (r.donor_id, r.delta_s) for r in out} == _nearest(items, 60.0)
    assert asof.nearest_donor(df.limit(0)).count() == 0


def test_reliable_fields_and_radius(spark):
    df = spark.createDataFrame([(0.0,), (120.0,), (600.0,), (600.5,), (7200.0,), (43_200.0,), (43_201.0,)], "d double")
    out = [([x.field for x in r.f], r.m) for r in df.select(reliable_fields(F.col("d"), F.lit(False)).alias("f"), uncertainty_m(F.col("d")).alias("m")).collect()]
    assert [len(f) for f, _ in out] == [3, 3, 3, 2, 2, 1, 0]
    assert out[0][1] == 15.0 and out[-1][1] == 50_000.0


@pytest.mark.parametrize(("make", "model", "want"), [("Canon", "Canon EOS R6", "Canon EOS R6"), ("Canon", "Canonical 1", "Canon Canonical 1"), (None, "X", "X"), ("Apple", None, "Apple"), (None, None, None), (" ", " ", None), ("SONY", "sony", "sony")])
def test_camera_names(spark, make, model, want):
    df = spark.createDataFrame([(make, model)], "make string, model string")
    assert df.select(camera_name(F.col("make"), F.col("model"))).first()[0] == want


def test_names_dates_and_paths(spark):
    names = {"IMG-20240115-WA0001.jpg": "2024-01-15", "IMG-20241315-WA0001.jpg": None, "Screenshot_2024-03-15-x.png": "2024-03-15", "20240229_1.jpg": "2024-02-29", "120240229.jpg": None, "x.jpg": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] and str(r[1]) for r in df.select("n", date_in_name(F.col("n"))).collect()} == names
    roots = {"/Volumes/photo/a/b": "/Volumes/photo", "/Users/me/x": "/Users/me", "/etc/x": "/", "a/b": "a", "a": "a"}
    df = spark.createDataFrame([(n,) for n in roots], "n string")
    assert {r[0]: r[1] for r in df.select("n", root_of(F.col("n"))).collect()} == roots
    df = spark.createDataFrame([("+02:00",), ("-14:00",), ("+15:00",), ("x",)], "o string")
    assert [r[0] for r in df.select(offset_seconds(F.col("o"))).collect()] == [7200, -50_400, None, None]
    df = spark.createDataFrame([("2024:01:02 03:04:05.12+02:00",), ("2024-01-02",), ("no",), (None,)], "o string")
    assert [r[0] and str(r[0]) for r in df.select(any_date(F.col("o"))).collect()] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None]
    df = spark.createDataFrame([("IMG_12.jpg",), ("77.png",), ("party.jpg",)], "o string")
    assert [r[0] for r in df.select(generic_name(F.col("o"))).collect()] == [True, True, False]


def test_filters_reject_what_they_do_not_know(spark, sf):
    from framelake.sources import catalog

    m = catalog.media(spark, sf)
    with pytest.raises(ValueError):
        filters.filtered(m, filters.MediaFilters(gap="nothing"))
    for bad in ("colour:red", "ext:jpg ext:png", "role:other", "ext:", "confidence:sure", "position:guessed", "confidence:low confidence:high"):
        with pytest.raises(ValueError):
            filters.parse_tokens(bad)
    text = """role:witness ext:jpg camera:"EOS R6" folder:'/a "b" c' sea side"""
    assert filters.parse_tokens(text).folder == '/a "b" c' and filters.parse_tokens(text).reach == "all"
    text += " confidence:low origin:'some where' Position:Measured"
    assert filters.parse_tokens(text).position == "measured"
    assert filters.parse_tokens(filters.serialise_tokens(filters.parse_tokens(text))) == filters.parse_tokens(text)
    both = m.withColumn("inherited_lat", F.when(F.col("id") % 2 == 0, 1.0))
    assert filters.filtered(both, filters.parse_tokens("position:estimated")).count() == both.where("id % 2 = 0").count()


def test_signatures_differ_by_at_most_eight(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(6)]
    for i in range(60):
        x = base[i % 6]
        for b in rng.sample(range(63), rng.randint(0, 10)):
            x ^= 1 << b
        rows.append((100 + i, x))
    first = {}
    for i, x in rows:
        first.setdefault(x, i)
    out = duplicates.near_pairs(spark.createDataFrame([(i, x) for x, i in first.items()], "id long, sig long")).collect()
    want = {(min(a, b), max(a, b)): bin(s ^ t).count("1") for s, a in first.items() for t, b in first.items() if s != t and bin(s ^ t).count("1") <= 8}
    assert {(r.a, r.b): r.distance for r in out} == want


def test_greedy_groups_in_id_order(spark):
    rng = random.Random(6)
    base, rows = [rng.getrandbits(63) for _ in range(8)], []
    for i in range(160):
        x = base[i % 8]
        for b in rng.sample(range(63), rng.choice([0, 1, 3, 4, 5, 6])):
            x ^= 1 << b
        rows.append((i, x))
    rng.shuffle(rows)
    sig, free, want = dict(rows), sorted(i for i, _ in rows), {}
    while free:
        seed = free[0]
        same = [i for i in free[1:] if sig[i] == sig[seed]]
        own = same or [i for i in free[1:] if bin(sig[i] ^ sig[seed]).count("1") <= 8]
        if own:
            want[seed] = {seed, *own}
        free = [i for i in free if i != seed and i not in own]
    out = {}
    for r in duplicates.greedy_groups(spark.createDataFrame(rows, "id long, sig long")).collect():
        assert r.distance == bin(sig[r.seed] ^ sig[r.id]).count("1")
        out.setdefault(r.seed, set()).add(r.id)
    assert out == want and len(want) > 10


def test_copy_plan_keeps_names_and_numbers_collisions(spark):
    from framelake.operators import ranks, suggest

    names = ["IMG_1234.jpg", "IMG_9876.jpg", "a.jpg", "a.jpg", "a (2).jpg", "a.jpg", "a (4).jpg", "a.jpg", ".hidden", ".hidden", "b", "b", "x.jpg", "y.jpg", "a (2).jpg"]
    media = spark.createDataFrame([(i, "/src", n) for i, n in enumerate(names)], "id long, folder string, name string")
    said = spark.createDataFrame([(i, {12: "../up", 13: "x/./ y "}.get(i, "d"), "approved") for i in range(len(names))], "media_id long, destination string, status string")
    out = {r.media_id: (r.target, r.conflict) for r in suggest.copy_plan(said, media).collect()}
    targets = [out[i][0] for i in range(len(names))]
    assert targets == ["d/IMG_1234.jpg", "d/IMG_9876.jpg", "d/a.jpg", "d/a (3).jpg", "d/a (2).jpg", "d/a (5).jpg", "d/a (4).jpg", "d/a (6).jpg", "d/.hidden", "d/.hidden (2)", "d/b", "d/b (2)", "", "x/y/y.jpg", "d/a (2) (2).jpg"]
    assert out[3][1] == "taken; renamed to a (3).jpg" and out[12][1] == "unsafe destination" and out[0][1] is None
    left = suggest.copy_plan(said, media, said.where("media_id < 2"), said.where("media_id = 4"), root="/src/out").collect()
    assert {r.media_id for r in left} == set(range(len(names))) - {0, 1, 4} and all(r.conflict for r in left)
    rows = spark.range(50).select((F.col("id") % 2).alias("g"), "id")
    got = {r.id: r.n for r in ranks.numbered(rows, ["g"], "id", "n", cell_ids=7).collect()}
    assert got == {i: i // 2 + 1 for i in range(50)}


def test_dates_in_folders(spark):
    from framelake.functions import folders

    cases = {
        "Visconde de Maua - Abril 2015": ("Visconde de Maua", "2015-04"), "2025_05_24": ("", "2025-05-24"), "Serena 15 Anos": ("Serena 15 Anos", None), "24.05.2025 Praia": ("Praia", "2025-05-24"),
        "29 de outubro de 2016": ("", "2016-10-29"), "Pantanal Jul.2023": ("Pantanal", "2023-07"), "2015-13": ("13", "2015"), "novembro 30": ("", None), "Mar 85": ("Mar 85", None), "Rio 2016 04": ("Rio 04", "2016"),
        "Viagem novembro 30": ("Viagem novembro 30", None), "Março/2015": ("", "2015-03"), "1750": ("1750", None),
    }
    rows = folders.part_dates(spark.createDataFrame([(k,) for k in cases], "n string"), "n").withColumn("x", F.struct("year", "month", "day"))
    assert {r.n: (r.rest, r.label) for r in rows.select("n", "rest", folders.date_label(F.col("x")).alias("label")).collect()} == cases
    paths = {"/2015/Abril 2015/x": "2015-04", "/2014/Abril 2015": "2015-04", "/Abril 2015/2015": "2015-04", "/a/b": None, "/2015-04-02/2016": "2016"}
    rows = folders.path_dates(spark.createDataFrame([(k,) for k in paths], "p string"), "p")
    assert {r.p: r.d for r in rows.select("p", folders.date_label(F.col("date")).alias("d")).collect()} == paths
    rows = spark.createDataFrame([(999.4, 59.0), (1500.0, 3599.0), (50_000.0, 7200.0), (1000.0, 7260.0)], "m double, s double")
    assert [tuple(r) for r in rows.select(folders.readable_metres(F.col("m")), folders.readable_time(F.col("s"))).collect()] == [("999 m", "59 s"), ("1,5 km", "59 min"), ("50 km", "2 h"), ("1 km", "2 h 1 min")]


def test_nearest_city_meets_across_the_date_line_and_near_poles(spark):
    from framelake.operators import details

    rng = random.Random(8)
    points = [(i, rng.uniform(-89.5, 89.5), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)])) for i in range(120)]
    cities = [(f"c{k}", max(-89.9, min(89.9, points[k % 120][1] + rng.uniform(-1, 1))), (points[k % 120][2] + rng.uniform(-2, 2) + 180) % 360 - 180) for k in range(200)]

    def km(a, b, c, d):
        import math

        p, q, l = math.radians(a), math.radians(c), math.radians(d - b)
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(l / 2) ** 2)))

    want = {}
    for i, lat, lon in points:
        d, c = min((km(lat, lon, y, x), n) for n, y, x in cities)
        if d <= 120:
            want[i] = c
    out = details.nearest_city(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(cities, "city string, city_lat double, city_lon double"), within_km=120.0)
    assert {r.id: r.city for r in out.collect()} == want and len(want) > 60


def test_contracts_of_sources_and_snapshots(spark, tmp_path):
    from framelake.operators import review
    from framelake.sources import scan

    rows = spark.createDataFrame([("u", "/p", "n", at(0), "America/Sao_Paulo", 0.0, 0.0, True, ["a"], None)], "uuid string, original_path string, original_name string, date timestamp_ntz, zone string, lat double, lon double, favorite boolean, albums array<string>, keywords array<string>")
    got = scan.apple_assets(rows)
    assert got.schema.simpleString() == scan.ASSET.simpleString()
    r = got.first()
    assert r.gps_lat is None and (r.taken_at_utc - r.taken_at).total_seconds() == 3 * 3600
    old, new = spark.range(1), spark.range(1).selectExpr("id", "cast(id as string) as s")
    assert review.schema_changes(old.schema, new.schema) == ["s is missing"] and review.schema_changes(new.schema, new.selectExpr("cast(id as int) as id", "s").schema) == ["id was bigint"]
    review.snapshot(old, str(tmp_path), "1")
    with pytest.raises(Exception):
        review.snapshot(old, str(tmp_path), "1")


def test_reconciliation_freezes_and_wraps(spark):
    from framelake.sources import scan

    media = spark.createDataFrame([(i, 1 if i != 6 else 2, "/f", f"n{i}", False, i == 2) for i in range(1, 9)], "id long, source_id long, folder string, name string, missing boolean, offline boolean")
    sources = spark.createDataFrame([(1, True), (2, False)], "source_id long, available boolean")
    here = media.where("id <> 3").select("id")
    changed, next_ = scan.reconciled(media, sources, here, 0, rows=4)
    assert {r.id: r.offline for r in changed.collect()} == {2: False, 3: True} and next_ == 4
    changed, next_ = scan.reconciled(media, sources, here, 4, rows=4)
    assert changed.count() == 0 and next_ == 5
    assert scan.reconciled(media, sources.withColumn("available", F.lit(True)), here, 6, rows=4)[1] == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    nodes = spark.range(110).withColumnRenamed("id", "node")
    out = {r.node: r.label for r in graph.components(nodes, links).collect()}
    assert all(out[i] == 0 for i in range(31)) and out[101] == 100 and out[50] == 50


def test_repeated_paths_and_versions(spark, tmp_path):
    from framelake.streaming import live

    old = spark.createDataFrame([("a", 1, at(0)), ("b", 1, at(0))], "path string, bytes long, mtime timestamp_ntz")
    seen = spark.createDataFrame([("a", 1, at(0)), ("a", 5, at(9)), ("c", 1, at(0)), ("c", 1, at(0))], "path string, bytes long, mtime timestamp_ntz")
    assert sorted((r.path, r.change) for r in ingest.changes(old, seen).collect()) == [("a", "changed"), ("c", "new")]
    assert sorted((r.path, r.bytes) for r in ingest.upserted(old, seen).collect()) == [("a", 5), ("b", 1), ("c", 1)]
    folder = str(tmp_path / "in")
    for k, rows in enumerate([[(1, 10, "x"), (1, 30, "z"), (1, 20, "y"), (2, 5, "only")], [(1, 40, "later")]]):
        frame = spark.createDataFrame(rows, "id long, s long, v string").select("id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v")
        frame.coalesce(1).write.parquet(f"{folder}/batch{k}")
        stream = spark.readStream.schema("id long, ts timestamp_ntz, v string").parquet(f"{folder}/batch{k}")
        query = live.upserts(stream, str(tmp_path / "out"), "id", str(tmp_path / f"ck{k}")).start()
        query.awaitTermination(60)
        if k == 0:
            first = spark.read.parquet(str(tmp_path / "out"))
            assert {(r.id, r.v) for r in live.latest(first, "id").collect()} == {(1, "z"), (2, "only")}


def test_ingest_cases(spark):
    old = spark.createDataFrame([("a", 1, at(0), False), ("b", 1, at(0), False), ("c", 1, None, True), ("x://1", 1, at(0), False)], "path string, bytes long, mtime timestamp_ntz, missing boolean")
    seen = spark.createDataFrame([("a", 1, at(0)), ("b", 2, at(0)), ("c", 1, None), ("d", 1, at(0))], "path string, bytes long, mtime timestamp_ntz")
    assert {r.path: r.change for r in ingest.changes(old, seen).collect()} == {"a": "same", "b": "changed", "c": "same", "d": "new"}
    assert {r.path: r.missing for r in ingest.gone(old, seen.where("path <> 'a'")).collect()} == {"a": True, "b": False, "c": False, "x://1": False}
    assert {r.path: r.missing for r in ingest.gone(old, seen.limit(0), complete=False).collect()} == {"a": False, "b": False, "c": True, "x://1": False}


def test_streamed_sessions(spark, sf, tmp_path):
    from framelake.streaming import live

    stream = live.sessions(live.events(spark, sf))
    q = stream.writeStream.format("memory").queryName("live_sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {"user_id", "start", "end", "n"} == set(spark.table("live_sessions").columns)


def test_weakest_link_of_nothing(spark):
    from framelake.functions.confidence import level_of, weakest

    df = spark.createDataFrame([([],), ([0.9, 0.4],), ([0.8],)], "s array<double>")
    assert [tuple(r) for r in df.select(weakest(F.col("s")), level_of(weakest(F.col("s")))).collect()] == [(0.0, "low"), (0.4, "low"), (0.8, "high")]
    assert suggest.LEVELS == ("low", "medium", "high")


def test_discovery_packages_and_sidecars(spark, tmp_path):
    from framelake.sources import files

    for p in ("a/x.JPG", "a/.hidden.jpg", "b/y.txt", "b/z.mov", ".trash/q.jpg", "a/Thumbs.db", "tmp/w.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"123")
    found = files.discovered(spark, f"file:{tmp_path}", ignored=("*/tmp/*",)).collect()
    assert {r.path.rpartition("/")[2]: r.ext for r in found} == {"x.JPG": "jpg", "z.mov": "mov"}
    roles = {"/p/A.photoslibrary/originals/1.jpg": "own", "/p/A.photoslibrary/resources/1.jpg": "derived", "/p/C.lrdata/originals/1.jpg": "derived", "/p/1.jpg": "own"}
    df = spark.createDataFrame([(p,) for p in roles], "p string")
    assert {r[0]: r[1] for r in df.select("p", files.role_in_package(F.col("p"))).collect()} == roles
    tags = "path string, tags map<string,string>"
    own = spark.createDataFrame([("d/a.jpg", {"EXIF:CreateDate": "2020:01:01 00:00:00", "EXIF:Make": "X"}), ("d/b.jpg", {"EXIF:Make": "Y"}), ("d/b.cr3", {"EXIF:Make": "Y"})], tags)
    side = spark.createDataFrame([("d/a.jpg.xmp", {"XMP:DateTimeOriginal": "2021:02:03 04:05:06"}), ("d/b.xmp", {"XMP:Make": "Z"})], tags)
    out = {r.path: r for r in files.from_tags(files.with_sidecars(own, side)).collect()}
    assert str(out["d/a.jpg"].taken_at) == "2021-02-03 04:05:06" and out["d/a.jpg"].make == "X"
    assert out["d/b.jpg"].tags == {"EXIF:Make": "Y"}
    df = spark.createDataFrame([("Trip|Sea, Sea,  Sun",), ("",)], "k string")
    assert [r[0] for r in df.select(files.keyword_levels(F.col("k"))).collect()] == [["Trip|Sea", "Trip", "Sea", "Sun"], []]
    j = '{"photoTakenTime":{"timestamp":"86400"},"geoData":{"latitude":0.0,"longitude":0.0},"geoDataExif":{"latitude":1.5,"longitude":2.0},"people":[{"name":"P"}]}'
    r = files.takeout(spark.createDataFrame([("x/Photos from 2020/i.json", j), ("x/Sea/i.json", "broken")], "path string, json string")).orderBy("path").collect()
    assert (str(r[0].taken_utc), r[0].gps_lat, r[0].people, r[0].album) == ("1970-01-02 00:00:00", 1.5, ["P"], None) and r[1].album == "Sea"


def test_session_cascade(spark):
    from framelake.operators import classify

    cases = [
        ("Serena 15 Anos", 0, None, None, ("occasion", "Serena 15 Anos")), ("Viagens/Praia", 1, None, None, ("trip", "Praia")), ("Japão/Tóquio", 0, None, None, ("trip", "Japão")),
        ("DCIM", 1, "Brasil", 450.0, ("trip", "Brasil")), ("exports", 5, "França", None, ("trip", "França")), ("DCIM", 0, "Brasil", 3.0, ("neutral", None)), ("DCIM", 6, "Brasil", 2.0, ("neutral", None)),
        ("Casamento de João e Maria", 2, None, None, ("occasion", "Casamento de João e Maria")), ("2025/Natal 2025", 2, None, None, ("occasion", "Natal")), ("Obra da casa", 10, None, None, ("neutral", None)),
        ("Quizomba", 0, None, None, ("occasion", "Quizomba")), ("2025_05_24/[Originals]", 0, None, None, ("neutral", None)), ("DCIM", 21, "Tailândia", 9000.0, ("trip", "Tailândia")),
    ]
    df = spark.createDataFrame([(i, *c[:4], "Praia") for i, c in enumerate(cases)], "id int, folder string, days int, country string, home_km double, period string")
    aliases = spark.createDataFrame([("Japan", "Japão"), ("Japão", "Japão"), ("França", "França")], "alias string, country string")
    got = classify.classified(df, aliases, "id").orderBy("id").collect()
    assert [(r.kind, r.label) for r in got] == [c[4] for c in cases]


def test_templates_drop_and_trim(spark):
    from framelake.functions import templates

    df = spark.createDataFrame([("photo", "2024", None, "Rio", "Rio"), (None, None, "Sea", None, "x/y:z"), (None, None, None, None, None)], "categoria string, ano string, viagem string, pais string, cidade string")
    fields = {c: F.col(c) for c in df.columns}
    assert [r[0] for r in df.select(templates.render(templates.DEFAULT, fields)).collect()] == ["photo/2024/Rio", "Sea/x_y_z", ""]


@pytest.mark.parametrize(("together", "keys"), [(1 << 18, 1), (1 << 18, 2), (16, 2)])
def test_clock_offsets_of_counted_pairs(spark, monkeypatch, together, keys):
    """Counted pairs give the offsets of listed ones: several sources, cameras and unknown ones, files that share both keys,
    and keys that are more frequent than what a task holds at once."""
    from framelake.operators import clocks

    monkeypatch.setattr(clocks, "TOGETHER", together)
    r = random.Random(keys)
    when = lambda: T0 + dt.timedelta(seconds=r.randint(0, 10**5), microseconds=r.choice([0, 1, 500_001]))
    rows = [(i, r.randint(1, 3), r.choice([None, when(), when(), when()]), *r.choice([("A", "a"), ("A", None), (None, "b"), (None, None), ("C", "c")]), r.choice([None, 1.0]), f"q{r.randint(0, 6)}", r.choice([None, "", f"p{r.randint(0, 2)}"])) for i in range(300)]
    rows += [(1000, 1, dt.datetime(1, 1, 1), "far", None, None, "z", None), (1001, 2, dt.datetime(9999, 1, 1), None, None, 1.0, "z", None), (1002, 2, dt.datetime(2024, 1, 1), "alone", None, None, "y", None)]
    media = spark.createDataFrame(rows, "id long, source_id long, taken_at timestamp_ntz, make string, model string, gps_lat double, quick_hash string, perceptual_hash string")
    names = ("quick_hash", "perceptual_hash")[:keys]
    told = lambda df: sorted((str(x.make), str(x.model), x.n, round(x.offset_s, 6), round(x.mad_s, 6), x.kept) for x in df.collect())
    got = told(clocks.offsets(media, *names, most_mad_s=40_000.0))
    assert got == told(asof.clock_offsets(asof.anchors(media, *names), most_mad_s=40_000.0)) and len(got) >= 5
    assert clocks.offsets(media.limit(0), *names).count() == 0


def marked(spark):
    """Spans that touch marks, lie between them, end before they begin, have the same key, and last for days; marks without label or time."""
    r = random.Random(5)
    marks = [(at(r.choice([0, 3600, 86_399, 86_400, 90_000, 200_000, 400_000])), r.choice(["a", "b", None])) for _ in range(60)] + [(None, "a")]
    spans = [(k, at(x), at(y)) for k, x, y in ((1, 0, 0), (1, 3600, 90_000), (2, 3601, 86_398), (3, 90_000, 0), (4, -100_000, 900_000), (5, 86_400, 86_400), (6, 200_000, 400_000), (None, 1, 86_400))] + [(7, None, at(0)), (8, at(0), None)]
    return spans, marks


def test_overlapping_without_listing_marks(spark):
    spans, marks = marked(spark)
    want = {}
    for k, lo, hi in spans:
        for t, label in marks:
            if lo and hi and t and lo <= t <= hi:
                want[k, label] = want.get((k, label), 0) + 1
    found = sessions.overlapping(spark.createDataFrame(spans, "k long, lo timestamp_ntz, hi timestamp_ntz"), spark.createDataFrame(marks, "at timestamp_ntz, label string"), ["k"])
    assert {(x.k, x.label): x.n for x in found.collect()} == want
    assert "taken" not in found.columns and "_day" not in found.columns
    # marks meet counts of spans' ends, not spans: no join has a mark on a side
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


@pytest.mark.parametrize("strips", [1, 3, 512])
def test_distinct_values_between_numbers(spark, strips):
    from framelake.operators import evaluate

    r = random.Random(strips)
    rows = [(i, r.choice(["a", "b", "c", "d", None])) for i in range(1, 60)]
    spans = [(i, a, b) for i, (a, b) in enumerate([(0, 59), (0, 1), (58, 59), (20, 21), *((a, a + r.randint(1, 12)) for a in range(0, 47, 2))])]
    found = evaluate.distinct_between(spark.createDataFrame(rows, "nth long, value string"), spark.createDataFrame(spans, "k long, a long, b long"), "k", strips)
    assert {x.k: x.n for x in found.collect()} == {k: len({v for i, v in rows if a < i <= b} - {None}) for k, a, b in spans}


def test_clusters_do_not_list_files(spark):
    """Spans over several days, with fewer files than names, without a folder or a city, and without a file."""
    from framelake.operators import evaluate

    spans, marks = marked(spark)
    spans = [(str(i), lo, hi) for i, (_, lo, hi) in enumerate(spans)] + [("none", at(10), at(20))]
    media = [(i, t, r, f"n{i}", len(r or "") + i % 3) for i, (t, r) in enumerate(marks)]
    places = [(1, "B"), (2, "A"), (3, None)]
    want = {}
    for k, lo, hi in spans:
        hits = sorted((t, i, f, n, dict(places).get(p)) for i, t, f, n, p in media if lo and hi and t and lo <= t <= hi) if lo and hi else []
        if hits:
            want[k] = (len(hits), len({h[2] for h in hits} - {None}), ",".join(sorted({h[4] for h in hits} - {None})), ",".join(h[3] for h in hits[:8]))
    found = evaluate.clusters(spark.createDataFrame(spans, "span string, lo timestamp_ntz, hi timestamp_ntz"), spark.createDataFrame(media, "id long, taken_at timestamp_ntz, folder string, name string, location_id long"), spark.createDataFrame(places, "location_id long, city string"), "span")
    assert {x.span: (x.n, x.folders, x.cities, x.names) for x in found.collect()} == want and len(want) > 5


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_near_pairs_of_few_and_many_signatures(spark, monkeypatch, few):
    """Eight bits apart in any places, also one in each block but some, whichever blocks signatures meet in."""
    monkeypatch.setattr(duplicates, "FEW", few)
    r = random.Random(9)
    sigs = {r.getrandbits(64) for _ in range(20)}
    for s in list(sigs):
        for n in (1, 7, 8, 9):
            sigs.add(s ^ sum(1 << b for b in r.sample(range(64), n)))
        sigs.add(s ^ sum(1 << min(63, 6 * k + r.randint(0, 5)) for k in r.sample(range(11), 8)))
    rows = [(i, s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sorted(sigs))]
    want = {(i, j, (s ^ t).bit_count()) for i, s in enumerate(sorted(sigs)) for j, t in enumerate(sorted(sigs)) if i < j and (s ^ t).bit_count() <= 8}
    found = duplicates.near_pairs(spark.createDataFrame(rows, "id long, sig long"))
    assert {(x.a, x.b, x.distance) for x in found.collect()} == want and len(want) >= 70

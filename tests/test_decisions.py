"""Duplicate levels, evidence with several voices, and the guards of a plan."""

import random

import xxhash
from pyspark.sql import functions as F

from framelake.functions import image_type, paths, signatures, templates
from framelake.operators import duplicates, suggest


def sequentially(signed, most=8):
    """(seed, id) of the groups, one id after the other."""
    order, seen, out = sorted(signed), set(), set()
    for i, s in order:
        if i in seen:
            continue
        free = [(j, t) for j, t in order if j not in seen and j != i]
        same = [j for j, t in free if t == s]
        taken = same or [j for j, t in free if ((s ^ t) & ((1 << 64) - 1)).bit_count() <= most]
        seen |= {i, *taken}
        if taken:
            out |= {(i, j) for j in (i, *taken)}
    return out


def signed_of(numbers):
    return [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(numbers)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rng, x, chain = random.Random(5), 0, []
    for _ in range(1000):
        chain.append(x)
        for b in rng.sample(range(64), rng.randint(5, 8)):
            x ^= 1 << b
    rows, rounds, staged = signed_of(chain), [], duplicates.staged
    monkeypatch.setattr(duplicates, "staged", lambda df, name, *a: rounds.append(name) or staged(df, name, *a))
    got = {(r.seed, r.id) for r in duplicates.greedy_groups(spark.createDataFrame(rows, "id long, sig long")).collect()}
    assert got == sequentially(rows) and rounds.count("greedy") < 15
    rounds.clear()
    got = {(r.seed, r.id) for r in duplicates.greedy_groups(spark.createDataFrame(rows, "id long, sig long"), block_rows=200).collect()}
    assert got == sequentially(rows) and rounds.count("greedy") < 15


def test_quick_signature_reads_both_ends(spark):
    n = signatures.SAMPLE
    contents = [b"", b"abc", bytes(range(256)) * 1024, b"x" * (2 * n), b"y" * (2 * n + 1), None, b"a" * n + b"b" * n + b"c" * n, b"a" * n + b"d" * n + b"c" * n]
    got = [r.q for r in spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "id long, c binary").select("id", signatures.quick(F.col("c")).alias("q")).orderBy("id").collect()]

    def plain(c):
        h = xxhash.xxh3_64(len(c).to_bytes(8, "little"))
        h.update(c[:n] + (c[-n:] if len(c) > 2 * n else b""))
        return f"xxh3:{h.hexdigest()}"

    assert got == [None if c is None else plain(c) for c in contents] and got[6] == got[7]


def test_files_of_equal_ends_and_other_middles_are_no_exact_duplicates(spark):
    n = signatures.SAMPLE
    files = spark.createDataFrame([(i, b"a" * n + m + b"c" * n) for i, m in enumerate((b"b" * n, b"d" * n, b"b" * n, b""))], "id long, content binary")
    files = files.select("id", F.lit("folder").alias("kind"), F.lit("/a").alias("folder"), F.lit("n.jpg").alias("name"), F.lit("jpg").alias("ext"), F.lit(None).cast("string").alias("make"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("timestamp").alias("taken_at"), F.octet_length("content").cast("long").alias("bytes"), signatures.quick(F.col("content")).alias("quick"), "content", F.lit(None).cast("long").alias("sig"))
    none = spark.createDataFrame([], "id long, richness long")
    assert sorted((r.level, r.seed, r.id, r.role) for r in duplicates.levels(files, none).collect()) == [("exact", 0, 0, "principal"), ("exact", 0, 2, "version")]
    assert duplicates.levels(files, none, files.where("id = 0").select("id")).count() == 0
    assert duplicates.levels(files.limit(0), none).count() == 0


def test_last_evidence_of_a_field_counts(spark):
    found = spark.createDataFrame([(1, "year", "exif", "2020", 0.95, 1), (1, "year", "pasta", "2015", 0.6, 2), (1, "kind", "arquivo", "photo", 0.9, 3), (1, "country", "gps", "Chile", 0.95, 4), (1, "country", "pasta", "Peru", 0.6, 0)], "id long, field string, origin string, value string, score double, nth int")
    (r,) = suggest.suggested(found).collect()
    assert (r.destination, r.score) == ("Chile/2015", 0.6)
    (r,) = suggest.suggested(found.drop("nth")).collect()
    assert (r.destination, r.score) == ("Chile/2020", 0.95)


def test_guards(spark):
    said = [("x<>:/" + "y" * 120, "x___/" + "y" * 80), ("a\\b", "a/b"), ("../x", None), ("a/ .. /b", None), ("~/x", None), ("", None), ("/", None), ("a/./b", "a/b"), ("...", None), ("a/. ./b", None), (" a  b /c.", "a b/c"), ("y" * 79 + ".z", "y" * 79)]
    got = [r.s for r in spark.createDataFrame([(i, p) for i, (p, _) in enumerate(said)], "i int, p string").select("i", paths.safe_relative(F.col("p")).alias("s")).orderBy("i").collect()]
    assert got == [want for _, want in said]
    pairs = [("/a/b", "/a", True), ("/a", "/a", True), ("/ab", "/a", False), ("/a/", "/a/./", True), ("//a//b", "/a/b/c", False), ("/a", "/a/b", False), ("/x", "/", True)]
    got = [r.s for r in spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", paths.inside(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [want for *_, want in pairs]


def test_plan_asks_for_the_source_s_root(spark):
    media = spark.createDataFrame([(1, 1, "/Volumes/A/2024", "a.jpg"), (2, 2, "/Volumes/B", "b.jpg"), (3, None, "/x", "c.jpg")], "id long, source_id long, folder string, name string")
    sources = spark.createDataFrame([(1, "/Volumes/A"), (2, "/Volumes/B")], "source_id long, path string")
    suggestions = spark.createDataFrame([(i, "d", "approved") for i in (1, 2, 3)], "media_id long, destination string, status string")
    plan = suggest.copy_plan(suggestions, media, root="/Volumes/A/out", sources=sources).orderBy("media_id").collect()
    assert [r.conflict for r in plan] == ["destination inside the source", None, None]


def test_templates_say_nothing_twice(spark):
    t = templates.Template(templates.DEFAULT)
    say = lambda **v: t.path({k: x for k, x in v.items()})
    assert say(categoria="Viagens", ano="2025", viagem="Tailândia – Vietnã", pais="TAILANDIA", cidade="Chiang Mai", regiao="Chiang Mai") == "Viagens/2025 - Tailândia – Vietnã/Chiang Mai"
    assert say(ano="2024") == "2024" and say(viagem="x") == "x" and say() == "" and say(pais="New York", cidade="York") == "New York/York"
    assert say(categoria="a/b:c", pais=". dots .") == "a_b_c/dots"
    rows = spark.createDataFrame([(1, "A", None), (2, None, None), (3, "A", None)], "id long, pais string, cidade string")
    got = {r.id: r.destination for r in templates.rendered(rows, "{pais}/{cidade}").collect()}
    assert got == {1: "A", 2: None, 3: "A"}


def test_kind_of_image_by_folder(spark):
    rows = [("P1.jpg", "/a/whatsapp images", False, "received"), ("P1.jpg", "/a/capturas de tela", False, "screen"), ("P1.jpg", "/a/downloads", False, "downloaded"), ("P1.jpg", "/a/downloads", True, "photo"), ("WhatsApp Imagery.jpg", "/a", True, "photo"), ("WhatsApp Image 2024.jpg", "/a", True, "received")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, folder string, camera boolean, want string")
    kind = image_type.image_type(F.col("name"), F.lit("jpg"), F.col("camera"), F.lit(False), folder=F.col("folder"))
    assert all(r.kind == r.want and r.reason for r in df.select("want", kind.alias("x")).select("want", "x.*").collect())


def test_greedy_groups_within_a_column(spark):
    """Near and equal signatures of different fives don't meet, and without the column they do."""
    rows = [(0, 0, 0), (1, 1, 0), (2, 3, 1), (3, 3, 1), (4, 0, 2), (5, 1 << 40, 2), (6, 0, 1)]
    signed = spark.createDataFrame(rows, "id long, sig long, five long")
    got = {(r.seed, r.id, r.distance) for r in duplicates.greedy_groups(signed, within="five").collect()}
    assert got == {(0, 0, 0), (0, 1, 1), (2, 2, 0), (2, 3, 0), (4, 4, 0), (4, 5, 1)}
    assert {(r.seed, r.id) for r in duplicates.greedy_groups(signed).collect()} == {(0, 0), (0, 4), (0, 6), (1, 1), (1, 2), (1, 3), (1, 5)}

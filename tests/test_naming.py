"""Names: spellings, technical and album-like names, lists of countries, shifts, labels."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from framelake.functions import names
from framelake.operators import naming


def test_folding_is_the_compatibility_form(spark):
    texts = ["São Paulo", "Straße", "ﬁlm ½ №", "x²", "東京", " a　", "Áb", "Ⅷ㎏", "𝐀", "", "\t b \x1f", "İI", None]
    want = [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().strip().lower() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", names.folded(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.f for r in rows] == want


@pytest.mark.parametrize(
    ("name", "technical", "tells", "occasion"),
    [
        ("[Originals]", True, True, False), ("2025-05-24", True, False, False), ("Pictures.wrp2", True, True, False), ("Rio.imageset", True, True, False), ("Quizomba", False, True, False),
        ("WhatsApp", False, False, False), ("Fotos do WhatsApp", False, False, False), ("GoPro Album", False, False, False), ("Serena 15 Anos", False, True, True), ("Chá de bebê", False, True, True), ("e-mail", False, False, False),
        ("Nikon Z6", False, False, False), ("ab", False, False, False), ("", False, False, False),
    ],
)
def test_kinds_of_names(spark, name, technical, tells, occasion):
    p = names.folded(F.col("n"))
    r = spark.createDataFrame([(name,)], "n string").select(names.technical(p), names.tells(p), names.occasion(p)).first()
    assert tuple(r) == (technical, tells, occasion)


def test_lists_of_countries(spark):
    aliases = spark.createDataFrame([("Dubai", "Emirados"), ("Tailândia", "Tailândia"), ("Thailand", "Tailândia"), ("Vietnam", "Vietnã"), ("Viet Nam", "Vietnã"), ("Guiné", "Guiné"), ("Guiné-Bissau", "Guiné-Bissau"), ("Peru", "Peru")], "alias string, country string")
    cases = {
        "Dubai, Thai & Viet": ["Emirados", "Tailândia", "Vietnã"], "Serena 15 Anos": [], "Peru": [], "Peru e Tailândia": ["Peru", "Tailândia"], "Peru, PERU": ["Peru"], "Peru, Ma": [],
        "Guiné-Bissau + peru": ["Guiné-Bissau", "Peru"], "Guin & Peru": [], "Peru, festa": [], "Tai, Peru": [], ",": [], None: [],
    }
    rows = names.listed_countries(spark.createDataFrame([(k,) for k in cases], "n string"), "n", aliases).collect()
    assert len(rows) == len(cases) and {r.n: r.listed for r in rows} == cases
    assert names.listed_countries(spark.createDataFrame([], "n string"), "n", aliases).count() == 0


def test_one_session_with_several_folders(spark):
    rows = spark.createDataFrame([(1, "/a/Festa 2020/raw/x/y"), (1, "/Quizomba"), (2, "/Users/maria"), (3, "/home/ana/Lapa"), (4, None), (5, "Lapa/r/s/2020")], "id int, folder string")
    aliases = spark.createDataFrame([("Peru", "Peru")], "alias string, country string")
    got = {r.id: (r.name, r.by_word) for r in naming.event_names(rows, "id", aliases).collect()}
    assert got[1] == ("Festa", True) and got[2] == (None, False) and got[3] == ("Lapa", False) and got[5] == (None, False)


def test_album_of_a_period(spark):
    counts = spark.createDataFrame([(1, "Férias", 9), (1, "Peru 2020", 4), (1, "Lima", 4), (1, "Zenit 12XP à noite", 8), (2, "Family", 3), (3, "Lima", 2), (4, None, 9), (4, "K10", 7)], "id int, album string, photos int")
    media = spark.createDataFrame([("Zenit", "Zenit 12XP"), (None, "K10"), (None, None)], "make string, model string")
    got = {r.id: (r.name, r.photos) for r in naming.chosen_albums(counts, ["id"], naming.camera_keys(media)).collect()}
    assert got == {1: ("Lima", 4), 2: ("Family", 3)}


def test_shifts_at_changes_of_clocks(spark):
    cases = {"2024-03-10 01:59:59": 5.0, "2024-03-10 02:30:00": None, "2024-03-10 03:00:00": 4.0, "2024-11-03 00:59:59": 4.0, "2024-11-03 01:00:00": None, "2024-11-03 01:59:59": None, "2024-11-03 02:00:00": 5.0, "2024-11-02 12:00:00": 4.0}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("at", F.to_timestamp_ntz("t"))
    got = {r.t: (r.verdict, r.hours) for r in naming.date_shifts(rows, ["t"], "at", "America/New_York").collect()}
    assert got == {k: ("ambiguous" if v is None else "shifted", v) for k, v in cases.items()}


def test_labels_tell_sources_apart(spark):
    rows = [(1, None, "/Users/ana"), (2, None, "/users/ana"), (3, None, "/x/b/c"), (4, None, "/y/b/c"), (5, "acervo", "/z"), (6, None, "/"), (7, None, "/q/Users/same"), (8, None, "q/Users/same/")]
    got = {r.source_id: r.label for r in naming.source_labels(spark.createDataFrame(rows, "source_id int, nickname string, path string")).collect()}
    assert got == {1: "Users/ana", 2: "users/ana", 3: "x/b/c", 4: "y/b/c", 5: "acervo", 6: "/", 7: "/q/Users/same", 8: "q/Users/same/"}

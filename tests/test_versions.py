"""Versions with two writers, retention and compaction; roll-ups that are merged."""

import threading

import pytest
from pyspark.sql import functions as F

from framelake.operators import rollups
from framelake.session import table
from framelake.sources import catalog
from framelake.sources.versions import Conflict, Versions


def test_two_writers_lose_nothing(spark, tmp_path):
    folder, failed = f"file://{tmp_path}/store", []

    def write(start):
        try:
            own = Versions(spark, folder)
            for k in range(4):
                own.add(spark.range(start + 10 * k, start + 10 * k + 10))
        except Exception as e:  # noqa: BLE001  the test shows it
            failed.append(e)

    writers = [threading.Thread(target=write, args=(s,)) for s in (0, 1000)]
    [w.start() for w in writers]
    seen = []
    while any(w.is_alive() for w in writers):
        seen.append(Versions(spark, folder).read().count())  # a reader sees whole versions
    [w.join() for w in writers]
    store = Versions(spark, folder)
    assert not failed and store.numbers() == list(range(1, 9)) and all(n % 10 == 0 for n in seen)
    assert sorted(r.id for r in store.read().collect()) == [*range(40), *range(1000, 1040)]
    assert sorted(store.read(n).count() for n in store.numbers()) == [10 * n for n in range(1, 9)]


def test_replace_compact_retain(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0 and store.numbers() == []
    first = store.add(spark.range(5))
    second = store.add(spark.range(5, 8))
    with pytest.raises(Conflict):
        store.replace(spark.range(1), first)
    assert store.replace(spark.range(100, 104), second) == 3 and store.read().count() == 4 and store.read(second).count() == 8
    store.add(spark.range(3))
    assert store.compact() == 5 and len(store.manifest()["parts"]) == 1 and store.read().count() == 7
    with pytest.raises(ValueError, match="id"):
        store.add(spark.range(1).select(F.col("id").cast("string")))
    with pytest.raises(ValueError, match="other is missing"):
        store.restored(5, spark.range(1).select("id", F.lit(1).alias("other")).schema)
    assert store.retain(2, 0.0) == [1, 2, 3] and store.numbers() == [4, 5] and store.read(4).count() == 7 and store.read().count() == 7
    assert len(store._names("data")) == 3  # two parts of version 4, one of version 5
    store.export(f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 7


def test_rollups_of_parts_are_those_of_the_whole(spark, sf):
    m = catalog.media(spark, sf)
    month, facets, sketched = F.date_format("taken_at", "yyyy-MM"), {"ext": F.col("ext"), "make": F.col("make")}, {"name": F.col("name"), "folder": F.col("folder")}
    parts = [rollups.part(m.where(F.col("id") % 3 == k), facets, month, sketched) for k in range(3)]
    twice = rollups.part(m.where("id % 3 = 0"), facets, month, sketched)
    back = rollups.part(m.where("id % 3 = 0"), facets, month, sketched, sign=-1)
    counts, sketches = rollups.merged([c for c, _ in [*parts, twice, back]], [s for _, s in parts])
    whole, _ = rollups.part(m, facets, month, sketched)
    assert sorted(map(str, counts.collect())) == sorted(map(str, whole.collect()))
    for name in sketched:
        exact = m.select(name).distinct().count()
        (r,) = rollups.distinct(sketches).where(F.col("name") == name).collect()
        assert abs(r.estimate - exact) <= max(1, 0.05 * exact)
    assert rollups.facet(counts, "ext").count() == 5
    none = rollups.merged([counts.limit(0)], [sketches.limit(0)])
    assert none[0].count() == 0 and rollups.distinct(none[1]).count() == 0 and table(spark, sf, "events").count() == m.count()

"""Outside catalogs, verified copies."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framelake.session import staged
from framelake.sources import copies, external


def export(spark, rows, kinds):
    return staged(spark.createDataFrame(rows, kinds), "export").inputFiles()[0].rsplit("/", 1)[0]


def test_catalog_of_few_columns_and_odd_rows(spark):
    path = export(spark, [("a", None, 1.0, None), (None, "/x/b", 0.0, 0.0), (None, None, 1.0, 1.0), ("", " ", 2.0, 2.0), ("c", "/x/c", 3.0, -4.0)], "external_id string, path string, gps_lat double, gps_lon double")
    got = {(r.external_id, r.path): r for r in external.catalog(spark, path).collect()}
    assert set(got) == {("a", None), (None, "/x/b"), ("c", "/x/c")}
    assert got["a", None].is_reference and got["a", None].gps_lat is None and got[None, "/x/b"].gps_lat is None and got["c", "/x/c"].gps_lon == -4.0
    assert got["a", None].albums == [] and got["a", None].favourite is False and got["a", None].taken_at is None
    empty = export(spark, [], "external_id string, path string")
    assert external.catalog(spark, empty).count() == 0


def test_catalog_rows_of_later_batches():
    """Arrow reads a row group in batches; all but the first begin inside the column's buffers."""
    import pyarrow as pa

    n = 1000
    text = lambda c, k: [None if i % k == 3 else " " if i % k == 4 else f"{c}{i}" for i in range(n)]
    zone = pa.array([None if i % 3 == 0 else i for i in range(n)], pa.int32())
    rows = pa.record_batch({"external_id": text("A", 9), "path": text("/p", 8), "title": text("t", 5), "moment": pa.array(range(n), pa.timestamp("us")), "zone_seconds": zone, "gps_lat": [None if i % 4 == 0 else 1.0 * i for i in range(n)], "gps_lon": [2.0] * n, "albums": [["a", "a", f"b{i}"] for i in range(n)]})
    whole = external.assets(rows).to_pylist()
    parts = [r for a, b in ((0, 131), (131, 512), (512, n)) for r in external.assets(rows.slice(a, b - a)).to_pylist()]
    assert parts == whole and len(whole) == sum(1 for i in range(n) if i % 9 not in (3, 4) or i % 8 not in (3, 4))


def test_catalog_as_a_stream_reads_each_file_once(spark, tmp_path):
    external.register(spark)
    folder = tmp_path / "export"
    df = spark.range(10).select(F.col("id").cast("string").alias("external_id"))
    df.coalesce(1).write.parquet(str(folder))

    def run():
        q = spark.readStream.format(external.FORMAT).option("path", str(folder)).load().select("external_id").writeStream.format("parquet")
        q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(int(r.external_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(10)) == run()
    (file,) = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    spark.range(10, 14).select(F.col("id").cast("string").alias("external_id")).coalesce(1).write.parquet(str(tmp_path / "more"))
    (more,) = [f for f in os.listdir(tmp_path / "more") if f.endswith(".parquet")]
    os.replace(tmp_path / "more" / more, folder / f"z-{file}")
    assert run() == list(range(14))


PLAN = [Row(media_id=i, target=f"a/{i}", conflict=None, content=f"text {i}".encode()) for i in range(6)]


def audit_of(spark, root):
    return sorted((r.media_id, r.result) for r in copies.audit(spark, root, "p").where("action LIKE '%copy'").collect())


def test_retry_of_a_lost_task_gives_the_same_audit(spark, tmp_path):
    root = str(tmp_path)

    def lost():
        yield from PLAN[:4]
        raise RuntimeError("executor lost")

    writer = copies.Copies(root, "p")
    with pytest.raises(RuntimeError):
        writer.write(lost())
    again = writer.write(iter(PLAN))
    twice = writer.write(iter(PLAN))  # a speculative attempt, not committed
    writer.commit([again])
    assert twice.copied == again.copied == 6
    assert audit_of(spark, root) == [(i, "ok") for i in range(6)]
    assert (tmp_path / "a/3").read_bytes() == b"text 3" and os.listdir(tmp_path / ".copies") == ["audit"]


def test_abort_leaves_nothing_and_takes_nothing_away(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/2").write_bytes(b"mine")
    writer = copies.Copies(str(tmp_path), "p")
    done = writer.write(iter(PLAN))
    assert (done.copied, done.failed) == (5, 1)
    writer.abort([done])
    assert sorted(os.listdir(tmp_path / "a")) == ["2"] and (tmp_path / "a/2").read_bytes() == b"mine" and not os.listdir(tmp_path / ".copies")


def test_failed_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    plan = spark.createDataFrame(PLAN, copies.PLAN).repartition(3)
    with pytest.raises(PermissionError):
        copies.copied(plan, root, "p")
    about = plan.select("*", F.octet_length("content").alias("bytes"), F.lit(True).alias("there"))
    copies.dry_run(about, plan.limit(0), root, "p")
    bad = plan.withColumn("content", F.when(F.col("media_id") == 5, F.raise_error(F.lit("unreadable")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="unreadable|Writing"):
        copies.copied(bad, root, "p")
    assert not os.path.exists(tmp_path / "a") or not os.listdir(tmp_path / "a")
    copies.copied(plan, root, "p")
    assert audit_of(spark, root) == [(i, "ok") for i in range(6)] and sorted(os.listdir(tmp_path / "a")) == list("012345")
    copies.dry_run(about.withColumn("there", F.lit(False)), plan.limit(0), root, "p")
    with pytest.raises(PermissionError):
        copies.copied(plan, root, "p")


def test_targets_stay_inside(spark, tmp_path):
    rows = [Row(media_id=1, target="../out", conflict=None, content=b"x"), Row(media_id=2, target=".copies/p/x", conflict=None, content=b"x"), Row(media_id=3, target=None, conflict="why", content=b"x"), Row(media_id=4, target="ok", conflict=None, content=None), Row(media_id=5, target="same", conflict=None, content=b"1"), Row(media_id=6, target="same", conflict=None, content=b"2")]
    writer = copies.Copies(str(tmp_path / "root"), "p")
    writer.commit([writer.write(iter(rows))])
    assert [r for _, r in audit_of(spark, str(tmp_path / "root"))] == ["error: target outside the root", "error: target outside the root", "error: why", "error: source out of reach", "ok", "refused: target exists"]
    assert not (tmp_path / "out").exists()

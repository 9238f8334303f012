"""Inheritance as a stream against the batch operator."""

import random

from pyspark.sql import functions as F

from framelake.operators import asof
from framelake.streaming import inheritance

KINDS = "id long, at timestamp_ntz, origin string, has_gps boolean"


def test_late_donors_and_restarts_end_as_the_batch_does(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(0, 400_000), rng.choice(["a", "b", "c", None]), rng.random() < 0.4) for i in range(400)]
    rows += [(400 + i, 50_000, o, g) for i, (o, g) in enumerate([("a", True), ("b", True), ("a", False), (None, False), (None, True), ("b", False)])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, s long, origin string, has_gps boolean").select("id", (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=F.col("s"))).alias("at"), "origin", "has_gps")
    df = df.unionByName(spark.createDataFrame([(999, None, "a", False)], KINDS))
    want = {(r.id, r.donor_id, r.delta_s) for r in asof.nearest_donor(df).collect()}
    folder, before = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", inheritance.STATE_STORE)
    try:
        for part in range(3):  # each part is another start of the stream
            df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(df.schema).parquet(folder)
            q = inheritance.inherited(stream, "30 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            q = q.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out"))).start()
            q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.id, r.donor_id, r.delta_s) for r in inheritance.latest(told).collect()}
    assert got == want and told.count() > len(want)  # some were revised
